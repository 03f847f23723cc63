import numpy as np

from leafwright.llm import mixing

DOC = "doc_id bigint, text string, lang string, fmt string, source string, n_tokens bigint, rate string"


def corpus(n=900):
    rows = []
    for i in range(n):
        s = "abc"[i % 3] if i % 10 else None
        word = {"a": "apple pear", "b": "bolt nut", "c": "cloud rain", None: "apple pear"}[s]
        rows.append((i, f"{word} {i % 7}", "en", "md", s, 20 + i * 37 % 90, "clash"))
    return rows


def test_targets_are_reached(spark):
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("gone", 0.1, 1)]
    got = mixing.mix(spark.createDataFrame(corpus(), DOC), targets).toPandas()
    assert len(got) == 900 and got.doc_id.is_unique
    used = (got.copies * got.n_tokens).groupby(got.source.fillna(got.member_of)).sum()
    share = used / used.sum()
    for s, p in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(share[s] - p) < 0.02
    for s, _p, most in targets:
        assert got[got.source == s].copies.max() <= most or s == "gone"
    assert set(got[got.source.isna()].member_of) == {"a"}


def test_edges(spark):
    rows = [(1, None, None, None, "a", None, None), (2, "", None, None, "b", 0, None), (3, "x", None, None, None, 5, None)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, DOC), [("a", 1.0, 1), (None, 0.5, 2), ("b", None, 1)]).collect()}
    assert set(got) == {1, 2, 3}
    assert mixing.mix(spark.createDataFrame([], DOC), [("a", 1.0, 1)]).count() == 0
    unlabelled = mixing.mix(spark.createDataFrame([(1, "x", None, None, None, 5, None)], DOC), [("a", 1.0, 1)]).collect()
    assert [(r.doc_id, r.copies) for r in unlabelled] == [(1, 0)]


def test_whole_copies_come_to_the_rate():
    sizes = np.sort(np.random.default_rng(0).integers(1, 500, 200))
    for rate in (0.0, 0.3, 1.0, 1.7, 2.99):
        c = mixing.whole_copies(sizes, rate)
        assert abs((c * sizes).sum() - rate * sizes.sum()) <= sizes.max() / 2 and set(c) <= {int(rate), int(rate) + 1}
