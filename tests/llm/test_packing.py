import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwright.llm import packing

ITEM = "doc_id bigint, n_tokens bigint, piece string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.integers(60, 90))
def test_plan_fills_no_container_beyond_its_capacity(counts, capacity):
    runs, used = packing.plan(counts, capacity)
    load, large, seen = {}, {}, {}
    for size, rank, n, first in runs:
        for k in range(n):
            load[first + k] = load.get(first + k, 0) + size
            large[first + k] = large.get(first + k, 0) + (3 * size > capacity)
            assert seen.setdefault(size, set()).isdisjoint({rank + k})
            seen[size].add(rank + k)
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(used))
    assert max(large.values(), default=0) <= 2
    assert {s: len(r) for s, r in seen.items()} == {s: n for s, n in counts.items() if n}
    assert used <= 2 * sum(s * n for s, n in counts.items()) / capacity + 1


def test_pack(spark):
    rows = [(i, n, "clash") for i, n in enumerate([5, 5, 5, 6, 4, 3, 3, 25, 10, 0, None, -2])] + [(None, 2, "x"), (0, 5, "again")]
    got = packing.pack(spark.createDataFrame(rows, ITEM).select("doc_id", "n_tokens"), [("ten", 10), ("none", 0), ("huge", 1000)]).toPandas()
    ten = got[got.spec_name == "ten"]
    assert set(got.spec_name) == {"ten", "huge"}
    assert ten.groupby("container_id").tokens.sum().max() <= 10
    assert sorted(ten[ten.doc_id == 7].tokens) == [5, 10, 10] and set(ten[ten.doc_id == 7].pieces) == {3}
    assert len(got[got.spec_name == "huge"]) == len(rows) and got[got.spec_name == "huge"].container_id.nunique() == 1
    whole = ten[ten.doc_id != 7].groupby(ten.doc_id.fillna(-1)).pieces.max()
    assert (whole == 1).all()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), [("a", 5)]).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 2)], "doc_id bigint, n_tokens bigint"), []).count() == 0
