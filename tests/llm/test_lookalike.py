"""One form: canonical equivalence, transitive classes over strings, blocks of pairs."""

import random
import unicodedata

from leafwright.llm import lookalike

POOL = "aeioucAEOскорАЕО ậệếàçñёйїǘΰᾳ가힣ｶﾞﬁﬀ" + "ậéо́̈­​-‐  \n.Ⅳⅳ口ロ二ニガ⽉"


def frequency(text, **more):
    out = {}
    for c in unicodedata.normalize("NFD", text):
        out[c] = out.get(c, 0) + 1
    return out | more


def test_equivalent_texts_get_one_form():
    rng = random.Random(3)
    for favourite in ("a", "а", "е" * 9 + "о" * 9, "ﬁ" * 20):
        f = lookalike.Rewriter(lookalike.rewrites(frequency(POOL * 3 + favourite * 50)))
        for _ in range(2500):
            t = "".join(rng.choice(POOL) for _ in range(rng.randint(1, 12)))
            a, b = f(unicodedata.normalize("NFC", t)), f(unicodedata.normalize("NFD", t))
            assert a == b == f(t), (t, a, b)
            assert unicodedata.is_normalized("NFC", a)


def test_classes_hold_strings_and_code_points():
    for favourite in ({"ﬁ": 90}, {"fi": 90}, {"ⅳ": 90}, {"і": 900}):
        f = lookalike.Rewriter(lookalike.rewrites(frequency("ﬁﬀﬃⅳⅠ file office iv I", **favourite)))
        for group in (("ﬁle", "file", "fіle"), ("oﬃce", "office", "oﬀice", "offiсe"), ("ⅳ", "iv", "іv"), ("Ⅰ", "I", "І")):
            assert len({f(x) for x in group}) == 1, (favourite, group, [f(x) for x in group])


def test_frequency_decides_between_a_string_and_a_code_point():
    rare, usual = lookalike.rewrites(frequency("ﬁ", fi=5)), lookalike.rewrites(frequency("ﬁ" * 9, fi=5))
    assert lookalike.Rewriter(rare)("ﬁ") == "fi" and lookalike.Rewriter(usual)("fi") == "ﬁ"


def test_strings_are_counted(spark):
    df = spark.createDataFrame([("file ﬁle fi",), (None,), ("",), ("é ﬁx",)], "text string")
    n = lookalike.code_points(df)
    assert n["fi"] == 2 and n["ﬁ"] == 2 and n["́"] == 1 and "\0" not in n


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 4)
    rows = [(i, 1, "Title" if i % 2 else "Тitle") for i in range(25)] + [(30, 1, "Other"), (31, 2, "Title")]
    df = spark.createDataFrame(rows, "row_id bigint, doc_id bigint, text string")
    c = lookalike.canonical_texts(df, lookalike.rewrites(lookalike.code_points(df)))
    got = sorted(tuple(r) for r in lookalike.same_look_pairs(c, "doc_id", "row_id").collect())
    assert got == [(a, b) for a in range(25) for b in range(a + 1, 25) if (a + b) % 2]
