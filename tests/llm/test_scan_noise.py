"""The lattice reads confusions, splits, merges and hyphens together, exactly and at any length; pages count ids once."""

import random
import time

import pytest

from leafwright.llm import scan_noise as S

COUNT = {"the": 900, "archive": 60, "keeps": 80, "all": 300, "pages": 90, "documents": 70, "volumes": 50, "volume": 20, "and": 700, "in": 400, "order": 80, "well": 60, "known": 70, "two": 50, "column": 60, "over": 50, "lapping": 3, "overlapping": 30}
WORDS = S.Words(COUNT, {"well-known": 30, "two-column": 20}, 5000)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("thearchive keeps all pages", "the archive keeps all pages"),
        ("the arch ive keeps all docu ments", "the archive keeps all documents"),
        ("the vo1-\numes keep", "the volumes keep"),
        ("all vol-\num3s in order", "all volumes in order"),
        ("thearch1ve keeps all", "the archive keeps all"),
        ("the arch 1ve keeps", "the archive keeps"),
        ("a well-\nknown order", "a well-known order"),
        ("the over¬ lap¬ ping pages", "the overlapping pages"),
        ("The Arch1ve keeps ALL PA6ES", "The Archive keeps ALL PA6ES"),
    ],
)
def test_all_kinds_are_read_together(text, want):
    assert S.repaired(text, WORDS) == [want]


def test_places_tell_hyphens_from_misread_characters():
    (p,) = S.places("the vo1-\numes and all", WORDS)
    assert p.reading == "volumes" and p.wrong == 6 and p.hyphens == (7,)
    (p,) = S.places("the vol-\numes and all", WORDS)
    assert p.wrong == -1 and p.hyphens == (7,)
    assert S.places("the pages|in order|n/a|5,271|", WORDS) == []
    assert S.places("", WORDS) == [] and S.places(" \n-\n ", WORDS) == []


def exhaustive(words, token):
    """Every reading through at most three confusions."""
    best = (words.cost(token), token)
    if best[0] <= 5.0 or len(token) < 2:
        return best
    stack = [(0, "", 0, 0.0)]
    while stack:
        i, out, used, pay = stack.pop()
        if i == len(token):
            n = words.count.get(out, 0) if used and len(out) > 1 else 0
            if n:
                c = S.math.log(words.total / n) + pay + (2.0 if len(out) < 4 else 0.0)
                best = min(best, (c, out), key=lambda x: x[0])
            continue
        stack.append((i + 1, out + token[i], used, pay))
        for seen, reals in S.CONFUSIONS.items() if used < 3 else ():
            if token.startswith(seen, i):
                stack += [(i + len(seen), out + real, used + 1, pay + (S._LETTER if seen.isalpha() else S._SYMBOL)) for real in reals.split()]
    return best


def test_reading_is_exact():
    rng = random.Random(7)
    for _ in range(3000):
        t = list(rng.choice(list(COUNT)))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("01!|+cebhtfvm6lirn")
        t = "".join(t)
        a, b = WORDS.read(t), exhaustive(WORDS, t)
        assert abs(a[0] - b[0]) < 1e-9, (t, a, b)


def test_what_is_remembered_changes_nothing():
    rng = random.Random(8)
    pieces = [*COUNT, "arch1ve", "thearchive", "docu", "ments", "(pages)", "B3-7", "12", "vo1-", "12|34", "档案"]
    for _ in range(400):
        t = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        fresh = S.Words(COUNT, {"well-known": 30, "two-column": 20}, 5000)
        assert S.places(t, WORDS, fully=True) == S.places(t, fresh, fully=True)


def test_long_tokens_are_read_and_end():
    word = "overlapping" * 12
    words = S.Words({word: 50, "the": 900}, {}, 5000)
    assert words.read("0" + word[1:])[1] == word
    began = time.time()
    WORDS.read("1il!|0" * 500)
    WORDS.split("1il!|0" * 300)
    S.places("l1-\n" * 2000, WORDS)
    assert time.time() - began < 30


def test_many_equal_lines():
    for n in (2000, 2001):
        assert len(S.repaired("\n".join(["the archive keeps all pages and"] * n), WORDS)) == 1


ELEMENT = "elem_id bigint, doc_id bigint, page_index int, reading_order int, element_type string, label string, y0 float, y1 float, canonical string, keys string"


def test_repeated_rows_and_rows_without_a_page(spark):
    """Repeated rows take no place on the page; elements without a page are no page together."""
    foot = (4, 7, 0, 9, "text", "footer", 2250.0, 2270.0, "Archive of pages", "x")
    rows = [(i, 7, 0, i, "text", None, 300.0 + 300 * i, 500.0 + 300 * i, "the archive keeps all pages.", "x") for i in range(4)] + [foot] * 6
    rows += [(10, 8, 0, 0, "text", None, 100.0, 130.0, "Archive of order", "x")] * 3  # alone on its page, so no header
    rows += [(20 + i, None, 0, 0, "text", None, 100.0 + i, 130.0, "Archive of order", "x") for i in range(3)] + [(30, None, None, None, None, None, None, None, None, None)]
    got = {r.elem_id: r for r in S.element_flags(spark.createDataFrame(rows, ELEMENT), WORDS).collect()}
    assert len(got) == 10 and got[4].furniture == "footer"
    assert got[10].furniture is None and all(got[20 + i].furniture is None for i in range(3))
