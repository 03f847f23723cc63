"""Residue: hints follow from the patterns, shortcuts change nothing, evidence finds what no list knows."""

import random
import re

import pytest

from leafwright.llm import residue as R

EXAMPLES = {
    R.STATUS: ["HTTP 404", "Error: 500", "403 Forbidden", "Bad Gateway", '"error": "no"', '"status": 404', "Warning: x", "Traceback (most recent call last)", 'File "a.py", line 3', "ValueError: x", "Exception in thread", "failed to open stream", "20 bytes exhausted"],
    R.STOCK_ERROR: ["Java Script", "scripts are blocked", "Script is disabled", "allow them", "The page you want was not found", "access is denied", "timed out", "scripts siano", "est necesario que scripts están", "não foi encontrad", "не найден", "脚本", "スクリプト"],
    R.STOCK: ["Platzhaltertext", "faux texte", "your text here", "здесь будет текст", "占位文本"],
}


@pytest.mark.parametrize("pattern", EXAMPLES)
def test_every_alternative_has_a_hint(pattern):
    hints = R.hints_of(pattern)
    for t in EXAMPLES[pattern]:
        m = pattern.search(t)
        assert m is None or any(h in R.lowered(t) for h in hints), t
    for alternative in pattern.pattern.split("|"):
        plain = re.sub(r"\\.|[^\w ]", "", alternative)
        if plain and (m := pattern.search(plain)):
            assert any(h in R.lowered(m.group()) for h in hints), plain


def test_a_pattern_without_a_literal_is_refused():
    with pytest.raises(ValueError):
        R.hints_of(re.compile(r"abc|\d+"))


def words(rng):
    pool = "Blick auf den Hafen Gut script error 404 not found Lorem ipsum dolor {{name}} „zitiert“ [insert date] at x.y(Z.java:3) # | `code` 。！ 文字 スクリプト \n . ! ? \n\n undefined Warning: try again placeholder text".split(" ")
    return " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))


def test_shortcuts_change_nothing():
    rng = random.Random(5)
    slow = re.compile(r"(?<=[.!?])\s+(?=[^\s\d])|(?<=[。！？])\s*|\n+")
    for _ in range(4000):
        t = words(rng)
        assert bool(any(R.FIELD.match(t, m.start()) for m in R._MARK.finditer(t))) == bool(R.FIELD.search(t))
        assert R.has_code(t) == bool(re.search(r"(?:^|\s)#{0,3}\s*[45]\d\d\b", t)), t
        plain = [s.strip() for s in slow.split(t) if s.strip()]
        assert [x for s in R.sentences_of(t) for x in s.split()] == [x for s in plain for x in s.split()], t
        assert bool(R.STATUS.search(t) or R.STOCK_ERROR.search(t)) <= R.hinted("message", R.lowered(t))
        lower = R.lowered(t)
        p = t.replace("\n", " ")
        assert R.is_filler(p, R.hinted("stock", lower), R.hinted("latin", lower)) == R.is_filler(p), p
        if len(p) > 40 and not R.DIGIT.search(p) and not R.RULE.search(p):
            g = {p[i : i + 5] for i in range(len(p) - 4)}
            assert R._is_repetition(p) or len(g) >= 0.4 * (len(p) - 4)


@pytest.mark.parametrize("text", ["Script is disabled in this browser.", "This script is blocked in your browser.", "404 Not Found\nThe requested page could not be found. " * 40])
def test_messages_are_bare(text):
    bare, said = R.responses(text, False, None)
    assert bare and any(s[3] for s in said)


@pytest.mark.parametrize("text", ["Blick auf den Hafen mit vielen bunten Schiffen. Gut. Gut. Gut. Gut. Gut. Gut.", "Hier steht Platzhaltertext. Platzhaltertext."])
def test_filler(text):
    assert R.is_filler(text)


COLUMNS = "doc_id bigint, source string, title string, text string, extra string"


def test_evidence_alone_finds_an_unknown_notice(spark):
    notice = "Xilo varan tessu mopi kelanda."
    rows = [(i, f"s{i % 4}", f"title {i}", notice, None) for i in range(8)]
    rows += [(20 + i, f"s{i % 4}", f"title {i}", "The harbour keeps its records in the tower.", None) for i in range(3)]  # a note that longer texts hold too
    rows += [(30 + i, f"s{i % 4}", f"title {i}", "The harbour keeps its records in the tower. " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for k in range(60)) + ".", None) for i in range(9)]
    rows += [(40 + i, "s1", f"title {i}", "A note of one source only.", None) for i in range(6)]
    rows += [(50, None, None, None, None), (51, "s1", None, "", None), (None, "s1", None, notice, None), (0, "s0", "title 0", notice, None)]
    found = sorted(r.doc_id for r in R.find(spark.createDataFrame(rows, COLUMNS)).collect())
    assert found == list(range(8))


def test_an_empty_table_gives_no_rows(spark):
    assert R.find(spark.createDataFrame([], COLUMNS)).collect() == []
