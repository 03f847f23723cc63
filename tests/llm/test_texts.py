import pytest
from pyspark.sql import functions as F

from leafwright.llm import language, lookalike, prose, residue, scan_noise
from leafwright.llm.prose_holdout import HOLDOUT

ROW = "row_id bigint, doc_id bigint, text string, canonical_extra string"


def rewriter(*texts):
    import unicodedata

    freq = {}
    for c in unicodedata.normalize("NFD", "".join(texts) + "etaoin shrdlu" * 50):
        freq[c] = freq.get(c, 0) + 1
    return lookalike.Rewriter(lookalike.rewrites(freq))


SAME = [("Ｗｉｄｅ １２", "Wide 12"), ("été", "été"), ("ﬁle", "file"), ("a​b﻿c", "abc"), ("a b　c", "a b c"), ("two‑part", "two-part"), ("cut­\nhere", "cut-\nhere"), ("mid­dle", "middle"), ("Аbс", "Abc"), ("Νοw", "Now"), ("⾯积", "面积"), ("ｶﾞｲﾄﾞ", "ガイド"), ("하", "하"), ("a\r\nb", "a\nb"), ("end­", "end-")]
OTHER = [("Case", "case"), ("naive", "naïve"), ("a b", "ab"), ("a\nb", "a b"), ("0il", "oil"), ("x2", "x²"), ("a-b", "a–b"), ("rn", "m")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    f = rewriter(a, b)
    assert f(a) == f(b) and f(f(a)) == f(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    f = rewriter(a, b)
    assert f(a) != f(b)


def test_words_keep_one_script():
    f = rewriter("Новый сервер", "server")
    assert f("Hoвый cepвep") == "Новый сервер" and f("sеrvеr") == "server"


def test_pairs(spark):
    rows = [(1, 1, "Title", "x"), (2, 1, "Тitle", "x"), (3, 1, "Title", "x"), (4, 2, "Тitle", "x"), (5, None, "Тitle", "x"), (6, 1, None, "x"), (7, 1, "", "x"), (8, 1, "​", "x"), (2, 1, "Тitle", "x"), (9, 1, "Ｔitle" * 3000, "x"), (10, 1, "Title" * 3000, "x")]
    df = spark.createDataFrame(rows, ROW)
    c = lookalike.canonical_texts(df, lookalike.rewrites(lookalike.code_points(df)))
    got = sorted(tuple(r) for r in lookalike.same_look_pairs(c, "doc_id", "row_id").collect())
    assert got == [(1, 2), (2, 3), (9, 10)]
    assert lookalike.same_look_pairs(c.limit(0), "doc_id", "row_id").count() == 0


def test_trees_on_the_holdout():
    x = prose._matrix(__import__("pandas").Series([t for t, _ in HOLDOUT]))
    import numpy as np

    y = np.array([int(k) for _, k in HOLDOUT])
    odd = np.arange(len(y)) % 2 == 1
    model = prose.Trees(rounds=20, depth=3).fit(x[odd], y[odd]).calibrate(x[odd], y[odd])
    assert ((model.probability(x[~odd]) >= 0.5) == y[~odd]).mean() >= 0.85


def test_statistics_edges():
    for t in (None, "", " \n", "x", "。" * 50, "word " * 20_000):
        assert len(prose.statistics(t)) == len(prose.NAMES)


def test_prose_over_a_table(spark):
    rows = [(i, t, "list" if not k and i % 2 else "text") for i, (t, k) in enumerate(HOLDOUT)] + [(900, None, None), (901, "", "text")]
    df = spark.createDataFrame(rows, "elem_id bigint, canonical string, element_type string").withColumn("n_words", F.lit(1).cast("string"))
    model = prose.train(df)
    got = {r.elem_id: r.is_prose for r in prose.score(df.drop("n_words"), model, ["elem_id"]).collect()}
    assert not got[900] and not got[901]
    assert sum(got[i] == k for i, (_t, k) in enumerate(HOLDOUT)) >= 0.9 * len(HOLDOUT)


TEXTS = {
    "en": "The clerk opens the letter and reads it to the council. Nobody in the room answers before the clock strikes nine.",
    "de": "Der Schreiber öffnet den Brief und liest ihn dem Rat vor. Niemand im Saal antwortet, bevor die Uhr neun schlägt.",
    "ru": "Секретарь открывает письмо и читает его совету. Никто в зале не отвечает, пока часы не пробьют девять.",
    "zh": "书记打开信件，读给委员会听。在钟敲九下之前，房间里没有人回答。",
    "ja": "書記は手紙を開いて委員会に読み上げます。時計が九時を打つまで誰も答えません。",
}


def test_languages(spark):
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(TEXTS.items())] * 3 + [(99, None, "en"), (98, "x", None)], "doc_id bigint, text string, lang string")
    model = language.train(docs)
    assert model.languages == sorted(TEXTS)
    for k, t in TEXTS.items():
        spans, sentences = language.segments(model, t)
        assert {model.languages[s[2]] for s in spans} == {k}
        assert language.whole_sentences(sentences) == {model.languages.index(k)}
    spans, sentences = language.segments(model, TEXTS["en"] + "\n" + TEXTS["zh"])
    assert [model.languages[s[2]] for s in spans] == ["en", "zh"] and len(language.whole_sentences(sentences)) == 2
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, TEXTS["de"])], "i int, canonical string")
    got = {r.i: r for r in language.label_texts(rows, model).collect()}
    assert got[1].lang is None and got[2].lang is None and got[3].spans == [] and got[4].lang == "de" and got[4].confidence > 0.5


WORDS = scan_noise.Words({"the": 900, "page": 300, "known": 200, "and": 700, "reading": 90, "over": 50, "order": 80, "column": 60, "two": 70, "damaged": 40, "overlapping": 30, "office": 50}, {"two-column": 20}, 5000)


def test_misread_words():
    text = "the pa9e and the damagcd office kn0wn readirig 0rder"
    got = {text[a:b]: w for a, b, w in scan_noise.misread_places(text, WORDS)}
    assert got == {"pa9e": "page", "damagcd": "damaged", "kn0wn": "known", "readirig": "reading", "0rder": "order"}
    assert scan_noise.misread_places("the page and Karloth B3X 17 the order", WORDS) == []
    assert scan_noise.misread_places("他们检查了标题o然后保存了", WORDS) == [(8, 9, "。")] or scan_noise.misread_places("他们检查了标题o然后保存了", WORDS)[0][2] == "。"


def test_hyphens():
    stream, _n, cut = scan_noise.joined_lines(["the over-", "lapping two-", "column page"], WORDS)
    assert cut == [True, False, False] and stream.startswith("the overlapping two-column page")
    assert scan_noise.inline_cuts("the over- lapping page", WORDS) and not scan_noise.inline_cuts("the two- column page", WORDS)


def test_decoding_splits_and_merges():
    assert [k for _a, _b, k, _w in WORDS.decode(["thepage", "known"])] == ["split", "same"]
    assert [(k, w) for _a, _b, k, w in WORDS.decode(["over", "lapping"])][0] == ("same", "over") or WORDS.decode(["overl", "apping"])[0][2] == "merge"


@pytest.mark.parametrize(("text", "yes"), [("- 3 -", True), ("Page 2 of 9", True), ("xii", True), ("第 3 页", True), ("[17]", True), ("3/5", True), ("= 12.50", False), ("4.8", False), ("Σ 3580.67", False), ("* 5: a note", False)])
def test_page_numbers(text, yes):
    assert scan_noise.is_number(text) is yes


def test_paragraphs():
    assert scan_noise.paragraph_starts(["a line that runs on", "and ends here.", "- an item", "", "more text follows"])[0] == 0
    assert scan_noise.repaired("the over-\nlapping pa9e", WORDS) == ["the overlapping page"]
    assert scan_noise.paragraph_starts([]) == []


ELEMENT = "elem_id bigint, doc_id bigint, page_index int, reading_order int, element_type string, label string, y0 float, y1 float, canonical string"
LINE = "line_id bigint, doc_id bigint, page_index int, region_id int, line_index int, canonical string"


def test_noise_rows(spark):
    e = [(1, 7, 0, 0, "text", "header", 130.0, 150.0, "The old map"), (2, 7, 0, 1, "text", None, 400.0, 500.0, "the page and the order of the\nThe old map\noffice and the known page."), (3, 7, 0, 2, "text", None, 2280.0, 2300.0, "- 1 -"), (4, 7, 0, 3, "text", "footnote", 2200.0, 2230.0, "* 1: the page."), (5, None, None, None, None, None, None, None, None), (3, 7, 0, 2, "text", None, 2280.0, 2300.0, "- 1 -")]
    lines = [(101, 7, 0, 0, 0, "The old map"), (102, 7, 0, 1, 0, "the over-"), (103, 7, 0, 1, 1, "lapping pa9e and"), (104, None, None, None, None, None), (102, 7, 0, 1, 0, "the over-")]
    got = scan_noise.noise_rows(scan_noise.element_flags(spark.createDataFrame(e, ELEMENT), WORDS), scan_noise.line_flags(spark.createDataFrame(lines, LINE), WORDS))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "furniture"), (2, "furniture_line"), (3, "furniture"), (101, "furniture"), (102, "hyphen"), (103, "misread")]
    none = scan_noise.noise_rows(scan_noise.element_flags(spark.createDataFrame([], ELEMENT), WORDS), scan_noise.line_flags(spark.createDataFrame([], LINE), WORDS))
    assert none.count() == 0


DOC = "doc_id bigint, source string, title string, text string, keys string"
FOUND = ["Dear {{name}}, your file is ready.", "Prepared for undefined on null.", "Report of [Your Name] to the board.", "Lorem ipsum dolor sit amet consectetur elit sed tempor magna aliqua.", "bla foo bla bla foo bla foo foo bla bla", "Error 404: Page not found", "Home > Docs > View\n\nPlease enable JavaScript to view this page.", "&#123;&#123;city&#125;&#125; is where we met."]
LEFT = ["The field `{{name}}` is filled by the writer.", "```\nx = {name}\n```\n\nThe clerk reads the letter.", 'The log says "404 not found" when a file was moved; start again.', "The value undefined in column 3 stands for an empty cell.", "A set {a, b, c} of boxes [1] is kept [sic].", "", None, "The clerk reads the letter. Then the council votes on it.\n\nEnable JavaScript to see the comments.", "The council met in May and read the report of the clerk."]


def test_residue(spark):
    rows = [(i, f"s{i % 3}", "The old map", t, "clash") for i, t in enumerate(FOUND + LEFT)]
    rows += [(100 + i, f"s{i % 3}", "A", f"The clerk in room {chr(97 + i)} waits for a {'xyzw'[i]} letter. Then {'abcd'[i]} goes home to {'klmn'[i]}.\n\nEnable JavaScript to see the comments.", "x") for i in range(4)]
    got = {r.doc_id for r in residue.find(spark.createDataFrame(rows + rows[:2], DOC)).collect()}
    assert got == set(range(len(FOUND)))
    assert residue.find(spark.createDataFrame([], DOC)).count() == 0


def test_inline_hyphens_are_joined():
    assert scan_noise.repaired("the over- lapping page and the two- column order", WORDS) == ["the overlapping page and the two- column order"]
    assert scan_noise.repaired("the over¬ lap¬ ping page", WORDS) == ["the overlapping page"]


def test_paragraphs_without_noise(spark):
    e = [(1, 7, 0, 0, "text", "header", 130.0, 150.0, "The old map"), (2, 7, 0, 1, "text", None, 400.0, 500.0, "the page and the order of the\nThe old map\noffice and the known page."), (3, 7, 0, 2, "text", None, 600.0, 700.0, "the known page and the The old map over- lapping order."), (4, 7, 0, 3, "text", None, 800.0, 900.0, "the page and the order of the\n- 12 -\noffice and the known page.")]
    lines = [(101, 7, 0, 0, 0, "The old map"), (102, 7, 0, 1, 0, "the over-"), (103, 7, 0, 1, 1, "lapping pa9e and"), (104, None, None, None, None, None), (102, 7, 0, 1, 0, "the over-"), (105, None, None, None, 0, "the pa9e"), (106, 7, 0, 4, 0, "the page and the order of the"), (107, 7, 0, 4, 1, "The old map"), (108, 7, 0, 4, 2, "office and the known page.")]
    elements, rec = spark.createDataFrame(e, ELEMENT), spark.createDataFrame(lines, LINE)
    got = scan_noise.paragraphs(elements, rec, scan_noise.element_flags(elements, None), scan_noise.line_flags(rec, None), WORDS)
    body = "the page and the order of the office and the known page."
    assert {(r.elem_id, r.line_id, r.text) for r in got.collect()} == {(2, None, body), (3, None, "the known page and the overlapping order."), (4, None, body), (None, 102, "the overlapping page and"), (None, 105, "the page"), (None, 106, body)}


def test_words_run_together_or_broken_are_repaired():
    assert scan_noise.repaired("Thepage and the overl apping order", WORDS) == ["The page and the overlapping order"]
    assert scan_noise.repaired("the known (thepage) and the overl\napping pa9e", WORDS) == ["the known (the page) and the overlapping page"]
    for text in ("the page and the overl, apping order", "the page and the overl 12 apping order", "the page and Karloth of the order"):
        assert scan_noise.repaired(text, WORDS) == [text]
    assert scan_noise.misread_places("Thepage and the overl apping order", WORDS) == []


def test_residue_wants_evidence_beside_messages(spark):
    """A sentence beside a message counts as part of a response only where several sources hold it and it stands mostly in bare documents."""
    known, once, content = "Reload the view when you are back online.", "The council met in May about the harbour.", "Ask the clerk in the hall for help."
    rows = [(i, f"s{i % 2}", None, f"Access denied. {known}") for i in range(4)] + [(10, "s0", None, f"Access denied. {once}")]
    rows += [(20 + i, f"s{i % 2}", None, f"Access denied. {content}") for i in range(3)] + [(30 + i, f"s{i % 2}", None, f"The harbour was closed in week {i}. {content}") for i in range(6)]
    rows += [(40 + i, "s0", None, "Access denied. Return to the lobby by the stairs.") for i in range(4)]
    got = {r.doc_id for r in residue.find(spark.createDataFrame(rows, "doc_id bigint, source string, title string, text string")).collect()}
    assert got == set(range(4))


def test_long_texts_are_read_to_their_end():
    text = "the Page of " * 500 + "the order The old map of the page."
    assert "The old map" in scan_noise.line_candidates(text)[0]
    got = scan_noise.repaired("the known over-\nlapping page\n" * 1500, WORDS)
    assert "over-" not in "".join(got) and sum(x.count("overlapping") for x in got) == 1500


def test_no_filter_loses_filler_or_messages():
    assert residue.is_filler("Platzhaltertext. Platzhaltertext.")
    assert residue.is_filler("Come in. Come in. Come in. Every other clerk reads letters about harbours, bridges, archives and old maps.")
    assert residue.responses("This script is blocked.", False, None)[0]
