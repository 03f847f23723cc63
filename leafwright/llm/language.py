"""Languages of texts and of their segments, with a confidence.

Scripts narrow the candidates of a word; a word's score per language is that of its
hashed letter n-grams, learned from labelled documents; Viterbi with a penalty for
switching (smaller where a sentence ends) labels the words, and runs of one label are
the segments.

Scale: training counts are summed on the executors into a table of fixed size
(2**15 x languages); labelling is a map without a shuffle, in which many texts step through
Viterbi at once. A word's score is kept per worker, in a table that is emptied when it grows beyond a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.sampling import hash_sample

BUCKETS = 1 << 15
SAMPLE = 20_000
SCRIPTS = ("latin", "cyrillic", "greek", "han", "kana", "hangul", "other")
UNIT = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]+(?:['’][A-Za-zÀ-ɏ]+)*|[Ͱ-Ͽἀ-῿]+|[Ѐ-ԯ]+|[㐀-䶿一-鿿豈-﫿々〇]{1,2}|[぀-ヿㇰ-ㇿ]+|[가-힯ᄀ-ᇿ]+|[^\W\d_]+")
STOP = re.compile(r"[.!?]+(?=[\s\"'”’»)\]]|$)|[。！？]+")
ENUMERATOR = re.compile(r"(?:^|\n|;)\s*\(?(?:\d{1,3}|[a-z])$")
SWITCH, SWITCH_AT_STOP, SCALE = 9.0, 3.0, 0.5
_KEPT = 200_000


def script_of(unit: str) -> int:
    c = unit[0]
    if c < "ɐ" or "Ḁ" <= c <= "ỿ":
        return 0
    if "Ѐ" <= c <= "ԯ":
        return 1
    if "Ͱ" <= c <= "Ͽ":
        return 2
    if "぀" <= c <= "ヿ" or "ㇰ" <= c <= "ㇿ":
        return 4
    if "가" <= c <= "힯" or "ᄀ" <= c <= "ᇿ":
        return 5
    return 3 if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "々〇" else 6


def grams(unit: str) -> list[int]:
    """Buckets of the n-grams of a unit: up to four letters with its ends marked, and the unit itself."""
    w = f"<{unit.lower()}>"
    out = [crc32(w[i : i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]
    out.append(crc32(("=" + w).encode()) % BUCKETS)
    return out


class Model:
    """Scores of n-grams per language, and the languages that each script is written in."""

    def __init__(self, languages: list[str], table: np.ndarray, allowed: np.ndarray) -> None:
        self.languages, self.table, self.allowed = languages, table.astype(np.float32), allowed
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.languages)))

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "table": self.table, "allowed": self.allowed}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def score(self, unit: str) -> np.ndarray:
        """Score of a unit per language; the best is 0."""
        g = grams(unit)
        got = self.table[g].sum(axis=0) * (SCALE * min(len(unit), 6) / len(g))
        got = got - got.max()
        allowed = self.allowed[script_of(unit)]
        return np.where(allowed, got, got.min() - 20.0) if allowed.any() else got

    def scores(self, units: list[str]) -> np.ndarray:
        """Scores of units, each remembered."""
        row = self.row
        if len(row) > _KEPT:
            self._forget()
            row = self.row
        at = np.empty(len(units), dtype=np.int64)
        for i, u in enumerate(units):
            k = row.get(u)
            if k is None:
                k = row[u] = len(row)
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[k] = self.score(u)
            at[i] = k
        return self.rows[at]

    def label(self, units: list[str], after_stop: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi path over the units, and their scores. `after_stop`: a sentence ended before the unit."""
        return self.label_all([(units, after_stop)])[0]

    def label_all(self, texts: list[tuple[list[str], list[bool]]], cells: int = 50_000) -> list[tuple[np.ndarray, np.ndarray]]:
        """`label` for many texts at once: those of like length step together, about `cells` units at a time."""
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]))
        k = len(self.languages)
        at = 0
        while at < len(order):
            longest = len(texts[order[at]][0])
            part = order[at : at + max(1, cells // max(1, longest))]
            at += len(part)
            if not longest:
                out[part[0]] = (np.empty(0, dtype=np.int64), np.empty((0, k)))
                at -= len(part) - 1
                continue
            sizes = np.array([len(texts[i][0]) for i in part])
            s = np.zeros((longest, len(part), k))
            cost = np.full((longest, len(part), 1), SWITCH)
            for j, i in enumerate(part):
                units, after = texts[i]
                s[: len(units), j] = self.scores(units)
                cost[: len(units), j, 0][np.asarray(after, dtype=bool)] = SWITCH_AT_STOP
            stays = np.ones((longest, len(part), k), dtype=bool)
            tops = np.empty((longest, len(part)), dtype=np.int64)
            best = s[0].copy()
            every = np.arange(len(part))
            final = best.copy()
            for i in range(1, longest):
                m = int(np.searchsorted(-sizes, -i, side="left"))  # texts that reach this unit
                if m < len(best):
                    final[m : len(best)] = best[m:]
                    best = best[:m]
                top = best.argmax(axis=1)
                leave = best[every[:m], top][:, None] - cost[i, :m]
                stay = best >= leave
                tops[i, :m], stays[i, :m] = top, stay
                best = np.where(stay, best, leave) + s[i, :m]
            final[: len(best)] = best
            state = final.argmax(axis=1)
            path = np.empty((longest, len(part)), dtype=np.int64)
            for i in range(longest - 1, -1, -1):
                m = int(np.searchsorted(-sizes, -i, side="left"))
                path[i, :m] = state[:m]
                if i:
                    state[:m] = np.where(stays[i, every[:m], state[:m]], state[:m], tops[i, :m])
            for j, i in enumerate(part):
                out[i] = (path[: sizes[j], j], s[: sizes[j], j])
        return out


def train(docs: DataFrame, sample: int = SAMPLE, languages: list[str] | None = None) -> Model:
    """Trained on about `sample` labelled documents (columns doc_id, text, lang), those with the smallest hash of the id.

    `languages` limits the labels; rows with other labels are left out.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    if languages is not None:
        rows = rows.where(F.col("lang").isin(languages))
    picked = hash_sample(rows, "doc_id", sample).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        kept: dict[str, np.ndarray] = {}
        for p in parts:
            for lang, text in zip(p.lang, p.text):
                t = tables.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                s = scripts.setdefault(lang, np.zeros(len(SCRIPTS), dtype=np.int64))
                units = UNIT.findall(text)
                for u in units:
                    g = kept.get(u)
                    if g is None:
                        g = kept[u] = np.array(grams(u))
                        if len(kept) > _KEPT:
                            kept.clear()
                    np.add.at(t, g, 1)
                    s[script_of(u)] += len(u)
        for lang, t in tables.items():
            b = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "b": b, "n": t[b]})
            yield pd.DataFrame({"lang": lang, "b": -1 - np.arange(len(SCRIPTS)), "n": scripts[lang]})

    got = picked.mapInPandas(count, "lang string, b int, n bigint").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(got.lang.unique()) or ["und"]
    at = {x: i for i, x in enumerate(names)}
    counts, scripts = np.zeros((BUCKETS, len(names))), np.zeros((len(SCRIPTS), len(names)))
    feats, marks = got[got.b >= 0], got[got.b < 0]
    counts[feats.b, feats.lang.map(at)] = feats.n
    scripts[-1 - marks.b, marks.lang.map(at)] = marks.n
    p = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS)
    logs = np.log(p) - np.log(p).mean(axis=1, keepdims=True)
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(names, np.clip(logs, -6, 6), share >= 0.1)


def _units(text: str) -> tuple[list[re.Match], np.ndarray, int, list[bool]]:
    """Units of a text, how many sentences ended before each, how many end in all, and whether one ended just before."""
    found = list(UNIT.finditer(text))
    stops = [m.end() for m in STOP.finditer(text) if not (m.group() == "." and ENUMERATOR.search(text[max(0, m.start() - 6) : m.start()]))]
    bounds = np.searchsorted(stops, [m.start() for m in found], side="right")
    return found, bounds, len(stops), [False, *(bounds[1:] != bounds[:-1]).tolist()][: len(found)]


def segments(model: Model, text: str) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, int, int, float, bool]]]:
    """Segments (start, end, language, confidence) and sentences (..., ends with a stop) of a text.

    A sentence lies between stops and is cut where the language changes.
    """
    return next(segments_all(model, [text]))


def segments_all(model: Model, texts: Iterable[str], chars: int = 300_000) -> Iterator[tuple[list, list]]:
    """`segments` of many texts, in parts of about `chars` characters."""
    part: list = []
    size = 0
    for t in chain(texts, [None]):
        if t is not None:
            part.append(_units(t))
            size += len(t)
        if part and (t is None or size > chars):
            paths = model.label_all([([m.group() for m in found], after) for found, _b, _n, after in part])
            yield from (_spans(*r, *p) if r[0] else ([], []) for r, p in zip(part, paths))
            part, size = [], 0


def _spans(found: list[re.Match], bounds: np.ndarray, stops: int, after: list[bool], path: np.ndarray, s: np.ndarray) -> tuple[list, list]:
    n = len(found)
    turns = path[1:] != path[:-1]
    cut = [0, *(np.flatnonzero(turns) + 1).tolist()]
    spans = []
    sums = np.add.reduceat(s, cut, axis=0)
    sums = np.exp(sums - sums.max(axis=1, keepdims=True))
    for i, (a, b) in enumerate(zip(cut, [*cut[1:], n])):
        k = int(path[a])
        spans.append((found[a].start(), found[b - 1].end(), k, float(sums[i, k] / sums[i].sum())))
    cut = [0, *(np.flatnonzero(turns | np.array(after[1:], dtype=bool)) + 1).tolist()]
    sentences = []
    units = [m.group() for m in found]
    sizes = [len(u) for u in units]
    wide = [n if script_of(u) in (3, 4) else 0 for u, n in zip(units, sizes)]
    for a, b in zip(cut, [*cut[1:], n]):
        broad = sum(wide[a:b])
        size = broad / 2 if 2 * broad > sum(sizes[a:b]) else sum(x > 1 for x in sizes[a:b])
        closed = bool(b == n or bounds[b] != bounds[b - 1]) and bool(bounds[b - 1] < stops)
        sentences.append((found[a].start(), found[b - 1].end(), int(path[a]), float(size), closed))
    return spans, sentences


def whole_sentences(sentences: list[tuple[int, int, int, float, bool]]) -> set[int]:
    """Languages with at least one whole sentence: four words that end with a stop, or eight where the stop was lost."""
    return {lang for _, _, lang, size, closed in sentences if size >= (4 if closed else 8)}


SPANS = "array<struct<start:int,end:int,lang:string,confidence:double>>"


def label_texts(rows: DataFrame, model: Model, text: str = "canonical") -> DataFrame:
    """`rows` with spans, sentence_langs (languages with a whole sentence), lang and confidence of the whole text.

    Null and empty texts, and texts without letters: no span, null language, null confidence. Offsets are code points of `text`.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            out = []
            for spans, sentences in segments_all(m, (t if isinstance(t, str) else "" for t in texts)):
                weight: dict[int, float] = {}
                for a, b, k, c in spans:
                    weight[k] = weight.get(k, 0.0) + (b - a) * c
                total = sum(b - a for a, b, _, _ in spans)
                top = max(weight, key=lambda k: (weight[k], -k)) if weight else None
                out.append((
                    [{"start": a, "end": b, "lang": m.languages[k], "confidence": c} for a, b, k, c in spans], sorted(m.languages[k] for k in whole_sentences(sentences)),
                    m.languages[top] if top is not None else None, weight[top] / total if top is not None and total else None,
                ))
            yield pd.DataFrame(out, columns=["spans", "sentence_langs", "lang", "confidence"])

    udf = F.pandas_udf(run, f"struct<spans:{SPANS},sentence_langs:array<string>,lang:string,confidence:double>")
    return rows.withColumn("_l", udf(F.col(text))).select(*rows.columns, "_l.*")
