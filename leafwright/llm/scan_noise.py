"""Noise of scanned pages: running headers and page numbers, hyphens at line ends, misread characters.

Words are decoded over the characters of a region, its line ends taken as blanks: one lattice
lets every stretch between breaks be read through confusions, fall into two words, merge with the next one
over a blank, or join it over a hyphen, and any of these together; the cheapest path under the
corpus's word frequencies wins, and tells hyphens and misread characters alike. Paragraph boundaries within a
region are chosen by dynamic programming over its lines. Furniture is found by its place on
the page and its shape; that it repeats in the document isn't demanded.

Scale: the word list holds words with at least one millionth of all tokens, so it has at
most a million entries however large the corpus, and is counted with map-side combining.
Positions are ranked per page over distinct elements, an element without a page being a page of its own; furniture strings meet candidate lines in an equi-join on document
and hash. A region's lines and a page's elements are the largest groups that one task holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.plans.arrow_groups import grouped_arrow
from leafwright.plans.lineage import cut

LEAST_SHARE = 1e-6
LEAST_COUNT = 3
WORD = re.compile(r"[^\W\d_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
PIECE = re.compile(r"[^\s'’\-–/\"«»„“”]+")
CODE = re.compile(r"[A-Za-z]-?\d+[A-Za-z]?|\d+[A-Za-z]|[\W\d_]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: What is seen on a scan, and what it may stand for.
CONFUSIONS = {
    "0": "o", "1": "l i", "!": "i l", "|": "l i", "+": "t", "(": "c", "9": "g", "5": "s", "6": "b é ó", "8": "b", "3": "e", "$": "s", "@": "a", "€": "e", "£": "e",
    "c": "e", "ri": "n", "cl": "d", "ii": "u ü", "rn": "m", "vv": "w", "b": "h", "h": "b", "t": "f", "f": "t", "v": "y", "m": "in rn", "i": "l", "l": "i", "ni": "m", "li": "h", "nn": "m", "q": "g", "iii": "m",
}
#: What a character begins: (seen, what it may stand for).
_FROM = {c: tuple((seen, tuple(reals.split())) for seen, reals in CONFUSIONS.items() if seen[0] == c) for c in {seen[0] for seen in CONFUSIONS}}
_SYMBOL, _LETTER = 3.0, 4.0
#: What a hyphen that must have cut a word saves, so that the halves don't stand alone.
_CUT = 40.0
HYPHEN_END = re.compile(r"([^\W\d_]+)([-¬‐‑­])[ ]?$")
STOP_MISREAD = re.compile(r"(?<=[぀-ヿ㐀-鿿])\n?([oO0•°˚])(?=\n?[぀-ヿ㐀-鿿]|\s*$|\n|\s*\()")
SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]]*\s*$")
NUMBER_WORDS = r"page|pages|p|pp|pag|pág|pagina|página|seite|s|стр|страница|bladzijde|blz|pg|of|von|sur|de|di|из|van|da|/"
NUMBER = re.compile(r"^[\W_]*(?:(?:" + NUMBER_WORDS + r")[\s.]*)?(?:第\s*)?(?:\d{1,4}|[ivxl]{1,7})\s*(?:页|頁|쪽|ページ)?\s*(?:(?:/|／|of|von|sur|de|di|из|van|da|共)\s*\d{1,4})?\s*(?:页|頁|쪽|ページ)?[\s\-–—·|.\])」】>]*$", re.I)
DECORATED = re.compile(r"^\W|\W$|[页頁쪽ペ/]|[^\W\d_]{1,}.*\d", re.I)
DECIMAL = re.compile(r"\d[.,]\d|^[\s]*[=Σ∑%+]|%|^[A-Z]-?\d|n/a", re.I)
TOP, BOTTOM, SHORT = 420.0, 2105.0, 70


class Words:
    """Word frequencies of a corpus, and decoding with them."""

    def __init__(self, count: dict[str, int], compounds: dict[str, int], total: int) -> None:
        self.count, self.compounds, self.total = count, compounds, max(total, 1)
        self.unknown = math.log(self.total) + 4.0
        self._forget()

    def _forget(self) -> None:
        self.ordered: list[str] = []
        self.kept: dict[str, tuple[float, str]] = {}
        self.parts: dict[str, tuple[float, str]] = {}
        self.sure: set[str] = set()
        self.known: set[str] = set()

    def __getstate__(self) -> dict:
        return {"count": self.count, "compounds": self.compounds, "total": self.total, "unknown": self.unknown}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def cost(self, word: str) -> float:
        n = self.count.get(word, 0)
        return math.log(self.total / n) if n else self.unknown + (3.0 if any(not c.isalpha() for c in word) else 0.0)

    def begins(self, start: str) -> bool:
        """Whether a known word begins so."""
        if not self.ordered:
            self.ordered = sorted(self.count)
        i = bisect_left(self.ordered, start)
        return i < len(self.ordered) and self.ordered[i].startswith(start)

    def read(self, token: str) -> tuple[float, str]:
        """Cheapest reading of one token (lower case) through at most three confusions: (cost, word).

        Readings are followed only as far as some known word begins like them, so tokens of any length are read exactly.
        """
        got = self.kept.get(token)
        if got is not None:
            return got
        best = (self.cost(token), token)
        if best[0] > 5.0 and len(token) > 1:
            n = len(token)
            stack = [(0, "", 0, 0.0)]
            while stack:
                i, out, used, pay = stack.pop()
                if i == n:
                    k = self.count.get(out, 0) if used and len(out) > 1 else 0
                    if k:
                        c = math.log(self.total / k) + pay + (2.0 if len(out) < 4 else 0.0)
                        if c < best[0]:
                            best = (c, out)
                    continue
                for seen, reals in _FROM.get(token[i], ()) if used < 3 else ():
                    if token.startswith(seen, i):
                        for real in reals:
                            if self.begins(out + real):
                                stack.append((i + len(seen), out + real, used + 1, pay + (_LETTER if seen.isalpha() else _SYMBOL)))
                if self.begins(out + token[i]):
                    stack.append((i + 1, out + token[i], used, pay))
        if len(self.kept) > 300_000:
            self.kept.clear()
        self.kept[token] = best
        return best

    def _all(self, pieces: list[str], fine: set[str], test: Callable[[str], bool]) -> bool:
        """Whether every piece between blanks passes a test; those that do are remembered."""
        if fine.issuperset(pieces):
            return True
        if len(fine) > 300_000:
            fine.clear()
        for x in pieces:
            if x not in fine:
                if not all(test(t) for _a, _b, t in tokens_of(x)):
                    return False
                fine.add(x)
        return True

    def undoubted(self, pieces: list[str]) -> bool:
        """Whether no word of the pieces could be read otherwise."""

        def plain(t: str) -> bool:
            inner = t.strip("!(+|$)")
            if inner != t and (inner in self.count or not inner):
                t = inner
            return self.read(t)[1] == t

        return self._all(pieces, self.sure, plain)

    def all_known(self, pieces: list[str]) -> bool:
        """Whether all words of the pieces are in the word list, so that none is two words or a part of one."""
        return self._all(pieces, self.known, lambda t: t.strip("!(+|$)") in self.count)

    def split(self, token: str) -> tuple[float, str]:
        """Cheapest reading of a token as two words run together, both known, those of four letters or more also through confusions."""
        got = self.parts.get(token)
        if got is not None:
            return got
        best = (math.inf, token)
        for i in range(2, len(token) - 1):
            if not self.begins(token[:2]) and token[0] not in _FROM and token[1] not in _FROM:
                break
            (ca, a), (cb, b) = self.read(token[:i]), self.read(token[i:])
            if ca + cb + 3.0 < best[0] and all(w in self.count and (w == t or len(w) > 3) for w, t in ((a, token[:i]), (b, token[i:]))):
                best = (ca + cb + 3.0, a + " " + b)
        if len(self.parts) > 300_000:
            self.parts.clear()
        self.parts[token] = best
        return best

    def decode(self, tokens: list[str], apart: frozenset[int] | set[int] = frozenset(), hyphens: dict[int, tuple[str, bool]] | None = None) -> list[tuple[int, int, str, str]]:
        """Viterbi over a lattice of tokens: (first, last + 1, kind, reading); kinds: same, confusion, split, merge, hyphen.

        Tokens in `apart` aren't merged with the next. `hyphens`: those before a hyphen that may have cut a word: its sign, and whether a line ends there.
        """
        n, hyphens = len(tokens), hyphens or {}
        cost, back = [0.0] + [math.inf] * n, [("", 0, "")] * (n + 1)
        for i, t in enumerate(tokens):
            c, w = self.read(t)
            options = [(i + 1, c, "same" if w == t else "confusion", w)]
            if t not in self.count and len(t) >= 4:
                options.append((i + 1, *_as(self.split(t), "split")))
            if i in hyphens:
                joined, j = t, i
                while j in hyphens and (j == i or i - 1 not in hyphens) and self.cut_word(joined, tokens[j + 1], *hyphens[j]):
                    joined, j = joined + tokens[j + 1], j + 1
                    c, w = self.read(joined)
                    options.append((j + 1, min(c, self.unknown) - _CUT * (j - i), "hyphen", w))
            elif i + 1 < n and i not in apart and (t not in self.count or tokens[i + 1] not in self.count):
                joined = t + tokens[i + 1]
                c, w = self.read(joined)
                if w in self.count:
                    options.append((i + 2, c + 3.0, "merge", w))
            for j, c, kind, w in options:
                if cost[i] + c < cost[j]:
                    cost[j], back[j] = cost[i] + c, (kind, i, w)
        out, j = [], n
        while j:
            kind, i, w = back[j]
            out.append((i, j, kind, w))
            j = i
        return out[::-1]

    def cut_word(self, a: str, b: str, mark: str = "-", line_end: bool = True) -> bool:
        """Whether a hyphen between two halves was put there by a line end; where lines were joined by blanks, only if the whole is a word."""
        a, b = a.lower(), b.lower()
        if not a or not b:
            return False
        if mark in "¬\xad":
            return True
        joined, kept = self.count.get(a + b, 0), self.compounds.get(a + "-" + b, 0)
        if joined or kept:
            return joined > kept
        if self.read(a + b)[1] != a + b:
            return True
        return line_end and a.isalpha() and b.isalpha() and not (self.count.get(a, 0) and self.count.get(b, 0))


def _as(found: tuple[float, str], kind: str) -> tuple[float, str, str]:
    return found[0], kind, found[1]


def count_words(texts: DataFrame, text: str = "canonical") -> Words:
    """Frequencies of words and of compounds inside lines. Words below a millionth of all tokens, or three, are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for b in batches:
            t = "\n".join(x for x in b.column(0).to_pylist() if x).lower()
            words.update(WORD.findall(t))
            words.update("=" + m for x in t.split() if "-" in x for m in COMPOUND.findall(x))
            if len(words) > 500_000:
                yield pa.record_batch([pa.array(list(words)), pa.array(list(words.values()), type=pa.int64())], names=["w", "n"])
                words = Counter()
        yield pa.record_batch([pa.array(list(words), type=pa.string()), pa.array(list(words.values()), type=pa.int64())], names=["w", "n"])

    counted = cut(texts.select(text).mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))  # read twice, counted once
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") >= max(LEAST_COUNT, int(total * LEAST_SHARE))).toArrow().to_pandas()  # at most 1 / LEAST_SHARE rows
    plain = rows[~rows.w.str.startswith("=")]
    joint = rows[rows.w.str.startswith("=")]
    return Words(dict(zip(plain.w, plain.n)), {w[1:]: n for w, n in zip(joint.w, joint.n)}, int(total))


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, lower-case token) of the words of a stream, without the punctuation around them but with signs that may stand for letters."""
    out = []
    for m in PIECE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".,;:?)]}>。，、；：？…_*#~=|¬\\" :
            b -= 1
        while a < b and text[a] in "[{<¿¡*#•·_=~…|\\":
            a += 1
        t = text[a:b]
        if t.isalpha() or (t and not CODE.fullmatch(t) and any(map(str.isalpha, t))):  # letters alone are no code
            if t.isascii() or not CJK.search(t):
                out.append((a, b, t.lower()))
    return out


class Place(NamedTuple):
    """A stretch of a region that is to be read otherwise."""

    start: int
    end: int
    kind: str  #: confusion, split, merge, hyphen
    reading: str
    wrong: int  #: position of the first misread character, -1 where none is
    hyphens: tuple[int, ...]  #: positions of the hyphens that cut the word


HYPHENATED = re.compile(r"(?<=\w)[-¬‐‑\xad][ \n]")
HYPHEN_GAP = re.compile(r"([-¬‐‑\xad])(?: ?(\n)\s*| {1,2})")
BLANK_GAP = re.compile(r"[ \n]{1,2}")


def places(text: str, words: Words, fully: bool = False) -> list[Place]:
    """What is to be read otherwise in a region, in order. Its lines are parted by line feeds or joined by blanks.

    `fully`: also words that ran together or fell apart without any misread character.
    """
    pieces = text.split()
    hyphenated = bool(HYPHENATED.search(text))
    if not hyphenated and words.undoubted(pieces) and (not fully or words.all_known(pieces)):
        return []
    toks = tokens_of(text)
    known = words.count
    forms, spans = [], []
    for a, b, t in toks:
        inner = t.strip("!(+|$)")
        if inner == t or not (inner in known or not inner or (inner.isalpha() and words.read(t)[1] == t and words.split(inner)[0] < words.unknown)):
            inner = t
        at = a + t.find(inner)
        forms.append(inner)
        spans.append((at, at + len(inner)) if inner else (a, b))
    apart, hyphens = set(), {}
    for i in range(len(toks) - 1):
        gap = text[spans[i][1] : spans[i + 1][0]]
        m = HYPHEN_GAP.fullmatch(gap) if hyphenated else None
        if m and (text[spans[i + 1][0]].islower() or text[spans[i][0] : spans[i][1]].isupper() or m.group(2) is None and not text[spans[i + 1][0]].isalpha()):
            hyphens[i] = (m.group(1), m.group(2) is not None)
        elif not BLANK_GAP.fullmatch(gap):
            apart.add(i)
    path = words.decode(forms, apart, hyphens)
    wordy = sum(j - i for i, j, kind, w in path if kind in ("split", "hyphen") or w in known) >= 0.6 * len(forms)  # machine data and junk have no words to misread
    out = []
    for i, j, kind, w in path:
        if kind == "same" or not (wordy or kind == "hyphen"):
            continue
        was = "".join(forms[i:j])
        letters = w.replace(" ", "")
        if kind == "hyphen" and not wordy:
            letters = w = was
        wrong = -1
        if letters != was:
            k = next((k for k, (x, y) in enumerate(zip(was, letters)) if x != y), min(len(was), len(letters)) - 1)
            for q in range(i, j):
                if k < len(forms[q]):
                    wrong = spans[q][0] + k
                    break
                k -= len(forms[q])
        as_it_stands = "".join(text[a:b] for a, b in spans[i:j])
        if wrong < 0:
            reading = as_it_stands if kind != "split" else as_it_stands[: w.index(" ")] + " " + as_it_stands[w.index(" ") :]
        else:
            reading = w.upper() if as_it_stands.isupper() and len(as_it_stands) > 1 else w.capitalize() if as_it_stands[:1].isupper() else w
        out.append(Place(spans[i][0], spans[j - 1][1], kind, reading, wrong, tuple(spans[q][1] for q in range(i, j - 1)) if kind == "hyphen" else ()))
    return out


def stop_places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, 。) of misread full stops."""
    return [(m.start(1), m.end(1), "。") for m in STOP_MISREAD.finditer(text)] if CJK.search(text) else []


def misread_places(text: str, words: Words) -> list[tuple[int, int, str]]:
    """(start, end, reading) of words of a region that were misread, and of full stops (reading 。)."""
    return stop_places(text) + [(p.start, p.end, p.reading) for p in places(text, words) if p.wrong >= 0]


def joined_lines(lines: list[str], words: Words) -> tuple[str, list[int], list[bool]]:
    """De-lined stream of a region, the first position of each line before, and which lines end with a word cut by a hyphen."""
    text, starts, at = "\n".join(lines), [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    cuts = [False] * len(lines)
    found = places(text, words)
    for p in found:
        for h in p.hyphens:
            cuts[bisect_right(starts, h) - 1] = True
    return delined(text, [(p.start, p.end, "".join(text[p.start : p.end].split("\n")) if p.wrong >= 0 and not p.hyphens else p.reading) for p in found if p.hyphens]), starts, cuts


def inline_cuts(text: str, words: Words) -> bool:
    """Whether a text whose lines were joined by blanks has a word cut by a hyphen before a blank."""
    return any(p.hyphens for p in places(text, words))


LINE_END = re.compile(r"[ \t]*\n")


def delined(text: str, replaced: list[tuple[int, int, str]]) -> str:
    """A region as one stream, with (start, end, reading) places replaced. A line end becomes a blank, or nothing after a hyphen between letters and between signs that need no blanks."""
    parts, at = [], 0
    for a, b, w in sorted(replaced):
        if a >= at:
            parts += [text[at:a], w]
            at = b
    text = "".join(parts) + text[at:]

    def glue(m: re.Match) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before and before in "-‐‑" and text[m.start() - 2 : m.start() - 1].isalpha() and after.isalpha():
            return ""
        return "" if before > "⺀" and (after > "⺀" or after and after in "oO0•") and not ("가" <= before <= "힯") else " "

    return LINE_END.sub(glue, text) if "\n" in text else text


def reread(text: str, words: Words) -> str:
    """A region as one stream with its misread words and full stops replaced (case kept where the word had one), words run together split, broken ones merged, cut ones joined."""
    return delined(text, stop_places(text) + [(p.start, p.end, p.reading) for p in places(text, words, fully=True)])


def without(text: str, places: list[tuple[int, int]]) -> str:
    """A text without the given (start, end) places, which are in order and don't overlap."""
    parts, at = [], 0
    for a, b in places:
        parts.append(text[at:a])
        at = b
    return "".join(parts) + text[at:]


CORELESS = re.compile(r"[\d|·•\-–—/]+")


def core(text: str) -> str:
    """A furniture text without its numbers and separators. Case tells a heading from the same words in a sentence, so it stays."""
    return " ".join(CORELESS.sub(" ", text).split())


def core_key(text: str) -> int:
    return xxhash.xxh64_intdigest(core(text).encode()) - (1 << 63)


def is_number(text: str) -> bool:
    """A page number in any of its forms."""
    t = text.strip()
    return len(t) <= 25 and bool(NUMBER.match(t)) and not DECIMAL.search(t) and any(c.isalnum() for c in t)


def furniture_kind(text: str, kind: str | None, label: str | None, y0: float | None, top: int, bottom: int, page_rows: int) -> str | None:
    """`header`, `footer` or `number` for an element that is page furniture by its place and shape, else None.

    `top`, `bottom`: its rank from the top and from the bottom of the page.
    """
    t = text.strip()
    if not t or "\n" in t or len(t) > SHORT or kind not in (None, "text") or y0 is None or math.isnan(y0):
        return None
    if kind is None and label not in ("header", "footer", "number"):
        return None
    low, high = y0 >= BOTTOM and bottom <= 4, y0 < TOP and top == 1 and page_rows > 1
    if is_number(t):
        return "number" if low or (high and label == "number") else None
    letters = sum(c.isalpha() for c in t)
    if SENTENCE_END.search(t) or letters < 2 or DECIMAL.search(t) or label in ("doc_title", "paragraph_title", "footnote", "reference"):
        return None
    if ITEM.match(t):
        return None
    return "footer" if low else "header" if high else None


_STOP, _CLOSERS = re.compile("[.!?。！？]"), frozenset(".!?。！？")
INNER_CAPITAL = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ] [A-ZÀ-ÖØ-ÞА-Я]")


def candidate_places(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the lines of a running text that may be furniture standing between its lines, and of those that are page numbers for sure.

    In texts whose lines are joined by blanks: runs of words that begin with a capital inside a sentence, or stand between blanks in scripts without blanks.
    """
    lines = text.split("\n")
    if not _STOP.search(text):
        return [], []
    found: list[tuple[int, int]] = []
    if len(lines) > 2:
        sizes = [len(x) for x in lines]
        usual = sorted(sizes)[len(sizes) // 2]
        most = min(SHORT, 0.95 * usual) if len(lines) > 4 else SHORT
        sure, at = [], sizes[0] + 1
        for i in range(1, len(lines) - 1):
            a, at = at, at + sizes[i] + 1
            if sizes[i] > most + 4 or sizes[i - 1] < 0.5 * usual - 4:
                continue
            x = lines[i].strip()
            if not x or len(x) > most or len(lines[i - 1].strip()) < 0.5 * usual or (i + 1 < len(lines) - 1 and len(lines[i + 1].strip()) < 0.4 * usual):
                continue
            number = len(x) <= 25 and is_number(x)
            if number:
                if usual >= 12 and DECORATED.search(x) and not x.endswith("."):
                    sure.append((a, at - 1))
            elif x[-1] not in _CLOSERS and not SENTENCE_END.search(x) and sum(map(str.isalpha, x)) >= 2:
                found.append((a, at - 1))
        return found, sure
    if len(lines) == 1 and " " in text:
        if len(CJK.findall(text)) > len(text) / 3:
            for m in re.finditer(r"(?<=\S) ([^\s。！？]{2,40}(?: [^\s。！？]{1,20})?) (?=\S)", text):
                found += [m.span(1), (m.start(1), m.start(1) + len(m.group(1).split(" ")[0]))]
        elif INNER_CAPITAL.search(text):
            words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            for i in range(1, len(words)):
                a = words[i][0]
                before = text[words[i - 1][0] : words[i - 1][1]]
                if text[a].isupper() and before.isalpha() and before.islower():
                    found += [(a, words[j][1]) for j in range(i, min(i + 9, len(words) - 1)) if text[words[j + 1][0]].islower()]
    return found, []


def line_candidates(text: str) -> tuple[list[str], bool]:
    """The texts of `candidate_places`, and whether one is a page number for sure."""
    found, sure = candidate_places(text)
    return [text[a:b].strip() for a, b in found], bool(sure)


def without_furniture(text: str, keys: frozenset[int]) -> str:
    """A text without the page numbers that stand between its lines, and without the headers and footers there whose core is in `keys`."""
    if not keys and "\n" not in text:
        return text
    found, sure = candidate_places(text)
    places, at = [], 0
    for a, b in sorted(sure + [(a, b) for a, b in found if keys and core(text[a:b]) and core_key(text[a:b]) in keys], key=lambda p: (p[0], -p[1])):  # the longest of a start
        if a < at:
            continue
        at = b
        if "\n" in text:  # a line with its break
            at = b + 1
        elif text[b : b + 1] == " ":  # one of the blanks around it, both between letters that need none
            a, at = (a - 1, b + 1) if CJK.match(text[a - 2 : a - 1]) and CJK.match(text[b + 1 : b + 2]) else (a, b + 1)
        places.append((a, at))
    return without(text, places) if places else text


_last = math.inf
FLAGS = "furniture string, core bigint, hyphen boolean, misread boolean, number_line boolean, candidates array<bigint>"


def element_flags(elements: DataFrame, words: Words | None, text: str = "canonical") -> DataFrame:
    """Furniture, hyphen, misread and candidate lines of content elements. Null and empty texts have none. Without `words` only furniture is looked for.

    Wants elem_id, doc_id, page_index, reading_order, element_type, label, y0, y1 and the text. Repeated rows count once; an element without a document or a page is alone on its page.
    """
    shared = elements.sparkSession.sparkContext.broadcast(words)
    types = dict(elements.dtypes)
    keep = ["elem_id", "doc_id", "page_index", "reading_order"]
    alone = F.when(F.col("doc_id").isNull() | F.col("page_index").isNull(), F.coalesce("elem_id", F.lit(-1)))

    def run(t: pa.Table, starts) -> pa.Table:
        w = shared.value
        ids, texts, kinds, labels, y0s, y1s = (t.column(c).to_pylist() for c in ("elem_id", text, "element_type", "label", "y0", "y1"))
        take, out = [], []
        bounds = [*starts.tolist(), t.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            rows = [i for i in range(s, e) if i == s or ids[i] != ids[i - 1]]
            tops = sorted(_last if (y := y0s[i]) is None or y != y else y for i in rows)
            bottoms = sorted(_last if (y := y1s[i]) is None or y != y else -y for i in rows)
            take += rows
            for i in rows:
                x = texts[i]
                if not x or x.isspace():
                    out.append((None, None, False, False, False, []))
                    continue
                y0, y1 = y0s[i], y1s[i]
                top = 1 + bisect_left(tops, _last if y0 is None or y0 != y0 else y0)
                bottom = 1 + bisect_left(bottoms, _last if y1 is None or y1 != y1 else -y1)
                f = furniture_kind(x, kinds[i], labels[i], y0, top, bottom, len(rows))
                hyphen = misread = False
                if w is not None:
                    found = places(x, w)
                    hyphen, misread = any(p.hyphens for p in found), any(p.wrong >= 0 for p in found) or bool(stop_places(x))
                inside, number = line_candidates(x) if kinds[i] in (None, "text") and f is None else ([], False)
                out.append((f, core_key(x) if f in ("header", "footer") else None, hyphen, misread, number, list({core_key(c) for c in inside if core(c)}) if inside else []))
        got = t.take(pa.array(take, type=pa.int64())).select(keep)
        for k, (name, kind) in enumerate((("furniture", pa.string()), ("core", pa.int64()), ("hyphen", pa.bool_()), ("misread", pa.bool_()), ("number_line", pa.bool_()), ("candidates", pa.list_(pa.int64())))):
            got = got.append_column(name, pa.array([x[k] for x in out], type=kind))
        return got

    keys = ["doc_id", "page_index", "_alone"]
    slim = elements.withColumn("_alone", alone).select(*keep, "_alone", "element_type", "label", "y0", "y1", text)
    return grouped_arrow(slim, keys, run, ", ".join(f"{k} {types[k]}" for k in keep) + ", " + FLAGS, order=["elem_id"], target_rows=20_000)


def line_flags(lines: DataFrame, words: Words | None, text: str = "canonical") -> DataFrame:
    """Hyphen and misread of each recognised line, read in its region, and the key of lines inside a region that may be furniture. Without `words` only furniture is looked for.

    Wants line_id, doc_id, page_index, region_id, line_index and the text. Repeated lines count once; lines without a place are read alone.
    """
    alone = F.when(F.col("doc_id").isNull() | F.col("page_index").isNull() | F.col("region_id").isNull(), F.col("line_id"))
    shared = lines.sparkSession.sparkContext.broadcast(words)
    types = dict(lines.dtypes)
    keys = ["doc_id", "page_index", "region_id", "_alone"]

    def run(t: pa.Table, starts) -> pa.Table:
        w = shared.value
        ids, texts_all = t.column("line_id").to_pylist(), [x or "" for x in t.column(text).to_pylist()]
        take, hyphen, misread, inside_key, number = [], [], [], [], []
        bounds = [*starts.tolist(), t.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            rows = [i for i in range(s, e) if i == s or ids[i] != ids[i - 1]]
            texts = [texts_all[i] for i in rows]
            region = "\n".join(texts)
            cuts, bad = [False] * len(texts), [False] * len(texts)
            if w is not None:
                found, stops = places(region, w), stop_places(region)
                if found or stops:
                    first = [0, *accumulate(len(x) + 1 for x in texts)][:-1]
                    for p in found:
                        for h in p.hyphens:
                            cuts[bisect_right(first, h) - 1] = True
                        if p.wrong >= 0:
                            bad[bisect_right(first, p.wrong) - 1] = True
                    for a, _b, _w in stops:
                        bad[bisect_right(first, a) - 1] = True
            inside, sure = line_candidates(region) if len(texts) > 2 else ([], False)
            take += rows
            hyphen += cuts
            misread += bad
            inside_key += [core_key(x) if inside and x.strip() in inside else None for x in texts]
            number += [sure and 0 < k < len(texts) - 1 and is_number(x) for k, x in enumerate(texts)]
        got = t.take(pa.array(take, type=pa.int64())).select(["line_id", "doc_id", "page_index", "region_id"])
        for name, values, kind in (("hyphen", hyphen, pa.bool_()), ("misread", misread, pa.bool_()), ("inside", inside_key, pa.int64()), ("number_line", number, pa.bool_())):
            got = got.append_column(name, pa.array(values, type=kind))
        return got

    schema = ", ".join(f"{k} {types[k]}" for k in ("line_id", "doc_id", "page_index", "region_id")) + ", hyphen boolean, misread boolean, inside bigint, number_line boolean"
    return grouped_arrow(lines.withColumn("_alone", alone).select("line_id", *keys, "line_index", text), keys, run, schema, order=["line_index", "line_id"], target_rows=20_000)


def furniture_keys(elements: DataFrame) -> DataFrame:
    """(doc_id, key) of the running headers and footers of documents, from the flags of elements."""
    return elements.where("core IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", F.col("core").alias("key")).agg(F.count("*").alias("n"))


PLACE = ("line_id", "doc_id", "page_index", "region_id")


def furniture_lines(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id and place of recognised lines that are furniture, from the flags of elements and lines."""
    inside = lines.where("inside IS NOT NULL").select(*PLACE, F.col("inside").alias("key")).join(furniture_keys(elements), ["doc_id", "key"], "left_semi").select(*PLACE)
    places = elements.where("furniture IS NOT NULL").select("doc_id", "page_index", F.col("reading_order").alias("region_id"))
    whole = lines.join(places, ["doc_id", "page_index", "region_id"], "left_semi").select(*PLACE)
    return lines.where("number_line").select(*PLACE).unionByName(inside).unionByName(whole)


def noise_rows(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """(row_id, noise_kind) from the flags of elements and lines."""
    kind = lambda c, k: F.when(F.col(c) if isinstance(c, str) else c, F.lit(k))
    of_elements = elements.select(F.col("elem_id").alias("row_id"), F.explode(F.array(kind(F.col("furniture").isNotNull(), "furniture"), kind("hyphen", "hyphen"), kind("misread", "misread"), kind("number_line", "furniture_line"))).alias("noise_kind"))
    of_elements = of_elements.where("noise_kind IS NOT NULL")
    stood = elements.where(F.size("candidates") > 0).select(F.col("elem_id").alias("row_id"), "doc_id", F.explode("candidates").alias("key")).join(furniture_keys(elements), ["doc_id", "key"], "left_semi").select("row_id", F.lit("furniture_line").alias("noise_kind"))
    of_lines = lines.select(F.col("line_id").alias("row_id"), F.explode(F.array(kind("hyphen", "hyphen"), kind("misread", "misread"))).alias("noise_kind")).where("noise_kind IS NOT NULL")
    furniture = furniture_lines(elements, lines).select(F.col("line_id").alias("row_id"), F.lit("furniture").alias("noise_kind"))
    return of_elements.unionByName(stood).unionByName(of_lines).unionByName(furniture).distinct()


_CLOSING = "\"'”’»)]"
ITEM = re.compile(r"(?:[-*•·▪○]|\(?\d{1,2}[.)]|\[[ x]\])\s")


def paragraph_starts(lines: list[str]) -> list[int]:
    """First lines of the paragraphs of a region, by dynamic programming: a paragraph costs, and so does joining lines that look like an end and a start."""
    n = len(lines)
    if not n:
        return []
    widths = sorted(len(x) for x in lines)
    usual = max(1, widths[(3 * len(widths)) // 4])

    def join(i: int) -> float:
        a, b = lines[i].rstrip(), lines[i + 1].strip()
        if not a or not b:
            return 6.0
        c = 0.0
        if a.rstrip(_CLOSING)[-1:] in _CLOSERS:
            c += 1.0 + (2.5 if len(a) < 0.75 * usual else 0.0)
        elif a[-1] in "-¬‐‑\xad" and HYPHEN_END.search(a):
            c -= 4.0
        if (b[0] in "-*•·▪○([" or b[0].isdecimal()) and ITEM.match(b):
            c += 4.0
        return c - (2.0 if b[0].islower() else 0.0)

    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    pay = [0.0]
    for i in range(n - 1):
        pay.append(pay[-1] + join(i))
    least, first = math.inf, 0  # the cheapest start of a paragraph so far
    for j in range(1, n + 1):
        if best[j - 1] - pay[j - 1] < least - 1e-9:
            least, first = best[j - 1] - pay[j - 1], j - 1
        best[j], back[j] = least + 2.0 + pay[j - 1], first
    starts, j = [], n
    while j:
        j = back[j]
        starts.append(j)
    return starts[::-1]


def repaired(text: str, words: Words) -> list[str]:
    """Continuous paragraphs of an element: boundaries, hyphens joined, words reread."""
    lines = text.split("\n")
    starts = paragraph_starts(lines)
    out = (reread("\n".join(x.rstrip() for x in lines[a:b]), words).strip() for a, b in zip(starts, [*starts[1:], len(lines)]))
    return [p for p in out if p]


PARAGRAPHS = ("elem_id", "line_id", "doc_id", "page_index", "reading_order", "paragraph", "text")


def element_paragraphs(elements: DataFrame, flags: DataFrame, words: Words, text: str = "canonical") -> DataFrame:
    """Repaired paragraphs of all elements but page furniture, without the furniture between their lines. `flags`: those of `element_flags`."""
    stood = flags.where(F.size("candidates") > 0).select("elem_id", "doc_id", F.explode("candidates").alias("key")).join(furniture_keys(flags), ["doc_id", "key"], "left_semi")
    drop = stood.groupBy("elem_id").agg(F.collect_set("key").alias("_drop"))
    numbered = flags.groupBy("elem_id").agg(F.max(F.col("furniture").isNotNull()).alias("_furniture"), F.max("number_line").alias("_number"))
    kept = elements.where(F.length(text) > 0).join(numbered, "elem_id", "left").where("NOT coalesce(_furniture, false)").join(drop, "elem_id", "left").withColumn("_number", F.coalesce("_number", F.lit(False)))
    shared = elements.sparkSession.sparkContext.broadcast(words)

    @cache
    def udf():
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for s, numbers, keys in parts:
                yield pd.Series([repaired(without_furniture(t, frozenset() if k is None else frozenset(map(int, k))) if n or k is not None else t, shared.value) for t, n, k in zip(s, numbers, keys)], index=s.index, dtype=object)

        return F.pandas_udf(run, "array<string>")

    return kept.select("elem_id", F.lit(None).cast("bigint").alias("line_id"), "doc_id", "page_index", "reading_order", F.posexplode(udf()(F.col(text), "_number", "_drop")).alias("paragraph", "text"))


def region_paragraphs(lines: DataFrame, furniture: DataFrame, words: Words, text: str = "canonical") -> DataFrame:
    """Repaired paragraphs of the recognised lines of each region, without those in `furniture` (line_id and place). Lines without a place stand alone.

    `line_id` is the first line that is left of the region, `reading_order` the region. Furniture travels beside the lines and meets them in their region, so texts are shuffled once.
    """
    types = dict(lines.dtypes)
    rows = lines.where(F.length(text) > 0).select(*PLACE, "line_index", F.col(text).alias("_text"), F.lit(False).alias("_gone"))
    marks = furniture.select(*PLACE, F.lit(None).cast(types["line_index"]).alias("line_index"), F.lit(None).cast("string").alias("_text"), F.lit(True).alias("_gone"))
    alone = F.when(F.col("doc_id").isNull() | F.col("page_index").isNull() | F.col("region_id").isNull(), F.col("line_id"))
    shared = lines.sparkSession.sparkContext.broadcast(words)
    keys = ["doc_id", "page_index", "region_id", "_alone"]

    def run(t: pa.Table, starts) -> pa.Table:
        ids, texts, gone = (t.column(c).to_pylist() for c in ("line_id", "_text", "_gone"))
        first, number, out = [], [], []
        bounds = [*starts.tolist(), t.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            drop = {ids[i] for i in range(s, e) if gone[i]}
            left = [i for i in range(s, e) if not gone[i] and ids[i] not in drop and (i == s or ids[i] is None or gone[i - 1] or ids[i] != ids[i - 1])]
            got = repaired("\n".join(texts[i] for i in left), shared.value) if left else []
            first += left[:1] * len(got)
            number += range(len(got))
            out += got
        got = t.take(pa.array(first, type=pa.int64())).select(list(PLACE))
        return got.append_column("paragraph", pa.array(number, type=pa.int32())).append_column("text", pa.array(out, type=pa.string()))

    schema = ", ".join(f"{k} {types[k]}" for k in PLACE) + ", paragraph int, text string"
    got = grouped_arrow(rows.unionByName(marks).withColumn("_alone", alone), keys, run, schema, order=["line_index", "line_id"], target_rows=20_000)
    return got.withColumn("elem_id", F.lit(None).cast("bigint")).withColumnRenamed("region_id", "reading_order").select(*PARAGRAPHS)


def paragraphs(elements: DataFrame, lines: DataFrame, flags: DataFrame, of_lines: DataFrame, words: Words, text: str = "canonical") -> DataFrame:
    """Repaired paragraphs of elements (ids once) and of regions of recognised lines; `flags` and `of_lines` are those of `element_flags` and `line_flags`."""
    regions = region_paragraphs(lines, furniture_lines(flags, of_lines), words, text)
    return element_paragraphs(elements, flags, words, text).select(*PARAGRAPHS).unionByName(regions)
