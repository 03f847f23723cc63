"""One form for texts that look the same on screen but differ in their characters.

Look-alike pairs of strings and code points (width forms, ligatures, radicals, letters of
other scripts, kinds of space and hyphen, line ends, characters of no width) are joined
by union-find into transitive classes. The member most frequent in the corpus stands
for its class, and texts are rewritten greedily, leftmost longest, by one multi-pattern
automaton between canonical decomposition and composition, which settles accents. At last
each word gets its letters from the one script that its other letters belong to, which
depends on the rewritten text alone, so what was equal stays equal and Russian stays Russian.

Kept apart, as they are visible: case, accents, line breaks, whether there is a space,
super- and subscripts, dashes longer than a hyphen, letters against digits.

Scale: the classes need only how often each code point occurs, counted on the executors
and bounded by the size of Unicode. Rewriting is a map without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.plans.lineage import cut

#: Letters of other scripts that look like the Latin letter they follow.
LETTERS = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уүγ",
    "У": "Ⲩ", "к": "κ", "Г": "Γ", "П": "Π", "Ф": "Φ",
}
#: Kana and ideographs that look like another.
IDEOGRAPHS = ("口ロ囗", "二ニ", "八ハ", "力カ", "工エ", "卜ト", "夕タ", "一ー", "へヘ", "りリ", "才オ", "千チ", "三ミ")
#: Radicals of the supplement block, each before the ideograph it looks like (those of the Kangxi block follow from Unicode).
RADICALS = "⺟母⺠民⻁虎⻄西⻅见⻆角⻉贝⻋车⻑長⻓长⻔门⻘青⻙韦⻚页⻛风⻜飞⻝食⻢马⻣骨⻤鬼⻥鱼⻦鸟⻨麦⻩黄⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻳龟"
HYPHENS = "‐‑⁃﹣－"
#: Width 0 though not of category Cf.
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def looks_like(ch: str) -> str | None:
    """The string that Unicode says a code point looks like: width forms, ligatures, radicals, letter styles, spaces, nothing for no width."""
    kind = unicodedata.category(ch)
    if ch in HYPHENS:
        return "-"
    if (kind == "Cf" and ch != "­") or ch in NO_WIDTH or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp") or ch == "\x85":
        return "\n"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    name = unicodedata.name(ch, "")
    if tag in ("<wide>", "<narrow>", "<font>") or (tag == "<compat>" and any(w in name for w in ("LIGATURE", "RADICAL", "ROMAN NUMERAL", "MICRO SIGN"))):
        return unicodedata.normalize("NFD", "".join(looks_like(c) or c for c in (chr(int(x, 16)) for x in rest.split())))
    return None


def sequences() -> tuple[str, ...]:
    """Strings of several code points that some code point looks like: ligatures and numerals."""
    return tuple(sorted({like for ch in map(chr, (*range(0x2160, 0x2180), *range(0xFB00, 0xFB50))) if (like := looks_like(ch)) and len(like) > 1}))


def rewrites(frequency: dict[str, int]) -> dict[str, str]:
    """Pattern -> its class's representative, for the strings and code points of a corpus (canonically decomposed). `frequency` holds the strings of `sequences` too."""
    classes = Classes()
    removed: list[str] = []
    for ch in frequency:
        like = looks_like(ch) if len(ch) == 1 else None
        if like == "":
            removed.append(ch)
        elif like is not None:
            classes.union(ch, like)
    for latin, others in LETTERS.items():
        for o in others:
            classes.union(latin, o)
    for radical, ideograph in zip(RADICALS[::2], RADICALS[1::2]):
        classes.union(radical, ideograph)
    out: dict[str, str] = {}
    strings: list[tuple[str, list[str]]] = []
    groups = list(classes.members().values())
    for members in groups:
        best = max(members, key=lambda m: (frequency.get(m, 0), len(m), [-ord(c) for c in m]))
        out |= {m: best for m in members if m != best and len(m) == 1}
        if any(len(m) > 1 for m in members):
            strings.append((best, members))
    for best, members in strings:
        spelled = "".join(out.get(c, c) for c in max(members, key=len))
        out |= {m: spelled for m in members if len(m) == 1}
        if len(best) == 1:  # written as one code point after all else
            out[spelled] = best
    for ch in removed:
        out[ch] = ""
    out["\r\n"] = "\n"
    # a soft hyphen shows only where the line ends
    out["­\n"], out["­\r\n"], out["­ \n"], out["­"] = "-\n", "-\n", "- \n", ""
    return out


_CYRILLIC, _GREEK = re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽ]")
_RUN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_KANA_CLASS = {g[0]: next(c for c in g if "ァ" <= c <= "ー") for g in IDEOGRAPHS if any("ァ" <= c <= "ー" for c in g)}


def _towards(first: str, last: str) -> dict[int, str]:
    """Every member of a letter class -> its member between `first` and `last`."""
    out = {}
    for latin, others in LETTERS.items():
        group = latin + others
        best = next((c for c in group if first <= c <= last), None)
        if best is not None:
            out |= {ord(c): best for c in group if c != best}
    return out


_TO = {"latin": _towards("A", "z"), "cyrillic": _towards("Ѐ", "ԯ"), "greek": _towards("Ͱ", "Ͽ")}
_AMBIGUOUS = frozenset(c for k, v in LETTERS.items() for c in k + v)
_IDEOGRAPH_OF = {c: g[0] for g in IDEOGRAPHS for c in g}


_SETTLED = re.compile("[Ѐ-ԯͰ-Ͽ" + "".join(_IDEOGRAPH_OF) + "]")
_IDEOGRAPH_RUN = re.compile("[" + "".join(_IDEOGRAPH_OF) + "]+")


def _is_kana(c: str) -> bool:
    return "ァ" <= c <= "ー" and c not in _IDEOGRAPH_OF


def _settle(m: re.Match) -> str:
    """A run of signs that are kana or ideographs: kana beside other kana, else ideographs."""
    a, b, whole = m.start(), m.end(), m.string
    base = [_IDEOGRAPH_OF[c] for c in m.group()]
    if (a and _is_kana(whole[a - 1])) or (b < len(whole) and _is_kana(whole[b])):
        return "".join(_KANA_CLASS.get(c, c) for c in base)
    return "".join(base)


def one_script(text: str) -> str:
    """Letters that fit several scripts, in that of the other letters of their word; a word of such letters only follows the word before, or the next one where a sentence or line begins, else is Latin."""
    if not _SETTLED.search(text):
        return text
    if _CYRILLIC.search(text) or _GREEK.search(text):
        text = unicodedata.normalize("NFD", text)  # an accent leaves its letter open to other scripts
        words, scripts = list(_RUN.finditer(text)), []
        for m in words:
            own = [c for c in m.group() if c not in _AMBIGUOUS and c.isalpha()]
            n = {"cyrillic": sum("Ѐ" <= c <= "ԯ" for c in own), "greek": sum("Ͱ" <= c <= "Ͽ" for c in own), "latin": sum(c < "ɐ" for c in own)}
            scripts.append(max(n, key=n.get) if any(n.values()) else None)
        following: list[str | None] = [None] * (len(words) + 1)
        for i in range(len(words) - 1, -1, -1):
            following[i] = scripts[i] or following[i + 1]
        known = following[0] or "latin"
        parts, at = [], 0
        for i, (m, script) in enumerate(zip(words, scripts)):
            opens = not script and any(c in ".!?。！？\n" for c in text[at : m.start()])
            known = script or (following[i] if opens else None) or known
            parts += [text[at : m.start()], m.group().translate(_TO[known])]
            at = m.end()
        text = unicodedata.normalize("NFC", "".join(parts) + text[at:])
    if not _IDEOGRAPH_OF.keys().isdisjoint(text):
        text = _IDEOGRAPH_RUN.sub(_settle, text)
    return text


@cache
def _decomposed() -> tuple[tuple[str, str], ...]:
    """Code points with a canonical decomposition, and it."""
    return tuple((c, d) for c in map(chr, (*range(0xC0, 0x3400), *range(0xF900, 0xFB50), *range(0x11000, 0x12000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20))) if (d := unicodedata.normalize("NFD", c)) != c)


class Rewriter:
    """Greedy leftmost-longest rewriting of texts. Texts that are canonically equivalent get the same form."""

    def __init__(self, patterns: dict[str, str]) -> None:
        import ahocorasick

        joins = {p: to for p, to in patterns.items() if len(p) > 1 and len(to) == 1 and to.isalnum()}
        first = {p[0] for p in patterns}
        #: what begins a pattern, as it stands or once it is decomposed; composed text without these stays as it is
        self.first = _any_of(first)
        self.touched = _any_of(first | {c for c, d in _decomposed() if not first.isdisjoint(d)})
        #: strings are spelled out by the first automaton, and those that are rarer than a code point joined by the second
        self.machines = []
        for step in (patterns.keys() - joins.keys(), joins.keys()):
            machine = ahocorasick.Automaton()
            for p in step:
                machine.add_word(p, (len(p), patterns[p]))
            machine.make_automaton()
            self.machines += [machine] * bool(step)

    def replaced(self, text: str) -> str:
        for machine in self.machines:
            parts, at = [], 0
            for end, (n, to) in machine.iter_long(text):
                parts.append(text[at : end - n + 1])
                parts.append(to)
                at = end + 1
            parts.append(text[at:])
            text = "".join(parts)
        return text

    def __call__(self, text: str) -> str:
        if text.isascii():
            if not self.first.search(text):
                return text
        else:
            if unicodedata.is_normalized("NFC", text) and not self.touched.search(text):
                return one_script(text)
            text = unicodedata.normalize("NFD", text)
            if not self.first.search(text):
                return one_script(unicodedata.normalize("NFC", text))
        return one_script(unicodedata.normalize("NFC", self.replaced(text) + "-" * text.endswith("­")))


def _any_of(chars: set[str]) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]") if chars else re.compile("(?!)")


def code_points(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each code point of the decomposed texts occurs, and each string of `sequences`. At most one row for each of them reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for x in sequences():
            machine.add_word(x, x)
        machine.make_automaton()
        n = np.zeros(0x110000, dtype=np.int64)
        strings: Counter[str] = Counter()
        for b in batches:
            rows = [x for x in b.column(0).to_pylist() if x]
            for t in ("\0".join(x for x in rows if x.isascii()), unicodedata.normalize("NFD", "\0".join(x for x in rows if not x.isascii()))):
                got = np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32))
                n[: len(got)] += got
                strings.update(x for _end, x in machine.iter(t))
        n[0] = 0
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([*map(chr, at.tolist()), *strings], type=pa.string()), pa.array([*n[at].tolist(), *strings.values()], type=pa.int64())], names=["ch", "n"])

    rows = texts.select(text).mapInArrow(count, "ch string, n bigint").groupBy("ch").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return dict(zip(rows.ch, rows.n))


@cache
def _rewriter(items: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(items))


def canonical_texts(texts: DataFrame, patterns: dict[str, str], text: str = "text", into: str = "canonical") -> DataFrame:
    """`texts` with a column `into` holding the one form of `text`. Null stays null, empty stays empty."""
    return texts.withColumn(into, _form_udf(tuple(sorted(patterns.items())))(F.col(text)))


def _form_udf(items: tuple[tuple[str, str], ...]):
    def one_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = _rewriter(items)
        for s in parts:
            yield s.map(rewrite, na_action="ignore")

    return F.pandas_udf(one_form, "string").asNondeterministic()  # else a filter on it would have it run twice


#: Rows of one form in one document that one task pairs with all others of it.
BLOCK = 1000


def same_look_pairs(rows: DataFrame, group: str, row_id: str, text: str = "text", canonical: str = "canonical") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one group whose canonical forms are equal and whose texts aren't.

    Ids count once. Rows without group, text or id, and texts that show nothing, have no partner. Texts travel as hashes, written once;
    groups of mere copies are dropped before the join, so only pairs of the result are made. A form that a group holds
    more than `BLOCK` times is joined in blocks, so that no task has all of its pairs.
    """
    slim = rows.where(F.col(group).isNotNull() & F.col(row_id).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).cast("long").alias("id"), F.xxhash64(text, F.lit(1)).alias("t"), F.col(canonical).alias("_form"))
    slim = cut(slim.where(F.length("_form") > 0).select("g", "id", "t", F.xxhash64("_form").alias("c"))).distinct()
    varied = slim.groupBy("g", "c").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("g", "c", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    kept = slim.join(varied, ["g", "c"])
    a = kept.select("g", "c", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("t").alias("ta"), F.col("id").alias("id_a"))
    b = kept.select("g", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("t").alias("tb"), F.col("id").alias("id_b"))
    return a.join(b, ["g", "c", "block"]).where("id_a < id_b AND ta <> tb").select("id_a", "id_b").distinct()
