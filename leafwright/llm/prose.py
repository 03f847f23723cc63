"""Text statistics, and whether a text is natural prose (boosted trees on the statistics).

Statistics are computed per text in one Arrow pass. The trees are trained on weak labels:
rules that are sure about clear prose or clear structural junk, and elements typed as
lists, label a bounded sample (the rows with the smallest hash of their id); texts about
which no rule is sure are not trained on. Probabilities are calibrated (Platt) on a holdout
of texts that were read and labelled by hand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.prose_holdout import HOLDOUT
from leafwright.llm.sampling import hash_sample

SAMPLE = 12_000
ENDS = ".!?。！？"
#: Common words of the languages that the corpus has, lower case.
COMMON = frozenset(
    "the of and to in is it that for was on are with as be by this have from or had not but an at which were a also if than then when while before after has will can must may its their our your his her "
    "der die das und ist nicht ein eine den dem des mit auf für von zu sich auch bei nach aber wie vor im aus wird werden hat es "
    "le la les des du de et est une un que qui dans pour pas sur avec au aux par ce mais avant après ses son sa plus "
    "el los las del y en que es una un por con para se lo no su al como pero desde más antes después "
    "il lo gli i di che è per non una un con del della delle dei nel alla ma prima dopo dal come si "
    "o a os as do da dos das em um uma não que para com por mas antes depois na no nas nos ao "
    "de het een en van is dat niet op te in voor met zijn er aan ook maar als bij naar na omdat volgens "
    "и в не на что с по как это за от из но для до к у же о все после перед при через во или со его".split()
)
#: Marks of running text in scripts without blanks between words, or with particles.
PARTICLES = "的了在是和已经于以及将把被就但而はがをにのとでもたすしまい은는을를이가의에로고다며했습니"
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NUMBER = re.compile(r"\d[\d.,]*%?")
BULLET = re.compile(r"^\s*(?:[-–•·▪○*]|\(?[0-9a-z]{1,3}[.)]|\[[ x]\]|[ivx]+[.)])\s", re.I)
KEY = re.compile(r"^\s*[^\s:=：][^:=：]{0,60}\s*[:=：]\s*\S")
LEADER = re.compile(r"[.·…_\-=]{4,}|(?:[.·] ){3,}")
GAP = re.compile(r"\t|\S {2,}\S")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
CAMEL = re.compile(r"[a-z][A-Z0-9]|\d[A-Za-z]")
#: Where a sentence ends: its mark, and what goes before the next.
SENTENCE = re.compile(r"[.!?。！？](?:(?<=[.!?])[\s\"”»)]+|(?<=[。！？]))")
LEADER_HINT, AFTER_ENUMERATOR, BROKEN, DOT_DIGIT, TIGHT = re.compile(r"[.·…_\-=](?:[.·…_\-=]{3}| [.·] [.·] )"), re.compile(r"[.)](?=\s)"), re.compile(r"-\s*\n\s*"), re.compile(r"\.(?=\d)"), re.compile(r",\S")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
ENUMERATOR = re.compile(r"(?:^|(?<=\n)|(?<=;))\s*\(?(?:\d{1,3}|[a-z])[.)](?=\s)")
GARBLED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]")  # UTF-8 read as Latin-1
CELL = re.compile(r"^(?:n/a|[-–]|\d[\d.,]*%?|null|0x[0-9a-f]+)$", re.I)

NAMES = (
    "n_chars", "n_lines", "n_words", "mean_word_length", "mean_line_length", "symbol_ratio", "digit_ratio", "letter_ratio", "line_end_share", "ends_per_100", "sentence_share", "mean_sentence_words", "longest_sentence",
    "bullet_share", "key_share", "gap_share", "leader_ratio", "pipe_ratio", "repeat_share", "entropy", "common_share", "particle_share", "single_share", "number_token_share", "longest_token", "bad_ratio", "consonant_share", "upper_ratio",
    "short_line_share", "comma_tight_ratio", "cell_share", "semicolon_ratio", "camel_share", "cjk_ratio", "lower_start_share", "starts_upper", "ends_final",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of a text, in the order of NAMES. Null and empty texts give zeros."""
    if not text or not text.strip():
        return [float(len(text or ""))] + [0.0] * (len(NAMES) - 1)
    n = len(text)
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    tokens = text.split()
    words = WORD.findall(text)
    plain = text.isascii()
    cjk = 0 if plain else len(CJK.findall(text))
    letters = sum(map(len, words))
    counts = Counter(text)
    digits = blanks = upper = 0
    entropy = 0.0
    for c, v in counts.items():
        entropy += v * math.log2(v)
        if c.isalpha():
            upper += v * c.isupper()
        elif c.isdigit():
            digits += v
        elif c.isspace():
            blanks += v
    entropy = math.log2(n) - entropy / n
    of = lambda chars: sum(map(counts.__getitem__, chars))  # noqa: E731  a Counter has 0 for what isn't there
    symbols = n - blanks - letters - digits
    leaders = LEADER.findall(text) if LEADER_HINT.search(text) else ()
    flat = LEADER.sub(" ", text) if leaders else text
    if any((flat[i - 1].isdecimal() or "a" <= flat[i - 1] <= "z") and not (i > 1 and flat[i - 2].isalpha()) for i in (m.start() for m in AFTER_ENUMERATOR.finditer(flat)) if i):
        flat = ENUMERATOR.sub(" ", flat)
    if "\n" in flat:
        if "-" in flat:
            flat = BROKEN.sub("", flat)
        flat = ("" if cjk > letters * 0.3 and " " not in text.strip() else " ").join(filter(None, map(str.strip, flat.split("\n"))))
    ends = sum(map(flat.count, ENDS)) - len(DOT_DIGIT.findall(flat))
    in_sentence, lengths, at = 0, [], 0
    for m in [*SENTENCE.finditer(flat), None]:
        s = (flat[at:] if m is None else flat[at : m.start() + 1]).strip()
        at = len(flat) if m is None else m.end()
        if not s or s[-1] not in ENDS:
            continue
        found = WORD.findall(s)
        wide = len(CJK.findall(s)) if cjk else 0
        size = len(found) if wide < 0.3 * len(s) else wide / 2 if " " not in s else max(wide / 3, len(found))
        if size >= 4 and sum(map(len, found)) > 0.55 * len(s):
            in_sentence += len(s)
            lengths.append(size)
    common = sum(map(COMMON.__contains__, map(str.lower, words)))
    trimmed = [x.strip() for x in lines]
    latin = [w for w in words if w.isascii() and len(w) > 1]
    numbers = sum(bool(NUMBER.fullmatch(t.strip("(),;:"))) for t in tokens if t[0].isdecimal() or t[0] in "(,;:)") if digits else 0
    cells = sum(bool(CELL.match(t)) for t in tokens if t[0] in "nN-–" or t[0].isdecimal())
    camel = sum(bool(CAMEL.search(t)) for t in tokens) if CAMEL.search(text) else 0
    hard = sum(bool(CONSONANTS.search(w)) for w in latin) if CONSONANTS.search(text) else 0
    return [
        float(n), float(len(lines)), float(len(words)), letters / max(1, len(words)), sum(map(len, trimmed)) / len(lines), symbols / n, digits / n, letters / n,
        sum(x[-1] in ENDS for x in trimmed) / len(lines), 100 * max(0, ends) / n, min(1.0, in_sentence / max(1, len(flat.strip()))), sum(lengths) / len(lengths) if lengths else 0.0, max(lengths, default=0.0),
        sum(bool(BULLET.match(x)) for x in lines) / len(lines), sum(bool(KEY.match(x)) for x in lines if ":" in x or "=" in x or "：" in x) / len(lines), sum(bool(GAP.search(x)) for x in lines if "  " in x or "\t" in x) / len(lines), sum(map(len, leaders)) / n,
        of("|│¦") / n, 1 - len(set(trimmed)) / len(lines), entropy, common / max(1, len(words)), (of(PARTICLES) if cjk else 0) / max(1, cjk), sum(len(t) == 1 for t in tokens) / max(1, len(tokens)),
        numbers / max(1, len(tokens)), float(max(map(len, tokens), default=0)), of("�■□¤§\\^~`<>{}[]$#@") / n + (0 if plain else 2 * len(GARBLED.findall(text)) / n),
        hard / max(1, len(latin)), upper / max(1, letters), sum(len(x) < 30 for x in trimmed) / len(lines), len(TIGHT.findall(text)) / n,
        cells / max(1, len(tokens)), of(";；") / n, camel / max(1, len(tokens)), cjk / n,
        sum(x[0].islower() for x in trimmed) / len(lines), float(trimmed[0][0].isupper() or bool(CJK.match(trimmed[0][0]))), float(trimmed[-1][-1] in ENDS),
    ]


_AT = {k: i for i, k in enumerate(NAMES)}


def weak_label(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """1 for clear prose, 0 for clear structural junk, -1 where no rule is sure. `listed`: the element is typed as a list."""
    c = lambda k: x[:, _AT[k]]
    wordy = (c("common_share") > 0.15) | ((c("cjk_ratio") > 0.4) & (c("particle_share") > 0.1))
    prose = (c("sentence_share") > 0.8) & (c("mean_sentence_words") >= 6) & wordy & (c("symbol_ratio") < 0.12) & (c("cell_share") < 0.1) & (c("bad_ratio") < 0.1) & ~listed
    structure = (c("bullet_share") > 0.7) | (c("key_share") > 0.7) | (c("gap_share") > 0.7) | (c("pipe_ratio") > 0.02) | (c("cell_share") > 0.25) | (c("leader_ratio") > 0.2) | (c("number_token_share") > 0.35) | (c("short_line_share") > 0.95)
    noise = (c("symbol_ratio") > 0.4) | (c("bad_ratio") > 0.2) | (c("longest_token") > 70) & (c("cjk_ratio") < 0.2) | (c("consonant_share") > 0.3) | (c("single_share") > 0.35) & (c("cjk_ratio") < 0.2)
    junk = (c("bad_ratio") > 0.3) | (c("sentence_share") < 0.15) & (c("ends_per_100") < 0.5) & (structure | noise | listed | (c("common_share") < 0.03) & (c("particle_share") < 0.05))
    return np.where(prose, 1, np.where(junk | listed & (c("sentence_share") < 0.3), 0, -1))


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss, with Platt calibration."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)  # both classes weigh the same
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feat, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, dtype=np.int64)
            for d in range(self.depth):
                width, first = 2**d, 2**d - 1
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    k = len(self.edges[j]) + 1
                    if k < 2:
                        continue
                    at = (node - first) * k + b[:, j]
                    gs, hs = np.bincount(at, g, width * k).reshape(width, k).cumsum(1), np.bincount(at, h, width * k).reshape(width, k).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[:, -1] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best + 1e-9
                    best[better] = gain[np.arange(width), top][better]
                    feat[first : first + width][better], cut[first : first + width][better] = j, top[better]
                side = np.where(feat[node] < 0, 0, b[np.arange(len(y)), np.maximum(feat[node], 0)] > cut[node])
                node = 2 * node + 1 + side
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feat, cut, value))
            f += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + np.where(feat[node] < 0, 0, b[rows, np.maximum(feat[node], 0)] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt scaling with the usual smoothed targets, held near the identity so that a separable holdout can't sharpen it without end."""
        f = np.clip(self.raw(x), -12, 12)
        t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        a, c, ridge = 1.0, 0.0, 5.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * f + c)))
            w = np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * f * f).sum() + ridge, (w * f).sum()], [(w * f).sum(), w.sum() + ridge]])
            a, c = np.array([a, c]) - 0.5 * np.linalg.solve(hess, [((p - t) * f).sum() + ridge * (a - 1), (p - t).sum() + ridge * c])
        self.slope, self.shift = float(max(a, 0.05)), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.raw(x), -12, 12) + self.shift)))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def train(rows: DataFrame, row_id: str = "elem_id", text: str = "canonical", kind: str = "element_type", sample: int = SAMPLE, form: Callable[[DataFrame], DataFrame] | None = None) -> Trees:
    """Trees trained on the weak labels of about `sample` rows of 40 characters and more, calibrated on the hand-checked holdout.

    `form` rewrites the sampled rows alone before they are measured. Where the rows give fewer than 20 labels of a class, the holdout is trained on as well.
    """
    picked = rows.where((F.length(text) >= 40) & F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("text"), F.coalesce(F.col(kind) == "list", F.lit(False)).alias("listed"))
    picked = hash_sample(picked, "_id", sample)
    text = "text"
    if form is not None:
        picked, text = form(picked), "canonical"
    picked = picked.select(text, "listed")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"x": pd.Series(list(_matrix(p[text])), dtype=object), "listed": p["listed"].to_numpy()})

    got = picked.mapInPandas(measure, "x array<double>, listed boolean").toArrow().to_pandas()
    hx, hy = _matrix(pd.Series([t for t, _ in HOLDOUT])), np.array([int(k) for _, k in HOLDOUT])
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), len(NAMES))
    y = weak_label(x, got.listed.to_numpy(bool)) if len(got) else np.empty(0, int)
    x, y = x[y >= 0], y[y >= 0]
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        x, y = np.concatenate([x, hx]), np.concatenate([y, hy])
    return Trees().fit(x, y).calibrate(hx, hy)


def score(rows: DataFrame, model: Trees, keep: list[str], text: str = "canonical", statistics_too: bool = True) -> DataFrame:
    """`keep`, every statistic (if wanted), prose_probability and is_prose for each row. Null and empty texts: zeros, probability 0, not prose."""
    names = NAMES if statistics_too else ()
    types = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = _matrix(p[text])
            prob = np.where(x[:, _AT["n_words"]] + x[:, _AT["cjk_ratio"]] > 0, shared.value.probability(x), 0.0) if len(p) else np.empty(0)
            out = p[keep].copy()
            for j, k in enumerate(names):
                out[k] = x[:, j]
            out["prose_probability"], out["is_prose"] = prob, prob >= 0.5
            yield out

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"{k} double" for k in names), "prose_probability double", "is_prose boolean"])
    return rows.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)
