"""Mix sources to target shares of the total size (soft membership, projected-gradient least squares).

1. A classifier (naive Bayes on hashed words, script runs and metadata, tempered to be
   calibrated) is fitted on the documents that carry a label and gives each unlabelled
   document a posterior over the sources; a labelled document belongs to its label.
2. Nonnegative document rates, at most `max_repeats` of the source, are fitted so that the
   expected tokens of each source meet its target: projected gradient on the sum of squared
   relative errors. Documents of one label share a rate, so they enter as one class per
   label; each unlabelled document has a rate of its own, and every step sums over them in
   one distributed pass. A rate follows from its posterior and the gradients so far (a list
   of iterations x sources), so nothing is carried between passes and nothing can be lost.
3. Rates become whole copies: floor, and one copy more for documents picked evenly along
   the sizes of the source so that their tokens make up the rest.

Hot sources are split into groups of about `group_rows` documents, each of which rounds to its own share.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.sampling import hash_sample
from leafwright.llm.tokens import TOKENIZER, with_sizes
from leafwright.plans.arrow_groups import grouped_arrow
from leafwright.plans.lineage import cut

BUCKETS = 4096
SAMPLE = 20_000
PRIOR_ROWS = 100.0
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, lang: str | None, fmt: str | None) -> np.ndarray:
    """Hashed features of a document, each once: words, pairs of letters in runs without blanks, language and format."""
    out = {crc32(f"\0lang {lang}".encode()) % BUCKETS, crc32(f"\0fmt {fmt}".encode()) % BUCKETS}
    for w in set(WORD.findall((text or "").lower())):
        if w.isascii() or len(w) < 3:
            out.add(crc32(w.encode()) % BUCKETS)
        else:
            out.update(crc32(w[i : i + 2].encode()) % BUCKETS for i in range(len(w) - 1))
    return np.fromiter(out, dtype=np.int64)


class Posterior:
    """Naive Bayes over hashed features with a temperature."""

    def __init__(self, classes: list[str], log_prior: np.ndarray, log_ratio: np.ndarray, temperature: float = 1.0) -> None:
        self.classes, self.log_prior, self.log_ratio, self.temperature = classes, log_prior, log_ratio, temperature

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([self.log_ratio[:, f].sum(axis=1) for f in feats]).reshape(len(feats), len(self.classes))

    def probabilities(self, scores: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = self.log_prior + (self.temperature if temperature is None else temperature) * scores
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_posterior(docs: DataFrame, label: str = "source", sample: int = SAMPLE) -> Posterior | None:
    """Fitted on about `sample` labelled rows, those with the smallest hash of the id; a fifth of them sets the temperature.

    Counts are summed on the executors: what comes back is classes x buckets. None without labelled rows.
    """
    labels = sorted(r[0] for r in _few(docs.where(F.col(label).isNotNull()).select(label).distinct()))
    if not labels:
        return None
    at = {c: i for i, c in enumerate(labels)}
    picked = hash_sample(docs.where(F.col(label).isNotNull()), "doc_id", sample).select(F.xxhash64("doc_id", F.lit(5)).alias("_h"), "text", "lang", "fmt", F.col(label).alias("_label"))

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n, held = np.zeros((len(labels), BUCKETS), dtype=np.int64), np.zeros(len(labels), dtype=np.int64), []
        for p in parts:
            for h, t, lang, fmt, lab in p.itertuples(index=False):
                f = features(t, lang, fmt)
                if h % 5 == 0:
                    held.append((at[lab], f.tolist()))
                else:
                    m[at[lab], f] += 1
                    n[at[lab]] += 1
        k, b = np.nonzero(m)
        yield pd.DataFrame({"k": k, "b": b, "n": m[k, b], "held": pd.Series([None] * len(k), dtype=object)})
        yield pd.DataFrame({"k": np.arange(len(labels)), "b": -1, "n": n, "held": pd.Series([None] * len(labels), dtype=object)})
        if held:
            yield pd.DataFrame({"k": [k for k, _ in held], "b": -2, "n": 1, "held": [f for _, f in held]})

    got = picked.mapInPandas(counts, "k int, b int, n bigint, held array<int>")
    table = got.where("b > -2").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counted = np.zeros((len(labels), BUCKETS))
    n = np.zeros(len(labels))
    feats, seen = table[table.b >= 0], table[table.b == -1]
    counted[feats.k, feats.b] = feats.n
    n[seen.k] = seen.n
    overall = (counted.sum(axis=0) + 0.5) / (n.sum() + 1.0)
    p = (counted + PRIOR_ROWS * overall) / (n[:, None] + PRIOR_ROWS)  # a small source looks like all until it has shown otherwise
    model = Posterior(labels, np.log((n + 1) / (n.sum() + len(labels))), np.log(p) - np.log(overall))
    tuned = got.where("b = -2").select("k", "held").toArrow().to_pandas()
    if len(tuned):
        scores = model.scores([np.asarray(f, dtype=np.int64) for f in tuned.held])
        k = tuned.k.to_numpy()
        loss = [-np.log(model.probabilities(scores, t)[np.arange(len(k)), k] + 1e-12).mean() for t in TEMPERATURES]
        model.temperature = TEMPERATURES[int(np.argmin(loss))]
    return model


MOST_SOURCES = 10_000


def _few(rows: DataFrame) -> list:
    """One row for each source. Sources are few by contract (the report has a row for each); more than `MOST_SOURCES` are refused."""
    got = rows.limit(MOST_SOURCES + 1).collect()
    if len(got) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return got


def rate_of(member: np.ndarray, cap: np.ndarray, gradients: list[np.ndarray], curvature: np.ndarray, step: float) -> np.ndarray:
    """Rates of rows of posteriors after the gradients so far, projected on [0, cap] after each."""
    w = np.zeros(len(member))
    bend = np.maximum(member @ curvature, 1e-300)
    for g in gradients:
        w = np.clip(w - step * (member @ g) / bend, 0, cap)
    return w


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None, iterations: int = 25, step: float = 0.8, sample: int = SAMPLE, group_rows: int = 50_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each document: doc_id, source, member_of (most likely source), n_tokens, rate, copies.

    `targets`: (source, share, max_repeats). Sources without documents, without a positive
    share or without repeats can't be reached: the others keep their proportions to each
    other. `total_tokens` defaults to the most at which every reachable source can meet its
    share within its repeats. Documents of other sources get rate 0. Null texts, null or
    negative sizes: see `with_sizes`; a repeated row is a document of its own.
    """
    sized = with_sizes(docs.select("doc_id", "text", "source", "n_tokens"), "text", "n_tokens", tokenizer)
    model = fit_posterior(docs, sample=sample)
    wanted = {s: (float(p or 0), int(r or 0)) for s, p, r in targets if s is not None}
    hard = {r["source"]: (r["n"], float(r["t"] or 0)) for r in _few(sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")))}
    names = sorted(s for s, (p, r) in wanted.items() if p > 0 and r > 0 and hard.get(s, (0, 0))[1] > 0)
    k = len(names)
    share = np.array([wanted[s][0] for s in names])
    share = share / share.sum() if k else share
    caps = np.array([float(wanted[s][1]) for s in names])
    tokens = np.array([hard[s][1] for s in names])
    total = float(total_tokens) if total_tokens is not None else (float((caps * tokens / share).min()) if k else 0.0)
    goal = share * total
    # the posteriors of unlabelled documents over the wanted sources; what lies on other sources counts for none
    columns = [model.classes.index(s) for s in names] if model else []

    def posteriors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            prob = model.probabilities(model.scores([features(*x) for x in zip(p.text, p.lang, p.fmt)])) if len(p) else np.zeros((0, len(model.classes)))
            best = prob.argmax(axis=1)
            yield pd.DataFrame({"doc_id": p.doc_id, "n_tokens": p.n_tokens, "member_of": pd.Series([model.classes[i] for i in best], dtype=object), "member": pd.Series([row.astype("float32").tolist() for row in prob[:, columns]], dtype=object)})

    soft = None
    if model is not None and k:
        unlabelled = docs.where(F.col("source").isNull()).withColumn("_text", F.col("text"))
        unlabelled = with_sizes(unlabelled.select("doc_id", "_text", "text", "lang", "fmt", "n_tokens"), "text", "n_tokens", tokenizer).withColumnRenamed("_text", "text")
        soft = cut(unlabelled.select("doc_id", "text", "lang", "fmt", "n_tokens").mapInPandas(posteriors, "doc_id bigint, n_tokens bigint, member_of string, member array<float>"))
        mass = soft.select(F.posexplode("member").alias("k", "p"), "n_tokens").groupBy("k").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("t")).toArrow().to_pandas()
        a = tokens.copy()
        a[mass.k.to_numpy()] += mass.t.to_numpy()
        weight = 1 / np.maximum(goal, 1e-9) ** 2
        cap_of = {s: float(c) for s, c in zip(names, caps)}
        curvature = a * weight
        gradients: list[np.ndarray] = []
        one = np.eye(k)

        def expected(history: list[np.ndarray]) -> np.ndarray:
            def part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                t = np.zeros(k)
                for p in parts:
                    if len(p):
                        m = np.array(p.member.tolist(), dtype=float).reshape(len(p), k)
                        w = rate_of(m, np.array([cap_of.get(s, 0.0) for s in p.member_of]), history, curvature, step)
                        t += (w * p.n_tokens.to_numpy(float)) @ m
                yield pd.DataFrame({"k": np.arange(k), "t": t})

            got = soft.mapInPandas(part, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).toArrow().to_pandas()
            t = rate_of(one, caps, history, curvature, step) * tokens
            t[got.k.to_numpy()] += got.t.to_numpy()
            return t

        for _ in range(iterations):
            gap = expected(gradients) - goal
            if np.abs(gap).max() <= 1e-4 * max(goal.max(), 1.0):
                break
            gradients.append(gap * weight)
        else:
            warnings.warn(f"rates after {iterations} steps still miss a target by {np.abs(gap / np.maximum(goal, 1e-9)).max():.2%}", stacklevel=2)
        rates = dict(zip(names, rate_of(one, caps, gradients, curvature, step)))
        cap_map, history = cap_of, gradients

        def soft_rates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                m = np.array(p.member.tolist(), dtype=float).reshape(len(p), k)
                w = rate_of(m, np.array([cap_map.get(s, 0.0) for s in p.member_of]), history, curvature, step) if len(p) else np.zeros(0)
                yield pd.DataFrame({"doc_id": p.doc_id, "n_tokens": p.n_tokens, "member_of": p.member_of, "rate": w})

        loose = soft.mapInPandas(soft_rates, "doc_id bigint, n_tokens bigint, member_of string, rate double")
        even = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
        loose = loose.select("doc_id", F.lit(None).cast("string").alias("source"), "member_of", "n_tokens", "rate", (F.floor("rate") + (even < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"))
    else:
        rates, loose = {}, None

    if not hard:
        held = sized.where(F.col("source").isNotNull())
        labelled = held.select("doc_id", "source", F.col("source").alias("member_of"), F.col("n_tokens").cast("long"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    else:
        groups = F.coalesce(F.create_map(*[x for s, (n, _) in hard.items() for x in (F.lit(s), F.lit(-(-n // group_rows)))])[F.col("source")], F.lit(1))
        rows = sized.where(F.col("source").isNotNull()).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), groups).cast("int").alias("_group"))
        labelled = grouped_arrow(rows, ["source", "_group"], lambda t, starts: _round_groups(t, starts, rates), "doc_id bigint, source string, member_of string, n_tokens bigint, rate double, copies int", order=["n_tokens", "doc_id"])
    if loose is None:
        loose = sized.where(F.col("source").isNull()).select("doc_id", "source", F.lit(None).cast("string").alias("member_of"), F.col("n_tokens").cast("long"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return labelled.unionByName(loose)


def whole_copies(sizes: np.ndarray, rate: float) -> np.ndarray:
    """Copies of documents sorted by size, all of one rate: floor(rate), and one more for some so that tokens come to rate * sum."""
    base = np.full(len(sizes), int(np.floor(rate + 1e-9)), dtype=np.int32)
    part = max(0.0, rate - np.floor(rate + 1e-9))
    if part < 1e-9 or not len(sizes):
        return base
    steps = np.floor(np.arange(len(sizes) + 1) * part + 0.5)
    extra = np.diff(steps) > 0
    need = part * sizes.sum() - sizes[extra].sum()
    while need:  # swap towards the rest, which shrinks with every swap and keeps its sign; sizes are sorted
        if need > 0:
            free = np.flatnonzero(~extra & (sizes > 0) & (sizes <= need))
        else:
            free = np.flatnonzero(extra & (sizes > 0) & (sizes <= -need))
        if not len(free):
            break
        i = free[-1]
        need += -sizes[i] if need > 0 else sizes[i]
        extra[i] = ~extra[i]
    return base + extra


def _round_groups(t: pa.Table, starts: np.ndarray, rates: dict[str, float]) -> pa.Table:
    sizes = t.column("n_tokens").fill_null(0).to_numpy().astype(np.int64)
    ends = np.append(starts[1:], t.num_rows)
    source = t.column("source").to_pylist()
    rate, copies = np.zeros(t.num_rows), np.zeros(t.num_rows, dtype=np.int32)
    for s, e in zip(starts, ends):
        r = rates.get(source[s], 0.0)
        rate[s:e], copies[s:e] = r, whole_copies(sizes[s:e], r)
    return pa.table({"doc_id": t.column("doc_id"), "source": t.column("source"), "member_of": t.column("source"), "n_tokens": t.column("n_tokens"), "rate": rate, "copies": pa.array(copies)})


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached against wanted for every source that has a target or documents (unlabelled ones under their most likely source)."""
    got = mixed.groupBy(F.coalesce("source", "member_of").alias("source")).agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens_available"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"), F.max("copies").alias("most_copies")
    )
    total = mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("total"))
    both = targets.select("source", "target_share", "max_repeats").join(got, "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.join(F.broadcast(total)).select(  # one row
        "source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("tokens_available").alias("tokens_available"), zero("tokens_used").alias("tokens_used"),
        zero("most_copies").alias("most_copies"), F.coalesce(F.try_divide("tokens_used", "total"), F.lit(0.0)).alias("actual_share"),
    )
