"""Mergeable percentiles over a bounded universe: compressed dyadic-tree counts.

Values are quantised to one of 2**16 leaves on a logarithmic scale (1024 leaves an
octave, so a leaf's middle is within 0.034 % of every value in it). A digest holds
counts on nodes of the dyadic tree over the leaves. Compression moves a node and its
sibling into their parent while the three together hold at most floor(eps * n / 16);
merging adds the counts of equal nodes. An inner node therefore never holds more than
eps * n / 16, in any order of merging, and as a value has 16 inner nodes above it, every
answer's rank is off by at most eps * n, deterministically.

Scale: the dyadic tree bounds a digest to some 48 / eps nodes whatever n. Rows are first
split by blocks of consecutive ids, so a group that holds a third of all rows is built by
many tasks, and digests are merged in a tree with a bounded fan-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.plans.arrow_groups import grouped_arrow

DEPTH = 16
UNIVERSE = 1 << DEPTH
PER_OCTAVE = 1024
LOWEST = 2.0**-20
METRICS = ("pipeline_call_ms", "npu_serial_ms", "cpu_only_ms", "npu_lock_wait_ms")
QUANTILES = (0.5, 0.9, 0.95, 0.99)
BLOCK = 1 << 16
FAN_IN = 256
_NONE = UNIVERSE - 1  # the code of a value that doesn't count; the top leaf is never used for a value


def leaf_of(value: Column) -> Column:
    """Leaf of a value; null, NaN, infinite and negative values get the code for none."""
    v = value.cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    code = F.floor(F.log2(v / F.lit(LOWEST)) * F.lit(float(PER_OCTAVE))).cast("int") + 1
    return F.when(~good | v.isNull(), F.lit(_NONE)).when(v < LOWEST, F.lit(0)).otherwise(F.least(code, F.lit(UNIVERSE - 2))).cast("int")


def value_of(leaf: np.ndarray) -> np.ndarray:
    """Middle of a leaf."""
    leaf = np.asarray(leaf, dtype=np.float64)
    return np.where(leaf <= 0, 0.0, LOWEST * np.exp2((leaf - 0.5) / PER_OCTAVE))


def compress(gid: np.ndarray, node: np.ndarray, count: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add equal nodes and compress, for many digests at once. Root is node 1, leaf x is UNIVERSE + x.

    Returns (gid, node, count) sorted by gid and node.
    """
    if not len(gid):
        return gid.astype(np.int64), node.astype(np.int64), count.astype(np.int64)
    width = 2 * UNIVERSE
    key, inv = np.unique(gid.astype(np.int64) * width + node.astype(np.int64), return_inverse=True)
    total = np.bincount(inv, weights=count.astype(np.float64)).astype(np.int64)
    n_of = np.bincount(gid.astype(np.int64), weights=count.astype(np.float64))
    limit_of = np.floor(eps * n_of / DEPTH).astype(np.int64)
    big = limit_of[key // width] > 0  # a digest of fewer than 16 / eps values stays exact
    done_key: list[np.ndarray] = [key[~big]]
    done_count: list[np.ndarray] = [total[~big]]
    key, total = key[big], total[big]
    level_of = lambda k: np.frexp((k % width).astype(np.float64))[1] - 1
    levels = level_of(key)
    by_level = {d: (key[levels == d], total[levels == d]) for d in range(DEPTH + 1)}
    for d in range(DEPTH, 0, -1):
        k, c = by_level[d]
        if not len(k):
            continue
        g, v = k // width, k % width
        parent = g * width + (v >> 1)
        up, pos = np.unique(parent, return_inverse=True)
        pair = np.bincount(pos, weights=c.astype(np.float64)).astype(np.int64)
        pk, pc_ = by_level[d - 1]
        held = np.zeros(len(up), dtype=np.int64)
        if len(pk):
            at = np.searchsorted(pk, up)
            ok = (at < len(pk)) & (pk[np.minimum(at, len(pk) - 1)] == up)
            held[ok] = pc_[at[ok]]
        move = pair + held <= limit_of[up // width]
        stay = ~move[pos]
        done_key.append(k[stay])
        done_count.append(c[stay])
        if move.any():
            allk = np.concatenate([pk, up[move]])
            allc = np.concatenate([pc_, pair[move]])
            nk, ni = np.unique(allk, return_inverse=True)
            by_level[d - 1] = (nk, np.bincount(ni, weights=allc.astype(np.float64)).astype(np.int64))
    done_key.append(by_level[0][0])
    done_count.append(by_level[0][1])
    k, c = np.concatenate(done_key), np.concatenate(done_count)
    order = np.argsort(k, kind="stable")
    return k[order] // width, k[order] % width, c[order]


def read_quantiles(gid: np.ndarray, node: np.ndarray, count: np.ndarray, groups: int, quantiles: tuple[float, ...] = QUANTILES) -> np.ndarray:
    """Values at the quantiles of many digests, a row each: the upper end of the node at which rank ceil(q n) is reached.

    NaN for a digest without nodes.
    """
    out = np.full((groups, len(quantiles)), np.nan)
    if not len(node):
        return out
    level = np.frexp(node.astype(np.float64))[1] - 1
    size = np.left_shift(np.int64(1), DEPTH - level)
    upper = (node - np.left_shift(np.int64(1), level)) * size + size - 1
    order = np.lexsort((size, upper, gid))
    cum, upper = np.cumsum(count[order]), upper[order]
    present, first = np.unique(gid[order], return_index=True)
    base = np.where(first > 0, cum[first - 1], 0)
    n = cum[np.append(first[1:], len(cum)) - 1] - base
    for j, q in enumerate(quantiles):
        want = base + np.maximum(1, np.ceil(q * n - 1e-9).astype(np.int64))
        out[present, j] = value_of(upper[np.searchsorted(cum, want)])
    return out


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, type=kind))


def _emit(table: pa.Table, starts: np.ndarray, keys: list[str], metrics: int, gid: np.ndarray, node: np.ndarray, count: np.ndarray) -> pa.Table:
    """gid = group position * metrics + metric. One row for each group and metric that has a value."""
    present, first = np.unique(gid, return_index=True)
    rows = table.take(pa.array(starts[present // metrics]))
    cols = {k: rows.column(k) for k in keys}
    offsets = np.append(first, len(gid))
    cols["metric"] = pa.array((present % metrics).astype(np.int32))
    cols["n"] = pa.array(np.add.reduceat(count, first) if len(count) else count.astype(np.int64), type=pa.int64())
    cols["node"] = _lists(offsets, node, pa.int32())
    cols["cnt"] = _lists(offsets, count, pa.int64())
    return pa.table(cols)


def build(df: DataFrame, keys: list[str], values: list[str], row_id: str, eps: float = 0.005, block: int = BLOCK) -> DataFrame:
    """Digests of each value column per `keys` and id block. Repeated ids count once (repeats are whole rows).

    Rows without an id count each. Result: keys, _block, metric (position in `values`), n, node, cnt.
    The one shuffle carries the id and the quantised values, 16 bits each.
    """
    packed = [(leaf_of(F.col(c)) - UNIVERSE // 2).cast("short") for c in values]
    types = dict(df.select(*keys).dtypes)
    rows = df.select(*keys, F.col(row_id).cast("long").alias("_id"), *[p.alias(f"_v{i}") for i, p in enumerate(packed)])
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("_id") / F.lit(block)).cast("long"), F.floor(F.rand(7) * 1024).cast("long") - F.lit(1 << 40)))
    by = [*keys, "_block"]
    m = len(values)

    def digest(t: pa.Table, starts: np.ndarray) -> pa.Table:
        n = t.num_rows
        group = np.zeros(n, dtype=np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        ids = t.column("_id").combine_chunks()
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        idv = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((idv, nulls, group))
        keep = np.ones(n, dtype=bool)
        if n > 1:
            a, b = order[1:], order[:-1]
            keep[a] = ~((group[a] == group[b]) & (idv[a] == idv[b]) & ~nulls[a] & ~nulls[b])
        gids, nodes = [], []
        for i in range(m):
            leaf = t.column(f"_v{i}").to_numpy().astype(np.int64) + UNIVERSE // 2
            ok = keep & (leaf != _NONE)
            gids.append(group[ok] * m + i)
            nodes.append(leaf[ok] + UNIVERSE)
        gid, node = np.concatenate(gids), np.concatenate(nodes)
        gid, node, count = compress(gid, node, np.ones(len(gid), dtype=np.int64), eps)
        return _emit(t, starts, by, m, gid, node, count)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _block bigint, metric int, n bigint, node array<int>, cnt array<bigint>"
    return grouped_arrow(rows, by, digest, schema)


def _merged(digests: DataFrame, keys: list[str], eps: float) -> DataFrame:
    types = dict(digests.select(*keys).dtypes)
    by = [*keys, "metric"]

    def add(t: pa.Table, starts: np.ndarray) -> pa.Table:
        lens = t.column("node").combine_chunks()
        per_row = np.diff(lens.offsets.to_numpy())
        group = np.zeros(t.num_rows, dtype=np.int64)
        group[starts[1:]] = 1
        gid = np.repeat(np.cumsum(group), per_row)
        node = lens.flatten().to_numpy().astype(np.int64)
        count = t.column("cnt").combine_chunks().flatten().to_numpy().astype(np.int64)
        gid, node, count = compress(gid, node, count, eps)
        out = _emit(t, starts, by, 1, gid, node, count)
        return out.drop_columns(["metric"]).append_column("metric", t.take(pa.array(starts[np.unique(gid)])).column("metric")).select([*keys, "metric", "n", "node", "cnt"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", metric int, n bigint, node array<int>, cnt array<bigint>"
    return grouped_arrow(digests.select(*keys, "metric", "node", "cnt"), by, add, schema, target_rows=4_000)


def merge(digests: DataFrame, keys: list[str], eps: float = 0.005, block: str | None = None, levels: int = 1) -> DataFrame:
    """Digests of coarser `keys`, by adding nodes. With `block`, a tree: each of `levels` steps merges FAN_IN blocks."""
    if block is not None:
        for _ in range(levels - 1):
            digests = digests.withColumn(block, F.floor(F.col(block) / F.lit(FAN_IN)).cast("long"))
            digests = _merged(digests, [*keys, block], eps)
    return _merged(digests, keys, eps)


def levels_for(first: int | None, last: int | None, block: int = BLOCK) -> int:
    """Merge levels for ids from `first` to `last`, so that no step merges more than FAN_IN blocks of a group."""
    span, levels = max(1, ((last or 0) - (first or 0)) // block + 1), 1
    while span > FAN_IN:
        span, levels = -(-span // FAN_IN), levels + 1
    return levels


def percentiles(digests: DataFrame, keys: list[str], values: list[str], eps: float = 0.005, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row for each digest: keys, metric name, n, a column per quantile, and the guaranteed rank error."""
    names = ["p" + f"{q * 100:g}".replace(".", "_") for q in quantiles]
    types = dict(digests.select(*keys).dtypes)

    def read(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            nodes, counts = b.column("node"), b.column("cnt")
            gid = np.repeat(np.arange(b.num_rows), np.diff(nodes.offsets.to_numpy()))
            got = read_quantiles(gid, nodes.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), b.num_rows, quantiles)
            names_of = pa.array(values, type=pa.string())
            n = b.column("n").to_numpy()
            cols = {k: t.column(k) for k in keys}
            cols["metric"] = names_of.take(b.column("metric"))
            cols["n"] = t.column("n")
            for j, name in enumerate(names):
                cols[name] = pa.array(got[:, j])
            cols["rank_error"] = pa.array(np.floor(eps * n / DEPTH) * DEPTH, type=pa.float64())
            yield from pa.table(cols).to_batches()

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", metric string, n bigint, " + ", ".join(f"{n} double" for n in names) + ", rank_error double"
    return digests.mapInArrow(read, schema)
