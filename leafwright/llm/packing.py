"""Fill containers of fixed capacity with whole items (large-item matching, best fit for the rest).

Items over the capacity are cut into full pieces and one rest. Items above a third of the
capacity are matched largest with largest fitting partner, at most two to a container;
smaller ones go, in falling size, into the tightest gap that takes them.

Scale: the plan depends only on how many items there are of each size, and there are at
most `capacity` sizes. So the histogram (bounded by the capacity, whatever the data) goes
to the driver, the greedy runs there on counts (a step places all equal items into all
equal gaps at once), and items find their container by their rank within their size. Ranks come
from numbering range partitions one by one, so a size that most items share is numbered by
as many tasks as its items need. No item ever reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.plans.ranking import running



class Gaps:
    """Ranges of containers by the space they have left."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in self.ranges:
            insort(self.sizes, gap)
            self.ranges[gap] = []
        self.ranges[gap].append((first, n))

    def tightest(self, need: int, most: int) -> tuple[int, int, int] | None:
        """Up to `most` containers of the smallest gap of at least `need`, taken out: (gap, first, n)."""
        at = bisect_left(self.sizes, need)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        held = self.ranges[gap]
        first, n = held.pop()
        if n > most:
            held.append((first + most, n - most))
            n = most
        if not held:
            del self.ranges[gap]
            self.sizes.pop(at)
        return gap, first, n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, n, first container): item rank r of a size goes to container first + r - first rank. And the containers used.

    `counts`: items by size, sizes from 1 to `capacity`.
    """
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps, containers = Gaps(), 0

    def place(size: int, n: int, first: int) -> None:
        runs.append((size, used[size], n, first))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    open_sizes = list(large)
    for s in reversed(large):
        while left[s] > 0:
            at = bisect_left(open_sizes, min(s, capacity - s) + 1) - 1
            while at >= 0 and (left[open_sizes[at]] == 0 or (open_sizes[at] == s and left[s] < 2)):
                if left[open_sizes[at]] == 0:
                    open_sizes.pop(at)
                at -= 1
            if at < 0:
                n = left[s]
                place(s, n, containers)
                gaps.add(capacity - s, containers, n)
            else:
                t = open_sizes[at]
                n = left[s] // 2 if t == s else min(left[s], left[t])
                place(s, n, containers)
                place(t, n, containers)
                gaps.add(capacity - s - t, containers, n)
            containers += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s] > 0:
            found = gaps.tightest(s, left[s])
            if found is None:
                n = -(-left[s] // (capacity // s))
                gaps.add(capacity, containers, n)
                containers += n
                continue
            gap, first, n = found
            place(s, n, first)
            gaps.add(gap - s, first, n)
    return runs, containers


def pack(items: DataFrame, specs: list[tuple[str, int]], item_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row for each spec and piece: spec_name, item id, piece, pieces, tokens, container_id (0, 1, ... per spec).

    `specs` is a parameter table of (name, capacity); entries without a positive capacity are left out.
    Items of size 0 and null sizes take no space: they lie in container rank modulo the number used
    (container 0 where there is no other item). Repeated item rows are items of their own. An item within the capacity has one piece.
    """
    specs = [(n, int(c)) for n, c in specs if c is not None and c > 0]
    schema = f"spec_name string, {item_id} {dict(items.dtypes)[item_id]}, piece bigint, pieces bigint, tokens bigint, container_id bigint"
    spark = items.sparkSession
    if not specs:
        return spark.createDataFrame([], schema)
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    table = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).cast("long").alias("cap")) for i, (_, c) in enumerate(specs)])
    base = items.select(F.col(item_id), n.alias("_n")).withColumn("_s", F.explode(table)).select(item_id, "_n", "_s.spec", "_s.cap")
    pieces = F.greatest(F.ceil(F.col("_n") / F.col("cap")).cast("long"), F.lit(1))
    base = base.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    tokens = F.when(F.col("piece") < F.col("pieces") - 1, F.col("cap")).otherwise(F.col("_n") - F.col("cap") * (F.col("pieces") - 1))
    base = base.select("spec", item_id, "piece", "pieces", tokens.cast("long").alias("tokens"))
    ranked = running(base, ["spec", "tokens"], [item_id, "piece"], into="_r")  # a size that most items have is numbered in many tasks

    counted = base.groupBy("spec", "tokens").count().toArrow().to_pandas()  # at most specs x capacity rows, whatever the data
    width = max(c for _, c in specs) + 1
    run_key, run_from, run_bin, totals = [], [], [], []
    for i, (_, cap) in enumerate(specs):
        mine = counted[counted["spec"] == i]
        runs, used = plan(dict(zip(mine["tokens"].tolist(), mine["count"].tolist())), cap)
        totals.append(max(1, used))
        for s, r, _n, b in sorted(runs):
            run_key.append(i * width + s)
            run_from.append(r)
            run_bin.append(b)
    # one sortable key for (spec, size, rank): run starts are found by searching twice
    key = np.asarray(run_key, dtype=np.int64)
    tables = spark.sparkContext.broadcast((key, np.asarray(run_from, dtype=np.int64), np.asarray(run_bin, dtype=np.int64), np.asarray(totals, dtype=np.int64), [s for s, _ in specs]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, to, totals, names = tables.value
        span = int(start.max()) + 1 if len(start) else 1
        uniq = np.unique(key)
        dense = np.searchsorted(uniq, key).astype(np.float64) * span + start  # exact below 2**53
        name_arr = pa.array(names)
        for b in batches:
            spec = b.column("spec").to_numpy().astype(np.int64)
            size_ = b.column("tokens").to_numpy().astype(np.int64)
            rank = b.column("_r").to_numpy().astype(np.int64)
            out = rank % totals[spec]
            some = size_ > 0
            if some.any():
                k = np.searchsorted(uniq, spec[some] * width + size_[some]).astype(np.float64) * span
                at = np.searchsorted(dense, np.minimum(k + rank[some], k + span - 1), side="right") - 1
                out[some] = to[at] + rank[some] - start[at]
            yield pa.record_batch([name_arr.take(pa.array(spec)), b.column(item_id), b.column("piece"), b.column("pieces"), b.column("tokens"), pa.array(out)], names=["spec_name", item_id, "piece", "pieces", "tokens", "container_id"])

    return ranked.select("spec", item_id, "piece", "pieces", "tokens", "_r").mapInArrow(assign, schema)


def report(packed: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """Containers used per spec, tokens, share of space filled, and the fewest containers that could do."""
    caps = F.create_map(*[x for n, c in specs for x in (F.lit(n), F.lit(int(c or 0)).cast("long"))])
    out = packed.groupBy("spec_name").agg(F.count_if(F.col("piece") == 0).alias("items"), F.sum("tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers"))
    out = out.withColumn("capacity_tokens", caps[F.col("spec_name")])
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("long"))
