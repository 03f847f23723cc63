"""Positions within ordered groups of any size, without gathering a group in one task.

The rows are range-partitioned by group and order, numbered within each partition, and the
partitions' totals, one row for a group and partition, give what goes before. A group that holds
most rows is spread over as many partitions as its order allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.plans.arrow_groups import key_changes
from leafwright.plans.lineage import cut


def running(df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str | None = None, into: str = "before") -> DataFrame:
    """`df` with `into`: the weights (or the number) of the rows of the same group that go before, in the order of `order`, which should tell rows apart."""
    groups, order = list(groups), list(order)
    rows = df.withColumn("_weight", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            w = t.column("_weight").to_numpy()
            key = tuple(t.column(g)[0].as_py() for g in groups)
            starts = np.concatenate([[0], key_changes(t, groups)]).astype(int) if groups else np.array([0])
            before = np.concatenate([[0], np.cumsum(w)[:-1]])
            base = np.zeros(len(starts), dtype=np.int64)
            base[0] = total if key == last else 0
            local = before - np.repeat(before[starts], np.diff(np.append(starts, len(w)))) + np.repeat(base, np.diff(np.append(starts, len(w))))
            last = tuple(t.column(g)[len(w) - 1].as_py() for g in groups)
            total = int(local[-1] + w[-1])
            yield from t.append_column("_local", pa.array(local, type=pa.int64())).append_column("_part", pa.array(np.full(len(w), part), type=pa.int32())).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _local bigint, _part int"
    numbered = cut(rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).mapInArrow(number, schema))
    totals = numbered.groupBy(*groups, "_part").agg(F.sum("_weight").alias("_sum"))
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds some of the group
    offsets = totals.select(*[F.col(g).alias("_g_" + g) for g in groups], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col("_g_" + g)) for g in groups], F.col("_part") == F.col("_p"))
    return numbered.join(offsets, same).select(*df.columns, (F.col("_local") + F.col("_offset")).alias(into))


def percentiles(rows: DataFrame, groups: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group by name, interpolated on rank p (n - 1). Null values are left out; groups without any have no row.

    Values are counted before they are ordered, so ties cost one row.
    """
    return percentiles_of_counts(rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), groups, points)


def percentiles_of_counts(counted: DataFrame, groups: Sequence[str], points: dict[str, float]) -> DataFrame:
    """`percentiles` of values `_v` that are counted in `_n`, each value once for its group."""
    at = running(counted, groups, ["_v"], "_n", "_before").withColumn("_end", F.col("_before") + F.col("_n"))
    size = at.groupBy(*groups).agg(F.max("_end").alias("_size")).select(*[F.col(g).alias("_s_" + g) for g in groups], "_size")
    both = at.join(size, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col("_s_" + g)) for g in groups], F.lit(True)))
    out = []
    for name, p in points.items():
        rank = F.lit(p) * (F.col("_size") - 1)
        low = F.floor(rank)
        pick = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_end")), F.col("_v")))
        a, b = pick(low), pick(F.least(low + 1, F.col("_size") - 1))
        out.append((a + (b - a) * F.max(rank - low)).alias(name))
    return both.groupBy(*groups).agg(*out)
