"""Positions and exact percentiles against plain Python."""

import random

import numpy as np
import pytest

from leafwright.plans.ranking import percentiles, running


@pytest.mark.parametrize("hot", [False, True])
def test_positions(spark, hot):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else "hot" if hot and rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.randrange(500), i, rng.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(7)
    got = {r.i: r.before for r in running(df, ["g"], ["v", "i"], "w").collect()}
    sums, want = {}, {}
    for g, v, i, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + w
    assert got == want
    whole = sorted((r.v, r.i, r.before) for r in running(df, [], ["v", "i"]).collect())
    assert [b for *_r, b in whole] == list(range(len(rows)))


def test_percentiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, 2.5, rng.random() * 100, None])) for _ in range(2000)] + [("one", 7.0), ("none", None)]
    got = {r.g: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None]
        for name, p in (("p0", 0), ("p50", 50), ("p95", 95), ("p100", 100)):
            assert abs(got[g][name] - np.percentile(v, p)) < 1e-9
    assert "none" not in got
    assert percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p": 0.5}).count() == 0
