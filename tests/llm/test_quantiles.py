import random
from datetime import date

import numpy as np
import pytest

from leafwright.llm import quantile_digest as qd

SCHEMA = "id bigint, g string, day date, v double, metric string, extra int"
KEYS = ["g"]


def rank_error(values, got, q):
    v = np.sort(values)
    want = max(1, int(np.ceil(q * len(v))))
    low, high = np.searchsorted(v, got * (1 - 4e-4)) + 1, np.searchsorted(v, got * (1 + 4e-4), "right")
    return max(0, low - want, want - high)


def result(digests, eps):
    return {r.g: r for r in qd.percentiles(digests, KEYS, ["v"], eps).collect()}


def test_rank_error_stays_within_the_bound_in_any_merge_order(spark):
    rng = np.random.default_rng(3)
    eps, rows = 0.02, []
    values = {"big": rng.lognormal(5, 3, 30_000), "ties": np.repeat([5.0, 7.0], 4000), "few": np.array([1.0, 2.0, 3.0]), None: rng.random(500)}
    i = 0
    for g, vs in values.items():
        for v in vs:
            rows.append((i, g, date(2024, 1, 1 + i % 5), float(v), "clash", 1))
            i += 1
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:200], SCHEMA)  # repeats count once
    built = qd.build(df, ["g", "day"], ["v"], "id", eps, block=4096)
    direct = qd.merge(qd.build(df, KEYS, ["v"], "id", eps, block=1 << 14), KEYS, eps, block="_block", levels=2)
    tree = qd.merge(qd.merge(built, ["g", "day"], eps, block="_block"), KEYS, eps)
    for digests in (direct, tree):
        for g, r in result(digests, eps).items():
            assert r.n == len(values[g])
            for q, got in zip(qd.QUANTILES, (r.p50, r.p90, r.p95, r.p99)):
                assert rank_error(values[g], got, q) <= eps * r.n + 1e-9
            assert r.rank_error <= eps * r.n


def test_sizes_are_bounded():
    rng = np.random.default_rng(0)
    leaf = rng.integers(0, qd.UNIVERSE, 200_000) + qd.UNIVERSE
    _g, node, count = qd.compress(np.zeros(len(leaf), dtype=np.int64), leaf, np.ones(len(leaf), dtype=np.int64), 0.02)
    assert count.sum() == len(leaf) and len(node) <= 48 / 0.02


def test_values_that_do_not_count(spark):
    rows = [(1, "a", None, None, None, 1), (2, "a", None, float("nan"), None, 1), (3, "a", None, -1.0, None, 1), (4, "a", None, float("inf"), None, 1), (5, "a", None, 0.0, None, 1), (6, "b", None, None, None, 1), (None, "a", None, 8.0, None, 1), (None, "a", None, 8.0, None, 1)]
    got = result(qd.merge(qd.build(spark.createDataFrame(rows, SCHEMA), KEYS, ["v"], "id"), KEYS, block="_block"), 0.005)
    assert set(got) == {"a"} and got["a"].n == 3 and got["a"].p50 == pytest.approx(8.0, rel=4e-4)
    empty = qd.merge(qd.build(spark.createDataFrame([], SCHEMA), KEYS, ["v"], "id"), KEYS, block="_block")
    assert qd.percentiles(empty, KEYS, ["v"]).count() == 0


def test_levels():
    assert [qd.levels_for(None, None), qd.levels_for(0, qd.BLOCK * 300), qd.levels_for(0, qd.BLOCK * 70_000)] == [1, 2, 3]
