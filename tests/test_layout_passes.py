"""The single pass over pages gives what its steps give one after the other."""

import random

import numpy as np
import pytest

from leafwright.operators import layout as L

BOX = "page_id bigint, det_pos int, cls_id int, score_m int, x0 int, y0 int, x1 int, y1 int"


def boxes(rng, pages=120):
    rows = []
    for p in range(pages):
        for d in range(rng.randint(1, 9)):
            if rng.random() < 0.2:
                x, y, w, h = rng.randint(-50, 30), rng.randint(-50, 30), rng.randint(80, 160), rng.randint(80, 160)
            else:
                x, y, w, h = rng.randint(-20, 110), rng.randint(-20, 110), rng.randint(0, 60), rng.randint(0, 60)
            rows.append((p, d, rng.choice([1, 1, 1, 2, 8, 7, 23, -1]), rng.choice([300, 500, 700, 900]), x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("size", [(100, 120), (120, 100)])
def test_one_pass_equals_the_steps(spark, size):
    df = spark.createDataFrame(boxes(random.Random(sum(size))), BOX)
    w, h = size
    steps = L.clipped(L.drop_page_images(L.suppress(L.categorised(L.confident(df))), w, h), w, h)
    once = L.postprocess(df, w, h)
    key = lambda t: sorted(tuple(r) for r in t.select("page_id", "det_pos", "label", "box_index", "x0", "y0", "x1", "y1").collect())
    assert key(steps) == key(once) and len(key(once)) > 100
    order = lambda t: sorted((r.page_id, r.reading_order, r.det_pos) for r in t.collect())
    assert order(L.reading_order(steps, w, h)) == order(L.postprocess(df, w, h, ordered=True))
    assert L.postprocess(df.limit(0), ordered=True).count() == 0


def plain_suppression(rows):
    kept = []
    for i, (b, c) in enumerate(rows):
        for j in kept:
            a, d = rows[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
            inter = max(w, 0) * max(h, 0)
            union = (a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - inter
            if inter >= (0.6 if c == d else 0.98) * union:
                break
        else:
            kept.append(i)
    return kept


def test_suppression_of_many_pages_at_once():
    rng = random.Random(3)
    pages = [[((x := rng.randint(0, 30), y := rng.randint(0, 30), x + rng.randint(5, 30), y + rng.randint(5, 30)), rng.randint(0, 2)) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    box, cls = np.array([b for p in pages for b, _ in p], dtype=float), np.array([c for p in pages for _, c in p])
    starts = np.cumsum([0, *map(len, pages)])[:-1]
    got = L.survivors(box, cls, starts)
    for s, p in zip(starts, pages):
        assert np.flatnonzero(got[s : s + len(p)]).tolist() == plain_suppression(p)


def plain_segments(lo, hi, size, gap, least):
    on = [sum(a <= x < b for a, b in zip(lo, hi)) > least for x in range(size)]
    runs, x = [], 0
    while x < size:
        if on[x]:
            e = x
            while e < size and on[e]:
                e += 1
            if runs and x - runs[-1][1] < gap:
                runs[-1] = (runs[-1][0], e)
            else:
                runs.append((x, e))
            x = e
        x += 1
    if runs and size - runs[-1][1] < gap:
        runs[-1] = (runs[-1][0], size)
    return runs


def test_segments_with_and_without_counts():
    rng = random.Random(9)
    for _ in range(1500):
        n, size = rng.randint(0, 8), rng.randint(5, 40)
        lo = np.array([rng.randint(-5, size + 5) for _ in range(n)], dtype=float)
        hi = lo + np.array([rng.randint(0, 12) for _ in range(n)])
        for least in (0, 1):
            gap = rng.randint(1, 6)
            assert L.gap_segments(lo, hi, size, gap, least) == plain_segments(np.maximum(lo, 0), np.minimum(hi, size), size, gap, least)
