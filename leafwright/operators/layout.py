"""Layout post-processing: thresholds, suppression, clipping, categories, reading order.

Per-page algorithms that are sequential by nature (greedy suppression, recursive cuts) run
over sorted Arrow streams with whole pages, many pages a call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import classes as C
from leafwright.functions import geometry as G
from leafwright.plans.arrow_groups import grouped_arrow
from leafwright.plans.registry import Registry
from leafwright.plans.virtual import DET, PAGE_H, PAGE_W, detections

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
SAME_CLASS, OTHER_CLASS = 0.6, 0.98
GAP_RATIO = 0.05


def page() -> Window:
    """Window over the boxes of a page. A function, as windows need a session and workers import this module without one."""
    return Window.partitionBy("page_id")


SCORED = f"{DET}, scored AS (SELECT *, {C.LABEL_SQL} AS label FROM det WHERE score_m >= {C.SCORE_SQL}), cat AS (SELECT *, {C.CATEGORY_SQL} AS category FROM scored)"


def confident(boxes: DataFrame) -> DataFrame:
    """Boxes of known classes that reach the least score of their class."""
    return boxes.where((F.col("cls_id") >= 0) & (F.col("score_m") >= C.least_score(F.col("cls_id"))))


def categorised(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("label", C.label_of(F.col("cls_id"))).withColumn("category", C.category_of(F.col("label")))


def suppress(boxes: DataFrame, keys: list[str] = ["page_id"], same: float = SAME_CLASS, other: float = OTHER_CLASS) -> DataFrame:  # noqa: B006
    """Greedy suppression per page: a box stays unless its IoU (edges as pixels) with a kept box of higher score reaches `same` for its class, `other` else.

    Ties in score keep the order of det_pos. Wants cls_id, score_m, det_pos, x0..y1; all columns come through.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes)
    ranked = boxes.withColumn("_rank", -F.col("score_m"))

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        return t.filter(pa.array(survivors(_corners(t), t.column("cls_id").to_numpy(), starts, same, other))).drop_columns(["_rank"])

    return grouped_arrow(ranked, keys, run, schema, order=["_rank", "det_pos"])


def _corners(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(k).to_numpy().astype(float) for k in ("x0", "y0", "x1", "y1")], axis=1)


def survivors(box: np.ndarray, cls: np.ndarray, starts: np.ndarray, same: float = SAME_CLASS, other: float = OTHER_CLASS) -> np.ndarray:
    """Mask of the boxes that greedy suppression keeps, for many pages at once: boxes are in falling score within their page, and pages of one size step together."""
    keep = np.ones(len(box), dtype=bool)
    sizes = np.diff(np.append(starts, len(box)))
    for n in np.unique(sizes[sizes > 1]):
        at = starts[sizes == n][:, None] + np.arange(n)
        b, c, k = box[at], cls[at], np.ones(at.shape, dtype=bool)
        area = (b[..., 2] - b[..., 0] + 1) * (b[..., 3] - b[..., 1] + 1)
        for i in range(n - 1):
            w = np.minimum(b[:, i, None, 2], b[:, i + 1 :, 2]) - np.maximum(b[:, i, None, 0], b[:, i + 1 :, 0]) + 1
            h = np.minimum(b[:, i, None, 3], b[:, i + 1 :, 3]) - np.maximum(b[:, i, None, 1], b[:, i + 1 :, 1]) + 1
            inter = np.maximum(w, 0) * np.maximum(h, 0)
            near = inter >= np.where(c[:, i + 1 :] == c[:, i, None], same, other) * (area[:, i, None] + area[:, i + 1 :] - inter)
            k[:, i + 1 :] &= ~(near & k[:, i, None])
        keep[at] = k
    return keep


def drop_page_images(boxes: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H) -> DataFrame:
    """Drop image boxes that cover nearly the page, where it has other boxes; a page that would be left empty keeps all."""
    limit = (0.82 if page_h > page_w else 0.93) * page_w * page_h
    seen = G.clip(F.lit(0), F.col("x1"), F.lit(page_w)) - G.clip(F.lit(0), F.col("x0"), F.lit(page_w))
    high = G.clip(F.lit(0), F.col("y1"), F.lit(page_h)) - G.clip(F.lit(0), F.col("y0"), F.lit(page_h))
    large = (F.col("label") == "image") & (F.count("*").over(page()) > 1) & ((seen * high).cast("double") > limit)
    marked = boxes.withColumn("_large", F.coalesce(large, F.lit(False)))
    return marked.withColumn("_every", F.min("_large").over(page())).where(~F.col("_large") | F.col("_every")).drop("_large", "_every")


def clipped(boxes: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H) -> DataFrame:
    """Boxes cut to the page with their index in score order; empty ones are dropped after numbering, so numbers may have gaps."""
    out = boxes.withColumn("box_index", F.row_number().over(page().orderBy(F.col("score_m").desc(), "det_pos")) - 1)
    for k, most in (("x0", page_w), ("x1", page_w), ("y0", page_h), ("y1", page_h)):
        out = out.withColumn(k, F.least(F.lit(most), F.col(k)) if k in ("x1", "y1") else F.greatest(F.lit(0), F.col(k)))
    return out.where("x1 > x0 AND y1 > y0")


def postprocess(boxes: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H, ordered: bool = False) -> DataFrame:
    """Thresholds, suppression, page images, numbering and clipping, with `ordered` the reading order too, in one pass over whole pages.

    The same as `suppress`, `drop_page_images`, `clipped` and `reading_order` one after the other, which shuffle the boxes for each step.
    """
    boxes = categorised(confident(boxes))
    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes) + ", box_index int" + ", reading_order int" * ordered
    limit = (0.82 if page_h > page_w else 0.93) * page_w * page_h

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        box = _corners(t)
        on_page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        keep = survivors(box, t.column("cls_id").to_numpy(), starts)
        cut = np.stack([np.maximum(box[:, 0], 0), np.maximum(box[:, 1], 0), np.minimum(box[:, 2], page_w), np.minimum(box[:, 3], page_h)], axis=1)
        seen = (np.clip(box[:, 2], 0, page_w) - np.clip(box[:, 0], 0, page_w)) * (np.clip(box[:, 3], 0, page_h) - np.clip(box[:, 1], 0, page_h))
        left = np.bincount(on_page[keep], minlength=len(starts))
        large = keep & (t.column("label").to_numpy(zero_copy_only=False) == "image") & (left[on_page] > 1) & (seen > limit)
        keep &= ~large | (np.bincount(on_page[large], minlength=len(starts)) == left)[on_page]
        nth = np.cumsum(keep)
        index = nth - 1 - np.concatenate([[0], nth])[starts][on_page]
        keep &= (cut[:, 2] > cut[:, 0]) & (cut[:, 3] > cut[:, 1])
        rows = np.flatnonzero(keep)
        if ordered:
            det = t.column("det_pos").to_numpy()
            rows = rows[np.lexsort((det[rows], on_page[rows]))]
            first = np.concatenate([[0], np.flatnonzero(np.diff(on_page[rows])) + 1]) if len(rows) else np.empty(0, dtype=int)
            sequence = [s + np.array(reading_sequence(cut[rows[s:e]], page_w, page_h), dtype=np.int64) for s, e in zip(first, np.append(first[1:], len(rows)))]
            order = np.concatenate([np.arange(len(x)) for x in sequence]) if sequence else np.empty(0, dtype=int)
            rows = rows[np.concatenate(sequence)] if sequence else rows
        out = t.take(pa.array(rows)).drop_columns(["_rank"])
        for i, k in enumerate(("x0", "y0", "x1", "y1")):
            out = out.set_column(out.column_names.index(k), k, pa.array(cut[rows, i]).cast(t.schema.field(k).type))
        out = out.append_column("box_index", pa.array(index[rows], type=pa.int32()))
        return out.append_column("reading_order", pa.array(order, type=pa.int32())) if ordered else out

    return grouped_arrow(boxes.withColumn("_rank", -F.col("score_m")), ["page_id"], run, schema, order=["_rank", "det_pos"])


def horizontal(width: Column, height: Column) -> Column:
    """Whether a page reads in lines: at least half of its boxes are 1.5 times as wide as high (no boxes: yes)."""
    valid = (width > 0) & (height > 0)
    return F.coalesce(F.avg(F.when(valid, (width >= 1.5 * height).cast("int"))) >= 0.5, F.lit(True))


def gap_segments(lo: np.ndarray, hi: np.ndarray, size: int, least_gap: int, least: int = 0) -> list[tuple[int, int]]:
    """Occupied runs of the projection of [lo, hi) on [0, size); runs closer than `least_gap` are one, and the last run reaches the end of the array if too little room follows it."""
    a, b = np.clip(lo.astype(np.int64), 0, size), np.clip(hi.astype(np.int64), 0, size)
    runs: list[tuple[int, int]] = []
    if least <= 0:  # a run is a union of intervals
        found = sorted(x for x in zip(a.tolist(), b.tolist()) if x[0] < x[1])
    else:
        depth = np.zeros(size + 1, dtype=np.int64)
        ok = b > a
        np.add.at(depth, a[ok], 1)
        np.add.at(depth, b[ok], -1)
        on = np.concatenate([[False], np.cumsum(depth)[:size] > least, [False]])
        edges = np.flatnonzero(on[1:] != on[:-1]).tolist()
        found = list(zip(edges[::2], edges[1::2]))
    for s, e in found:
        if runs and s - runs[-1][1] < max(least_gap, 1):
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((s, e))
    if runs and size - runs[-1][1] < least_gap:
        runs[-1] = (runs[-1][0], size)
    return runs


def reading_sequence(box: np.ndarray, page_w: int, page_h: int, gap_ratio: float = GAP_RATIO, least: float = 0.0) -> list[int]:
    """Order of the boxes of one page by recursive cuts at white gaps; boxes whose center lies in no segment are left out."""
    w, h = box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]
    cx, cy = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
    valid = (w > 0) & (h > 0)
    across = not valid.any() or bool((w[valid] >= 1.5 * h[valid]).mean() >= 0.5)
    axes = ((0, 2, page_w, cx), (1, 3, page_h, cy))
    axes = axes if across else axes[::-1]

    def before(i: int, j: int) -> bool:
        if across:
            return box[i, 0] < box[j, 0] if abs(box[i, 1] - box[j, 1]) < 0.5 * min(h[i], h[j]) else box[i, 1] < box[j, 1]
        return box[i, 1] < box[j, 1] if abs(box[i, 0] - box[j, 0]) < 0.5 * min(w[i], w[j]) else box[i, 0] > box[j, 0]

    out: list[int] = []
    stack = [list(range(len(box)))]
    while stack:
        part = stack.pop()
        if len(part) < 2:
            out += part
            continue
        for lo, hi, size, center in axes:
            runs = gap_segments(box[part, lo], box[part, hi], size, max(1, int(size * gap_ratio)), int(least))
            if len(runs) > 1:
                stack += [[i for i in part if s <= center[i] < e] for s, e in reversed(runs)]
                break
        else:
            done: list[int] = []
            for i in part:  # insertion by a comparator that isn't transitive: the order of detection decides
                k = len(done)
                while k and before(i, done[k - 1]):
                    k -= 1
                done.insert(k, i)
            out += done
    return out


def reading_order(boxes: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H) -> DataFrame:
    """Boxes with their reading_order (0, 1, ...); those that the cuts lose are left out."""
    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes) + ", reading_order int"

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        box = np.stack([t.column(k).to_numpy().astype(float) for k in ("x0", "y0", "x1", "y1")], axis=1)
        take, order = [], []
        for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
            seq = reading_sequence(box[s:e], page_w, page_h)
            take += [s + i for i in seq]
            order += range(len(seq))
        return t.take(pa.array(take, type=pa.int64())).append_column("reading_order", pa.array(order, type=pa.int32()))

    return grouped_arrow(boxes, ["page_id"], run, schema, order=["det_pos"])


@R.query("layout_category_profile", f"{SCORED} SELECT category, count(*) AS boxes, round(avg(score_m), 4) AS mean_score_m, min(score_m) AS min_score_m FROM cat GROUP BY category")
def layout_category_profile(spark, sf_dir):
    """Boxes and scores per category after the class thresholds."""
    return categorised(confident(detections(spark, sf_dir))).groupBy("category").agg(F.count("*").alias("boxes"), F.round(F.avg("score_m"), 4).alias("mean_score_m"), F.min("score_m").alias("min_score_m"))


@R.query("layout_clip_filter", f"""{SCORED}, c AS (SELECT page_id, det_pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score_m DESC, det_pos) - 1 AS INT) AS box_index, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least({PAGE_W}, x1) AS x1, least({PAGE_H}, y1) AS y1 FROM cat)
    SELECT * FROM c WHERE x1 > x0 AND y1 > y0""")
def layout_clip_filter(spark, sf_dir):
    return clipped(confident(detections(spark, sf_dir))).select("page_id", "det_pos", "box_index", "x0", "y0", "x1", "y1")


def _in(names) -> str:
    return "(" + ", ".join(repr(n) for n in names) + ")"


@R.query("layout_text_boxes", f"{SCORED} SELECT page_id, det_pos, label, category FROM cat WHERE category IN {_in(C.TEXT_CATEGORIES)}")
def layout_text_boxes(spark, sf_dir):
    return categorised(confident(detections(spark, sf_dir))).where(F.col("category").isin(*C.TEXT_CATEGORIES)).select("page_id", "det_pos", "label", "category")


@R.query("layout_unsupported_boxes", f"{SCORED} SELECT page_id, det_pos, cls_id, category FROM cat WHERE category IN {_in(C.UNSUPPORTED_CATEGORIES)}")
def layout_unsupported_boxes(spark, sf_dir):
    return categorised(confident(detections(spark, sf_dir))).where(F.col("category").isin(*C.UNSUPPORTED_CATEGORIES)).select("page_id", "det_pos", "cls_id", "category")


BUCKET_SQL = f"CASE WHEN category = 'table' THEN 'table' WHEN category = 'figure' THEN 'figure' WHEN category IN {_in(C.EQUATION_CATEGORIES)} THEN 'equation' WHEN category IN {_in(C.UNSUPPORTED_CATEGORIES)} THEN 'unsupported' WHEN category IN {_in(C.TEXT_CATEGORIES)} THEN 'text' ELSE 'other' END"


@R.query("layout_bucket_counts", f"{SCORED} SELECT page_id, {BUCKET_SQL} AS bucket, count(*) AS boxes FROM cat GROUP BY ALL")
def layout_bucket_counts(spark, sf_dir):
    """How many boxes of a page each branch of the page plan gets."""
    return categorised(confident(detections(spark, sf_dir))).withColumn("bucket", F.expr(BUCKET_SQL)).groupBy("page_id", "bucket").agg(F.count("*").alias("boxes"))


@R.query("bbox_geometry", f"{DET} SELECT page_id, det_pos, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, x0 AS rx, y0 AS ry, x1 - x0 AS rw, y1 - y0 AS rh FROM det")
def bbox_geometry(spark, sf_dir):
    return detections(spark, sf_dir).select("page_id", "det_pos", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), G.area("").alias("area"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), *G.to_rect("x0", "y0", "x1", "y1"))


@R.query("bbox_normalized", f"{DET} SELECT page_id, det_pos, " + ", ".join(f"CAST(trunc(({k}::FLOAT / {s}::FLOAT)::FLOAT * 1000::FLOAT) AS INT) AS n{k}" for k, s in (("x0", PAGE_W), ("y0", PAGE_H), ("x1", PAGE_W), ("y1", PAGE_H))) + " FROM det")
def bbox_normalized(spark, sf_dir):
    return detections(spark, sf_dir).select("page_id", "det_pos", *[G.normalized(k, F.lit(s)).alias("n" + k) for k, s in (("x0", PAGE_W), ("y0", PAGE_H), ("x1", PAGE_W), ("y1", PAGE_H))])


@R.query("bbox_roi", f"{DET}, r AS (SELECT page_id, det_pos, greatest(x0, 0) AS left_x, greatest(y0, 0) AS top_y, least(x1, {PAGE_W}) - greatest(x0, 0) AS roi_w, least(y1, {PAGE_H}) - greatest(y0, 0) AS roi_h FROM det) SELECT *, roi_w > 0 AND roi_h > 0 AS valid FROM r")
def bbox_roi(spark, sf_dir):
    """Crop of a box on the page; without width or height it's invalid."""
    left, top = F.greatest("x0", F.lit(0)), F.greatest("y0", F.lit(0))
    out = detections(spark, sf_dir).select("page_id", "det_pos", left.alias("left_x"), top.alias("top_y"), (F.least("x1", F.lit(PAGE_W)) - left).alias("roi_w"), (F.least("y1", F.lit(PAGE_H)) - top).alias("roi_h"))
    return out.withColumn("valid", (F.col("roi_w") > 0) & (F.col("roi_h") > 0))


NMS_CTE = f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score_m DESC, det_pos) AS k FROM cat),
walk AS (SELECT page_id, k, [{{'c': cls_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'p': det_pos}}] AS kept FROM ranked WHERE k = 1
  UNION ALL SELECT r.page_id, r.k, CASE WHEN len(list_filter(w.kept, lambda b: greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0) + 1) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0) + 1)
      >= (CASE WHEN b.c = r.cls_id THEN {SAME_CLASS}::DOUBLE ELSE {OTHER_CLASS}::DOUBLE END) * ((b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) + (r.x1 - r.x0 + 1) * (r.y1 - r.y0 + 1)
      - greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0) + 1) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0) + 1)))) = 0
      THEN list_append(w.kept, {{'c': r.cls_id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'p': r.det_pos}}) ELSE w.kept END
    FROM walk w JOIN ranked r ON r.page_id = w.page_id AND r.k = w.k + 1),
ends AS (SELECT page_id, arg_max(kept, k) AS kept FROM walk GROUP BY page_id),
survivors AS (SELECT cat.* FROM (SELECT page_id, unnest(kept).p AS det_pos FROM ends) u JOIN cat USING (page_id, det_pos))"""


@R.query("layout_nms", f"{NMS_CTE} SELECT page_id, det_pos, cls_id, score_m FROM survivors")
def layout_nms(spark, sf_dir):
    return suppress(categorised(confident(detections(spark, sf_dir)))).select("page_id", "det_pos", "cls_id", "score_m")


@R.query("layout_large_image_filter", f"""{SCORED}, l AS (SELECT *, label = 'image' AND count(*) OVER (PARTITION BY page_id) > 1 AND CAST((least({PAGE_W}, x1) - greatest(0, x0)) * (least({PAGE_H}, y1) - greatest(0, y0)) AS DOUBLE) > 0.03::DOUBLE * {PAGE_W} * {PAGE_H} AS large FROM cat),
    m AS (SELECT *, bool_and(large) OVER (PARTITION BY page_id) AS every FROM l) SELECT page_id, det_pos, label FROM m WHERE NOT large OR every""")
def layout_large_image_filter(spark, sf_dir):
    """The filter with a share that these pages reach (their largest image covers 3 to 5 % of the page)."""
    boxes = categorised(confident(detections(spark, sf_dir)))
    seen = (F.least(F.lit(PAGE_W), "x1") - F.greatest(F.lit(0), "x0")) * (F.least(F.lit(PAGE_H), "y1") - F.greatest(F.lit(0), "y0"))
    marked = boxes.withColumn("_large", (F.col("label") == "image") & (F.count("*").over(page()) > 1) & (seen.cast("double") > 0.03 * PAGE_W * PAGE_H))
    return marked.withColumn("_every", F.min("_large").over(page())).where(~F.col("_large") | F.col("_every")).select("page_id", "det_pos", "label")


SPREAD = f"{SCORED}, big AS (SELECT page_id, det_pos, label, score_m, x0 // 8 AS x0, y0 // 8 AS y0, x0 // 8 + (x1 - x0) * 7 AS x1, y0 // 8 + (y1 - y0) * 9 AS y1 FROM cat)"


@R.query("layout_page_images", f"""{SPREAD}, l AS (SELECT *, label = 'image' AND count(*) OVER (PARTITION BY page_id) > 1 AND CAST((least({PAGE_W}, x1) - least({PAGE_W}, greatest(0, x0))) * (least({PAGE_H}, y1) - least({PAGE_H}, greatest(0, y0))) AS DOUBLE) > 0.82::DOUBLE * {PAGE_W} * {PAGE_H} AS large FROM big),
    w AS (SELECT *, label = 'image' AND count(*) OVER (PARTITION BY page_id) > 1 AND CAST((least({PAGE_H}, x1) - least({PAGE_H}, greatest(0, x0))) * (least({PAGE_W}, y1) - least({PAGE_W}, greatest(0, y0))) AS DOUBLE) > 0.93::DOUBLE * {PAGE_W} * {PAGE_H} AS large FROM big)
    SELECT page_id, det_pos, label, 'portrait' AS form FROM (SELECT *, bool_and(large) OVER (PARTITION BY page_id) AS every FROM l) WHERE NOT large OR every UNION ALL SELECT page_id, det_pos, label, 'landscape' FROM (SELECT *, bool_and(large) OVER (PARTITION BY page_id) AS every FROM w) WHERE NOT large OR every""")
def layout_page_images(spark, sf_dir):
    """The filter of images as large as the page, with its own shares (0.82 upright, 0.93 lying), over boxes spread out so that some reach them."""
    b = categorised(confident(detections(spark, sf_dir)))
    left, top = F.floor(F.col("x0") / 8).cast("int"), F.floor(F.col("y0") / 8).cast("int")
    big = b.select("page_id", "det_pos", "label", "score_m", left.alias("x0"), top.alias("y0"), (left + (F.col("x1") - F.col("x0")) * 7).alias("x1"), (top + (F.col("y1") - F.col("y0")) * 9).alias("y1"))
    kept = lambda w, h, form: drop_page_images(big, w, h).select("page_id", "det_pos", "label", F.lit(form).alias("form"))
    return kept(PAGE_W, PAGE_H, "portrait").unionByName(kept(PAGE_H, PAGE_W, "landscape"))


@R.query("layout_postprocess", f"""{NMS_CTE}, c AS (SELECT page_id, label, category, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score_m DESC, det_pos) - 1 AS INT) AS box_index, score_m, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least({PAGE_W}, x1) AS x1, least({PAGE_H}, y1) AS y1 FROM survivors)
    SELECT * FROM c WHERE x1 > x0 AND y1 > y0""")
def layout_postprocess(spark, sf_dir):
    """Thresholds, suppression, page images, clipping and categories. (No image here covers a page, so the oracle leaves that step out.)"""
    return postprocess(detections(spark, sf_dir)).select("page_id", "label", "category", "box_index", "score_m", "x0", "y0", "x1", "y1")


_I = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + {p}) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + {p})"
_U = "((a.x1 - a.x0 + {p}) * (a.y1 - a.y0 + {p}) + (b.x1 - b.x0 + {p}) * (b.y1 - b.y0 + {p}) - " + _I + ")"


@R.query("iou_pairs", f"{DET} SELECT a.page_id, a.det_pos, " + ", ".join(f"round(CAST({_I.format(p=p)} AS DOUBLE) / {_U.format(p=p)}, 9) AS {n}" for p, n in ((1, "iou_pixels"), (0, "iou_plain"))) + " FROM det a JOIN det b ON a.page_id = b.page_id AND b.det_pos = a.det_pos + 1")
def iou_pairs(spark, sf_dir):
    """IoU of each box with the next one of its page, by both conventions. A window, not a self-join."""
    w = page().orderBy("det_pos")
    d = detections(spark, sf_dir)
    d = d.select("page_id", "det_pos", *[F.col(k).alias("a_" + k) for k in ("x0", "y0", "x1", "y1")], *[F.lead(k).over(w).alias("b_" + k) for k in ("x0", "y0", "x1", "y1")]).where("b_x0 IS NOT NULL")
    return d.select("page_id", "det_pos", F.round(G.iou("a_", "b_", 1), 9).alias("iou_pixels"), F.round(G.iou("a_", "b_"), 9).alias("iou_plain"))


@R.query("text_direction", f"{DET} SELECT page_id, coalesce(avg(CASE WHEN x1 > x0 AND y1 > y0 THEN CAST(x1 - x0 >= 1.5 * (y1 - y0) AS INT) END) >= 0.5, true) AS horizontal FROM det GROUP BY page_id")
def text_direction(spark, sf_dir):
    return detections(spark, sf_dir).groupBy("page_id").agg(horizontal(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("horizontal"))


PROFILE_CTE = f"""ev AS (SELECT page_id, greatest(0, x0) AS pos_x, 1 AS step FROM det WHERE least({PAGE_W}, x1) > greatest(0, x0) UNION ALL SELECT page_id, least({PAGE_W}, x1), -1 FROM det WHERE least({PAGE_W}, x1) > greatest(0, x0)),
es AS (SELECT page_id, pos_x, sum(step) AS step FROM ev GROUP BY page_id, pos_x),
prof AS (SELECT page_id, CAST(pos_x AS INT) AS start_x, CAST(lead(pos_x) OVER (PARTITION BY page_id ORDER BY pos_x) AS INT) AS end_x, CAST(sum(step) OVER (PARTITION BY page_id ORDER BY pos_x) AS BIGINT) AS depth FROM es)"""


def projection(boxes: DataFrame, lo: str = "x0", hi: str = "x1", size: int = PAGE_W) -> DataFrame:
    """Projection profile as runs (start_x, end_x, depth): opening and closing edges summed along the axis, no pixel rows."""
    a, b = F.greatest(F.lit(0), lo), F.least(F.lit(size), hi)
    edges = boxes.select("page_id", a.alias("a"), b.alias("b")).where("b > a").select("page_id", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("step")))).alias("e")).groupBy("page_id", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    w = page().orderBy("at")
    return edges.select("page_id", F.col("at").alias("start_x"), F.lead("at").over(w).alias("end_x"), F.sum("step").over(w).alias("depth")).where("end_x IS NOT NULL")


@R.query("projection_profile", f"{DET}, {PROFILE_CTE} SELECT * FROM prof WHERE end_x IS NOT NULL")
def projection_profile(spark, sf_dir):
    return projection(detections(spark, sf_dir))


GAP = int(PAGE_W * GAP_RATIO)
SEGMENT_CTE = f"""{PROFILE_CTE}, occ AS (SELECT page_id, start_x, end_x FROM prof WHERE end_x IS NOT NULL AND depth > 0),
brk AS (SELECT *, CASE WHEN start_x - lag(end_x) OVER (PARTITION BY page_id ORDER BY start_x) < {GAP} THEN 0 ELSE 1 END AS opens FROM occ),
grp AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY start_x) AS seg FROM brk),
raw AS (SELECT page_id, CAST(seg - 1 AS INT) AS segment, min(start_x) AS start_x, max(end_x) AS end_x FROM grp GROUP BY page_id, seg),
seg AS (SELECT page_id, segment, start_x, CASE WHEN segment = max(segment) OVER (PARTITION BY page_id) AND {PAGE_W} - end_x < {GAP} THEN {PAGE_W} ELSE end_x END AS end_x FROM raw)"""


def column_segments(boxes: DataFrame, size: int = PAGE_W, gap: int = GAP) -> DataFrame:
    """Segments of the profile: gaps and islands, islands nearer than `gap` merged."""
    w = page().orderBy("start_x")
    occupied = projection(boxes, size=size).where("depth > 0")
    opens = F.when(F.col("start_x") - F.lag("end_x").over(w) < gap, 0).otherwise(1)
    runs = occupied.withColumn("opens", opens).withColumn("seg", F.sum("opens").over(w)).groupBy("page_id", "seg").agg(F.min("start_x").alias("start_x"), F.max("end_x").alias("end_x"))
    last = (F.col("seg") == F.max("seg").over(page())) & (size - F.col("end_x") < gap)
    return runs.select("page_id", (F.col("seg") - 1).cast("int").alias("segment"), "start_x", F.when(last, size).otherwise(F.col("end_x")).alias("end_x"))


@R.query("projection_segments", f"{DET}, {SEGMENT_CTE} SELECT * FROM seg")
def projection_segments(spark, sf_dir):
    return column_segments(detections(spark, sf_dir))


@R.query("xycut_first_split", f"{DET}, {SEGMENT_CTE}, m AS (SELECT d.page_id, d.det_pos, s.segment FROM det d LEFT JOIN seg s ON s.page_id = d.page_id AND (d.x0 + d.x1) / 2.0 >= s.start_x AND (d.x0 + d.x1) / 2.0 < s.end_x) SELECT page_id, segment, count(*) AS boxes, segment IS NULL AS dropped FROM m GROUP BY page_id, segment")
def xycut_first_split(spark, sf_dir):
    """Boxes by the segment that holds their center; those in none would be dropped by the cut. The join is on the page."""
    d, s = detections(spark, sf_dir).withColumn("cx", (F.col("x0") + F.col("x1")) / 2), column_segments(detections(spark, sf_dir)).withColumnRenamed("page_id", "p")
    m = d.join(s, (F.col("page_id") == F.col("p")) & (F.col("cx") >= F.col("start_x")) & (F.col("cx") < F.col("end_x")), "left")
    return m.groupBy("page_id", "segment").agg(F.count("*").alias("boxes")).withColumn("dropped", F.col("segment").isNull())


@R.query("reading_order")
def reading_order_query(spark, sf_dir):
    return postprocess(detections(spark, sf_dir), ordered=True).select("page_id", "det_pos", "label", "category", "x0", "y0", "x1", "y1", "reading_order")


@R.query("reading_order_drawn", "WITH w0 AS (SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS det_pos FROM lineitem) SELECT page_id, det_pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN page_id % 2 = 1 THEN det_pos % 3 ELSE det_pos // 3 END, CASE WHEN page_id % 2 = 1 THEN det_pos // 3 ELSE det_pos % 3 END) - 1 AS INT) AS reading_order FROM w0")
def reading_order_drawn(spark, sf_dir):
    """Pages of three columns with white gaps: wide boxes (odd pages) are read column by column, high ones row by row."""
    d = detections(spark, sf_dir).select("page_id", "det_pos", (F.col("det_pos") % 3).alias("c"), F.floor(F.col("det_pos") / 3).cast("int").alias("r"))
    wide = F.col("page_id") % 2 == 1
    w, h = F.when(wide, 300).otherwise(100), F.when(wide, 100).otherwise(200)
    boxes = d.select("page_id", "det_pos", (F.col("c") * 700).alias("x0"), (F.col("r") * 400).alias("y0"), (F.col("c") * 700 + w).alias("x1"), (F.col("r") * 400 + h).alias("y1"))
    return reading_order(boxes).select("page_id", "det_pos", "reading_order")


def _numbered(spark, sf_dir, categories, name):
    boxes = categorised(confident(detections(spark, sf_dir))).where(F.col("category").isin(*categories))
    roi = (F.least("x1", F.lit(PAGE_W)) > F.greatest("x0", F.lit(0))) & (F.least("y1", F.lit(PAGE_H)) > F.greatest("y0", F.lit(0)))
    boxes = boxes.withColumn("ordinal", F.row_number().over(page().orderBy("det_pos")) - 1).where(roi)
    return boxes.select("page_id", "det_pos", "ordinal", F.format_string(f"images/page%d_{name}%d.png", "page_id", "ordinal").alias("image_path"))


def _numbered_sql(categories, name) -> str:
    return f"""{SCORED}, n AS (SELECT page_id, det_pos, x0, y0, x1, y1, CAST(row_number() OVER (PARTITION BY page_id ORDER BY det_pos) - 1 AS INT) AS ordinal FROM cat WHERE category IN {_in(categories)})
        SELECT page_id, det_pos, ordinal, 'images/page' || page_id || '_{name}' || ordinal || '.png' AS image_path FROM n WHERE least(x1, {PAGE_W}) > greatest(x0, 0) AND least(y1, {PAGE_H}) > greatest(y0, 0)"""


@R.query("figure_elements", _numbered_sql(("figure",), "fig"))
def figure_elements(spark, sf_dir):
    """Figures with their path; numbered before invalid crops are dropped."""
    return _numbered(spark, sf_dir, ("figure",), "fig")


@R.query("equation_elements", _numbered_sql(C.EQUATION_CATEGORIES, "eq"))
def equation_elements(spark, sf_dir):
    return _numbered(spark, sf_dir, C.EQUATION_CATEGORIES, "eq")


@R.query("unsupported_elements", f"{SCORED} SELECT page_id, det_pos, 'unknown' AS element_type, true AS skipped, '[Unsupported layout category: ' || category || ']' AS text FROM cat WHERE category IN {_in(C.UNSUPPORTED_CATEGORIES)}")
def unsupported_elements(spark, sf_dir):
    return layout_unsupported_boxes(spark, sf_dir).select("page_id", "det_pos", F.lit("unknown").alias("element_type"), F.lit(True).alias("skipped"), F.concat(F.lit("[Unsupported layout category: "), "category", F.lit("]")).alias("text"))


@R.query("overlay_colors", f"{DET} SELECT page_id, det_pos, CAST((cls_id * 37) % 255 AS INT) AS c0, CAST((cls_id * 67) % 255 AS INT) AS c1, CAST((cls_id * 97) % 255 AS INT) AS c2, 'layout/page_' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '_layout.png' AS overlay_path FROM det")
def overlay_colors(spark, sf_dir):
    """Colour of a box in the layout overlay and the overlay's path."""
    return detections(spark, sf_dir).select("page_id", "det_pos", *[F.pmod(F.col("cls_id") * m, F.lit(255)).alias(f"c{i}") for i, m in enumerate((37, 67, 97))], F.concat(F.lit("layout/page_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("_layout.png")).alias("overlay_path"))
