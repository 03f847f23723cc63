"""The page plan: elements built from detected boxes, recognised text and recognised tables.

Five branches (text, tables, figures, equations, unsupported) are projections of one set of
boxes; each adds its columns, and their union keeps the order of the branches. A stage that is
switched off leaves its boxes out. No branch needs a shuffle of its own: recognised text and tables
are joined by page and box, and positions come from one window over a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import classes as C
from leafwright.operators.layout import SCORED, _in, categorised, confident
from leafwright.operators.tables import REASON
from leafwright.plans.registry import Registry
from leafwright.plans.virtual import PAGE_H, PAGE_W, detections

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
COLUMNS = ("page_id", "box_index", "branch", "element_type", "label", "text", "html", "image_path", "skipped", "confidence_m", "x0", "y0", "x1", "y1")


def has_roi(page_w: int = PAGE_W, page_h: int = PAGE_H) -> Column:
    """Whether the integer rectangle of a box has an area on the page."""
    x, y, w, h = F.col("x0").cast("int"), F.col("y0").cast("int"), (F.col("x1") - F.col("x0")).cast("int"), (F.col("y1") - F.col("y0")).cast("int")
    return (F.least(x + w, F.lit(page_w)) > F.greatest(x, F.lit(0))) & (F.least(y + h, F.lit(page_h)) > F.greatest(y, F.lit(0)))


def elements_of(boxes: DataFrame, texts: DataFrame, tables: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H, ocr: bool = True, wired_tables: bool = True, formulas: bool = True, save_images: bool = True) -> DataFrame:
    """Elements of pages in the order in which the plan makes them, `position` from 0.

    `boxes`: page_id, box_index, label, category, score_m, x0, y0, x1, y1. `texts`: page_id, box_index, text of the
    recognised lines. `tables`: page_id, box_index, supported, kind, illegal (null without cells), empty_html, html. A text box without a place on the page is kept and
    skipped; one whose text wasn't recognised is kept with empty text; figures and equations without a place have no element but keep their number.
    """
    rows = boxes.withColumn("roi", has_roi(page_w, page_h))
    keys = ["page_id", "box_index"]
    none = F.lit(None).cast("string")
    order = Window.partitionBy("page_id", "is_figure").orderBy("box_index")
    rows = rows.withColumn("is_figure", F.when(F.col("category") == "figure", 1).when(F.col("category").isin(*C.EQUATION_CATEGORIES), 2).otherwise(0)).withColumn("nth", F.row_number().over(order) - 1)
    is_text, is_table = F.col("category").isin(*C.TEXT_CATEGORIES), F.col("category") == "table"
    rows = rows.withColumn("branch", F.when(is_text, 0).when(is_table, 1).when(F.col("is_figure") == 1, 2).when(F.col("is_figure") == 2, 3).when(F.col("category").isin(*C.UNSUPPORTED_CATEGORIES), 4))
    wanted = F.col("branch").isNotNull() & (F.col("branch").isin([b for b, on in ((0, ocr), (1, wired_tables), (2, True), (3, formulas), (4, True)) if on])) & (~F.col("branch").isin(2, 3) | F.col("roi"))
    rows = rows.where(wanted).join(texts.select(*keys, F.col("text").alias("_text")), keys, "left").join(tables.select(*keys, "supported", "kind", "illegal", "empty_html", F.col("html").alias("_html")), keys, "left")
    rows = rows.withColumn("valid_box", F.col("roi")).withColumn("supported", F.coalesce("supported", F.lit(False))).withColumn("kind", F.coalesce("kind", F.lit("UNKNOWN"))).withColumn("empty_html", F.coalesce("empty_html", F.lit(False))).withColumn("reason", F.expr(REASON))
    b = F.col("branch")
    picture = F.concat(F.lit("images/page"), F.col("page_id").cast("string"), F.when(b == 2, "_fig").otherwise("_eq"), F.col("nth").cast("string"), F.lit(".png"))
    text = F.when(b == 0, F.when(F.col("roi"), F.coalesce("_text", F.lit(""))).otherwise("")).when(b == 1, F.coalesce(F.concat(F.lit("[Unsupported table: "), "reason", F.lit("]")), F.lit(""))).when(b == 4, F.concat(F.lit("[Unsupported layout category: "), "category", F.lit("]"))).otherwise("")
    out = rows.select(
        "page_id", "box_index", "branch", F.when(b == 0, F.when(F.col("category") == "title", "title").otherwise("text")).when(b == 1, "table").when(b == 2, "image").when(b == 3, "equation").otherwise("unknown").alias("element_type"), "label", text.alias("text"),
        F.when((b == 1) & F.col("reason").isNull(), F.col("_html")).otherwise(none).alias("html"), F.when(b.isin(2, 3) & F.lit(save_images), picture).alias("image_path"),
        F.when(b == 0, ~F.col("roi")).when(b == 1, F.col("reason").isNotNull()).when(b == 4, True).otherwise(b == 3).alias("skipped"), F.col("score_m").alias("confidence_m"), "x0", "y0", "x1", "y1",
    )
    return out.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("branch", "box_index")) - 1)


SHIFT = 900
BOX_CTE = f"{SCORED}, bx AS (SELECT page_id, det_pos AS box_index, label, category, score_m, CAST(x0 + CASE WHEN page_id % 3 = 1 THEN {SHIFT} ELSE 0 END AS INT) AS x0, y0, CAST(x1 + CASE WHEN page_id % 3 = 1 THEN {SHIFT} ELSE 0 END AS INT) AS x1, y1 FROM cat)"


def _boxes(spark, sf_dir) -> DataFrame:
    """Confident detections; those of every third page are moved to the right, some of them off the page."""
    shift = F.when(F.col("page_id") % 3 == 1, SHIFT).otherwise(0)
    return categorised(confident(detections(spark, sf_dir))).select("page_id", F.col("det_pos").alias("box_index"), "label", "category", "score_m", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")


def _texts(boxes: DataFrame) -> DataFrame:
    """Recognised text, missing for every fourth box."""
    return boxes.where((F.col("page_id") + F.col("box_index")) % 4 != 0).select("page_id", "box_index", F.concat_ws(" ", F.lit("text"), F.col("page_id").cast("string"), F.col("box_index").cast("string")).alias("text"))


def _tables(boxes: DataFrame) -> DataFrame:
    k = F.col("page_id") + F.col("box_index")
    return boxes.where("category = 'table'").select("page_id", "box_index", (k % 5 != 1).alias("supported"), F.when(k % 2 == 0, "WIRELESS").otherwise("WIRED").alias("kind"), F.when(k % 7 != 2, k % 3 == 0).alias("illegal"), (k % 11 == 4).alias("empty_html"), F.concat(F.lit("<table>"), k.cast("string"), F.lit("</table>")).alias("html"))


def _plan_sql(ocr: bool = True, formulas: bool = True, save: bool = True) -> str:
    roi = f"(least(x1, {PAGE_W}) > greatest(x0, 0) AND least(y1, {PAGE_H}) > greatest(y0, 0))"
    k = "(page_id + box_index)"
    wanted = [b for b, on in ((0, ocr), (1, True), (2, True), (3, formulas), (4, True)) if on]
    return f"""{BOX_CTE}, cl AS (SELECT *, {roi} AS roi, CASE WHEN category IN {_in(C.TEXT_CATEGORIES)} THEN 0 WHEN category = 'table' THEN 1 WHEN category = 'figure' THEN 2 WHEN category IN {_in(C.EQUATION_CATEGORIES)} THEN 3 WHEN category IN {_in(C.UNSUPPORTED_CATEGORIES)} THEN 4 END AS branch FROM bx),
    nn AS (SELECT *, row_number() OVER (PARTITION BY page_id, branch ORDER BY box_index) - 1 AS nth FROM cl WHERE branch IS NOT NULL), kp AS (SELECT *, CASE WHEN branch <> 1 THEN NULL WHEN NOT roi THEN 'invalid_table_bbox' WHEN {k} % 5 = 1 THEN CASE WHEN {k} % 2 = 0 THEN 'wireless_table' ELSE 'table_model_unavailable' END WHEN {k} % 7 = 2 THEN 'no_cell_table' WHEN {k} % 3 = 0 THEN 'illegal_table_structure' WHEN {k} % 11 = 4 THEN 'empty_table_html' END AS reason FROM nn WHERE branch IN ({', '.join(map(str, wanted))}) AND (branch NOT IN (2, 3) OR roi))
    SELECT page_id, box_index, branch, CASE branch WHEN 0 THEN CASE WHEN category = 'title' THEN 'title' ELSE 'text' END WHEN 1 THEN 'table' WHEN 2 THEN 'image' WHEN 3 THEN 'equation' ELSE 'unknown' END AS element_type, label,
      CASE branch WHEN 0 THEN CASE WHEN roi AND {k} % 4 <> 0 THEN 'text ' || page_id || ' ' || box_index ELSE '' END WHEN 1 THEN coalesce('[Unsupported table: ' || reason || ']', '') WHEN 4 THEN '[Unsupported layout category: ' || category || ']' ELSE '' END AS text,
      CASE WHEN branch = 1 AND reason IS NULL THEN '<table>' || {k} || '</table>' END AS html, {f"CASE WHEN branch IN (2, 3) THEN 'images/page' || page_id || CASE WHEN branch = 2 THEN '_fig' ELSE '_eq' END || nth || '.png' END" if save else 'CAST(NULL AS VARCHAR)'} AS image_path,
      CASE branch WHEN 0 THEN NOT roi WHEN 1 THEN reason IS NOT NULL WHEN 4 THEN true WHEN 3 THEN true ELSE false END AS skipped, score_m AS confidence_m, x0, y0, x1, y1, CAST(row_number() OVER (PARTITION BY page_id ORDER BY branch, box_index) - 1 AS INT) AS position FROM kp"""


@R.query("page_elements", _plan_sql())
def page_elements(spark, sf_dir):
    """All stages on."""
    b = _boxes(spark, sf_dir)
    return elements_of(b, _texts(b), _tables(b))


@R.query("page_elements_stages_off", _plan_sql(ocr=False, formulas=False, save=False))
def page_elements_stages_off(spark, sf_dir):
    """Text and formulas off, images not saved: their boxes leave no element."""
    b = _boxes(spark, sf_dir)
    return elements_of(b, _texts(b), _tables(b), ocr=False, formulas=False, save_images=False)
