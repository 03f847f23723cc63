"""Page elements: types, flags, Markdown, JSON forms and reports.

Elements come from the content_list table, ids once. Nested JSON is built with collect and
sort within a page and then a document, the two natural groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.classes import LABELS
from leafwright.operators.stats import PAGES, _us, pages, to_us
from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
EL = "el AS (SELECT DISTINCT ON (elem_id) * FROM content_list)"
PREVIEW = 96
SEPARATOR = "\n---\n\n"


def elements(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "content_list").dropDuplicates(["elem_id"])


def filled(c: str) -> Column:
    """The column, empty for null."""
    return F.coalesce(F.col(c), F.lit(""))


def is_unsupported() -> Column:
    return F.coalesce(F.col("element_type") == "unknown", F.lit(False)) | filled("text").contains("[Unsupported layout category:")


def is_fallback() -> Column:
    kind = F.coalesce(F.col("element_type"), F.lit(""))
    return F.coalesce(F.col("skipped"), F.lit(False)) & (((kind == "table") & (filled("text") != "")) | kind.isin("equation", "image"))


def element_markdown() -> Column:
    """Markdown of one element; every fragment that isn't empty ends with a blank line."""
    kind, text, html, image = F.coalesce("element_type", F.lit("unknown")), filled("text"), filled("html"), filled("image_path")
    picture = F.when(image != "", F.concat(F.lit("![]("), image, F.lit(")"))).otherwise("")
    body = (
        F.when(kind == "title", F.concat(F.when(F.col("label") == "doc_title", "# ").otherwise("## "), text))
        .when(kind == "table", F.when(html != "", html).otherwise(text))
        .when(kind == "image", picture)
        .when(kind == "equation", F.when(image != "", picture).otherwise(text))
        .otherwise(text)
    )
    dropped = F.coalesce(F.col("skipped"), F.lit(False)) & (text == "") & (html == "")
    return F.when(dropped | (body == ""), "").otherwise(F.concat(body, F.lit("\n\n")))


MD_SQL = r"""CASE WHEN (coalesce(skipped, false) AND coalesce(text, '') = '' AND coalesce(html, '') = '') THEN '' ELSE
  (SELECT CASE WHEN b = '' THEN '' ELSE b || chr(10) || chr(10) END FROM (SELECT CASE coalesce(element_type, 'unknown')
    WHEN 'title' THEN (CASE WHEN label = 'doc_title' THEN '# ' ELSE '## ' END) || coalesce(text, '') WHEN 'table' THEN CASE WHEN coalesce(html, '') <> '' THEN html ELSE coalesce(text, '') END
    WHEN 'image' THEN CASE WHEN coalesce(image_path, '') <> '' THEN '![](' || image_path || ')' ELSE '' END
    WHEN 'equation' THEN CASE WHEN coalesce(image_path, '') <> '' THEN '![](' || image_path || ')' ELSE coalesce(text, '') END ELSE coalesce(text, '') END AS b)) END"""
ORDER = "reading_order, elem_id"


def joined(by: list[str], order: list[str], value: Column, separator: str = "") -> Column:
    """Ordered concatenation within a group."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), separator)


@R.query("element_markdown", f"WITH {EL} SELECT elem_id, {MD_SQL} AS markdown FROM el")
def element_markdown_query(spark, sf_dir):
    return elements(spark, sf_dir).select("elem_id", element_markdown().alias("markdown"))


@R.query("page_markdown", f"WITH {EL} SELECT doc_id, page_index, string_agg({MD_SQL}, '' ORDER BY {ORDER}) AS markdown FROM el GROUP BY doc_id, page_index")
def page_markdown(spark, sf_dir):
    return elements(spark, sf_dir).withColumn("md", element_markdown()).groupBy("doc_id", "page_index").agg(joined([], ["reading_order", "elem_id"], F.col("md")).alias("markdown"))


@R.query("document_markdown", f"WITH {EL}, pm AS (SELECT doc_id, page_index, string_agg({MD_SQL}, '' ORDER BY {ORDER}) AS md FROM el GROUP BY doc_id, page_index) SELECT doc_id, string_agg(md, chr(10) || '---' || chr(10) || chr(10) ORDER BY page_index) AS markdown, count(*) AS pages FROM pm GROUP BY doc_id")
def document_markdown(spark, sf_dir):
    """Pages joined by a rule, also before an empty page."""
    return page_markdown(spark, sf_dir).groupBy("doc_id").agg(joined([], ["page_index"], F.col("markdown"), SEPARATOR).alias("markdown"), F.count("*").alias("pages"))


@R.query("page_element_counts", f"WITH {EL} SELECT doc_id, page_index, count(*) AS elements, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE coalesce(skipped, false) AND ((element_type = 'table' AND coalesce(text, '') <> '') OR element_type IN ('equation', 'image'))) AS fallback, count(*) FILTER (WHERE coalesce(element_type = 'unknown', false) OR contains(coalesce(text, ''), '[Unsupported layout category:')) AS unsupported, count(*) FILTER (WHERE coalesce(text, '') <> '') AS text_elements FROM el GROUP BY doc_id, page_index")
def page_element_counts(spark, sf_dir):
    return elements(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count("*").alias("elements"), F.count_if("skipped").alias("skipped"), F.count_if(is_fallback()).alias("fallback"), F.count_if(is_unsupported()).alias("unsupported"), F.count_if(filled("text") != "").alias("text_elements"))


@R.query("document_skipped", f"WITH {EL} SELECT doc_id, count(*) FILTER (WHERE skipped) AS skipped_elements FROM el GROUP BY doc_id")
def document_skipped(spark, sf_dir):
    return elements(spark, sf_dir).groupBy("doc_id").agg(F.count_if("skipped").alias("skipped_elements"))


def preview(c: str, size: int = PREVIEW) -> Column:
    """Text on one line, cut to `size` bytes of UTF-8 with dots."""
    flat = F.regexp_replace(filled(c), "[\\n\\r]", " ")
    raw = F.encode(flat, "utf-8")
    return F.when(F.length(raw) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


@R.query("flagged_elements", f"WITH {EL} SELECT elem_id, element_type, coalesce(skipped, false) AS is_skipped, '(' || CAST(trunc(x0) AS INT) || ', ' || CAST(trunc(y0) AS INT) || ', ' || CAST(trunc(x1) AS INT) || ', ' || CAST(trunc(y1) AS INT) || ')' AS bbox, image_path, CASE WHEN strlen(f) > {PREVIEW} THEN f[1:{PREVIEW - 3}] || '...' ELSE f END AS preview FROM (SELECT *, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') AS f FROM el) WHERE coalesce(skipped, false) OR coalesce(element_type = 'unknown', false) OR contains(coalesce(text, ''), '[Unsupported layout category:') OR coalesce(image_path, '') <> ''")
def flagged_elements(spark, sf_dir):
    """Elements that a report points out: skipped, fallback, unsupported, or with an image."""
    flagged = F.coalesce(F.col("skipped"), F.lit(False)) | is_fallback() | is_unsupported() | (filled("image_path") != "")
    box = F.concat(F.lit("("), *[x for i, k in enumerate(("x0", "y0", "x1", "y1")) for x in ((F.lit(", "),) if i else ()) + (F.col(k).cast("int").cast("string"),)], F.lit(")"))
    return elements(spark, sf_dir).where(flagged).select("elem_id", "element_type", F.coalesce("skipped", F.lit(False)).alias("is_skipped"), box.alias("bbox"), "image_path", preview("text").alias("preview"))


@R.query("content_list_flat", f"WITH {EL} SELECT elem_id, coalesce(element_type, 'unknown') AS type, coalesce(text, '') AS text, page_index AS page, reading_order AS \"order\", coalesce(skipped, false) AS skipped, CAST(x0 AS DOUBLE) AS b0, CAST(y0 AS DOUBLE) AS b1, CAST(x1 AS DOUBLE) AS b2, CAST(y1 AS DOUBLE) AS b3, nullif(html, '') AS html, nullif(image_path, '') AS image_path FROM el")
def content_list_flat(spark, sf_dir):
    """The fields of the content list: empty html and image paths are left out (null)."""
    e = elements(spark, sf_dir)
    return e.select("elem_id", F.coalesce("element_type", F.lit("unknown")).alias("type"), filled("text").alias("text"), F.col("page_index").alias("page"), F.col("reading_order").alias("order"), F.coalesce("skipped", F.lit(False)).alias("skipped"), *[F.col(k).cast("double").alias(f"b{i}") for i, k in enumerate(("x0", "y0", "x1", "y1"))], F.nullif("html", F.lit("")).alias("html"), F.nullif("image_path", F.lit("")).alias("image_path"))


def _box() -> Column:
    return F.array(*[F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")])


def content_list(e: DataFrame) -> DataFrame:
    """doc_id and its content list as JSON: an array of pages of elements, keys in alphabetical order, optional ones left out."""
    item = F.struct(_box().alias("bbox"), F.nullif("html", F.lit("")).alias("html"), F.nullif("image_path", F.lit("")).alias("image_path"), F.col("reading_order").alias("order"), F.col("page_index").alias("page"), F.coalesce("skipped", F.lit(False)).alias("skipped"), filled("text").alias("text"), F.coalesce("element_type", F.lit("unknown")).alias("type"))
    return _nested(e, item).select("doc_id", F.to_json(F.transform("pages", lambda p: p["items"])).alias("content_list"))


def _nested(e: DataFrame, item: Column, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, pages: array of (page_index, items, page_w, page_h) in page order, items in reading order. `sizes`: doc_id, page_index, page_w, page_h; null where there are none."""
    per = e.groupBy("doc_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "elem_id", item.alias("v")))), lambda x: x["v"]).alias("items"))
    if sizes is None:
        per = per.withColumn("page_w", F.lit(None).cast("int")).withColumn("page_h", F.lit(None).cast("int"))
    else:
        per = per.join(sizes.select("doc_id", "page_index", "page_w", "page_h"), ["doc_id", "page_index"], "left")
    return per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "page_w", "page_h", "items"))).alias("pages"))


def middle_json(e: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id and the parsed pages with their size and elements as JSON; empty texts, html and image paths are left out."""
    item = F.struct(F.coalesce("element_type", F.lit("unknown")).alias("type"), _box().alias("bbox"), F.col("confidence").cast("double").alias("score"), F.col("page_index").alias("page_idx"), "reading_order", F.coalesce("skipped", F.lit(False)).alias("skipped"), F.nullif("text", F.lit("")).alias("text"), F.nullif("html", F.lit("")).alias("html"), F.nullif("image_path", F.lit("")).alias("image_path"))
    info = F.transform("pages", lambda p: F.struct(p["page_index"].alias("page_idx"), F.array(p["page_w"], p["page_h"]).alias("page_size"), p["items"].alias("elements")))
    return _nested(e, item, sizes).select("doc_id", F.to_json(F.struct(info.alias("pdf_info"))).alias("middle_json"))


#: Codes of categories, by the type of element that comes of them.
TYPE_CODE = {"text": 0, "title": 1, "image": 2, "table": 4, "header": 7, "footer": 8, "reference": 9, "equation": 10, "code": 13, "list": 17}


def category_id() -> Column:
    """Class id of an element's layout label, or the code of its category where the label is none of the model's; -1 for unknown ones."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    code = F.element_at(F.create_map(*[x for k, v in TYPE_CODE.items() for x in (F.lit(k), F.lit(v))]), F.coalesce("element_type", F.lit("unknown")))
    return F.when(at > 0, at - 1).otherwise(F.coalesce(code, F.lit(-1))).cast("int")


def model_json(e: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id and the detections of each page with the page's number and size as JSON."""
    poly = F.array(*[F.col(k).cast("int") for k in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")])
    item = F.struct(category_id().alias("category_id"), F.coalesce(F.nullif("label", F.lit("")), "element_type", F.lit("unknown")).alias("label"), poly.alias("poly"), _box().alias("bbox"), F.col("confidence").cast("double").alias("score"))
    pages_ = F.transform("pages", lambda p: F.struct(p["items"].alias("layout_dets"), F.struct(p["page_index"].alias("page_no"), p["page_w"].alias("width"), p["page_h"].alias("height")).alias("page_info")))
    return _nested(e, item, sizes).select("doc_id", F.to_json(pages_).alias("model_json"))


def _num(c: str) -> str:
    return f"coalesce(CAST(CAST({c} AS DOUBLE) AS VARCHAR), 'null')"


def _str(c: str) -> str:
    return f"CAST(to_json({c}) AS VARCHAR)"


def _key(key: str, c: str, value: str) -> str:
    """A key with its value, or nothing where the column is null."""
    return f"CASE WHEN {c} IS NOT NULL THEN ',\"{key}\":' || {value} ELSE '' END"


_BOX_SQL = "'[' || " + " || ',' || ".join(_num(k) for k in ("x0", "y0", "x1", "y1")) + " || ']'"
_FLAG = "CAST(coalesce(skipped, false) AS VARCHAR)"
_KIND = _str("coalesce(element_type, 'unknown')")
_NAMED = ("order", "reading_order"), ("page", "page_index")
CONTENT_ITEM = f"""'{{"bbox":' || {_BOX_SQL} || {_key('html', "nullif(html, '')", _str('html'))} || {_key('image_path', "nullif(image_path, '')", _str('image_path'))} || {' || '.join(_key(k, c, f'CAST({c} AS VARCHAR)') for k, c in _NAMED)} || ',"skipped":' || {_FLAG} || ',"text":' || {_str("coalesce(text, '')")} || ',"type":' || {_KIND} || '}}'"""
MIDDLE_ITEM = f"""'{{"type":' || {_KIND} || ',"bbox":' || {_BOX_SQL} || {_key('score', 'confidence', _num('confidence'))} || {_key('page_idx', 'page_index', 'CAST(page_index AS VARCHAR)')} || {_key('reading_order', 'reading_order', 'CAST(reading_order AS VARCHAR)')} || ',"skipped":' || {_FLAG} || {' || '.join(_key(k, f"nullif({k}, '')", _str(k)) for k in ('text', 'html', 'image_path'))} || '}}'"""
_CATEGORY_ID = f"CASE label {' '.join(f'WHEN {x!r} THEN {i}' for i, x in enumerate(LABELS))} ELSE CASE element_type {' '.join(f'WHEN {k!r} THEN {v}' for k, v in TYPE_CODE.items())} ELSE -1 END END"
_POLY = " || ',' || ".join(f"coalesce(CAST(CAST(trunc({k}) AS INT) AS VARCHAR), 'null')" for k in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))
MODEL_ITEM = f"""'{{"category_id":' || {_CATEGORY_ID} || ',"label":' || {_str("coalesce(nullif(label, ''), element_type, 'unknown')")} || ',"poly":[' || {_POLY} || '],"bbox":' || {_BOX_SQL} || {_key('score', 'confidence', _num('confidence'))} || '}}'"""


def _pages_sql(item: str) -> str:
    return f"WITH {EL}, {PAGES}, it AS (SELECT doc_id, page_index, string_agg({item}, ',' ORDER BY reading_order NULLS FIRST, elem_id) AS items FROM el GROUP BY ALL), pg AS (SELECT it.*, p.page_w, p.page_h FROM it LEFT JOIN pages p USING (doc_id, page_index))"


@R.query("content_list", f"{_pages_sql(CONTENT_ITEM)} SELECT doc_id, '[' || string_agg('[' || items || ']', ',' ORDER BY page_index NULLS FIRST) || ']' AS content_list FROM pg GROUP BY doc_id")
def content_list_query(spark, sf_dir):
    return content_list(elements(spark, sf_dir))


@R.query("middle_json", f"""{_pages_sql(MIDDLE_ITEM)} SELECT doc_id, '{{"pdf_info":[' || string_agg('{{' || CASE WHEN page_index IS NOT NULL THEN '"page_idx":' || page_index || ',' ELSE '' END || '"page_size":[' || coalesce(CAST(page_w AS VARCHAR), 'null') || ',' || coalesce(CAST(page_h AS VARCHAR), 'null') || '],"elements":[' || items || ']}}', ',' ORDER BY page_index NULLS FIRST) || ']}}' AS middle_json FROM pg GROUP BY doc_id""")
def middle_json_query(spark, sf_dir):
    return middle_json(elements(spark, sf_dir), pages(spark, sf_dir))


@R.query("model_json", f"""{_pages_sql(MODEL_ITEM)} SELECT doc_id, '[' || string_agg('{{"layout_dets":[' || items || '],"page_info":{{' || concat_ws(',', '"page_no":' || page_index, '"width":' || page_w, '"height":' || page_h) || '}}}}', ',' ORDER BY page_index NULLS FIRST) || ']' AS model_json FROM pg GROUP BY doc_id""")
def model_json_query(spark, sf_dir):
    return model_json(elements(spark, sf_dir), pages(spark, sf_dir))


@R.query("quad_poly", f"WITH {EL} SELECT elem_id, " + ", ".join(f"CAST(trunc({k}) AS INT) AS p{i}" for i, k in enumerate(("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))) + ", coalesce(nullif(label, ''), element_type, 'unknown') AS label, " + _CATEGORY_ID + " AS category_id FROM el")
def quad_poly(spark, sf_dir):
    return elements(spark, sf_dir).select("elem_id", *[F.col(k).cast("int").alias(f"p{i}") for i, k in enumerate(("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))], F.coalesce(F.nullif("label", F.lit("")), "element_type", F.lit("unknown")).alias("label"), category_id().alias("category_id"))


LINES = "ln AS (SELECT DISTINCT ON (line_id) * FROM rec_results)"


def lines(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "rec_results").dropDuplicates(["line_id"])


@R.query("ocr_region_text", f"""WITH {LINES}, o AS (SELECT *, bool_or(coalesce(text, '') <> '') OVER (PARTITION BY doc_id, page_index, region_id ORDER BY line_index, line_id) AS begun FROM ln)
    SELECT doc_id, page_index, region_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY line_index, line_id) FILTER (WHERE begun), '') AS text, count(*) AS lines FROM o GROUP BY doc_id, page_index, region_id""")
def ocr_region_text(spark, sf_dir):
    """Lines of a region as one text. Empty lines before the first text add nothing, later ones do."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line_id", filled("text").alias("t")))), lambda x: x["t"])
    joined_ = F.array_join(F.col("ts"), "\n")
    return lines(spark, sf_dir).groupBy("doc_id", "page_index", "region_id").agg(ordered.alias("ts"), F.count("*").alias("lines")).select("doc_id", "page_index", "region_id", F.regexp_replace(joined_, "^\\n+", "").alias("text"), "lines")


@R.query("page_plan", f"""WITH {EL}, b AS (SELECT *, CASE element_type WHEN 'table' THEN 1 WHEN 'image' THEN 2 WHEN 'equation' THEN 3 WHEN 'unknown' THEN 4 ELSE 0 END AS branch FROM el)
    SELECT elem_id, branch, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY branch, reading_order, elem_id) - 1 AS INT) AS insert_order FROM b""")
def page_plan(spark, sf_dir):
    """Order in which the branches of the page plan give their elements: text, tables, figures, equations, unsupported."""
    from pyspark.sql import Window

    branch = F.when(F.col("element_type") == "table", 1).when(F.col("element_type") == "image", 2).when(F.col("element_type") == "equation", 3).when(F.col("element_type") == "unknown", 4).otherwise(0)
    w = Window.partitionBy("doc_id", "page_index").orderBy("branch", "reading_order", "elem_id")
    return elements(spark, sf_dir).withColumn("branch", branch).select("elem_id", "branch", (F.row_number().over(w) - 1).alias("insert_order"))


@R.query("content_totals", f"WITH {EL} SELECT doc_id, count(*) AS elements, CAST(coalesce(sum(length(text)) FILTER (WHERE coalesce(text, '') <> ''), 0) + greatest(count(*) FILTER (WHERE coalesce(text, '') <> '') - 1, 0) AS BIGINT) AS chars FROM el GROUP BY doc_id")
def content_totals(spark, sf_dir):
    """Elements, and characters of their texts joined by line breaks."""
    some = filled("text") != ""
    return elements(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("elements"), (F.coalesce(F.sum(F.when(some, F.length("text"))), F.lit(0)) + F.greatest(F.count_if(some) - 1, F.lit(0))).cast("long").alias("chars"))


def ms_text(us: Column) -> Column:
    """Whole microseconds as milliseconds with two digits."""
    cents = F.floor((us + 5) / 10)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" ms"))


def _ms(us: str) -> str:
    return f"(CAST(({us} + 5) // 10 // 100 AS VARCHAR) || '.' || lpad(CAST(({us} + 5) // 10 % 100 AS VARCHAR), 2, '0') || ' ms')"


def described(name: str, value: Column) -> Column:
    """Line of an artifact; one that wasn't written is said to be missing."""
    return F.concat(F.lit(f"  {name}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit("(not generated)")), F.lit("\n"))


_TRACKED = ("layout", "ocr", "table")
_LINES = ("layout", "ocr", "table", "npu_serial", "cpu_only", "npu_lock_wait", "npu_lock_hold")


def detail_report(spark, sf_dir) -> DataFrame:
    """doc_id and a readable report: input, stages and artifacts of its job, totals, then a block a page with its times and flagged elements. Stages that page_stats doesn't record have no line."""
    on = lambda c: F.when(c, "on").otherwise("off")
    counts = page_element_counts(spark, sf_dir)
    e = elements(spark, sf_dir).withColumn("_fallback", is_fallback()).withColumn("_unsupported", is_unsupported())
    flagged = flagged_elements(spark, sf_dir).join(e.select("elem_id", "doc_id", "page_index", "reading_order", "_fallback", "_unsupported"), "elem_id")
    mark = lambda c, t: F.when(F.col(c), t).otherwise("")
    line = F.concat(F.lit("    - "), F.coalesce("element_type", F.lit("unknown")), mark("is_skipped", " [skipped]"), mark("_fallback", " [fallback]"), mark("_unsupported", " [unsupported]"), F.lit(" bbox="), F.coalesce("bbox", F.lit("()")), F.when(filled("image_path") != "", F.concat(F.lit(" image="), "image_path")).otherwise(""), F.when(F.col("preview") != "", F.concat(F.lit(' text="'), "preview", F.lit('"'))).otherwise(""), F.lit("\n"))
    marks = flagged.groupBy("doc_id", "page_index").agg(joined([], ["reading_order", "elem_id"], line).alias("marks"))
    us = [to_us(k + "_ms").alias(k + "_us") for k in (*_LINES, "total")]
    p = pages(spark, sf_dir).select("doc_id", "page_index", "page_w", "page_h", *us).join(counts, ["doc_id", "page_index"], "left").join(marks, ["doc_id", "page_index"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    tracked_us = sum((F.col(k + "_us") for k in _TRACKED[1:]), F.col(_TRACKED[0] + "_us"))
    head = F.concat(F.lit("  Page "), F.col("page_index").cast("string"), F.lit(" | size="), zero("page_w"), F.lit("x"), zero("page_h"), F.lit(" | total="), ms_text(F.col("total_us")), F.lit(" | tracked="), ms_text(tracked_us), *[x for k in ("elements", "skipped", "fallback", "unsupported") for x in (F.lit(f" | {k}="), zero(k))], F.lit("\n"))
    stage = F.concat(*[x for k in _LINES for x in (F.lit(f"    {k}: "), ms_text(F.col(k + "_us")), F.lit("\n"))])
    block = F.concat(head, stage, F.coalesce("marks", F.lit("    - no skipped/fallback/unsupported elements\n")))
    docs = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("skipped", F.lit(0))).alias("skipped"), *[F.sum(k + "_us").alias(k + "_us") for k in (*_LINES, "total")], joined([], ["page_index"], block).alias("blocks"))
    jobs = load(spark, sf_dir, "parse_jobs", "doc_id", "stem", "suffix", "table_enable", "total_pages").dropDuplicates(["doc_id"])
    d = docs.join(jobs, "doc_id", "left")
    source = F.coalesce(F.nullif(F.concat(filled("stem"), filled("suffix")), F.lit("")), F.lit("(unknown)"))
    out = F.nullif(F.concat(F.lit("out/"), F.col("stem")), F.lit("out/"))
    totals = F.concat(F.lit("  total_time: "), ms_text(F.col("total_us")), F.lit("\n  tracked_stage_time: "), ms_text(tracked_us), F.lit("\n"), *[x for k in _LINES for x in (F.lit(f"  {k}: "), ms_text(F.col(k + "_us")), F.lit("\n"))])
    top = F.concat(
        F.lit("Detail Report\n=============\nInput: "), source, F.lit("\nStages: layout=on, ocr=on, wired_table="), on(F.coalesce("table_enable", F.lit(True))), F.lit(", reading_order=on, markdown=on\nArtifacts\n"), described("output_dir", out), described("markdown_path", F.concat(out, F.lit(".md"))), described("layout_dir", F.lit(None).cast("string")),
        F.lit("Document Summary\n  pages: "), F.col("n").cast("string"), F.lit("/"), F.coalesce(F.col("total_pages").cast("string"), F.lit("?")), F.lit("\n  skipped_elements: "), F.col("skipped").cast("string"), F.lit("\n"), totals, F.lit("Per-page\n"),
    )
    return d.select("doc_id", F.concat(top, "blocks").alias("report"))


def _report_sql() -> str:
    flagged = oracle_sql()["flagged_elements"].replace("WITH " + EL, "", 1)
    tracked_us = lambda p="": " + ".join(f"{p}{k}_us" for k in _TRACKED)
    nl = "chr(10)"
    line = f"""'    - ' || coalesce(f.element_type, 'unknown') || CASE WHEN is_skipped THEN ' [skipped]' ELSE '' END || CASE WHEN fb THEN ' [fallback]' ELSE '' END || CASE WHEN un THEN ' [unsupported]' ELSE '' END || ' bbox=' || coalesce(bbox, '()') || CASE WHEN coalesce(f.image_path, '') <> '' THEN ' image=' || f.image_path ELSE '' END || CASE WHEN preview <> '' THEN ' text="' || preview || '"' ELSE '' END || {nl}"""
    head = f"'  Page ' || u.page_index || ' | size=' || coalesce(page_w, 0) || 'x' || coalesce(page_h, 0) || ' | total=' || {_ms('total_us')} || ' | tracked=' || {_ms('(' + tracked_us() + ')')} || " + " || ".join(f"' | {k}=' || coalesce({k}, 0)" for k in ("elements", "skipped", "fallback", "unsupported")) + f" || {nl}"
    stage = " || ".join(f"'    {k}: ' || {_ms(k + '_us')} || {nl}" for k in _LINES)
    totals = f"'  total_time: ' || {_ms('total_us')} || {nl} || '  tracked_stage_time: ' || {_ms('(' + tracked_us() + ')')} || {nl} || " + " || ".join(f"'  {k}: ' || {_ms(k + '_us')} || {nl}" for k in _LINES)
    out = "nullif('out/' || stem, 'out/')"
    art = lambda n, v: f"'  {n}: ' || coalesce(nullif({v}, ''), '(not generated)') || {nl}"
    return f"""WITH {EL}, {PAGES}, fl AS ({flagged}), ct AS ({oracle_sql()['page_element_counts'].replace('WITH ' + EL, '', 1)}),
    lf AS (SELECT el.doc_id, el.page_index, string_agg({line}, '' ORDER BY el.reading_order NULLS FIRST, el.elem_id) AS marks FROM (SELECT fl.*, coalesce(el.skipped, false) AND ((el.element_type = 'table' AND coalesce(el.text, '') <> '') OR coalesce(el.element_type IN ('equation', 'image'), false)) AS fb, coalesce(el.element_type = 'unknown', false) OR contains(coalesce(el.text, ''), '[Unsupported layout category:') AS un FROM fl JOIN el USING (elem_id)) f JOIN el USING (elem_id) GROUP BY ALL),
    u AS (SELECT doc_id, page_index, page_w, page_h, {', '.join(f"{_us(k + '_ms')} AS {k}_us" for k in (*_LINES, 'total'))} FROM pages),
    bl AS (SELECT u.doc_id, u.page_index, coalesce(skipped, 0) AS skipped, {', '.join(k + '_us' for k in (*_LINES, 'total'))}, {head} || {stage} || coalesce(marks, '    - no skipped/fallback/unsupported elements' || {nl}) AS block FROM u LEFT JOIN ct USING (doc_id, page_index) LEFT JOIN lf USING (doc_id, page_index)),
    dc AS (SELECT doc_id, count(*) AS n, sum(skipped) AS skipped, {', '.join(f'CAST(sum({k}_us) AS BIGINT) AS {k}_us' for k in (*_LINES, 'total'))}, string_agg(block, '' ORDER BY page_index) AS blocks FROM bl GROUP BY doc_id), jb AS (SELECT DISTINCT ON (doc_id) * FROM parse_jobs)
    SELECT doc_id, 'Detail Report' || {nl} || '=============' || {nl} || 'Input: ' || coalesce(nullif(coalesce(stem, '') || coalesce(suffix, ''), ''), '(unknown)') || {nl} || 'Stages: layout=on, ocr=on, wired_table=' || CASE WHEN coalesce(table_enable, true) THEN 'on' ELSE 'off' END || ', reading_order=on, markdown=on' || {nl} || 'Artifacts' || {nl} || {art('output_dir', out)} || {art('markdown_path', out + " || '.md'")} || {art('layout_dir', 'CAST(NULL AS VARCHAR)')} || 'Document Summary' || {nl} || '  pages: ' || n || '/' || coalesce(CAST(total_pages AS VARCHAR), '?') || {nl} || '  skipped_elements: ' || skipped || {nl} || {totals} || 'Per-page' || {nl} || blocks AS report FROM dc LEFT JOIN jb USING (doc_id)"""


R.query("detail_report", _report_sql())(detail_report)


@R.query("document_stage_report", f"WITH {PAGES} SELECT doc_id, count(*) AS pages, round(coalesce(sum(total_ms), 0), 3) AS total_ms, round(coalesce(sum(coalesce(layout_ms, 0) + coalesce(ocr_ms, 0) + coalesce(table_ms, 0)), 0), 3) AS tracked_ms FROM pages GROUP BY doc_id")
def document_stage_report(spark, sf_dir):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(z(F.sum("total_ms")), 3).alias("total_ms"), F.round(z(F.sum(z("layout_ms") + z("ocr_ms") + z("table_ms"))), 3).alias("tracked_ms"))
