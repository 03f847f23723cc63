"""What the service does around parsing: names, options, page ranges, warnings, payload choice, errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
JB = "jb AS (SELECT DISTINCT ON (doc_id) * FROM parse_jobs)"
#: Suffixes that are accepted, and their media types.
MEDIA = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff"}
IMAGES = tuple(k for k in MEDIA if k != ".pdf")
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def jobs(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "parse_jobs").dropDuplicates(["doc_id"])


def source_kind(suffix: Column) -> Column:
    s = F.lower(suffix)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGES), "image").otherwise("error")


def media_type(suffix: Column) -> Column:
    table = F.create_map(*[x for k, v in MEDIA.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, F.lower(suffix)), F.lit("application/octet-stream"))


def parse_method(raw: Column) -> Column:
    """`ocr` or `txt` in any case, else `auto`."""
    m = F.lower(raw)
    return F.when(m.isin("ocr", "txt"), m).otherwise("auto")


def parse_bool(raw: Column, default: bool) -> Column:
    v = F.lower(F.trim(raw))
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False).otherwise(default)


def parse_int(raw: Column, default: int) -> Column:
    """The integer that a text begins with, blanks before it allowed; else the default."""
    return F.coalesce(F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def safe_filename(name: Column) -> Column:
    """Base name with separators replaced; `upload.bin` for none."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1), "[/\\\\:\\x00]", "_")
    return F.when(base == "", "upload.bin").otherwise(base)


def safe_stem(name: Column) -> Column:
    stem = F.regexp_replace(safe_filename(name), r"\.[^.]*$", "")
    return F.when(stem == "", "document").otherwise(stem)


def base_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


@R.query("source_dispatch", f"WITH {JB} SELECT doc_id, CASE WHEN lower(suffix) = '.pdf' THEN 'pdf' WHEN lower(suffix) IN {IMAGES} THEN 'image' ELSE 'error' END AS kind, CASE lower(suffix) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in MEDIA.items())} ELSE 'application/octet-stream' END AS media_type FROM jb")
def source_dispatch(spark, sf_dir):
    return jobs(spark, sf_dir).select("doc_id", source_kind(F.col("suffix")).alias("kind"), media_type(F.col("suffix")).alias("media_type"))


@R.query("parse_options", f"WITH {JB} SELECT doc_id, CASE WHEN lower(parse_method) IN ('ocr', 'txt') THEN lower(parse_method) ELSE 'auto' END AS method, coalesce(table_enable, true) AS table_enable, coalesce(backend, 'pipeline') AS backend, coalesce(len(lang_list), 0) AS n_langs FROM jb")
def parse_options(spark, sf_dir):
    """Options of a job merged over the defaults; only fields that are set replace them."""
    return jobs(spark, sf_dir).select("doc_id", parse_method(F.col("parse_method")).alias("method"), F.coalesce("table_enable", F.lit(True)).alias("table_enable"), F.coalesce("backend", F.lit("pipeline")).alias("backend"), F.when(F.col("lang_list").isNull(), 0).otherwise(F.size("lang_list")).cast("long").alias("n_langs"))


def page_range(start: Column, end: Column, pages: Column, most: int = 0) -> tuple[Column, Column]:
    """First and last page to render (both null for none): negative starts are 0, -1 and ends past the document are its last page."""
    first = F.greatest(F.lit(0), start)
    last = F.when(end == -1, pages - 1).otherwise(F.least(end, pages - 1))
    if most > 0:
        last = F.least(last, first + most - 1)
    ok = (first < pages) & (last >= first)
    return F.when(ok, first), F.when(ok, last)


@R.query("page_range", f"WITH {JB}, p AS (SELECT doc_id, total_pages, greatest(0, start_page_id) AS f, least(CASE WHEN end_page_id = -1 THEN total_pages - 1 ELSE least(end_page_id, total_pages - 1) END, greatest(0, start_page_id) + 3) AS l FROM jb) SELECT doc_id, CASE WHEN f < total_pages AND l >= f THEN f END AS first_page, CASE WHEN f < total_pages AND l >= f THEN l END AS last_page, CASE WHEN f < total_pages AND l >= f THEN l - f + 1 ELSE 0 END AS pages FROM p")
def page_range_query(spark, sf_dir):
    """Range of pages of each job, at most four."""
    f, last = page_range(F.col("start_page_id"), F.col("end_page_id"), F.col("total_pages"), 4)
    return jobs(spark, sf_dir).select("doc_id", f.alias("first_page"), last.alias("last_page"), F.coalesce(last - f + 1, F.lit(0)).alias("pages"))


@R.query("selected_pages", f"WITH {JB}, pg AS (SELECT DISTINCT ON (doc_id, page_index) doc_id, page_index FROM page_stats) SELECT p.doc_id, p.page_index FROM pg p JOIN jb USING (doc_id) WHERE p.page_index >= greatest(0, start_page_id) AND p.page_index <= CASE WHEN end_page_id = -1 THEN total_pages - 1 ELSE least(end_page_id, total_pages - 1) END")
def selected_pages(spark, sf_dir):
    p = load(spark, sf_dir, "page_stats", "doc_id", "page_index").distinct()
    f, last = page_range(F.col("start_page_id"), F.col("end_page_id"), F.col("total_pages"))
    return p.join(jobs(spark, sf_dir).select("doc_id", f.alias("f"), last.alias("l")), "doc_id").where("page_index BETWEEN f AND l").select("doc_id", "page_index")


#: What a request may ask for and what runs here; None where any value is taken.
ENGINES = {"layout_engine": ("builtin",), "ocr_engine": ("builtin",), "table_engine": ("builtin",), "formula_engine": ("builtin", "image")}


def request_warnings_of(accelerated: Column, engines: dict[str, Column], method: Column) -> Column:
    """The six warnings about options that have no effect: acceleration switched off, another engine for layout, text, tables or formulas, and the method `txt`. Empty and null engines ask for nothing."""
    asks = [F.when(~F.coalesce(accelerated, F.lit(True)), "acceleration can't be switched off; the option was ignored.")]
    for name, allowed in ENGINES.items():
        e = F.lower(F.coalesce(engines[name], F.lit("")))
        asks.append(F.when((e != "") & ~e.isin(*allowed), f"{name} request ignored; only {' and '.join(allowed)} run here."))
    asks.append(F.when(F.lower(method) == "txt", "parse_method=txt has no path of its own; falling back to auto."))
    return F.filter(F.array(*asks), lambda x: x.isNotNull())


_ASKED = {"layout_engine": ("doc_id", 7, 3), "ocr_engine": ("doc_id", 5, 1), "table_engine": ("doc_id", 11, 2), "formula_engine": ("doc_id", 3, 0)}


def _asked(sql: bool):
    """Engines that a job asks for: another one than the built-in for some ids, none for others."""
    if sql:
        return {k: f"CASE WHEN doc_id % {m} = {r} THEN 'Other' WHEN doc_id % 2 = 0 THEN 'BUILTIN' ELSE '' END" for k, (_c, m, r) in _ASKED.items()}
    return {k: F.when(F.col(c) % m == r, "Other").when(F.col(c) % 2 == 0, "BUILTIN").otherwise("") for k, (c, m, r) in _ASKED.items()}


def _warnings_sql() -> str:
    engines = _asked(True)
    asks = ["CASE WHEN doc_id % 13 = 0 THEN 'acceleration can''t be switched off; the option was ignored.' END"]
    asks += [f"CASE WHEN lower({engines[n]}) <> '' AND lower({engines[n]}) NOT IN ({', '.join(map(repr, allowed))}) THEN '{n} request ignored; only {' and '.join(allowed)} run here.' END" for n, allowed in ENGINES.items()]
    asks.append("CASE WHEN lower(parse_method) = 'txt' THEN 'parse_method=txt has no path of its own; falling back to auto.' END")
    return f"WITH {JB} SELECT doc_id, list_filter([{', '.join(asks)}], lambda x: x IS NOT NULL) AS warnings FROM jb"


@R.query("request_warnings", _warnings_sql())
def request_warnings(spark, sf_dir):
    """Warnings of each job; what it asks for beside its method is a formula of its id."""
    return jobs(spark, sf_dir).select("doc_id", request_warnings_of(F.col("doc_id") % 13 != 0, _asked(False), F.col("parse_method")).alias("warnings"))


@R.query("request_ids", "WITH rq AS (SELECT DISTINCT ON (request_id) * FROM requests) SELECT request_id, 'req_' || CAST(epoch_us(ts) // 1000 AS BIGINT) || '_pid' || CAST(shard_id AS BIGINT) || '_' || request_id % 1000 AS name FROM rq")
def request_ids(spark, sf_dir):
    """Names of requests from time, process (the shard) and a running number; never random, so a rerun names them alike."""
    r = load(spark, sf_dir, "requests", "request_id", "ts", "shard_id").dropDuplicates(["request_id"])
    return r.select("request_id", F.concat(F.lit("req_"), F.unix_millis("ts").cast("string"), F.lit("_pid"), F.col("shard_id").cast("string"), F.lit("_"), (F.col("request_id") % 1000).cast("string")).alias("name"))


@R.query("base_urls", "SELECT doc_id, rtrim('http://host' || doc_id || '/api' || repeat('/', CAST(doc_id % 3 AS INT)), '/') AS url FROM (SELECT DISTINCT doc_id FROM parse_jobs)")
def base_urls(spark, sf_dir):
    d = load(spark, sf_dir, "parse_jobs", "doc_id").distinct()
    return d.select("doc_id", base_url(F.concat(F.lit("http://host"), F.col("doc_id").cast("string"), F.lit("/api"), F.repeat(F.lit("/"), (F.col("doc_id") % 3).cast("int")))).alias("url"))


#: Parts of a file's payload that are sent only when a request asks for them.
RETURNED = ("md_content", "middle_json", "model_output", "content_list", "images")


def payload(fields: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """A file's result as JSON: `fields` always, those of `RETURNED` only where `wanted`; null fields are left out."""
    return F.to_json(F.struct(*[(F.when(F.coalesce(wanted[k], F.lit(False)), v) if k in RETURNED else v).alias(k) for k, v in fields.items()]))


@R.query("file_payloads", f"""WITH {JB}, el AS (SELECT DISTINCT ON (elem_id) * FROM content_list), im AS (SELECT doc_id, count(*) AS n FROM el WHERE coalesce(image_path, '') <> '' GROUP BY doc_id), tx AS (SELECT doc_id, count(*) AS n FROM el GROUP BY doc_id)
    SELECT doc_id, '{{"filename":' || CAST(to_json(stem || suffix) AS VARCHAR) || ',"backend":' || CAST(to_json(coalesce(backend, 'pipeline')) AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ',"md_content":' || coalesce(tx.n, 0) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ',"middle_json":' || coalesce(tx.n, 0) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ',"model_output":' || coalesce(tx.n, 0) ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ',"content_list":' || coalesce(tx.n, 0) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ',"images":' || coalesce(im.n, 0) ELSE '' END || '}}' AS payload FROM jb LEFT JOIN tx USING (doc_id) LEFT JOIN im USING (doc_id)""")
def file_payloads(spark, sf_dir):
    """Which parts of each file's result are sent back; the numbers of elements and images stand for the parts, and what is asked for is a formula of the id."""
    el = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "image_path").dropDuplicates(["elem_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("image_path", F.lit("")) != "").alias("pictures"))
    j = jobs(spark, sf_dir).join(el, "doc_id", "left")
    n, pictures = F.coalesce("n", F.lit(0)), F.coalesce("pictures", F.lit(0))
    fields = {"filename": F.concat("stem", "suffix"), "backend": F.coalesce("backend", F.lit("pipeline")), **dict.fromkeys(RETURNED[:4], n), "images": pictures}
    wanted = {k: F.col("doc_id") % m == 0 for k, m in zip(RETURNED, (2, 3, 5, 7, 11))}
    return j.select("doc_id", payload(fields, wanted).alias("payload"))


#: Keys of a file's statistics; the last three only where they are known.
STATS = ("cpu_only_ms", "layout_ms", "npu_lock_hold_ms", "npu_lock_wait_ms", "npu_serial_ms", "ocr_ms", "output_gen_ms", "pages", "pdf_render_ms", "skipped", "table_ms", "time_ms", "total_pages", "pipeline_call_ms", "route_queue_ms", "lb_proxy_ms")
_SUMMED = ("cpu_only_ms", "layout_ms", "npu_lock_hold_ms", "npu_lock_wait_ms", "npu_serial_ms", "ocr_ms", "table_ms")


def _stats_sql() -> str:
    from leafwright.operators.stats import PAGES, REQ, _us

    ms = lambda c: f"CAST({c} / 1000.0::DOUBLE AS VARCHAR)"
    value = {**{k: ms(f"coalesce({k[:-3]}_us, 0)") for k in _SUMMED}, "output_gen_ms": "'0.0'", "pdf_render_ms": "'0.0'", "pages": "CAST(coalesce(pages, 0) AS VARCHAR)", "skipped": "CAST(coalesce(skipped, 0) AS VARCHAR)", "time_ms": ms("coalesce(time_us, 0)"), "total_pages": "CAST(total_pages AS VARCHAR)"}
    body = " || ',' || ".join(f"'\"{k}\":' || {value[k]}" for k in STATS[:13])
    return f"""WITH {JB}, {PAGES}, {REQ}, pg AS (SELECT doc_id, count(*) AS pages, {', '.join(f'CAST(sum({_us(k)}) AS BIGINT) AS {k[:-3]}_us' for k in _SUMMED)}, CAST(sum({_us('total_ms')}) AS BIGINT) AS time_us FROM pages GROUP BY doc_id), sk AS (SELECT doc_id, count(*) FILTER (WHERE skipped) AS skipped FROM (SELECT DISTINCT ON (elem_id) * FROM content_list) GROUP BY doc_id)
    SELECT doc_id, '{{' || {body} || CASE WHEN r.request_id IS NOT NULL THEN ',"pipeline_call_ms":' || {ms(_us('r.pipeline_call_ms'))} || ',"route_queue_ms":' || {ms(_us('r.route_queue_ms'))} ELSE '' END || '}}' AS stats FROM jb LEFT JOIN pg USING (doc_id) LEFT JOIN sk USING (doc_id) LEFT JOIN req r ON r.request_id = jb.request_id"""


@R.query("file_stats", _stats_sql())
def file_stats(spark, sf_dir):
    """Statistics of each file as JSON, keys in alphabetical order, those about the call only where its request is known. Times are whole microseconds in milliseconds."""
    from leafwright.operators import stats

    ms = lambda c: F.coalesce(c, F.lit(0)) / 1000.0
    p = stats.pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.sum(stats.to_us(k)).alias(k) for k in _SUMMED], F.sum(stats.to_us("total_ms")).alias("time_ms"))
    skipped = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "skipped").dropDuplicates(["elem_id"]).groupBy("doc_id").agg(F.count_if("skipped").alias("skipped"))
    r = stats.requests(spark, sf_dir, "pipeline_call_ms", "route_queue_ms").select("request_id", (stats.to_us("pipeline_call_ms") / 1000.0).alias("pipeline_call_ms"), (stats.to_us("route_queue_ms") / 1000.0).alias("route_queue_ms"))
    j = jobs(spark, sf_dir).select("doc_id", "request_id", "total_pages").join(p, "doc_id", "left").join(skipped, "doc_id", "left").join(r, "request_id", "left")
    value = {**{k: ms(F.col(k)) for k in (*_SUMMED, "time_ms")}, "output_gen_ms": F.lit(0.0), "pdf_render_ms": F.lit(0.0), "pages": F.coalesce("pages", F.lit(0)), "skipped": F.coalesce("skipped", F.lit(0)), "lb_proxy_ms": F.lit(None).cast("double")}
    return j.select("doc_id", F.to_json(F.struct(*[value.get(k, F.col(k)).alias(k) for k in STATS])).alias("stats"))


def inline_images(markdown: Column, names: Column, urls: Column) -> Column:
    """Markdown whose pictures are replaced by image tags with data URLs: arrays of paths and of URLs, in the same order. Other pictures stay."""
    pairs = F.arrays_zip(names.alias("n"), urls.alias("u"))
    return F.aggregate(pairs, markdown, lambda t, p: F.replace(t, F.concat(F.lit("![]("), p["n"], F.lit(")")), F.concat(F.lit('<img src="'), p["u"], F.lit('">'))))


@R.query("inline_image_markdown", """WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list WHERE coalesce(image_path, '') <> '') SELECT elem_id, 'see <img src="data:image/png;base64,' || base64(encode(image_path)) || '"> and ![](other.gif)' AS markdown FROM el""")
def inline_image_markdown(spark, sf_dir):
    """A line of Markdown about each picture, with the picture in it; the path stands for the bytes."""
    el = load(spark, sf_dir, "content_list", "elem_id", "image_path").where("coalesce(image_path, '') <> ''").dropDuplicates(["elem_id"])
    url = F.concat(F.lit("data:"), media_type(F.regexp_extract("image_path", r"(\.[^.]*)$", 1)), F.lit(";base64,"), F.base64(F.encode("image_path", "utf-8")))
    return el.select("elem_id", inline_images(F.concat(F.lit("see ![]("), "image_path", F.lit(") and ![](other.gif)")), F.array("image_path"), F.array(url)).alias("markdown"))


@R.query("performance_table", """WITH rq AS (SELECT DISTINCT ON (request_id) * FROM requests), g AS (SELECT coalesce(case_name, '-') AS name, count(*) AS files, CAST(sum(page_count) AS BIGINT) AS pages FROM rq GROUP BY 1) SELECT '| Case | Files | Pages |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || name || ' | ' || files || ' | ' || coalesce(CAST(pages AS VARCHAR), '-') || ' |', chr(10) ORDER BY name) AS markdown FROM g""")
def performance_table(spark, sf_dir):
    """Files and pages by case as a Markdown table; a dash where there is no name or number."""
    g = load(spark, sf_dir, "requests", "request_id", "case_name", "page_count").dropDuplicates(["request_id"]).groupBy(F.coalesce("case_name", F.lit("-")).alias("name")).agg(F.count("*").alias("files"), F.sum("page_count").alias("pages"))
    line = F.concat(F.lit("| "), "name", F.lit(" | "), F.col("files").cast("string"), F.lit(" | "), F.coalesce(F.col("pages").cast("string"), F.lit("-")), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"]), "\n")  # a row for each case
    return g.agg(F.concat(F.lit("| Case | Files | Pages |\n| --- | --- | --- |\n"), rows).alias("markdown"))


@R.query("page_summaries", f"WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list), pg AS (SELECT DISTINCT ON (doc_id, page_index) * FROM page_stats), c AS (SELECT doc_id, page_index, count(*) AS layout_boxes, count(*) FILTER (WHERE coalesce(text, '') <> '') AS text_elements FROM el GROUP BY ALL) SELECT doc_id, page_index, coalesce(layout_boxes, 0) AS layout_boxes, coalesce(text_elements, 0) AS text_elements, round(coalesce(total_ms, 0), 3) AS time_ms, 'doc' || doc_id || '/page_' || lpad(CAST(page_index AS VARCHAR), 4, '0') || '_layout.json' AS layout_file FROM pg LEFT JOIN c USING (doc_id, page_index)")
def page_summaries(spark, sf_dir):
    """Boxes, texts and time of each page, and the file that its layout goes to."""
    c = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "page_index", "text").dropDuplicates(["elem_id"]).groupBy("doc_id", "page_index").agg(F.count("*").alias("layout_boxes"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("text_elements"))
    p = load(spark, sf_dir, "page_stats", "doc_id", "page_index", "total_ms").dropDuplicates(["doc_id", "page_index"])
    file = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("/page_"), F.lpad(F.col("page_index").cast("string"), 4, "0"), F.lit("_layout.json"))
    return p.join(c, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.coalesce("layout_boxes", F.lit(0)).alias("layout_boxes"), F.coalesce("text_elements", F.lit(0)).alias("text_elements"), F.round(F.coalesce("total_ms", F.lit(0.0)), 3).alias("time_ms"), file.alias("layout_file"))


@R.query("output_paths", f"WITH {JB}, s AS (SELECT *, 'req_' || request_id AS req, CASE WHEN lower(parse_method) IN ('ocr', 'txt') THEN lower(parse_method) ELSE 'auto' END AS m FROM jb) SELECT doc_id, concat_ws('/', 'out', req, stem, m) AS output_dir, concat_ws('/', 'out', req, stem, m, stem || '.md') AS markdown_path, concat_ws('/', 'out', req, stem, m, stem || '_content_list.json') AS content_list_path, concat_ws('/', 'out', req, stem, m, stem || '_middle.json') AS middle_path, concat_ws('/', 'out', req, stem, m, stem || '_origin' || lower(suffix)) AS origin_path FROM s")
def output_paths(spark, sf_dir):
    root = F.concat_ws("/", F.lit("out"), F.concat(F.lit("req_"), F.col("request_id").cast("string")), "stem", parse_method(F.col("parse_method")))
    file = lambda tail: F.concat_ws("/", root, F.concat("stem", tail))
    return jobs(spark, sf_dir).select("doc_id", root.alias("output_dir"), file(F.lit(".md")).alias("markdown_path"), file(F.lit("_content_list.json")).alias("content_list_path"), file(F.lit("_middle.json")).alias("middle_path"), file(F.concat(F.lit("_origin"), F.lower("suffix"))).alias("origin_path"))


@R.query("safe_names", r"""WITH n AS (SELECT doc_id, source || '/' || coalesce(title, '') || '.pdf' AS name FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_extract(coalesce(name, ''), '([^/\\]*)$', 1), '[/\\:\x00]', '_', 'g') AS base FROM n), f AS (SELECT doc_id, CASE WHEN base = '' THEN 'upload.bin' ELSE base END AS file_name FROM b) SELECT doc_id, file_name, CASE WHEN regexp_replace(file_name, '\.[^.]*$', '') = '' THEN 'document' ELSE regexp_replace(file_name, '\.[^.]*$', '') END AS stem FROM f""")
def safe_names(spark, sf_dir):
    name = F.concat("source", F.lit("/"), F.coalesce("title", F.lit("")), F.lit(".pdf"))
    return load(spark, sf_dir, "documents", "doc_id", "source", "title").select("doc_id", safe_filename(name).alias("file_name"), safe_stem(name).alias("stem"))


@R.query("parse_flags", r"SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), -1) AS n, CASE WHEN coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), -1) = 1 THEN true WHEN coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), -1) = 0 THEN false ELSE true END AS flag FROM events")
def parse_flags(spark, sf_dir):
    """Loose integers and booleans out of the events' properties."""
    n = parse_int(F.regexp_extract("props", r"([0-9]+)", 1), -1)
    return load(spark, sf_dir, "events", "event_id", "props").select("event_id", n.alias("n"), parse_bool(n.cast("string"), True).alias("flag"))


@R.query("base64_roundtrip", "SELECT doc_id, base64(encode(coalesce(title, ''))) AS encoded, coalesce(title, '') AS decoded FROM documents")
def base64_roundtrip(spark, sf_dir):
    """Titles to base64 and back; decoding ignores white space and signs that aren't of the alphabet, and stops at the padding."""
    t = F.coalesce("title", F.lit(""))
    enc = F.base64(F.encode(t, "utf-8"))
    noisy = F.concat(F.lit(" \n"), enc, F.lit("!"))
    return load(spark, sf_dir, "documents", "doc_id", "title").select("doc_id", enc.alias("encoded"), lenient_base64(noisy).cast("string").alias("decoded"))


def lenient_base64(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_extract(F.regexp_replace(c, "[^A-Za-z0-9+/=]", ""), "^([^=]*)", 1), "", "")
    return F.unbase64(F.rpad(clean, (F.ceil(F.length(clean) / 4) * 4).cast("int"), "="))


@R.query("data_urls", f"WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list) SELECT elem_id, regexp_extract(image_path, '([^/]*)$', 1) AS name, 'data:image/png;base64,' || base64(encode(image_path)) AS data_url FROM el WHERE image_path IS NOT NULL")
def data_urls(spark, sf_dir):
    """Images as data URLs; the path stands for the bytes."""
    el = load(spark, sf_dir, "content_list", "elem_id", "image_path").dropDuplicates(["elem_id"]).where("image_path IS NOT NULL")
    return el.select("elem_id", F.regexp_extract("image_path", "([^/]*)$", 1).alias("name"), F.concat(F.lit("data:"), media_type(F.regexp_extract("image_path", r"(\.[^.]*)$", 1)), F.lit(";base64,"), F.base64(F.encode("image_path", "utf-8"))).alias("data_url"))


@R.query("file_results", f"WITH {JB}, c AS (SELECT doc_id, count(*) AS elements FROM (SELECT DISTINCT ON (elem_id) * FROM content_list) GROUP BY doc_id) SELECT request_id, count(*) AS files, count(*) FILTER (WHERE lower(suffix) IN ('.pdf', {str(IMAGES)[1:-1]})) AS successful_files, count(*) FILTER (WHERE NOT lower(suffix) IN ('.pdf', {str(IMAGES)[1:-1]})) AS failed_files, CAST(coalesce(sum(elements), 0) AS BIGINT) AS elements FROM jb LEFT JOIN c USING (doc_id) GROUP BY request_id")
def file_results(spark, sf_dir):
    """Batch response of each request: one bad file is an item with an error and doesn't stop the others."""
    c = load(spark, sf_dir, "content_list", "elem_id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("elements"))
    j = jobs(spark, sf_dir).join(c, "doc_id", "left").withColumn("ok", source_kind(F.col("suffix")) != "error")
    return j.groupBy("request_id").agg(F.count("*").alias("files"), F.count_if("ok").alias("successful_files"), F.count_if(~F.col("ok")).alias("failed_files"), F.coalesce(F.sum("elements"), F.lit(0)).alias("elements"))


@R.query("annotate_errors", f"WITH {JB}, u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/' || stem WHEN doc_id % 5 = 1 THEN '' ELSE '/data/' || stem || suffix END AS uri FROM jb) SELECT doc_id, CASE WHEN starts_with(uri, 'http://') OR starts_with(uri, 'https://') THEN 403 WHEN uri = '' THEN 400 END AS code, CASE WHEN starts_with(uri, 'http://') OR starts_with(uri, 'https://') THEN 'PERMISSION_DENIED' WHEN uri = '' THEN 'INVALID_ARGUMENT' END AS status FROM u")
def annotate_errors(spark, sf_dir):
    """Errors of image requests by their address: remote ones are refused, missing ones invalid."""
    uri = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://example.org/"), "stem")).when(F.col("doc_id") % 5 == 1, "").otherwise(F.concat(F.lit("/data/"), "stem", "suffix"))
    j = jobs(spark, sf_dir).withColumn("uri", uri)
    remote = F.col("uri").startswith("http://") | F.col("uri").startswith("https://")
    return j.select("doc_id", F.when(remote, 403).when(F.col("uri") == "", 400).alias("code"), F.when(remote, "PERMISSION_DENIED").when(F.col("uri") == "", "INVALID_ARGUMENT").alias("status"))


def status(spark, sf_dir) -> DataFrame:
    """One row: the service's status document as JSON."""
    from leafwright.operators import stats

    totals = stats.requests(spark, sf_dir, "failed").agg(F.count("*").alias("requests"), F.count_if(~F.col("failed")).alias("success"), F.count_if("failed").alias("errors"))
    per = stats.shard_status(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("shard_id", "device_id", "request_count", "busy_us", "npu_busy_us", "avg_infer_ms"))).alias("per_device"))  # a fixed table of 8
    lock = stats.lock_stats(spark, sf_dir).select(F.struct("*").alias("pipeline_lock"))
    balance = stats.load_imbalance(spark, sf_dir).select("imbalanced")
    one = totals.join(F.broadcast(per)).join(F.broadcast(lock)).join(F.broadcast(balance))  # one row each
    return one.select(F.to_json(F.struct(F.lit("running").alias("status"), "requests", "success", "errors", "per_device", "pipeline_lock", "imbalanced", F.struct(F.lit(True).alias("layout"), F.lit(True).alias("ocr"), F.lit(True).alias("wired_table"), F.lit(False).alias("wireless_table"), F.lit(False).alias("formula_latex")).alias("capabilities"))).alias("status"))


def _status_sql() -> str:
    from leafwright.operators.stats import IMBALANCE, PAGES, SHARDS_CTE, _us

    d = lambda c: f"CAST({c} AS VARCHAR)"
    lock = ["'\"samples\":' || count(*)"]
    for c, n in (("npu_lock_wait_ms", "wait"), ("npu_lock_hold_ms", "hold")):
        lock += [f"'\"{n}_total_us\":' || CAST(sum({_us(c)}) AS BIGINT)", f"'\"{n}_max_us\":' || max({_us(c)})", f"'\"{n}_avg_ms\":' || {d(f'round(sum({_us(c)}) / CAST(count(*) AS DOUBLE) / 1000.0::DOUBLE, 6)')}"]
    lock_text = " || ',' || ".join(lock)
    return f"""WITH {SHARDS_CTE}, {PAGES}, st AS (SELECT s.shard_id, s.device_id, coalesce(request_count, 0) AS request_count, coalesce(busy_us, 0) AS busy_us, coalesce(npu_busy_us, 0) AS npu_busy_us, round(coalesce(npu_busy_us / CAST(request_count AS DOUBLE) / 1000.0::DOUBLE, 0), 6) AS avg_infer_ms FROM shards s LEFT JOIN sh USING (shard_id)),
    pd AS (SELECT '[' || string_agg('{{"shard_id":' || shard_id || CASE WHEN device_id IS NOT NULL THEN ',"device_id":' || device_id ELSE '' END || ',"request_count":' || request_count || ',"busy_us":' || busy_us || ',"npu_busy_us":' || npu_busy_us || ',"avg_infer_ms":' || {d('avg_infer_ms')} || '}}', ',' ORDER BY shard_id) || ']' AS t FROM st),
    lk AS (SELECT '{{' || {lock_text} || '}}' AS t FROM pages), rq AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT failed) AS ok, count(*) FILTER (WHERE failed) AS bad FROM req),
    im AS (SELECT round(max(request_count) / CAST(min(request_count) AS DOUBLE), 9) > {IMBALANCE} OR round(max(busy_us) / CAST(min(busy_us) AS DOUBLE), 9) > {IMBALANCE} AS f FROM sh WHERE request_count > 0 OR busy_us > 0)
    SELECT '{{"status":"running","requests":' || n || ',"success":' || ok || ',"errors":' || bad || ',"per_device":' || pd.t || ',"pipeline_lock":' || lk.t || ',"imbalanced":' || CAST(f AS VARCHAR) || ',"capabilities":{{"layout":true,"ocr":true,"wired_table":true,"wireless_table":false,"formula_latex":false}}}}' AS status FROM rq, pd, lk, im"""


R.query("service_status", _status_sql())(status)
