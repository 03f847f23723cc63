"""Tables: matching text to cells, validity, HTML, and recovery of the grid from cell outlines.

Joins are on the table, whose cells and lines are few; the recovery runs over sorted Arrow streams of whole tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.plans.arrow_groups import grouped_arrow
from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
LEAST_OVERLAP = 0.3
ROW_BREAK, COLUMN_NEAR, SPAN_NEAR = 10.0, 15.0, 10.0

CELLS_CTE = """c0 AS (SELECT l_orderkey AS table_id, l_partkey AS lp, l_suppkey AS ls, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos,
  concat(l_returnflag, ' < ', l_linestatus, ' & "', CAST(l_partkey AS {string}), '"') AS content FROM {lineitem}),
cells AS (SELECT table_id, pos AS cell_index,
  CAST(CASE WHEN table_id % 7 = 0 AND pos = 1 THEN 0 WHEN table_id % 5 = 2 AND pos > 0 THEN floor((pos - 1) / 3) + 1 ELSE floor(pos / 3) END AS INT) AS r,
  CAST(CASE WHEN table_id % 7 = 0 AND pos = 1 THEN 0 WHEN table_id % 5 = 2 THEN CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) % 3 END ELSE pos % 3 END AS INT) AS c,
  1 AS row_span, CASE WHEN table_id % 5 = 2 AND pos = 0 THEN 3 ELSE 1 END AS col_span, content FROM c0),
boxes AS (SELECT table_id, cell_index, c * 100 AS x0, r * 50 AS y0, (c + col_span) * 100 AS x1, (r + row_span) * 50 AS y1 FROM cells),
ocr AS (SELECT table_id, pos AS line_index, concat('w', CAST(lp AS {string})) AS text, CAST((lp * 7) % 280 AS INT) AS x0, CAST((ls * 11) % 140 AS INT) AS y0, CAST((lp * 7) % 280 + 30 + lp % 60 AS INT) AS x1, CAST((ls * 11) % 140 + 10 + ls % 30 AS INT) AS y1 FROM c0)"""
T = "WITH " + CELLS_CTE.replace("{lineitem}", "lineitem").replace("{string}", "VARCHAR")


def _derived(spark, sf_dir, name: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    return spark.sql("WITH " + CELLS_CTE.replace("{string}", "STRING") + f" SELECT * FROM {name}", lineitem=lines)


def match_cells(cells: DataFrame, lines: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Cell of each line: the one that covers most of it, the first of equals, if that is more than `least` of its area. Empty lines and lines without cell are left out."""
    c = cells.select("table_id", "cell_index", *[F.col(k).alias("c" + k) for k in ("x0", "y0", "x1", "y1")])
    inter = F.greatest(F.lit(0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) * F.greatest(F.lit(0), F.least("y1", "cy1") - F.greatest("y0", "cy0"))
    area = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    both = lines.where(F.coalesce("text", F.lit("")) != "").join(c, "table_id").where((F.col("x0") < F.col("cx1")) & (F.col("cx0") < F.col("x1")) & (F.col("y0") < F.col("cy1")) & (F.col("cy0") < F.col("y1"))).withColumn("share", inter / area)
    best = both.groupBy("table_id", "line_index").agg(F.max_by(F.struct("cell_index", "share", "text"), F.struct("share", -F.col("cell_index"))).alias("b"))
    return best.where(F.col("b.share") > least).select("table_id", "line_index", "b.cell_index", "b.share", "b.text")


MATCH = f"""{T}, m AS (SELECT o.table_id, o.line_index, o.text, b.cell_index, (least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0)) / CAST(greatest(1, (o.x1 - o.x0) * (o.y1 - o.y0)) AS DOUBLE) AS share
  FROM ocr o JOIN boxes b ON o.table_id = b.table_id AND o.x0 < b.x1 AND b.x0 < o.x1 AND o.y0 < b.y1 AND b.y0 < o.y1),
k AS (SELECT *, row_number() OVER (PARTITION BY table_id, line_index ORDER BY share DESC, cell_index) AS rn FROM m), hit AS (SELECT * FROM k WHERE rn = 1 AND share > {LEAST_OVERLAP}::DOUBLE)"""


@R.query("ocr_cell_match", f"{MATCH} SELECT table_id, line_index, cell_index, round(share, 9) AS share FROM hit")
def ocr_cell_match(spark, sf_dir):
    return match_cells(_derived(spark, sf_dir, "boxes"), _derived(spark, sf_dir, "ocr")).select("table_id", "line_index", "cell_index", F.round("share", 9).alias("share"))


@R.query("table_cell_text", f"{MATCH} SELECT b.table_id, b.cell_index, coalesce(string_agg(h.text, chr(10) ORDER BY h.line_index), '') AS text FROM boxes b LEFT JOIN hit h USING (table_id, cell_index) GROUP BY ALL")
def table_cell_text(spark, sf_dir):
    """Every cell with its lines in reading order; cells without a line are empty."""
    boxes = _derived(spark, sf_dir, "boxes")
    hits = match_cells(boxes, _derived(spark, sf_dir, "ocr")).groupBy("table_id", "cell_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return boxes.select("table_id", "cell_index").join(hits, ["table_id", "cell_index"], "left").select("table_id", "cell_index", F.coalesce("text", F.lit("")).alias("text"))


def validity(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table, whether cells overlap, leave holes or are malformed."""
    bad = (F.col("r") < 0) | (F.col("c") < 0) | (F.col("row_span") < 1) | (F.col("col_span") < 1)
    spots = cells.where(~bad).select("table_id", F.explode(F.sequence("r", F.col("r") + F.col("row_span") - 1)).alias("i"), "c", "col_span").select("table_id", "i", F.explode(F.sequence("c", F.col("c") + F.col("col_span") - 1)).alias("j")).groupBy("table_id", "i", "j").count()
    spots = spots.groupBy("table_id").agg((F.max("count") > 1).alias("overlap"), F.count("*").alias("covered"))
    dims = cells.groupBy("table_id").agg(F.max(F.col("r") + F.col("row_span")).alias("n_rows"), F.max(F.col("c") + F.col("col_span")).alias("n_cols"), F.max(bad).alias("malformed"))
    out = dims.join(spots, "table_id", "left")
    return out.select("table_id", "n_rows", "n_cols", F.coalesce("overlap", F.lit(False)).alias("overlap"), (F.coalesce("covered", F.lit(0)) < F.col("n_rows") * F.col("n_cols")).alias("hole"), "malformed")


VALID = f"""{T}, sp AS (SELECT table_id, i, j, count(*) AS n FROM (SELECT table_id, unnest(range(r, r + row_span)) AS i, c, col_span FROM cells) a, LATERAL (SELECT unnest(range(c, c + col_span)) AS j) b GROUP BY ALL),
va AS (SELECT table_id, max(n) > 1 AS overlap, count(*) AS covered FROM sp GROUP BY table_id), di AS (SELECT table_id, max(r + row_span) AS n_rows, max(c + col_span) AS n_cols FROM cells GROUP BY table_id),
val AS (SELECT di.table_id, n_rows, n_cols, overlap, covered < n_rows * n_cols AS hole FROM di JOIN va USING (table_id))"""


@R.query("table_validity", f"{VALID} SELECT table_id, n_rows, n_cols, overlap, hole FROM val")
def table_validity(spark, sf_dir):
    return validity(_derived(spark, sf_dir, "cells")).drop("malformed")


REASON = "CASE WHEN NOT valid_box THEN 'invalid_table_bbox' WHEN NOT supported THEN CASE WHEN kind = 'WIRELESS' THEN 'wireless_table' ELSE 'table_model_unavailable' END WHEN illegal IS NULL THEN 'no_cell_table' WHEN illegal THEN 'illegal_table_structure' WHEN empty_html THEN 'empty_table_html' END"


@R.query("table_fallback_reason", f"""{VALID}, tb AS (SELECT o_orderkey AS table_id, o_orderkey % 11 <> 3 AS valid_box, o_orderkey % 13 <> 5 AS supported, CASE WHEN o_orderkey % 2 = 1 THEN 'WIRELESS' ELSE 'UNKNOWN' END AS kind, o_orderkey % 17 = 4 AS empty_html FROM orders),
    j AS (SELECT tb.*, overlap OR hole AS illegal FROM tb LEFT JOIN val USING (table_id)), f AS (SELECT table_id, {REASON} AS reason FROM j) SELECT *, CASE WHEN reason IS NOT NULL THEN '[Unsupported table: ' || reason || ']' END AS text FROM f""")
def table_fallback_reason(spark, sf_dir):
    """First reason, in order, why a table can't be shown as a grid; null where it can."""
    orders = load(spark, sf_dir, "orders", F.col("o_orderkey").alias("table_id"))
    t = orders.withColumn("valid_box", F.col("table_id") % 11 != 3).withColumn("supported", F.col("table_id") % 13 != 5).withColumn("kind", F.when(F.col("table_id") % 2 == 1, "WIRELESS").otherwise("UNKNOWN")).withColumn("empty_html", F.col("table_id") % 17 == 4)
    v = validity(_derived(spark, sf_dir, "cells")).select("table_id", (F.col("overlap") | F.col("hole") | F.col("malformed")).alias("illegal"))
    return t.join(v, "table_id", "left").select("table_id", F.expr(REASON).alias("reason")).withColumn("text", F.when(F.col("reason").isNotNull(), F.concat(F.lit("[Unsupported table: "), "reason", F.lit("]"))))


def escape_html(c: Column) -> Column:
    """& < > and the double quote; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_html(cells: DataFrame) -> DataFrame:
    """table_id and HTML of tables whose cells tile the grid."""
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f" {name}="), F.col(c).cast("string"))).otherwise("")
    td = F.concat(F.lit("<td"), span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), escape_html(F.coalesce("content", F.lit(""))), F.lit("</td>"))
    ok = validity(cells).where("NOT overlap AND NOT hole AND NOT malformed").select("table_id")
    rows = cells.join(ok, "table_id", "left_semi").groupBy("table_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell_index", td.alias("td")))), lambda x: x["td"]), "").alias("tds"))
    line = F.concat(F.lit("  <tr>"), "tds", F.lit("</tr>\n"))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "").alias("trs")).select("table_id", F.concat(F.lit('<table border="1">\n'), "trs", F.lit("</table>")).alias("html"))


_ESC = "replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@R.query("table_html", f"""{VALID}, rw AS (SELECT table_id, r, string_agg('<td' || CASE WHEN row_span > 1 THEN ' rowspan=' || row_span ELSE '' END || CASE WHEN col_span > 1 THEN ' colspan=' || col_span ELSE '' END || '>' || {_ESC} || '</td>', '' ORDER BY c, cell_index) AS tds
    FROM cells JOIN (SELECT table_id FROM val WHERE NOT overlap AND NOT hole) g USING (table_id) GROUP BY table_id, r) SELECT table_id, '<table border="1">' || chr(10) || string_agg('  <tr>' || tds || '</tr>' || chr(10), '' ORDER BY r) || '</table>' AS html FROM rw GROUP BY table_id""")
def table_html_query(spark, sf_dir):
    return table_html(_derived(spark, sf_dir, "cells"))


@R.query("table_rows", f"""{T}, j AS (SELECT table_id, cell_index, x0, y0 + (table_id * 3 + cell_index) % 4 AS y0 FROM boxes), d AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY table_id ORDER BY y0, x0, cell_index)) > {ROW_BREAK} THEN 1 ELSE 0 END AS brk FROM j)
    SELECT table_id, cell_index, CAST(sum(brk) OVER (PARTITION BY table_id ORDER BY y0, x0, cell_index) AS BIGINT) AS table_row FROM d""")
def table_rows(spark, sf_dir):
    """Row of each cell: a new row where the top edge jumps by more than 10."""
    w = Window.partitionBy("table_id").orderBy("y0", "x0", "cell_index")
    j = _derived(spark, sf_dir, "boxes").select("table_id", "cell_index", "x0", (F.col("y0") + (F.col("table_id") * 3 + F.col("cell_index")) % 4).alias("y0"))
    return j.withColumn("brk", F.when(F.abs(F.col("y0") - F.lag("y0").over(w)) > ROW_BREAK, 1).otherwise(0)).select("table_id", "cell_index", F.sum("brk").over(w).alias("table_row"))


def _reach(steps: np.ndarray, start: int, length: float) -> int:
    """How many steps from `start` make up `length`: the first sum within reach, or the nearer one where it is passed."""
    sums = np.cumsum(steps[start:])
    if not len(sums) or sums[0] > length:
        return 1
    for i, s in enumerate(sums):
        if abs(s - length) <= SPAN_NEAR:
            return i + 1
        if s > length:
            return i + 1 if abs(s - length) < abs(sums[i - 1] - length) else i
    return len(sums)


def recover_grid(box: np.ndarray) -> np.ndarray:
    """Row, column, row span and column span of the cells of a table from their outlines (x0, y0, x1, y1)."""
    order: list[int] = []
    for i in range(len(box)):  # top to bottom; tops within 20 count as level, then left to right. Not transitive: the given order decides
        k = len(order)
        while k and (box[i, 1] < box[order[k - 1], 1] if abs(box[i, 1] - box[order[k - 1], 1]) > 20 else box[i, 0] < box[order[k - 1], 0]):
            k -= 1
        order.insert(k, i)
    tops = box[order, 1]
    row_of = np.concatenate([[0], np.cumsum(np.abs(np.diff(tops)) > ROW_BREAK)]).astype(int)
    rows = [[order[i] for i in np.flatnonzero(row_of == r)] for r in range(row_of[-1] + 1)]
    longest = max(rows, key=len)
    edges = [float(box[i, 0]) for i in longest]
    low, high = edges[0], float(box[longest[-1], 2])
    for i in (i for r in rows for i in r):
        for value, closes in ((float(box[i, 0]), False), (float(box[i, 2]), True)):
            if any(abs(value - e) <= COLUMN_NEAR for e in edges):
                continue
            if value < low:
                edges.insert(0, value)
                low = value
            elif value > high:
                if not closes:
                    edges.append(value)
                high = value
            else:
                at = next((k for k, e in enumerate(edges) if value < e), None)
                if at is not None:
                    edges.insert(at, value)
    columns = np.array(edges)
    widths = np.append(np.diff(columns), high - columns[-1])
    marks = np.array([box[r[0], 1] for r in rows])
    heights = np.append(np.diff(marks), max(box[i, 3] - box[i, 1] for i in rows[-1]))
    out = np.zeros((len(box), 4), dtype=np.int32)
    for r, members in enumerate(rows):
        used = 0
        for i in members:
            c = max(used, int(np.abs(columns - box[i, 0]).argmin()))
            span = _reach(widths, c, box[i, 2] - box[i, 0]) if c < len(widths) else 1
            used += span
            out[i] = r, c, _reach(heights, r, box[i, 3] - box[i, 1]), span
    return out


def table_grid(boxes: DataFrame) -> DataFrame:
    """table_id, cell_index, r, c, row_span, col_span recovered from outlines, table by table."""

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        box = np.stack([t.column(k).to_numpy().astype(float) for k in ("x0", "y0", "x1", "y1")], axis=1)
        got = np.concatenate([recover_grid(box[s:e]) for s, e in zip(starts, np.append(starts[1:], t.num_rows))])
        return pa.table({"table_id": t.column("table_id"), "cell_index": t.column("cell_index"), "r": got[:, 0], "c": got[:, 1], "row_span": got[:, 2], "col_span": got[:, 3]})

    return grouped_arrow(boxes, ["table_id"], run, "table_id bigint, cell_index int, r int, c int, row_span int, col_span int", order=["cell_index"])


@R.query("table_grid")
def table_grid_query(spark, sf_dir):
    return table_grid(_derived(spark, sf_dir, "boxes"))


DRAWN_CTE = """w0 AS (SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS cell_index, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n FROM lineitem),
drawn AS (SELECT table_id, cell_index, CAST(CASE WHEN table_id % 5 = 2 AND cell_index > 0 THEN floor((cell_index - 1) / 3) + 1 ELSE floor(cell_index / 3) END AS INT) AS r, CAST(CASE WHEN table_id % 5 <> 2 THEN cell_index % 3 WHEN cell_index = 0 THEN 0 ELSE (cell_index - 1) % 3 END AS INT) AS c, CAST(CASE WHEN table_id % 5 = 2 AND cell_index = 0 THEN least(3, greatest(1, n - 1)) ELSE 1 END AS INT) AS col_span FROM w0)"""


def drawn(spark, sf_dir) -> DataFrame:
    """Cells of a well-formed table for each order: three columns, under a head across all of them where the id is 2 modulo 5."""
    return spark.sql("WITH " + DRAWN_CTE.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM drawn", lineitem=load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))


@R.query("table_grid_drawn", f"WITH {DRAWN_CTE} SELECT table_id, cell_index, r, c, 1 AS row_span, col_span FROM drawn")
def table_grid_drawn(spark, sf_dir):
    """The grid recovered from the outlines of well-formed tables is the one they were drawn from."""
    d = drawn(spark, sf_dir)
    edge = lambda c, k: (c * k).cast("double")
    boxes = d.select("table_id", "cell_index", edge(F.col("c"), 100).alias("x0"), edge(F.col("r"), 50).alias("y0"), edge(F.col("c") + F.col("col_span"), 100).alias("x1"), edge(F.col("r") + 1, 50).alias("y1"))
    return table_grid(boxes)


ALPHA, ANGLE = 100.0, 50.0
ENDS = (("x1", "y1", "x1", "y1"), ("x1", "y1", "x2", "y2"), ("x2", "y2", "x1", "y1"), ("x2", "y2", "x2", "y2"))
RULES_CTE = "ru AS (SELECT table_id, line_index, CAST(x0 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y1, CAST(x1 AS DOUBLE) AS x2, CAST(y0 + (line_index + table_id) % 3 AS DOUBLE) AS y2 FROM ocr)"


def rules_of(spark, sf_dir) -> DataFrame:
    """Nearly level rules, one for each derived line."""
    d = lambda c: c.cast("double")
    y = F.col("y0")
    return _derived(spark, sf_dir, "ocr").select("table_id", "line_index", d(F.col("x0")).alias("x1"), d(y).alias("y1"), d(F.col("x1")).alias("x2"), d(y + (F.col("line_index") + F.col("table_id")) % 3).alias("y2"))


def bridges(rules: DataFrame, longest: float = ALPHA, steepest: float = ANGLE) -> DataFrame:
    """New rules between the ends of two rules of a table, in each order and for all four pairs of ends, that are short and flat enough.

    Rules of which one covers the middle of the other, in either direction, are left out.
    """
    a = rules.select("table_id", F.col("line_index").alias("from_line"), *[F.col(k).alias("a" + k) for k in ("x1", "y1", "x2", "y2")])
    b = rules.select("table_id", F.col("line_index").alias("to_line"), *[F.col(k).alias("b" + k) for k in ("x1", "y1", "x2", "y2")])
    middle = lambda p, k: (F.col(f"{p}{k}1") + F.col(f"{p}{k}2")) / 2
    covers = lambda p, q, k: (F.col(f"{p}{k}1") < middle(q, k)) & (middle(q, k) < F.col(f"{p}{k}2"))
    apart = ~(covers("b", "a", "x") | covers("b", "a", "y") | covers("a", "b", "x") | covers("a", "b", "y"))
    pairs = a.join(b, "table_id").where((F.col("from_line") != F.col("to_line")) & apart)
    each = pairs.select("table_id", "from_line", "to_line", F.explode(F.array(*[F.struct(F.lit(i).alias("ends"), F.col("a" + p).alias("x1"), F.col("a" + q).alias("y1"), F.col("b" + r).alias("x2"), F.col("b" + t).alias("y2")) for i, (p, q, r, t) in enumerate(ENDS)])).alias("n")).select("table_id", "from_line", "to_line", "n.*")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return each.withColumn("gap", F.sqrt(dx * dx + dy * dy)).where((F.col("gap") < longest) & (F.degrees(F.atan(F.abs(dy / (dx + 1e-10)))) < steepest))


_COVER = "({p}.{k}1 < ({q}.{k}1 + {q}.{k}2) / 2 AND ({q}.{k}1 + {q}.{k}2) / 2 < {p}.{k}2)"


@R.query("line_bridges", f"""{T}, {RULES_CTE}, p AS (SELECT a.table_id, a.line_index AS from_line, b.line_index AS to_line, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM ru a JOIN ru b ON a.table_id = b.table_id AND a.line_index <> b.line_index WHERE NOT ({' OR '.join(_COVER.format(p=p, q=q, k=k) for p, q in (('b', 'a'), ('a', 'b')) for k in 'xy')})),
    e AS ({' UNION ALL '.join(f'SELECT table_id, from_line, to_line, {i} AS ends, b{r} - a{p} AS dx, b{t} - a{q} AS dy FROM p' for i, (p, q, r, t) in enumerate(ENDS))})
    SELECT table_id, from_line, to_line, ends, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM e WHERE sqrt(dx * dx + dy * dy) < {ALPHA}::DOUBLE AND degrees(atan(abs(dy / (dx + 1e-10::DOUBLE)))) < {ANGLE}::DOUBLE""")
def line_bridges(spark, sf_dir):
    return bridges(rules_of(spark, sf_dir)).select("table_id", "from_line", "to_line", "ends", F.round("gap", 6).alias("gap"))


@R.query("table_lines", f"""{T}, {RULES_CTE}, p AS (SELECT a.table_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM ru a JOIN ru b ON a.table_id = b.table_id AND a.line_index <> b.line_index WHERE NOT ({' OR '.join(_COVER.format(p=p, q=q, k=k) for p, q in (('b', 'a'), ('a', 'b')) for k in 'xy')})),
    e AS ({' UNION ALL '.join(f'SELECT table_id, b{r} - a{p} AS dx, b{t} - a{q} AS dy FROM p' for p, q, r, t in ENDS)}), n AS (SELECT table_id FROM e WHERE sqrt(dx * dx + dy * dy) < {ALPHA}::DOUBLE AND degrees(atan(abs(dy / (dx + 1e-10::DOUBLE)))) < {ANGLE}::DOUBLE)
    SELECT table_id, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(bridged) AS BIGINT) AS bridged FROM (SELECT table_id, 1 AS detected, 0 AS bridged FROM ru UNION ALL SELECT table_id, 0, 1 FROM n) GROUP BY table_id""")
def table_lines(spark, sf_dir):
    """Detected rules and the bridges between them as one set, counted by table."""
    rules = rules_of(spark, sf_dir)
    kinds = rules.select("table_id", F.lit(1).alias("detected"), F.lit(0).alias("bridged")).unionAll(bridges(rules).select("table_id", F.lit(0), F.lit(1)))
    return kinds.groupBy("table_id").agg(F.sum("detected").alias("detected"), F.sum("bridged").alias("bridged"))


def join_rules(rules: DataFrame) -> DataFrame:
    """table_id, line_index, is_row, x1, y1, x2, y2: the rules of each table drawn out to each other, rows and columns in the order of their index."""
    from leafwright.functions.raster import joined_rules

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        line = np.stack([t.column(k).to_numpy() for k in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
        row = t.column("is_row").to_numpy(zero_copy_only=False)
        for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
            part, level = line[s:e], row[s:e]
            part[level], part[~level] = joined_rules(part[level], part[~level])
        keys = t.select(["table_id", "line_index", "is_row"])
        for i, k in enumerate(("x1", "y1", "x2", "y2")):
            keys = keys.append_column(k, pa.array(line[:, i]))
        return keys

    return grouped_arrow(rules, ["table_id"], run, "table_id bigint, line_index int, is_row boolean, x1 double, y1 double, x2 double, y2 double", order=["line_index"])


@R.query("extended_lines")
def extended_lines(spark, sf_dir):
    """Rules of derived tables, odd ones turned upright, drawn out to each other."""
    r = rules_of(spark, sf_dir).withColumn("is_row", F.col("line_index") % 2 == 0)
    up = ~F.col("is_row")
    return join_rules(r.select("table_id", "line_index", "is_row", "x1", "y1", F.when(up, F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(up, F.col("y1") + 40).otherwise(F.col("y2")).alias("y2")))


LETTERBOX = 768


def letterbox(width: Column, height: Column, size: int = LETTERBOX) -> dict[str, Column]:
    """Scale, size and padding of an image fitted into a square."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    w, h = (width * scale).cast("int"), (height * scale).cast("int")
    return {"scale": scale, "fit_w": w, "fit_h": h, "pad_left": F.floor((size - w) / 2).cast("int"), "pad_top": F.floor((size - h) / 2).cast("int"), "resample": F.when(scale < 1, "area").otherwise("cubic")}


@R.query("table_letterbox", f"WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list), b AS (SELECT elem_id, CAST(trunc(x1) AS INT) - CAST(trunc(x0) AS INT) AS w, CAST(trunc(y1) AS INT) - CAST(trunc(y0) AS INT) AS h FROM el WHERE element_type = 'table'), s AS (SELECT *, {LETTERBOX}.0::DOUBLE / greatest(w, h) AS scale FROM b WHERE w > 0 AND h > 0), f AS (SELECT *, CAST(trunc(w * scale) AS INT) AS fit_w, CAST(trunc(h * scale) AS INT) AS fit_h FROM s) SELECT elem_id, round(scale, 9) AS scale, fit_w, fit_h, CAST(floor(({LETTERBOX} - fit_w) / 2.0) AS INT) AS pad_left, CAST(floor(({LETTERBOX} - fit_h) / 2.0) AS INT) AS pad_top, CASE WHEN scale < 1 THEN 'area' ELSE 'cubic' END AS resample, round(640.0::DOUBLE / w, 9) AS layout_scale_x, round(640.0::DOUBLE / h, 9) AS layout_scale_y FROM f")
def table_letterbox(spark, sf_dir):
    """How the image of each table is fitted into the model's square, and the factors of the plain resize for the layout model. Tables without area have no row."""
    el = load(spark, sf_dir, "content_list", "elem_id", "element_type", "x0", "y0", "x1", "y1").where("element_type = 'table'").dropDuplicates(["elem_id"])
    i = lambda c: F.col(c).cast("int")
    b = el.select("elem_id", (i("x1") - i("x0")).alias("w"), (i("y1") - i("y0")).alias("h")).where("w > 0 AND h > 0")
    box = letterbox(F.col("w"), F.col("h"))
    return b.select("elem_id", *[(F.round(v, 9) if k == "scale" else v).alias(k) for k, v in box.items()], F.round(640.0 / F.col("w"), 9).alias("layout_scale_x"), F.round(640.0 / F.col("h"), 9).alias("layout_scale_y"))


MOST_ROWS = 15


def zipped_rows(a: DataFrame, b: DataFrame, key: str, most: int = MOST_ROWS) -> DataFrame:
    """key, row_index, columns of two tables side by side and their difference, row by row up to the shorter one and `most` rows. Wants key, row_index, logical_columns."""
    left, right = (t.where(F.col("row_index") < most).select(key, "row_index", F.col("logical_columns").alias(n)) for t, n in ((a, "columns_a"), (b, "columns_b")))
    return left.join(right, [key, "row_index"]).withColumn("difference", F.col("columns_a") - F.col("columns_b"))


@R.query("table_row_diff", f"""WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list), t AS (SELECT elem_id, doc_id, regexp_extract(html, '(?s)<table.*?</table>') AS tab FROM el WHERE html IS NOT NULL), r AS (SELECT elem_id, doc_id, unnest(regexp_extract_all(tab, '(?s)<tr>(.*?)</tr>', 1)) AS tr, generate_subscripts(regexp_extract_all(tab, '(?s)<tr>(.*?)</tr>', 1), 1) - 1 AS row_index FROM t),
    c AS (SELECT elem_id, doc_id, CAST(row_index AS INT) AS row_index, CAST(len(regexp_extract_all(tr, '<td[^>]*>')) + coalesce(list_sum(list_transform(regexp_extract_all(tr, 'colspan=.?([0-9]+)', 1), lambda x: CAST(x AS INT) - 1)), 0) AS INT) AS n FROM r WHERE row_index < {MOST_ROWS}),
    o AS (SELECT elem_id, lead(elem_id) OVER (PARTITION BY doc_id ORDER BY elem_id) AS other FROM t) SELECT a.elem_id, a.row_index, a.n AS columns_a, b.n AS columns_b, a.n - b.n AS difference FROM o JOIN c a ON a.elem_id = o.elem_id JOIN c b ON b.elem_id = o.other AND b.row_index = a.row_index""")
def table_row_diff(spark, sf_dir):
    """Each table's rows against those of the next table of its document."""
    rows = table_logical_columns(spark, sf_dir)
    t = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "html").dropDuplicates(["elem_id"]).where("html IS NOT NULL")
    pairs = t.select("elem_id", F.lead("elem_id").over(Window.partitionBy("doc_id").orderBy("elem_id")).alias("other"))
    other = pairs.join(rows.withColumnRenamed("elem_id", "other"), "other").select("elem_id", "row_index", "logical_columns")
    return zipped_rows(rows, other, "elem_id")


def html_page(body: Column, title: str = "table") -> Column:
    """A whole page around the first table of a text; an empty body where it has none."""
    head = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title></head><body>\n'
    return F.concat(F.lit(head), F.regexp_extract(F.coalesce(body, F.lit("")), "(?s)<table.*?</table>", 0), F.lit("\n</body></html>\n"))


@R.query("table_pages", """WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list) SELECT elem_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>table</title></head><body>' || chr(10) || coalesce(regexp_extract(html, '(?s)<table.*?</table>'), '') || chr(10) || '</body></html>' || chr(10) AS page FROM el WHERE element_type = 'table'""")
def table_pages(spark, sf_dir):
    el = load(spark, sf_dir, "content_list", "elem_id", "element_type", "html").where("element_type = 'table'").dropDuplicates(["elem_id"])
    return el.select("elem_id", html_page(F.col("html")).alias("page"))


@R.query("table_logical_columns", """WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list), t AS (SELECT elem_id, regexp_extract(html, '(?s)<table.*?</table>') AS tab FROM el WHERE html IS NOT NULL), r AS (SELECT elem_id, unnest(regexp_extract_all(tab, '(?s)<tr>(.*?)</tr>', 1)) AS tr, generate_subscripts(regexp_extract_all(tab, '(?s)<tr>(.*?)</tr>', 1), 1) - 1 AS row_index FROM t)
    SELECT elem_id, CAST(row_index AS INT) AS row_index, CAST(len(regexp_extract_all(tr, '<td[^>]*>')) + coalesce(list_sum(list_transform(regexp_extract_all(tr, 'colspan=.?([0-9]+)', 1), lambda x: CAST(x AS INT) - 1)), 0) AS INT) AS logical_columns FROM r""")
def table_logical_columns(spark, sf_dir):
    """Columns of each row of an element's first table, spans counted."""
    el = load(spark, sf_dir, "content_list", "elem_id", "html").dropDuplicates(["elem_id"]).where("html IS NOT NULL")
    rows = el.select("elem_id", F.posexplode(F.regexp_extract_all(F.regexp_extract("html", "(?s)<table.*?</table>", 0), F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("row_index", "tr"))
    spans = F.aggregate(F.regexp_extract_all("tr", F.lit("colspan=.?([0-9]+)"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int") - 1)
    return rows.select("elem_id", "row_index", (F.size(F.regexp_extract_all("tr", F.lit("<td[^>]*>"), F.lit(0))) + spans).alias("logical_columns"))
