"""Detections derived from the order lines: exact integer arithmetic, the same text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.sources import load

PAGE_W, PAGE_H = 2383, 3500

DETECTIONS_CTE = """d0 AS (
  SELECT l_orderkey AS page_id, l_partkey AS lp, l_suppkey AS ls,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS det_pos FROM {lineitem}),
d1 AS (SELECT *, CAST(floor(det_pos / 2) AS BIGINT) AS pr, det_pos % 2 AS odd FROM d0),
d2 AS (SELECT page_id, det_pos, CAST((page_id * 5 + pr * 7 + CASE WHEN odd = 1 AND ls % 2 = 0 THEN 0 ELSE odd * 3 END) % 24 AS INT) AS cls_id,
    CAST((lp * 7 + ls * 13) % 700 + 250 + 13 - det_pos AS INT) AS score_m,
    CAST((page_id * 37 + pr * 611) % 1700 + odd * (lp % 60) AS INT) AS x0, CAST((page_id * 53 + pr * 907) % 2900 + odd * (ls % 40) AS INT) AS y0,
    CAST(200 + (page_id * 11 + pr * 29) % 480 AS INT) AS w, CAST(80 + (page_id * 17 + pr * 41) % 500 AS INT) AS h FROM d1),
det AS (SELECT page_id, CAST(det_pos AS INT) AS det_pos, cls_id, score_m, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM d2)"""

#: For DuckDB, to be followed by the query.
DET = "WITH RECURSIVE " + DETECTIONS_CTE.replace("{lineitem}", "lineitem")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, det_pos, cls_id, score_m (thousandths), x0, y0, x1, y1."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return spark.sql("WITH " + DETECTIONS_CTE + " SELECT * FROM det", lineitem=lines)
