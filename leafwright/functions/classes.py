"""Layout classes, their thresholds and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the layout model by class id.
LABELS = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "table_title", "reference", "doc_title",
    "footnote", "header", "algorithm", "footer", "seal", "chart_title", "chart", "formula_number", "header_image", "footer_image", "aside_text",
)
#: Least score in thousandths, by class id; 500 where none is named.
LEAST_SCORE = {0: 300, 2: 400, 7: 300, 16: 450}
DEFAULT_SCORE = 500
#: Category of each label; anything else is unknown.
CATEGORY = {
    "text": "text content reference footnote number abstract aside_text", "title": "paragraph_title doc_title chart_title", "figure": "image header_image footer_image chart", "figure_caption": "figure_title", "table": "table",
    "table_caption": "table_title", "header": "header", "footer": "footer", "equation": "formula formula_number", "stamp": "algorithm seal", "code": "code",
}
#: Categories that are read as text, and those that nothing handles.
TEXT_CATEGORIES = ("text", "title", "content", "list", "code", "abstract", "reference", "index", "header", "footer", "table_caption", "table_footnote", "figure_caption", "stamp")
EQUATION_CATEGORIES = ("equation", "interline_equation")
UNSUPPORTED_CATEGORIES = ("unknown", "toc", "separator")
CATEGORY_OF = {label: cat for cat, labels in CATEGORY.items() for label in labels.split()}


def label_of(cls_id: Column) -> Column:
    """Label of a class id, `unknown` outside the model's classes."""
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), cls_id), F.lit("unknown"))


def category_of(label: Column) -> Column:
    table = F.create_map(*[x for k, v in CATEGORY_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, label), F.lit("unknown"))


def least_score(cls_id: Column) -> Column:
    out = F.lit(DEFAULT_SCORE)
    for k, v in LEAST_SCORE.items():
        out = F.when(cls_id == k, v).otherwise(out)
    return out


# the same as SQL text, for the oracle
LABEL_SQL = "CASE cls_id " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " ELSE 'unknown' END"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in CATEGORY.items()) + " ELSE 'unknown' END"
SCORE_SQL = "CASE " + " ".join(f"WHEN cls_id = {k} THEN {v}" for k, v in LEAST_SCORE.items()) + f" ELSE {DEFAULT_SCORE} END"
