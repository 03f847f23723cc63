"""The survey map names every operator, and only queries and tests that are there; README holds it."""

import re
from pathlib import Path

from leafwright import catalogue
from survey_map import IDS, MAP, table

HERE = Path(__file__).parent


def test_map_is_whole_and_true():
    assert list(MAP) == IDS or sorted(MAP) == sorted(IDS)
    tests = set(re.findall(r"^def (test_\w+)", "\n".join(p.read_text() for p in HERE.glob("test_*.py")), re.M))
    known = set(catalogue.queries()) | tests | {"plug-in"}
    for k, names in MAP.items():
        assert names.split() and set(names.split()) <= known, (k, set(names.split()) - known)


def test_every_query_is_on_the_map_or_extra():
    extra = {"cer_pairs_whole", "content_list_flat", "document_stage_report", "latency_windows", "repeated_hash_check"}
    assert set(catalogue.queries()) - extra == {x for names in MAP.values() for x in names.split()} & set(catalogue.queries())


def test_readme_holds_the_map():
    assert table() in (HERE.parent / "README.md").read_text()
