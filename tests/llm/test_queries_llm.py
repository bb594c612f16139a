"""Registered queries against their SQL, and the entry point's guard."""

import sys

import pytest
from oracle import connect, differences

from reefline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, name):
    run, sql = QUERIES[name]
    assert differences(run(spark, FOLDER), connect(FOLDER), sql) == []


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    users = [p for p in (root / "reefline").rglob("*.py") if "llm" not in p.parts and "reefline.llm" in p.read_text()]
    assert users == []
    assert "reefline" in sys.modules
