"""Every query with SQL gives the same rows as that, and every other one runs, on the driver's smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import duck, norm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = got.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        a, b = norm(rows), norm(con.execute(sql).df())
        assert list(a.columns) == list(b.columns) and a.equals(b)


def test_references_to_names_are_found(spark):
    import re

    import pyarrow.parquet as pq

    from sightline.operators.page_changes import MODELS

    rows = pq.read_table(f"{DATA}/discovery_results.parquet", columns=["result_id", "raw_reference"]).to_pylist()
    want = {r["result_id"]: ",".join(m) for r in rows if (m := sorted({x.strip() for p in MODELS for x in re.findall(p, r["raw_reference"] or "")}))}
    got = {r["result_id"]: r["models"] for r in entry.queries()["q63_all_model_references"](spark, DATA).collect()}
    assert got == want and any("pixel" in x.lower() for x in got.values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(monkeypatch):
    import importlib

    original = importlib.import_module
    monkeypatch.setattr(importlib, "import_module", lambda n, *a: (_ for _ in ()).throw(ModuleNotFoundError(n, name="sightline.llm")) if n.startswith("sightline.llm") else original(n, *a))
    assert "p1_found" in entry.queries() and "p4_found" not in entry.queries()


def test_nothing_outside_imports_llm():
    root = Path(__file__).resolve().parent.parent / "sightline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sightline.llm" not in p.read_text(), p
