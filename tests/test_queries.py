"""Every query of the core on the smallest tables, against its SQL where it has one."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerloom.queries import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def values(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if hasattr(x, "is_integer") or type(x).__name__.startswith(("int", "float", "Decimal")) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(x)

    return sorted(tuple(plain(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_columns_of_the_found_queries(spark):
    assert catalog.QUERIES["p2_found"](spark, DATA).dtypes == [("label_id", "bigint"), ("pos", "int"), ("category", "string")]
    assert catalog.QUERIES["p3_found"](spark, DATA).dtypes == [("line_id", "string"), ("rate_ord", "int"), ("rate_cents", "bigint")]
    assert catalog.QUERIES["p4_found"](spark, DATA).dtypes == [(c, "string") for c in ("src_table", "src_key", "ref_key", "orphan_kind", "load_month")]


def test_core_plans_stay_in_the_jvm(spark):
    for name in ("p2_found", "p3_found", "p4_found", "findings", "audit_report"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_the_core_knows_nothing_of_llm():
    root = Path(__file__).resolve().parent.parent / "ledgerloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "ledgerloom.llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "cap_extremes", "price_candidates", "audit_report", "grounded_names"])
def test_nothing_changes_beyond_the_broadcast_bound(spark, monkeypatch, name):
    from ledgerloom.operators import bounded

    want = values(catalog.QUERIES[name](spark, DATA).toPandas())
    monkeypatch.setattr(bounded, "is_bounded", lambda *a: False)
    assert values(catalog.QUERIES[name](spark, DATA).toPandas()) == want


def test_every_kind_of_fault_is_injected_found_and_named(spark):
    got = {r.fault: r for r in catalog.QUERIES["fault_injection_kinds"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 8 and all(r.injected > 0 and r.injected == r.detected == r.named and r.false_alarms == 0 for r in got.values()), got


def test_a_report_with_other_columns_is_rejected(spark):
    from ledgerloom.plans.audit import REPORT, violations

    units = spark.createDataFrame([("c", "i")], "contract_id string, invoice_id string")
    row = {"contract_id": "c", "invoice_id": "i", "flagged": 0, "categories": None, "expected_total_cents": 1, "billed_total_cents": 1, "confidence": 0.5}
    good = spark.createDataFrame([tuple(row.values())], "contract_id string, invoice_id string, flagged int, categories string, expected_total_cents long, billed_total_cents long, confidence double")
    assert good.columns == list(REPORT) and violations(good, units).collect() == []
    assert [tuple(r) for r in violations(good.drop("confidence"), units).collect()] == [("columns", 1)]
    assert {r.violation: r.n for r in violations(good.limit(0), units).collect()} == {"missing": 1}


def test_every_line_and_finding_of_an_invoice_comes_out(spark):
    out = catalog.QUERIES["explained_invoice_lines"](spark, DATA).cache()
    sums = catalog.QUERIES["explained_invoices"](spark, DATA)
    assert out.select("contract_id", "source_seq").distinct().count() == sums.count()
    assert out.where("line_id is not null").count() == sums.agg({"n_lines": "sum"}).first()[0]
    assert out.where("findings <> ''").count() > 0 and out.where("line_findings <> ''").count() > 0
