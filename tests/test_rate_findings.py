import datetime as dt

import duckdb

from ledgerloom.queries import catalog

T0 = dt.datetime(2024, 1, 1)
LINE = ("i", "A", "2024-01-05", 1, 7, "per_day", T0)
TABLES = {
    "line_items": ("line_id string, contract_id string, source_seq string, invoice_id string, description string, service_date string, quantity long, unit_price_cents long, unit_basis_as_billed string, loaded_at timestamp_ntz", [(f"L{n}", c, seq, *LINE) for n, (c, seq) in enumerate([("h1", "s1"), ("h1", "s1"), ("h1", None), ("h1", None), ("h2", None), ("h2", "s9")])]),
    "invoices": ("contract_id string, source_seq string, invoice_date string, patient_id string, loaded_at timestamp_ntz", [("h1", "s1", "2024-01-09", "p1", T0)]),
    "dim_service": ("contract_id string, service string, unit_basis string, daily_cap long", [("h1", "A", "per_unit", 5), ("h2", "A", "per_unit", 5)]),
    "dim_rate": ("contract_id string, service string, rate_cents long", [("h1", "A", 100), ("h2", "A", 100)]),
}


def test_lines_without_source_seq_count_as_one_invoice_a_contract(spark, tmp_path):
    con = duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["rate_findings"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.SQL["rate_findings"]).fetchall()) == [("unit_basis", 6, 4), ("unit_price", 6, 4)]
