"""The queries p2, p3 and p4 over the billing tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import iso_day, key_of
from ledgerloom.operators.asknown import as_known_join
from ledgerloom.operators.bounded import lookup_join
from ledgerloom.operators.orphans import orphan_references, orphan_report
from ledgerloom.operators.packed import infer_delimiters, split_packed
from ledgerloom.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every packed category in a row of its own; the labels of a hospital are one source."""
    return split_packed(table(spark, sf, "hospital_1_labels"), ["label_id"], "error_categories", "category")


def p2_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """The delimiters inferred for the labels."""
    return infer_delimiters(table(spark, sf, "hospital_1_labels"), "error_categories")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rate valid on the day of each line and known by then."""
    lines = table(spark, sf, "line_items").where("line_id is not null")
    listed = table(spark, sf, "dim_service").select("contract_id", "service").distinct()
    rated = as_known_join(lines, lookup_join(table(spark, sf, "dim_rate"), listed, ["contract_id", "service"], "left_semi"), {"contract_id": "contract_id", "description": "service"}, iso_day(F.col("service_date")), ["line_id", "loaded_at"], "valid_from", "valid_to", "known_from", "rate_ord", ["rate_ord", "rate_cents"])
    # A line that was sent again counts by its earliest copy.
    first = F.min(F.struct("loaded_at", "rate_ord", "rate_cents"))
    return rated.groupBy("line_id").agg(first.alias("r")).select("line_id", "r.rate_ord", "r.rate_cents")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """References of lines, invoices and labels that didn't hold when their record came."""
    lines, invoices, labels, contracts = (table(spark, sf, x) for x in ("line_items", "invoices", "hospital_1_labels", "dim_contract"))
    joined = lambda: F.concat(key_of(F.col("contract_id")), F.lit("\u001f"), key_of(F.col("source_seq")))
    parts = [
        ("line_items", orphan_references(lines, invoices, F.col("line_id"), joined(), joined()).withColumn("ref_key", F.substring_index("ref_key", "\u001f", -1))),
        ("invoices", orphan_references(invoices, contracts, F.col("source_seq"), key_of(F.col("contract_number")), key_of(F.col("contract_number")))),
        ("hospital_1_labels", orphan_references(labels, invoices, F.col("label_id"), key_of(F.col("invoice_id")), key_of(F.col("invoice_id")))),
    ]
    found = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("src_table"), "src_key", "ref_key", "orphan_kind", F.date_format("loaded", "yyyy-MM").alias("load_month"))
        found = part if found is None else found.unionByName(part)
    return found


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return orphan_report(p4_found(spark, sf)).select("src_table", "orphan_kind", "load_month", "n_references")


_P3_SQL = """
WITH l AS (SELECT DISTINCT line_id, contract_id, description, try_strptime(service_date, '%Y-%m-%d')::DATE AS d FROM line_items
           WHERE line_id IS NOT NULL AND regexp_full_match(service_date, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')),
r AS (SELECT l.line_id, r.rate_ord, r.rate_cents, row_number() OVER (PARTITION BY l.line_id ORDER BY r.known_from DESC, r.rate_ord DESC) AS n
      FROM l JOIN dim_service s ON s.contract_id = l.contract_id AND s.service = l.description
      JOIN dim_rate r ON r.contract_id = l.contract_id AND r.service = l.description
      WHERE d IS NOT NULL AND r.known_from <= d AND (r.valid_from IS NULL OR r.valid_from <= d) AND (r.valid_to IS NULL OR r.valid_to >= d))
SELECT line_id, rate_ord, rate_cents FROM r WHERE n = 1"""

_BLANK = r"[\s\x{00A0}\x{2007}\x{202F}\x{200B}\x{FEFF}]"


def _key(c: str) -> str:
    return f"nullif(upper(regexp_replace(regexp_replace({c}, '^{_BLANK}+', ''), '{_BLANK}+$', '')), '')"


_P4_SQL = f"""
WITH c AS (
  SELECT 'line_items' AS src_table, line_id AS src_key, {_key('contract_id')} AS scope, {_key('source_seq')} AS ref_key, min(loaded_at) AS t FROM line_items GROUP BY ALL
  UNION ALL SELECT 'invoices', source_seq, '', {_key('contract_number')}, min(loaded_at) FROM invoices GROUP BY ALL
  UNION ALL SELECT 'hospital_1_labels', label_id::VARCHAR, '', {_key('invoice_id')}, min(loaded_at) FROM hospital_1_labels GROUP BY ALL),
p AS (
  SELECT 'line_items' AS src_table, {_key('contract_id')} AS scope, {_key('source_seq')} AS k, loaded_at, deleted_at FROM invoices
  UNION ALL SELECT 'invoices', '', {_key('contract_number')}, loaded_at, deleted_at FROM dim_contract
  UNION ALL SELECT 'hospital_1_labels', '', {_key('invoice_id')}, loaded_at, deleted_at FROM invoices),
j AS (
  SELECT c.src_table, c.src_key, c.scope, c.ref_key, c.t, count(p.k) AS n,
    count(CASE WHEN p.loaded_at <= c.t AND (p.deleted_at IS NULL OR p.deleted_at > c.t) THEN 1 END) AS n_alive, count(CASE WHEN p.loaded_at <= c.t THEN 1 END) AS n_come
  FROM c LEFT JOIN p ON p.src_table = c.src_table AND p.scope = c.scope AND p.k = c.ref_key
  WHERE c.ref_key IS NOT NULL AND c.scope IS NOT NULL GROUP BY ALL)
SELECT src_table, src_key, ref_key, CASE WHEN n = 0 THEN 'missing' WHEN n_come > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind, strftime(t, '%Y-%m') AS load_month
FROM j WHERE n_alive = 0"""

QUERIES = {"p2_found": p2_found, "p2_delimiters": p2_delimiters, "p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report}
SQL = {"p3_found": _P3_SQL, "p4_found": _P4_SQL, "p4_report": f"SELECT src_table, orphan_kind, load_month, count(*) AS n_references FROM ({_P4_SQL}) GROUP BY ALL"}
