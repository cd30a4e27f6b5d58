"""One query for every operator of the billing pipeline over the billing tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import loose, markup
from ledgerloom.functions.text import iso_day, key_of
from ledgerloom.operators import checks, matching, ordered, scores, similarity
from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join, salted_join
from ledgerloom.plans.audit import audit, description_confidence, expected_totals, least_confidence, report, violations
from ledgerloom.session import written
from ledgerloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DAY = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime({0}, '%Y-%m-%d')::DATE END"
_BASE = f"""l AS (SELECT * EXCLUDE (n), {_DAY.format('service_date')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS n FROM line_items WHERE line_id IS NOT NULL) WHERE n = 1),
i AS (SELECT * EXCLUDE (n), {_DAY.format('invoice_date')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, source_seq ORDER BY loaded_at) AS n FROM invoices WHERE source_seq IS NOT NULL) WHERE n = 1)"""


def query(sql: str | None = None):
    """Register a query under its function's name; SQL that needs them gets the tables l (lines once) and i (invoices once)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            SQL[f.__name__] = text if "{base}" not in text else text.replace("{base}", _BASE)
        return f

    return register


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return checks.lines_once(table(spark, sf, "line_items"), columns)


def _invoices(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return checks.invoices_once(table(spark, sf, "invoices"), columns)


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and invoices once with the columns that the checks read, and the contracts."""
    lines = _lines(spark, sf, "contract_id", "invoice_id", "source_seq", "service_date", "quantity", "unit_price_cents", "line_total_cents")
    return lines, _invoices(spark, sf, "invoice_id", "invoice_date", "invoice_total_cents", "contract_number"), table(spark, sf, "dim_contract")


# --- scans -----------------------------------------------------------------------------------------------------------


@query(f"SELECT contract_id, source_seq, invoice_id, CAST({_DAY.format('invoice_date')} AS VARCHAR) AS invoice_day, invoice_date AS invoice_date_raw, CAST({_DAY.format('admission_date')} AS VARCHAR) AS admission_day, CAST({_DAY.format('discharge_date')} AS VARCHAR) AS discharge_day, invoice_total_cents FROM invoices")
def scan_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with their dates read and the text kept beside."""
    day = lambda c: iso_day(F.col(c)).cast("string")
    return table(spark, sf, "invoices").select("contract_id", "source_seq", "invoice_id", day("invoice_date").alias("invoice_day"), F.col("invoice_date").alias("invoice_date_raw"), day("admission_date").alias("admission_day"), day("discharge_date").alias("discharge_day"), "invoice_total_cents")


@query("WITH {base} SELECT line_id, split_part(line_id, '-', 2) AS id_seq, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY contract_id, source_seq ORDER BY day NULLS LAST, line_id) AS place FROM l")
def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines once, with the sequence in their id and their place in the order of their invoice row."""
    lines = _lines(spark, sf, "contract_id", "source_seq", "service_date").select("line_id", "contract_id", "source_seq", "day")
    placed = ordered.place(lines, ["contract_id", "source_seq"], "day", [F.col("line_id")], "place")
    return placed.select("line_id", F.split_part("line_id", F.lit("-"), F.lit(2)).alias("id_seq"), F.col("day").cast("string").alias("day"), "place")


# --- checks ----------------------------------------------------------------------------------------------------------

_FOUND = "contract_id, invoice_id, source_seq, '{}' AS category, CAST({} AS VARCHAR) AS detail"
_CHECK_SQL = {
    "line_arithmetic": f"SELECT {_FOUND.format('line_arithmetic', 'line_id')} FROM l WHERE line_total_cents <> quantity * unit_price_cents",
    "invoice_total": f"SELECT {_FOUND.format('invoice_total', 's')} FROM i JOIN (SELECT contract_id, source_seq, CAST(sum(line_total_cents) AS BIGINT) AS s FROM l GROUP BY ALL) USING (contract_id, source_seq) WHERE invoice_total_cents <> s",
    "reused_id": f"SELECT {_FOUND.format('reused_id', 'n')} FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, invoice_id ORDER BY day NULLS LAST, source_seq) AS n FROM i WHERE trim(invoice_id) <> '') WHERE n > 1",
    "malformed_date": f"SELECT {_FOUND.format('malformed_date', 'line_id')} FROM l WHERE day IS NULL",
    "out_of_term": f"SELECT {_FOUND.format('out_of_term', 'line_id')} FROM l JOIN (SELECT contract_id, eff_from, eff_to FROM dim_contract) USING (contract_id) WHERE day < eff_from OR day > eff_to",
    "after_invoice": f"SELECT {_FOUND.format('after_invoice', 'line_id')} FROM l JOIN (SELECT contract_id, source_seq, day AS d2 FROM i) USING (contract_id, source_seq) JOIN (SELECT contract_id, eff_from, eff_to FROM dim_contract) USING (contract_id) WHERE day BETWEEN eff_from AND eff_to AND day > d2",
    "contract_number": f"SELECT {_FOUND.format('contract_number', 'contract_number')} FROM i JOIN (SELECT contract_id, contract_number AS own FROM dim_contract) USING (contract_id) WHERE contract_number IS DISTINCT FROM own",
}
_RAISED = " UNION ALL ".join(_CHECK_SQL.values())


def _register_check(name: str, f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[f"check_{name}"] = lambda spark, sf: f(*_checked(spark, sf))
    SQL[f"check_{name}"] = f"WITH {_BASE} {_CHECK_SQL[name]}"


_register_check("line_arithmetic", lambda li, iv, dc: checks.line_arithmetic(li))
_register_check("invoice_total", lambda li, iv, dc: checks.invoice_total(iv, li))
_register_check("reused_id", lambda li, iv, dc: checks.reused_id(iv))
_register_check("malformed_date", lambda li, iv, dc: checks.malformed_date(li))
_register_check("out_of_term", lambda li, iv, dc: checks.out_of_term(li, dc))
_register_check("after_invoice", lambda li, iv, dc: checks.after_invoice(li, iv, dc))
_register_check("contract_number", lambda li, iv, dc: checks.contract_number(iv, dc))


def _raised(spark: SparkSession, sf: str) -> DataFrame:
    return checks.all_checks(*_checked(spark, sf))


@query(f"WITH {{base}} SELECT contract_id, invoice_id, category, min(detail) AS detail, count(*) AS n FROM ({_RAISED}) GROUP BY ALL")
def findings(spark: SparkSession, sf: str) -> DataFrame:
    """All checks, per invoice id and category."""
    return checks.findings(_raised(spark, sf))


@query(f"WITH {{base}} SELECT category, count(DISTINCT (contract_id, invoice_id)) AS n_invoices FROM ({_RAISED}) GROUP BY ALL")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Different invoices per category."""
    return checks.findings(_raised(spark, sf)).groupBy("category").agg(F.count("*").alias("n_invoices"))


@query(f"""WITH {{base}}, f AS ({_RAISED}),
g AS (SELECT contract_id, invoice_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, count(*) AS n_findings FROM f GROUP BY ALL),
u AS (SELECT contract_id, invoice_id, max(source_seq) AS source_seq, arg_max(invoice_total_cents, source_seq) AS invoice_total_cents, count(*) AS n_units FROM i WHERE invoice_id IS NOT NULL GROUP BY ALL)
SELECT u.contract_id, u.invoice_id, u.source_seq, u.invoice_total_cents, u.n_units, CASE WHEN g.categories IS NULL THEN 0 ELSE 1 END AS flagged, coalesce(g.categories, '') AS categories, coalesce(g.n_findings, 0) AS n_findings
FROM u LEFT JOIN g USING (contract_id, invoice_id)""")
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row per invoice id: flagged or not, with its categories joined."""
    return audit(table(spark, sf, "line_items"), table(spark, sf, "invoices"), table(spark, sf, "dim_contract"))


_CONFIDENCE = """k AS (SELECT contract_id, description, max(confidence) AS confidence FROM (SELECT contract_id, service AS description, CAST(1 AS DOUBLE) AS confidence FROM dim_service UNION ALL SELECT contract_id, description, CAST(confidence AS DOUBLE) FROM resolution WHERE description IS NOT NULL AND service IS NOT NULL) GROUP BY ALL),
lc AS (SELECT l.contract_id, l.source_seq, min(coalesce(k.confidence, 0)) AS confidence FROM l LEFT JOIN k ON k.contract_id = l.contract_id AND k.description = l.description GROUP BY ALL)"""
_EXPECTED = """rr AS (SELECT l.line_id, r.rate_cents, row_number() OVER (PARTITION BY l.line_id ORDER BY CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN 1 ELSE 0 END, r.rate_ord) AS n FROM l JOIN dim_rate r ON r.contract_id = l.contract_id AND r.service = l.description
 WHERE (valid_from IS NULL AND valid_to IS NULL) OR (l.day IS NOT NULL AND (valid_from IS NULL OR valid_from <= l.day) AND (valid_to IS NULL OR valid_to >= l.day))),
et AS (SELECT l.contract_id, l.source_seq, CAST(sum(coalesce(r.rate_cents * l.quantity, l.line_total_cents)) AS BIGINT) AS expected_total_cents FROM l LEFT JOIN (SELECT * FROM rr WHERE n = 1) r USING (line_id) GROUP BY ALL)"""
_REPORT = f"""f AS ({_RAISED}),
g AS (SELECT contract_id, invoice_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM f GROUP BY ALL),
u AS (SELECT contract_id, invoice_id, max(source_seq) AS source_seq, arg_max(invoice_total_cents, source_seq) AS invoice_total_cents FROM i WHERE invoice_id IS NOT NULL GROUP BY ALL), {_CONFIDENCE}, {_EXPECTED},
rep AS (SELECT u.contract_id, u.invoice_id, CASE WHEN g.categories IS NULL THEN 0 ELSE 1 END AS flagged, coalesce(g.categories, '') AS categories, coalesce(et.expected_total_cents, 0) AS expected_total_cents, u.invoice_total_cents AS billed_total_cents, round(coalesce(lc.confidence, 0), 3) AS confidence
 FROM u LEFT JOIN g USING (contract_id, invoice_id) LEFT JOIN et ON et.contract_id = u.contract_id AND et.source_seq = u.source_seq LEFT JOIN lc ON lc.contract_id = u.contract_id AND lc.source_seq = u.source_seq)"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return report(*(table(spark, sf, x) for x in ("line_items", "invoices", "dim_contract", "dim_service", "dim_rate", "resolution")))


@query(f"WITH {{base}}, {_REPORT} SELECT * FROM rep")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The report as it is handed in: flag, categories, expected and billed total and confidence per invoice id."""
    return _report(spark, sf)


@query(f"WITH {{base}}, {_CONFIDENCE} SELECT i.contract_id, i.source_seq, coalesce(lc.confidence, 0) AS confidence FROM i LEFT JOIN lc USING (contract_id, source_seq)")
def least_match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The weakest match among each invoice row's lines; 0 for unknown descriptions and for no lines."""
    known = description_confidence(table(spark, sf, "resolution"), table(spark, sf, "dim_service"))
    return least_confidence(_invoices(spark, sf), _lines(spark, sf, "contract_id", "source_seq", "description"), known)


@query(f"WITH {{base}}, {_EXPECTED} SELECT * FROM et")
def unit_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Per invoice row the quantities at the rates in force, or as billed where there is none."""
    return expected_totals(_lines(spark, sf, "contract_id", "source_seq", "description", "service_date", "quantity", "line_total_cents"), table(spark, sf, "dim_rate"))


_VIOLATIONS = """own AS (SELECT contract_id, invoice_id, count(*) AS k, count(*) FILTER (flagged IS NULL OR flagged NOT IN (0, 1)) AS bad_flag, count(*) FILTER (confidence IS NULL OR confidence < 0 OR confidence > 1) AS bad_confidence, count(*) FILTER (expected_total_cents IS NULL OR billed_total_cents IS NULL) AS null_total,
 count(*) FILTER (flagged = 1 AND coalesce(categories, '') = '') AS flagged_without_category, count(*) FILTER (flagged IS DISTINCT FROM 1 AND coalesce(categories, '') <> '') AS category_without_flag FROM rep GROUP BY ALL),
ids AS (SELECT DISTINCT contract_id, invoice_id, 1 AS known FROM i WHERE invoice_id IS NOT NULL),
j AS (SELECT * FROM own FULL JOIN ids USING (contract_id, invoice_id)),
n AS (SELECT 'repeated' AS violation, count(*) FILTER (k > 1) AS n FROM j UNION ALL SELECT 'missing', count(*) FILTER (k IS NULL) FROM j UNION ALL SELECT 'foreign', count(*) FILTER (known IS NULL) FROM j UNION ALL SELECT 'bad_flag', sum(bad_flag) FROM j UNION ALL SELECT 'bad_confidence', sum(bad_confidence) FROM j
 UNION ALL SELECT 'null_total', sum(null_total) FROM j UNION ALL SELECT 'flagged_without_category', sum(flagged_without_category) FROM j UNION ALL SELECT 'category_without_flag', sum(category_without_flag) FROM j{more})
SELECT violation, CAST(n AS BIGINT) AS n FROM n WHERE n > 0"""


@query(f"WITH {{base}}, {_REPORT}, {_VIOLATIONS.replace('{more}', '')}")
def audit_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the report itself: nulls among the totals billed, and nothing else."""
    return violations(_report(spark, sf), _invoices(spark, sf, "invoice_id"))


@query(f"""WITH {{base}}, {_REPORT.replace("rep AS (", "rep0 AS (")}, s AS (SELECT *, substr(md5(concat_ws('/', contract_id, invoice_id)), 1, 1) AS d FROM rep0),
rep AS (SELECT contract_id, CASE WHEN d = '2' THEN 'X-' || invoice_id ELSE invoice_id END AS invoice_id, CASE WHEN d = '3' THEN 2 WHEN d = '5' THEN 1 WHEN d = '6' THEN 0 ELSE flagged END AS flagged, CASE WHEN d = '5' THEN '' WHEN d = '6' THEN 'odd' ELSE categories END AS categories, CASE WHEN d <> '7' THEN expected_total_cents END AS expected_total_cents, billed_total_cents,
 CASE WHEN d = '4' THEN 1.5 WHEN d = '8' THEN NULL ELSE confidence END AS confidence FROM s, range(CASE WHEN d = '0' THEN 2 WHEN d = '1' THEN 0 ELSE 1 END) t), {_VIOLATIONS.replace('{more}', " UNION ALL SELECT 'not_integer', 1")}""")
def spoiled_report(spark: SparkSession, sf: str) -> DataFrame:
    """The violations found in a report that was spoiled in nine manners."""
    d = F.substring(F.md5(F.concat_ws("/", "contract_id", "invoice_id")), 1, 1)
    r = _report(spark, sf).withColumn("d", d)
    r = r.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == "0", 2).when(F.col("d") == "1", 0).otherwise(1))))
    r = r.withColumns({
        "invoice_id": F.when(F.col("d") == "2", F.concat(F.lit("X-"), "invoice_id")).otherwise(F.col("invoice_id")),
        "flagged": F.when(F.col("d") == "3", 2).when(F.col("d") == "5", 1).when(F.col("d") == "6", 0).otherwise(F.col("flagged")),
        "categories": F.when(F.col("d") == "5", "").when(F.col("d") == "6", "odd").otherwise(F.col("categories")),
        "expected_total_cents": F.when(F.col("d") != "7", F.col("expected_total_cents")),
        "billed_total_cents": F.col("billed_total_cents").cast("double"),
        "confidence": F.when(F.col("d") == "4", 1.5).when(F.col("d") != "8", F.col("confidence")),
    })
    return violations(r.drop("d", "copies"), _invoices(spark, sf, "invoice_id"))


@query(r"SELECT invoice_id, CASE WHEN regexp_matches(upper(invoice_id), '^[^-]*-H\d+(-|$)') THEN 'hospital_' || regexp_extract(upper(invoice_id), '^[^-]*-H(\d+)(-|$)', 1) END AS contract_id FROM hospital_1_labels")
def provider_of_id(spark: SparkSession, sf: str) -> DataFrame:
    """The provider named in an invoice id."""
    n = F.regexp_extract(F.upper("invoice_id"), r"^[^-]*-H(\d+)(-|$)", 1)
    return table(spark, sf, "hospital_1_labels").select("invoice_id", F.when(n != "", F.concat(F.lit("hospital_"), n)).alias("contract_id"))


@query("SELECT contract_id, service FROM dim_service WHERE contains(lower(service), 'thoracic') AND contains(lower(service), 'removal')")
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Services whose name has all the words asked for."""
    words = F.array(F.lit("thoracic"), F.lit("removal"))
    return table(spark, sf, "dim_service").where(F.forall(words, lambda w: F.contains(F.lower("service"), w))).select("contract_id", "service")


@query("SELECT DISTINCT contract_id, description FROM line_items l WHERE description IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_service s WHERE s.contract_id = l.contract_id AND s.service = l.description)")
def unknown_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions that aren't exactly a service of their contract."""
    known = table(spark, sf, "dim_service").select("contract_id", F.col("service").alias("description"))
    return table(spark, sf, "line_items").where("description is not null").select("contract_id", "description").distinct().join(broadcast_if_bounded(known), ["contract_id", "description"], "left_anti")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("""WITH {base}, a AS (SELECT contract_id || '/' || invoice_id AS k, source_seq, row_number() OVER (PARTITION BY contract_id || '/' || invoice_id ORDER BY day NULLS LAST, source_seq) AS rank FROM i WHERE invoice_id IS NOT NULL),
b AS (SELECT contract_id || '/' || invoice_id AS k, source_seq AS line_seq, count(*) AS n_lines, CAST(sum(line_total_cents) AS BIGINT) AS total FROM l WHERE invoice_id IS NOT NULL AND source_seq IS NOT NULL GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line_seq) AS rank FROM b)
SELECT a.k, a.rank, a.source_seq, c.line_seq, c.n_lines, c.total FROM a LEFT JOIN c ON a.k = c.k AND a.rank = c.rank""")
def unit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice rows of one id paired with the line groups of that id by their place."""
    k = F.concat_ws("/", "contract_id", "invoice_id").alias("k")
    a = _invoices(spark, sf, "invoice_id", "invoice_date").where("invoice_id is not null").select(k, "source_seq", "day")
    b = _lines(spark, sf, "contract_id", "invoice_id", "source_seq", "line_total_cents").where("invoice_id is not null and source_seq is not null").groupBy(k, F.col("source_seq").alias("line_seq")).agg(F.count("*").alias("n_lines"), F.sum("line_total_cents").alias("total"))
    return matching.ordinal_pairs(a, b, "k", [F.col("day").asc_nulls_last(), F.col("source_seq")], [F.col("line_seq")]).select("k", "rank", "source_seq", "line_seq", "n_lines", "total")


@query("WITH {base} SELECT l.line_id, i.patient_id, i.facility_code, i.plan_tier, CAST(i.day AS VARCHAR) AS invoice_day FROM l LEFT JOIN i ON l.contract_id = i.contract_id AND l.source_seq = i.source_seq")
def line_context(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with patient, facility, tier and day of their invoice."""
    i = _invoices(spark, sf, "patient_id", "facility_code", "plan_tier", "invoice_date").select("contract_id", "source_seq", "patient_id", "facility_code", "plan_tier", F.col("day").cast("string").alias("invoice_day"))
    return _lines(spark, sf, "contract_id", "source_seq").select("line_id", "contract_id", "source_seq").join(i, ["contract_id", "source_seq"], "left").drop("contract_id", "source_seq")


@query("""WITH {base}, e AS (SELECT line_id, contract_id, description, day FROM l JOIN dim_service s USING (contract_id) WHERE s.service = l.description),
r AS (SELECT e.line_id, r.rate_ord, r.rate_cents, row_number() OVER (PARTITION BY e.line_id ORDER BY CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN 1 ELSE 0 END, r.rate_ord) AS n
 FROM e JOIN dim_rate r ON r.contract_id = e.contract_id AND r.service = e.description
 WHERE (valid_from IS NULL AND valid_to IS NULL) OR (e.day IS NOT NULL AND (valid_from IS NULL OR valid_from <= e.day) AND (valid_to IS NULL OR valid_to >= e.day)))
SELECT e.line_id, r.rate_ord, r.rate_cents FROM e LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (line_id)""")
def rate_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """The rate in force on each line's day: the first covering period in list order, else an unbounded one, else none."""
    s = table(spark, sf, "dim_service").select("contract_id", F.col("service").alias("description"))
    e = _lines(spark, sf, "contract_id", "description", "service_date").join(broadcast_if_bounded(s), ["contract_id", "description"]).select("line_id", "contract_id", "description", "day")
    periods = table(spark, sf, "dim_rate").withColumnRenamed("service", "description")
    return matching.interval_lookup(e, periods, ["contract_id", "description"], "day", "valid_from", "valid_to", "rate_ord", ["rate_ord", "rate_cents"]).select("line_id", "rate_ord", "rate_cents")


_SERVED = """e AS (SELECT l.line_id, l.contract_id, i.patient_id, l.day, s.service_ord AS ord, l.quantity, s.daily_cap FROM l JOIN i ON l.contract_id = i.contract_id AND l.source_seq = i.source_seq
 JOIN dim_service s ON s.contract_id = l.contract_id AND s.service = l.description)"""


def _served(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a known service, with patient, day and the service's number."""
    i = _invoices(spark, sf, "patient_id").select("contract_id", "source_seq", "patient_id")
    s = table(spark, sf, "dim_service").select("contract_id", F.col("service").alias("description"), F.col("service_ord").alias("ord"), "daily_cap")
    return _lines(spark, sf, "contract_id", "source_seq", "description", "service_date", "quantity").join(i, ["contract_id", "source_seq"]).join(broadcast_if_bounded(s), ["contract_id", "description"]).select("line_id", "contract_id", "patient_id", "day", "ord", "quantity", "daily_cap")


@query(f"WITH {{base}}, {_SERVED} SELECT line_id, EXISTS (SELECT 1 FROM e f WHERE f.contract_id = e.contract_id AND f.patient_id = e.patient_id AND f.day = e.day AND f.ord = xor(e.ord, 1)) AS partner_same_day FROM e")
def partner_same_day(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the patient had the service's partner (the other of each pair in list order) on the same day."""
    e = _served(spark, sf)
    partners = table(spark, sf, "dim_service").select(F.col("service_ord").alias("ord")).distinct().withColumn("partner", F.col("ord").bitwiseXOR(F.lit(1)).cast("int"))
    return matching.with_partner(e, ["contract_id", "patient_id", "day"], "ord", broadcast_if_bounded(partners), "partner_same_day").select("line_id", "partner_same_day")


@query(f"WITH {{base}}, {_SERVED} SELECT line_id, EXISTS (SELECT 1 FROM e f WHERE f.contract_id = e.contract_id AND f.patient_id = e.patient_id AND f.ord % 3 = 0 AND abs(f.day - e.day) <= 7) AS near FROM e WHERE ord % 3 <> 0")
def neighbour_within_week(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the patient had one of the triggering services (every third) within seven days either way."""
    e = _served(spark, sf)
    return matching.with_neighbour(e.where("ord % 3 <> 0"), e.where("ord % 3 = 0"), ["contract_id", "patient_id"], "day", 7, "near").select("line_id", "near")


@query("""WITH {base}, e AS (SELECT l.*, i.patient_id FROM l JOIN i ON l.contract_id = i.contract_id AND l.source_seq = i.source_seq)
SELECT line_id, n AS billing FROM (SELECT line_id, row_number() OVER (PARTITION BY contract_id, patient_id, description, day ORDER BY line_id) AS n FROM e WHERE day IS NOT NULL AND description IS NOT NULL AND patient_id IS NOT NULL) WHERE n > 1""")
def billed_again(spark: SparkSession, sf: str) -> DataFrame:
    """Second and later lines of one patient, description and day."""
    i = _invoices(spark, sf, "patient_id").select("contract_id", "source_seq", "patient_id")
    e = _lines(spark, sf, "contract_id", "source_seq", "description", "service_date").join(i, ["contract_id", "source_seq"]).where("day is not null and description is not null and patient_id is not null")
    return ordered.numbered(e, ["contract_id", "patient_id", "description", "day"], [F.col("line_id")], "billing").where("billing > 1").select("line_id", "billing")


@query("""WITH a AS (SELECT DISTINCT contract_id, service FROM resolution WHERE service IS NOT NULL), b AS (SELECT contract_id, service FROM dim_service)
SELECT coalesce(a.contract_id, b.contract_id) AS contract_id, coalesce(a.service, b.service) AS service, CASE WHEN b.service IS NULL THEN 'only_old' WHEN a.service IS NULL THEN 'only_new' ELSE 'same' END AS state, '' AS changed
FROM a FULL JOIN b ON a.contract_id = b.contract_id AND a.service = b.service""")
def list_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Services named by the earlier run against the list: shared, missed and invented."""
    a = table(spark, sf, "resolution").where("service is not null").select("contract_id", "service").distinct()
    return matching.full_difference(a, table(spark, sf, "dim_service").select("contract_id", "service"), ["contract_id", "service"], [])


@query("""WITH x AS (SELECT upper(trim(invoice_id)) AS k, label_id, is_erroneous, expected_total_cents, row_number() OVER (PARTITION BY upper(trim(invoice_id)) ORDER BY label_id) AS n, row_number() OVER (PARTITION BY upper(trim(invoice_id)) ORDER BY label_id DESC) AS m FROM hospital_1_labels WHERE trim(invoice_id) <> ''),
a AS (SELECT * FROM x WHERE n = 1), b AS (SELECT * FROM x WHERE m = 1)
SELECT a.k AS invoice_key, CASE WHEN c = '' THEN 'same' ELSE 'changed' END AS state, c AS changed FROM (SELECT a.k, concat_ws('|', CASE WHEN a.is_erroneous IS DISTINCT FROM b.is_erroneous THEN 'is_erroneous' END, CASE WHEN a.expected_total_cents IS DISTINCT FROM b.expected_total_cents THEN 'expected_total_cents' END) AS c FROM a JOIN b ON a.k = b.k) a""")
def label_changes(spark: SparkSession, sf: str) -> DataFrame:
    """First against last label of each invoice, field by field."""
    x = table(spark, sf, "hospital_1_labels").select(key_of(F.col("invoice_id")).alias("invoice_key"), "label_id", "is_erroneous", "expected_total_cents").where("invoice_key is not null")
    both = x.groupBy("invoice_key").agg(F.min(F.struct("label_id", "is_erroneous", "expected_total_cents")).alias("a"), F.max(F.struct("label_id", "is_erroneous", "expected_total_cents")).alias("b"))
    side = lambda s: both.select("invoice_key", f"{s}.is_erroneous", f"{s}.expected_total_cents")
    return matching.full_difference(side("a"), side("b"), ["invoice_key"], ["is_erroneous", "expected_total_cents"])


@query("SELECT contract_id, service, b AS basis, f AS factor FROM dim_service, unnest(['per_day', 'per_night']) t(b), unnest([1, 2, 3]) u(f)")
def option_product(spark: SparkSession, sf: str) -> DataFrame:
    """Each service with every combination of its options."""
    d = table(spark, sf, "dim_service").select("contract_id", "service", F.array(F.lit("per_day"), F.lit("per_night")).alias("basis"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("factor"))
    return matching.product_of_options(d, ["basis", "factor"])


@query("""WITH a AS (SELECT contract_id || '/' || description AS k, max(service) AS s FROM resolution WHERE resolution_id % 2 = 0 GROUP BY ALL), b AS (SELECT contract_id || '/' || description AS k, max(service) AS s FROM resolution WHERE resolution_id % 2 = 1 GROUP BY ALL)
SELECT count(*) AS n, count(CASE WHEN a.s IS NOT DISTINCT FROM b.s THEN 1 END) AS agree, CASE WHEN count(*) > 0 THEN round(count(CASE WHEN a.s IS NOT DISTINCT FROM b.s THEN 1 END) / count(*), 6) END AS share FROM a JOIN b ON a.k = b.k""")
def halves_agree(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out: how far the mapping learnt from one half of the resolutions agrees with the other half."""
    half = lambda m: table(spark, sf, "resolution").where(f"resolution_id % 2 = {m}").groupBy(F.concat_ws("/", "contract_id", "description").alias("k")).agg(F.max("service").alias("s"))
    return matching.agreement(half(0).where("k is not null"), half(1), "k", "s")


# --- windows ---------------------------------------------------------------------------------------------------------


@query("WITH {base} SELECT line_id, CAST(coalesce(sum(quantity) OVER (PARTITION BY contract_id, description ORDER BY day NULLS LAST, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_quantity FROM l")
def prior_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the same contract and description before each line."""
    lines = _lines(spark, sf, "contract_id", "description", "service_date", "quantity").select("line_id", "contract_id", "description", "day", "quantity")
    return ordered.prior_total(lines, ["contract_id", "description"], "day", [F.col("line_id")], F.col("quantity"), "prior_quantity").select("line_id", "prior_quantity")


@query("""WITH {base}, c AS (SELECT line_id, coalesce(sum(quantity) OVER (PARTITION BY contract_id, description ORDER BY day NULLS LAST, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM l)
SELECT line_id, CAST(CASE WHEN p > 500 THEN 20 WHEN p > 100 THEN 10 END AS BIGINT) AS tier FROM c""")
def tier_reached(spark: SparkSession, sf: str) -> DataFrame:
    """The highest tier whose threshold the earlier units exceed."""
    return prior_quantity(spark, sf).select("line_id", ordered.tier_of(F.col("prior_quantity"), [(100, 10), (500, 20)]).alias("tier"))


@query(f"WITH {{base}}, {_SERVED} SELECT line_id, CAST(CASE WHEN patient_id IS NOT NULL AND day IS NOT NULL THEN sum(quantity) OVER (PARTITION BY contract_id, patient_id, ord, day) END AS BIGINT) AS day_quantity FROM e")
def day_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """Units of one patient, service and day, on each of its lines; null without a day."""
    return ordered.group_total(_served(spark, sf), ["contract_id", "patient_id", "ord", "day"], F.col("quantity"), "day_quantity").select("line_id", "day_quantity")


@query(f"""WITH {{base}}, {_SERVED}, c AS (SELECT *, sum(quantity) OVER w AS cum FROM e WINDOW w AS (PARTITION BY contract_id, patient_id, ord, day ORDER BY line_id ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, cum - greatest(0, max(cum - daily_cap) OVER (PARTITION BY contract_id, patient_id, ord, day ORDER BY line_id ROWS UNBOUNDED PRECEDING)) AS used FROM c)
SELECT line_id, CAST(CASE WHEN daily_cap IS NULL THEN quantity ELSE used - coalesce(lag(used) OVER (PARTITION BY contract_id, patient_id, ord, day ORDER BY line_id), 0) END AS BIGINT) AS allowed FROM u""")
def day_allowance(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each line's quantity that the cap of its day still allows."""
    return ordered.allowance(_served(spark, sf), ["contract_id", "patient_id", "ord", "day"], [F.col("line_id")], F.col("quantity"), F.col("daily_cap"), "allowed").select("line_id", "allowed")


@query("""WITH {base}, c AS (SELECT contract_id, description, unit_basis_as_billed, unit_price_cents, count(*) AS n, min(line_id) AS f FROM l WHERE description IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY contract_id, description) AS a, row_number() OVER (PARTITION BY contract_id, description ORDER BY n DESC, f) AS r FROM c)
SELECT contract_id, description, unit_basis_as_billed, unit_price_cents, n, round(n / a, 6) AS share FROM r WHERE r = 1""")
def modal_price(spark: SparkSession, sf: str) -> DataFrame:
    """The basis and price that a description is billed with most often."""
    lines = _lines(spark, sf, "contract_id", "description", "unit_basis_as_billed", "unit_price_cents").where("description is not null")
    return ordered.mode_of(lines, ["contract_id", "description"], ["unit_basis_as_billed", "unit_price_cents"], [F.col("line_id")]).withColumn("share", F.round("share", 6))


@query("""WITH {base}, t AS (SELECT contract_id, description AS best, CAST(sum(line_total_cents) AS BIGINT) AS s FROM l WHERE description IS NOT NULL GROUP BY ALL HAVING s IS NOT NULL),
r AS (SELECT *, lead(best) OVER w AS second, lead(s) OVER w AS s2, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY contract_id ORDER BY s DESC, best))
SELECT contract_id, best, s AS best_score, second, s - coalesce(s2, 0) AS margin FROM r WHERE r = 1""")
def best_and_second(spark: SparkSession, sf: str) -> DataFrame:
    """The description with the largest billed sum of each contract, the next and the margin."""
    t = _lines(spark, sf, "contract_id", "description", "line_total_cents").where("description is not null").groupBy("contract_id", "description").agg(F.sum("line_total_cents").alias("s")).where("s is not null")
    return ordered.best_two(t, ["contract_id"], "description", "s")


@query("""WITH {base} SELECT contract_id, invoice_id, arg_max(patient_id, source_seq) FILTER (patient_id IS NOT NULL) AS patient_id, arg_max(plan_tier, source_seq) FILTER (plan_tier IS NOT NULL) AS plan_tier, arg_max(invoice_total_cents, source_seq) FILTER (invoice_total_cents IS NOT NULL) AS invoice_total_cents FROM i WHERE invoice_id IS NOT NULL GROUP BY ALL""")
def last_unit(spark: SparkSession, sf: str) -> DataFrame:
    """The last values known of each invoice id, column by column."""
    return ordered.last_known(_invoices(spark, sf, "invoice_id", "patient_id", "plan_tier", "invoice_total_cents").where("invoice_id is not null"), ["contract_id", "invoice_id"], ["source_seq"], ["patient_id", "plan_tier", "invoice_total_cents"])


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("WITH {base} SELECT contract_id, source_seq, CAST(sum(line_total_cents) AS BIGINT) AS total, count(*) AS n_lines FROM l WHERE source_seq IS NOT NULL GROUP BY ALL")
def unit_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Billed sums per invoice row."""
    return _lines(spark, sf, "contract_id", "source_seq", "line_total_cents").where("source_seq is not null").groupBy("contract_id", "source_seq").agg(F.sum("line_total_cents").alias("total"), F.count("*").alias("n_lines"))


@query(f"WITH {{base}}, {_SERVED} SELECT contract_id, patient_id, CAST(day AS VARCHAR) AS day, string_agg(DISTINCT lpad(CAST(ord AS VARCHAR), 3, '0'), '|' ORDER BY lpad(CAST(ord AS VARCHAR), 3, '0')) AS services FROM e WHERE day IS NOT NULL AND patient_id IS NOT NULL GROUP BY ALL")
def services_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """The set of services that a patient had on a day."""
    e = _served(spark, sf).where("day is not null and patient_id is not null")
    return e.groupBy("contract_id", "patient_id", F.col("day").cast("string").alias("day")).agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("ord").cast("string"), 3, "0"))), "|").alias("services"))


@query("""WITH {base}, x AS (SELECT s.contract_id, s.unit_basis, r.rate_cents, string_agg(DISTINCT s.service, '|' ORDER BY s.service) AS names, count(DISTINCT s.service) AS n FROM dim_service s JOIN dim_rate r USING (contract_id, service) GROUP BY ALL)
SELECT l.line_id, x.n AS n_candidates, x.names FROM l JOIN x ON l.contract_id = x.contract_id AND l.unit_basis_as_billed = x.unit_basis AND l.unit_price_cents = x.rate_cents""")
def price_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The services that a line's basis and price may stand for."""
    s, r = table(spark, sf, "dim_service").select("contract_id", "service", "unit_basis"), table(spark, sf, "dim_rate").select("contract_id", "service", "rate_cents")
    names = F.collect_set("service")
    x = s.join(broadcast_if_bounded(r), ["contract_id", "service"]).groupBy("contract_id", F.col("unit_basis").alias("unit_basis_as_billed"), F.col("rate_cents").alias("unit_price_cents")).agg(F.size(names).cast("long").alias("n_candidates"), F.array_join(F.array_sort(names), "|").alias("names"))
    return _lines(spark, sf, "contract_id", "unit_basis_as_billed", "unit_price_cents").join(broadcast_if_bounded(x), ["contract_id", "unit_basis_as_billed", "unit_price_cents"]).select("line_id", "n_candidates", "names")


_JUDGED = f"""f AS ({_RAISED}), j AS (SELECT upper(trim(h.invoice_id)) AS k, max(h.is_erroneous) = 1 AS t, max(CASE WHEN f.invoice_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS p
 FROM hospital_1_labels h LEFT JOIN (SELECT DISTINCT upper(trim(invoice_id)) AS invoice_id FROM f WHERE contract_id = 'hospital_1') f ON f.invoice_id = upper(trim(h.invoice_id)) WHERE trim(h.invoice_id) <> '' GROUP BY ALL)"""


@query(f"""WITH {{base}}, {_JUDGED}, s AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM j)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM s""")
def detection_score(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of the checks against the labels of hospital_1."""
    t = table(spark, sf, "hospital_1_labels").select(key_of(F.col("invoice_id")).alias("k"), "is_erroneous").where("k is not null").groupBy("k").agg((F.max("is_erroneous") == 1).alias("t"))
    p = _raised(spark, sf).where("contract_id = 'hospital_1'").select(key_of(F.col("invoice_id")).alias("k"), F.lit(True).alias("p")).distinct()
    return scores.precision_recall(t.join(p, "k", "left"), [], F.col("p"), F.col("t"))


@query()
def category_score(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall per category: the checks' categories against those of the labels, unpacked."""
    from ledgerloom.operators.packed import split_packed

    #: The labels' names of the checks.
    names = {"line_arithmetic": "line_total_arithmetic", "invoice_total": "invoice_total_mismatch", "reused_id": "duplicate_invoice_id", "malformed_date": "malformed_service_date", "out_of_term": "service_date_out_of_window", "after_invoice": "service_date_after_invoice_date", "contract_number": "contract_number_mismatch"}
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    labels = table(spark, sf, "hospital_1_labels").select("label_id", key_of(F.col("invoice_id")).alias("k")).where("k is not null")
    truth = split_packed(table(spark, sf, "hospital_1_labels"), ["label_id"], "error_categories", "category").join(labels, "label_id").select("k", "category")
    found = _raised(spark, sf).where("contract_id = 'hospital_1'").select(key_of(F.col("invoice_id")).alias("k"), mapped[F.col("category")].alias("category")).join(labels.select("k").distinct(), "k", "left_semi")
    return scores.set_scores(found, truth, ["k", "category"], ["category"])


@query("SELECT qtype, prompt_version, count(seconds_taken) AS n, round(avg(seconds_taken), 6) AS mean, round(quantile_cont(seconds_taken, 0.5), 6) AS median, round(quantile_cont(seconds_taken, 0.95), 6) AS p95 FROM qa_results GROUP BY ALL")
def qa_times(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds per type and prompt: mean, median and 95th percentile."""
    return scores.spread(table(spark, sf, "qa_results"), ["qtype", "prompt_version"], "seconds_taken")


@query("SELECT qtype, coalesce(round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FILTER (prompt_version = 'qa_v4'), 6), 0) AS qa_v4, coalesce(round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FILTER (prompt_version = 'qa_v5'), 6), 0) AS qa_v5 FROM qa_results GROUP BY ALL")
def qa_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share passed per type, a column per prompt."""
    return scores.pivoted(table(spark, sf, "qa_results"), "qtype", "prompt_version", ["qa_v4", "qa_v5"], F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6))


@query("SELECT hospital, count(DISTINCT question) FILTER (model = 'model-a') AS \"model-a\", count(DISTINCT question) FILTER (model = 'model-b') AS \"model-b\" FROM qa_results GROUP BY ALL")
def questions_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Different questions per hospital, a column per model."""
    return scores.pivoted(table(spark, sf, "qa_results"), "hospital", "model", ["model-a", "model-b"], F.countDistinct("question"))


@query("SELECT model, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CAST(round(cost_usd * 100000) AS BIGINT)) AS BIGINT) AS cost_1e5, bool_and(route IS NOT NULL) AS all_routed FROM qa_results GROUP BY ALL")
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and cost per model."""
    return table(spark, sf, "qa_results").groupBy("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.round(F.col("cost_usd") * 100000).cast("long")).alias("cost_1e5"), F.bool_and(F.col("route").isNotNull()).alias("all_routed"))


@query("""WITH t AS (SELECT contract_id, service, daily_cap FROM dim_service WHERE daily_cap IS NOT NULL)
SELECT contract_id, service, daily_cap, 'largest' AS kind FROM t QUALIFY daily_cap = max(daily_cap) OVER (PARTITION BY contract_id)
UNION ALL SELECT contract_id, service, daily_cap, 'smallest' FROM t QUALIFY daily_cap = min(daily_cap) OVER (PARTITION BY contract_id)""")
def cap_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Services with the largest and smallest cap of each contract, all that tie."""
    d = table(spark, sf, "dim_service").select("contract_id", "service", "daily_cap")
    return scores.extremes(d, ["contract_id"], "daily_cap").withColumn("kind", F.lit("largest")).unionByName(scores.extremes(d, ["contract_id"], "daily_cap", False).withColumn("kind", F.lit("smallest")))


@query("SELECT s.contract_id, count(*) AS n FROM dim_service s WHERE daily_cap IS NULL AND NOT EXISTS (SELECT 1 FROM dim_rate r WHERE r.contract_id = s.contract_id AND r.service = s.service AND r.rate_ord > 0) GROUP BY ALL")
def without_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Services without a cap and without a second rate, counted per contract."""
    more = table(spark, sf, "dim_rate").where("rate_ord > 0").select("contract_id", "service")
    return table(spark, sf, "dim_service").where("daily_cap is null").join(more, ["contract_id", "service"], "left_anti").groupBy("contract_id").agg(F.count("*").alias("n"))


@query("""SELECT s.contract_id, count(DISTINCT s.service) AS n_services, count(r.rate_ord) AS n_rates, count(DISTINCT CASE WHEN s.daily_cap IS NOT NULL THEN s.service END) AS n_capped, min(r.rate_cents) AS least_cents, max(r.rate_cents) AS most_cents FROM dim_service s LEFT JOIN dim_rate r USING (contract_id, service) GROUP BY ALL""")
def contract_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Services, rates and caps per contract."""
    j = table(spark, sf, "dim_service").join(table(spark, sf, "dim_rate").select("contract_id", "service", "rate_ord", "rate_cents"), ["contract_id", "service"], "left")
    return j.groupBy("contract_id").agg(F.countDistinct("service").alias("n_services"), F.count("rate_ord").alias("n_rates"), F.countDistinct(F.when(F.col("daily_cap").isNotNull(), F.col("service"))).alias("n_capped"), F.min("rate_cents").alias("least_cents"), F.max("rate_cents").alias("most_cents"))


@query("""SELECT s.contract_id, s.service, s.unit_basis, s.daily_cap, r.rate_ord, r.rate_cents, CAST(r.valid_from AS VARCHAR) AS valid_from, CAST(r.valid_to AS VARCHAR) AS valid_to, row_number() OVER (PARTITION BY s.contract_id, s.service ORDER BY r.valid_from NULLS FIRST, r.rate_ord) AS place FROM dim_service s LEFT JOIN dim_rate r USING (contract_id, service)""")
def rules_table(spark: SparkSession, sf: str) -> DataFrame:
    """Services with their rates as one flat table, in the order of the days they begin."""
    j = table(spark, sf, "dim_service").join(table(spark, sf, "dim_rate").drop("known_from"), ["contract_id", "service"], "left")
    placed = ordered.numbered(j, ["contract_id", "service"], [F.col("valid_from").asc_nulls_first(), F.col("rate_ord")], "place")
    return placed.select("contract_id", "service", "unit_basis", "daily_cap", "rate_ord", "rate_cents", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), "place")


@query("SELECT CASE WHEN service IS NULL THEN 0 ELSE 1 END AS resolved, count(*) AS n, CAST(round(avg(CAST(confidence AS DOUBLE)), 4) AS DOUBLE) AS mean_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence FROM resolution GROUP BY ALL")
def confidence_by_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and largest confidence of what the earlier run resolved and what it didn't."""
    return table(spark, sf, "resolution").groupBy(F.when(F.col("service").isNull(), 0).otherwise(1).alias("resolved")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence"), F.max("confidence").cast("double").alias("max_confidence"))


@query("""WITH {base}, d AS (SELECT DISTINCT line_id, contract_id, description, quantity, unit_price_cents, unit_basis_as_billed FROM l), x AS (SELECT d.line_id, max(CASE WHEN r.rate_cents = d.unit_price_cents THEN 1 ELSE 0 END) AS hit, d.contract_id FROM d JOIN dim_rate r ON r.contract_id = d.contract_id AND r.service = d.description GROUP BY ALL)
SELECT contract_id, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS rate FROM x GROUP BY ALL""")
def reproduction_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of lines billed at one of the rates of their service."""
    rates = table(spark, sf, "dim_rate").groupBy("contract_id", F.col("service").alias("description")).agg(F.collect_set("rate_cents").alias("rates"))
    j = _lines(spark, sf, "contract_id", "description", "unit_price_cents").join(broadcast_if_bounded(rates), ["contract_id", "description"])
    hit = F.when(F.array_contains("rates", F.col("unit_price_cents")), 1.0).otherwise(0.0)
    return j.groupBy("contract_id").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("rate"))


# --- texts -----------------------------------------------------------------------------------------------------------

_TEXT = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


@query(rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({_TEXT}, '(^|\n)(#{{2,3}} )', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS seq FROM d)
SELECT doc_id, seq, CASE WHEN regexp_matches(part, '^#{{2,3}} ') THEN trim(regexp_extract(part, '^#{{2,3}} ([^\n]*)', 1)) END AS title, length(CASE WHEN regexp_matches(part, '^#{{2,3}} ') THEN regexp_replace(part, '^[^\n]*\n?', '') ELSE part END) AS n_chars FROM p""")
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of every document with title and size."""
    return markup.sections(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "seq", "title", F.length("body").alias("n_chars"))


@query()
def section_of_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The first section of each document whose title has the word rates."""
    s = markup.sections(table(spark, sf, "documents"), ["doc_id"], "text")
    return markup.section_with(s, ["doc_id"], ["rates"]).select("doc_id", "title", F.length("body").alias("n_chars"))


@query()
def rate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of rate tables in documents, cells taken by header and read as values."""
    r = markup.table_rows(table(spark, sf, "documents"), ["doc_id"], "text")
    rate = markup.cell_under("Rate|Charge|Price")
    return r.select("doc_id", "line", markup.cell_under("Service").alias("service"), loose.canonical_basis(markup.cell_under("Basis|Unit")).alias("unit_basis"), markup.cents(F.split(rate, ",? later ")[0]).alias("cents"), loose.lenient_integer(markup.cell_under("Cap|Limit")).alias("cap")).where("service is not null")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\d+(\.\d+)?\s*%') THEN CAST(CAST(regexp_extract(text, '(\d+(?:\.\d+)?)\s*%', 1) AS DECIMAL(12,4)) / 100 AS DOUBLE) END AS fraction,
 TRY_CAST(regexp_extract(text, '(\d{1,9})', 1) AS BIGINT) AS number, len(regexp_extract_all(text, 'GBP [0-9][0-9,]*\.[0-9]{2}')) AS n_amounts FROM documents WHERE text IS NOT NULL""")
def values_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """The first percentage and number of each document, and its amounts counted."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", markup.fraction(F.col("text")).cast("double").alias("fraction"), F.regexp_extract("text", r"(\d{1,9})", 1).try_cast("long").alias("number"), F.size(F.regexp_extract_all("text", F.lit(r"GBP [0-9][0-9,]*\.[0-9]{2}"), F.lit(0))).alias("n_amounts"))


@query(r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, 'GBP ([0-9][0-9,]*\.[0-9]{2})(?:[^0-9]|$)', 1), lambda x: CAST(replace(replace(x, ',', ''), '.', '') AS BIGINT))), 0) AS BIGINT) AS cents FROM documents WHERE text IS NOT NULL""")
def repaired_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the amounts of each document, read after digits were misread as letters and repaired."""
    spans = F.regexp_extract_all("text", F.lit(r"GBP ([0-9][0-9,]*\.[0-9]{2})(?:[^0-9]|$)"), F.lit(1))
    spoiled = F.transform(spans, lambda s: F.concat(F.lit("GBP "), F.translate(s, "015", "OlS")))
    amounts = F.flatten(F.transform(spoiled, markup.repaired_amounts))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.aggregate(amounts, F.lit(0).cast("long"), lambda a, x: a + x).alias("cents"))


@query()
def document_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs and numbered clauses with the heading above them."""
    return markup.clauses(table(spark, sf, "documents"), ["doc_id"], "text")


@query("SELECT source, count(*) AS n_documents, count(*) FILTER (length(text) >= 400) AS n_kept, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents kept and left out by size, with tokens estimated at four characters each."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy("source").agg(F.count("*").alias("n_documents"), F.count(F.when(F.length("text") >= 400, 1)).alias("n_kept"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


@query("SELECT contract_id, (row_number() OVER (PARTITION BY contract_id ORDER BY service_ord) - 1) // 15 AS batch, service FROM dim_service")
def service_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Services in lots of fifteen per contract."""
    return markup.batches(table(spark, sf, "dim_service"), ["contract_id"], "service_ord").select("contract_id", F.col("batch").cast("long").alias("batch"), "service")


_RULES = {"rounding": r"fraction of a cent|rounded", "cap": r"beyond [0-9]+ on a Service Day|no more than [0-9]+ units", "weekend": r"Saturday or Sunday|[Ww]eekend", "discount": r"lowered by [0-9]+%|[Dd]iscount of [0-9]+%", "window": r"within [0-9]+ days", "notice": r"days ahead"}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _RULES.items()) + " END AS convention FROM documents WHERE text IS NOT NULL")
def convention_of(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a list of conventions that each document states."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", markup.first_of(F.col("text"), _RULES).alias("convention"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, 'Units of ([A-Z][A-Za-z ]+) beyond ([0-9]+) on a Service Day', 1)) AS service, CAST(unnest(regexp_extract_all(text, 'Units of ([A-Z][A-Za-z ]+) beyond ([0-9]+) on a Service Day', 2)) AS BIGINT) AS cap FROM documents""")
def stated_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Caps that sentences of one shape state."""
    p = F.lit(r"Units of ([A-Z][A-Za-z ]+) beyond ([0-9]+) on a Service Day")
    both = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("s"), F.regexp_extract_all("text", p, F.lit(2)).alias("c"))
    return table(spark, sf, "documents").select("doc_id", F.explode(both).alias("x")).select("doc_id", F.col("x.s").alias("service"), F.col("x.c").cast("long").alias("cap"))


@query("""WITH n AS (SELECT DISTINCT service, trim(regexp_replace(lower(service), '[^a-z0-9]+', ' ', 'g')) AS k FROM dim_service),
a AS (SELECT qa_id, ' ' || trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM qa_results WHERE answer IS NOT NULL)
SELECT a.qa_id, count(*) AS n_services FROM a JOIN n ON contains(a.t, ' ' || n.k || ' ') GROUP BY ALL""")
def grounded_names(spark: SparkSession, sf: str) -> DataFrame:
    """How many different services of the lists each answer names, by word sequences of the names' own lengths."""
    n = table(spark, sf, "dim_service").select(markup.normal(F.col("service")).alias("k")).distinct().withColumn("size", F.size(F.split("k", " ")))
    sizes = [r.size for r in n.select("size").distinct().orderBy("size").collect()]
    words = F.split(markup.normal(F.col("answer")), " ")
    a = table(spark, sf, "qa_results").where("answer is not null").select("qa_id", words.alias("w"))
    of_size = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (s - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, s), " "))
    runs = F.flatten(F.array(*map(of_size, sizes))) if sizes else F.array().cast("array<string>")
    return a.select("qa_id", F.explode(F.array_distinct(runs)).alias("k")).join(broadcast_if_bounded(n.select("k")), "k").groupBy("qa_id").agg(F.count("*").alias("n_services"))


# --- loosely written values ------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k10, count(*) AS n FROM events GROUP BY ALL")
def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A value from the JSON of events."""
    k = F.try_variant_get(loose.json_payload(F.col("props")), "$.k", "bigint")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k10")).agg(F.count("*").alias("n"))


@query(r"""SELECT qa_id, TRY_CAST(CASE WHEN regexp_full_match(x, '-?[0-9]{1,18}(\.0+)?') THEN regexp_replace(x, '\.0+$', '') END AS BIGINT) AS number FROM (SELECT qa_id, replace(trim(answer), ',', '') AS x FROM qa_results)""")
def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are whole numbers, with or without thousands marks."""
    return table(spark, sf, "qa_results").select("qa_id", loose.lenient_integer(F.col("answer")).alias("number"))


@query("SELECT line_id, unit_basis_as_billed AS basis FROM line_items")
def canonical_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Unit bases as phrases, brought back to tokens."""
    phrase = F.initcap(F.regexp_replace("unit_basis_as_billed", "_", " "))
    return table(spark, sf, "line_items").select("line_id", loose.canonical_basis(phrase).alias("basis"))


@query("""WITH c AS (SELECT contract_id, description, service, confidence, resolution_id, count(*) OVER (PARTITION BY contract_id, description, service) AS n FROM resolution WHERE description IS NOT NULL)
SELECT contract_id, description, service, CAST(confidence AS DOUBLE) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY contract_id, description ORDER BY confidence DESC NULLS LAST, resolution_id DESC) = 1""")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated records the one with the best confidence, the later on a tie."""
    r = table(spark, sf, "resolution").where("description is not null")
    best = F.max_by(F.struct("service", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1).cast("decimal(4,3)")), "resolution_id"))
    return r.groupBy("contract_id", "description").agg(best.alias("b")).select("contract_id", "description", "b.service", F.col("b.confidence").cast("double").alias("confidence"))


# --- similarity ------------------------------------------------------------------------------------------------------


@query()
def lexical_best(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest service name of each resolved description by character n-grams."""
    q = table(spark, sf, "resolution").where("description is not null")
    return similarity.lexical_rank(q, table(spark, sf, "dim_service"), "contract_id", "description", "service", "service_ord").where("rank = 1").select("contract_id", "description", "service", "score")


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"


@query(f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS same, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 4) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every twentieth."""
    e = table(spark, sf, "embeddings")
    return similarity.cosine_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query(f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 4) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label % 2 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def nearest_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest among vectors that a condition on their data lets through."""
    e = table(spark, sf, "embeddings")
    return similarity.cosine_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, F.col("label") % 2 == 0)


@query(f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS same, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 4) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)
SELECT round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS label_share, count(DISTINCT query_id) FILTER (score >= 0.35) AS n_relevant FROM t""")
def label_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of neighbours with the query's label, and queries whose best neighbour passes the gate of 0.35."""
    e = table(spark, sf, "embeddings")
    top = nearest_vectors(spark, sf)
    labels = lambda k, n: e.select(F.col("vec_id").alias(k), F.col("label").alias(n))
    j = top.join(labels("query_id", "a"), "query_id").join(labels("vec_id", "b"), "vec_id")
    return j.agg(F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("label_share"), F.countDistinct(F.when(F.col("score") >= 0.35, F.col("query_id"))).alias("n_relevant"))


@query("""WITH c AS (SELECT label AS a, list_position(embedding, list_max(embedding)) % 8 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY ALL),
r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), k AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS pab, (SELECT sum(n * (n - 1) / 2) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2) FROM k) AS pb, (SELECT sum(n * ln(n)) FROM c) AS lab, (SELECT sum(n * ln(n)) FROM r) AS la, (SELECT sum(n * ln(n)) FROM k) AS lb)
SELECT round(1 - ((ln(n) - lab / n) - (ln(n) - lb / n)) / (ln(n) - la / n), 6) AS homogeneity, round(1 - ((ln(n) - lab / n) - (ln(n) - la / n)) / (ln(n) - lb / n), 6) AS completeness, round((pab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM s""")
def grouping_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the labels with a grouping by the vectors' largest component."""
    e = table(spark, sf, "embeddings").select("label", (F.array_position("embedding", F.array_max("embedding")) % 8).alias("g"))
    return scores.grouping_agreement(e, "label", "g")


@query()
def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """k-means clusters of the vectors (seeded), by label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    return KMeans(k=8, seed=7, maxIter=10).fit(e).transform(e).groupBy(F.col("prediction").alias("cluster"), "label").agg(F.count("*").alias("n"))


# --- trials ----------------------------------------------------------------------------------------------------------


@query("""WITH {base}, f AS (SELECT line_id, CASE WHEN line_id IN (SELECT line_id FROM l WHERE line_total_cents = quantity * unit_price_cents AND day IS NOT NULL AND CAST(right(line_id, 2) AS INT) % 10 = 3) THEN 1 ELSE 0 END AS hit FROM l)
SELECT 'line_arithmetic' AS fault, CAST(sum(hit) AS BIGINT) AS injected, CAST(sum(hit) AS BIGINT) AS detected, CAST(0 AS BIGINT) AS false_alarms FROM f""")
def fault_injection(spark: SparkSession, sf: str) -> DataFrame:
    """Faults put into clean lines by a fixed rule, and how many the check finds; untouched clean lines must raise none."""
    li = _lines(spark, sf, "quantity", "unit_price_cents", "line_total_cents", "service_date", "contract_id", "invoice_id", "source_seq")
    clean = (F.col("line_total_cents") == F.col("quantity") * F.col("unit_price_cents")) & F.col("day").isNotNull()
    li = li.withColumn("clean", F.coalesce(clean, F.lit(False))).withColumn("hit", F.col("clean") & (F.substring("line_id", -2, 2).try_cast("int") % 10 == 3))
    spoiled = li.withColumn("line_total_cents", F.when(F.col("hit"), F.col("line_total_cents") + 1).otherwise(F.col("line_total_cents")))
    raised = checks.line_arithmetic(spoiled).select(F.col("detail").alias("line_id"), F.lit(1).alias("raised"))
    j = spoiled.select("line_id", "clean", "hit").join(raised, "line_id", "left")
    return j.agg(F.count(F.when(F.col("hit"), 1)).alias("injected"), F.count(F.when(F.col("hit") & (F.col("raised") == 1), 1)).alias("detected"), F.count(F.when(F.col("clean") & ~F.col("hit") & (F.col("raised") == 1), 1)).alias("false_alarms")).select(F.lit("line_arithmetic").alias("fault"), "injected", "detected", "false_alarms")


_RATED = """rs AS (SELECT contract_id, service, list(DISTINCT rate_cents) AS rates FROM dim_rate WHERE rate_cents IS NOT NULL GROUP BY ALL),
sv AS (SELECT s.contract_id, s.service, s.unit_basis, s.daily_cap, rs.rates FROM dim_service s LEFT JOIN rs USING (contract_id, service))"""


def _rated_sql(l: str, i: str, name: str) -> str:
    """The SQL of the checks against the list of services, over tables of lines and invoices."""
    return f"""{name}_j AS (SELECT {l}.contract_id, {l}.invoice_id, {l}.source_seq, {l}.line_id, {l}.description, {l}.day, {l}.quantity, {l}.unit_price_cents, {l}.unit_basis_as_billed, sv.unit_basis, sv.daily_cap, sv.rates, {i}.patient_id
 FROM {l} JOIN sv ON sv.contract_id = {l}.contract_id AND sv.service = {l}.description LEFT JOIN {i} ON {i}.contract_id = {l}.contract_id AND {i}.source_seq = {l}.source_seq),
{name}_u AS (SELECT contract_id, patient_id, description, day, sum(quantity) AS used FROM {name}_j GROUP BY ALL),
{name} AS (SELECT contract_id, invoice_id, source_seq, 'unit_price' AS category, line_id AS detail FROM {name}_j WHERE NOT list_contains(rates, unit_price_cents)
 UNION ALL SELECT contract_id, invoice_id, source_seq, 'unit_basis', line_id FROM {name}_j WHERE unit_basis_as_billed <> unit_basis
 UNION ALL SELECT contract_id, invoice_id, source_seq, 'daily_cap', line_id FROM {name}_j JOIN {name}_u USING (contract_id, patient_id, description, day) WHERE used > daily_cap)"""


@query(f"WITH {{base}}, {_RATED}, {_rated_sql('l', 'i', 'rc')} SELECT category, count(*) AS n_lines, count(DISTINCT (contract_id, source_seq)) AS n_invoices FROM rc GROUP BY ALL")
def rate_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose price or basis isn't their service's, or whose day holds more units than its cap."""
    lines = _lines(spark, sf, "contract_id", "invoice_id", "source_seq", "description", "service_date", "quantity", "unit_price_cents", "unit_basis_as_billed")
    found = checks.rate_checks(lines, _invoices(spark, sf, "patient_id"), table(spark, sf, "dim_service"), table(spark, sf, "dim_rate"))
    # Of a struct, as countDistinct of columns leaves out rows with a null among them, such as lines without source_seq.
    return found.groupBy("category").agg(F.count("*").alias("n_lines"), F.countDistinct(F.struct("contract_id", "source_seq")).alias("n_invoices"))


_FAULT_NAMES = ", ".join(f"'{x}'" for x in checks.FAULTS)
_SPOILED_RAISED = re.sub(r"\bFROM l\b", "FROM l2", re.sub(r"\b(FROM|JOIN) i\b", r"\1 i2", _RAISED)).replace("FROM i WHERE", "FROM i2 WHERE")
_KIND_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS fault, count(*) FILTER (fault = '{k}') AS injected, count(*) FILTER (fault = '{k}' AND raised IS NOT NULL) AS detected, count(*) FILTER (fault = '{k}' AND list_contains(raised, '{k}')) AS named, count(*) FILTER (fault IS NULL AND list_contains(raised, '{k}')) AS false_alarms FROM jj" for k in checks.FAULTS)


@query(f"""WITH {{base}}, {_RATED}, {_rated_sql('l', 'i', 'rc')}, bad AS (SELECT contract_id, source_seq FROM ({_RAISED}) UNION SELECT contract_id, source_seq FROM rc),
vic AS (SELECT l.contract_id, l.source_seq, min(line_id) AS any_line, min(CASE WHEN sv.daily_cap IS NOT NULL THEN line_id END) AS capped, arg_min(sv.daily_cap, line_id) FILTER (sv.daily_cap IS NOT NULL) AS cap FROM l JOIN sv ON sv.contract_id = l.contract_id AND sv.service = l.description
 WHERE sv.rates IS NOT NULL AND quantity * unit_price_cents IS NOT NULL AND line_total_cents IS NOT NULL AND unit_basis_as_billed IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
cl AS (SELECT i.contract_id, i.source_seq, any_line, capped, cap, CAST(c.eff_from - 1 AS DATE)::VARCHAR AS before, list_extract([{_FAULT_NAMES}], CAST(CAST('0x' || substr(md5(concat_ws('/', '0', i.contract_id, i.source_seq)), 1, 8) AS BIGINT) % 20 AS INT) + 1) AS kind FROM i JOIN vic USING (contract_id, source_seq) JOIN dim_contract c USING (contract_id)
 WHERE i.invoice_total_cents IS NOT NULL AND i.patient_id IS NOT NULL AND c.eff_from IS NOT NULL AND c.contract_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.contract_id = i.contract_id AND b.source_seq = i.source_seq)),
ft AS (SELECT contract_id, source_seq, before, cap, CASE WHEN kind <> 'daily_cap' OR capped IS NOT NULL THEN kind END AS fault, CASE WHEN kind = 'daily_cap' THEN capped ELSE any_line END AS victim FROM cl),
l1 AS (SELECT l.* EXCLUDE (day), ft.fault, ft.before, ft.cap FROM l LEFT JOIN (SELECT * FROM ft WHERE fault IS NOT NULL) ft ON ft.victim = l.line_id),
l1b AS (SELECT * REPLACE (CASE WHEN fault = 'unit_price' THEN unit_price_cents + 10000019 ELSE unit_price_cents END AS unit_price_cents, CASE WHEN fault = 'daily_cap' THEN cap + 5 ELSE quantity END AS quantity, CASE WHEN fault = 'unit_basis' THEN unit_basis_as_billed || '_other' ELSE unit_basis_as_billed END AS unit_basis_as_billed,
 CASE WHEN fault = 'malformed_date' THEN '2025-02-30' WHEN fault = 'out_of_term' THEN before ELSE service_date END AS service_date), line_total_cents AS old_total FROM l1),
l2 AS (SELECT * REPLACE (CASE WHEN fault IN ('unit_price', 'daily_cap') THEN unit_price_cents * quantity WHEN fault = 'line_arithmetic' THEN line_total_cents + 137 ELSE line_total_cents END AS line_total_cents), {_DAY.format('service_date')} AS day FROM l1b),
i2 AS (SELECT i.* REPLACE (i.invoice_total_cents + coalesce(g.more, 0) + CASE WHEN ft.fault = 'invoice_total' THEN 500 ELSE 0 END AS invoice_total_cents, CASE WHEN ft.fault = 'contract_number' THEN 'INS-XX-0000-0000' ELSE i.contract_number END AS contract_number)
 FROM i LEFT JOIN ft ON ft.contract_id = i.contract_id AND ft.source_seq = i.source_seq LEFT JOIN (SELECT contract_id, source_seq, line_total_cents - old_total AS more FROM l2 WHERE fault IN ('unit_price', 'daily_cap', 'line_arithmetic')) g ON g.contract_id = i.contract_id AND g.source_seq = i.source_seq),
{_rated_sql('l2', 'i2', 'rc2')}, ra AS (SELECT contract_id, source_seq, list(DISTINCT category) AS raised FROM ({_SPOILED_RAISED} UNION ALL SELECT * FROM rc2) GROUP BY ALL),
jj AS (SELECT ft.fault, ra.raised FROM ft LEFT JOIN ra USING (contract_id, source_seq)) {_KIND_COUNTS}""")
def fault_injection_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of eight kinds put into clean invoices, one each by a seeded hash, and how many the checks find and name."""
    lines = _lines(spark, sf, "contract_id", "invoice_id", "source_seq", "description", "service_date", "quantity", "unit_price_cents", "line_total_cents", "unit_basis_as_billed")
    invoices = _invoices(spark, sf, "invoice_id", "invoice_date", "invoice_total_cents", "contract_number", "patient_id")
    return checks.injected_faults(lines, invoices, table(spark, sf, "dim_contract"), table(spark, sf, "dim_service"), table(spark, sf, "dim_rate"))


@query("SELECT count(*) AS n, count(*) FILTER (CAST(round(round(CAST(rate_cents AS DECIMAL(18,0)) * 1.075, 0) * 0.95, 0) AS BIGINT) <> CAST(round(CAST(rate_cents AS DECIMAL(18,0)) * 1.075 * 0.95, 0) AS BIGINT)) AS n_differ FROM dim_rate")
def rounding_policies(spark: SparkSession, sf: str) -> DataFrame:
    """How often rounding at each of two steps differs from rounding once, halves away from zero."""
    c, up, down = F.col("rate_cents").cast("decimal(18,0)"), F.lit("1.075").cast("decimal(4,3)"), F.lit("0.95").cast("decimal(3,2)")
    stepwise, once = F.round(F.round(c * up, 0).cast("decimal(18,0)") * down, 0), F.round(c * up * down, 0)
    return table(spark, sf, "dim_rate").agg(F.count("*").alias("n"), F.count(F.when(stepwise.cast("long") != once.cast("long"), 1)).alias("n_differ"))


@query("SELECT contract_id, service, rate_ord, CAST(rate_cents AS VARCHAR) || '|' || format('{:,}', rate_cents) || '|' || CAST(rate_cents // 100 AS VARCHAR) || '.' || lpad(CAST(rate_cents % 100 AS VARCHAR), 2, '0') || '|' || format('{:,}', rate_cents // 100) || '.' || lpad(CAST(rate_cents % 100 AS VARCHAR), 2, '0') AS forms FROM dim_rate")
def money_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every way in which a rate may be written."""
    return table(spark, sf, "dim_rate").select("contract_id", "service", "rate_ord", F.array_join(loose.money_forms(F.col("rate_cents")), "|").alias("forms"))


@query("""WITH a AS (SELECT DISTINCT contract_id, service FROM resolution WHERE service IS NOT NULL), b AS (SELECT contract_id, service FROM dim_service),
j AS (SELECT coalesce(a.contract_id, b.contract_id) AS contract_id, a.service IS NOT NULL AND b.service IS NOT NULL AS s, b.service IS NULL AS i, a.service IS NULL AS m FROM a FULL JOIN b ON a.contract_id = b.contract_id AND a.service = b.service),
c AS (SELECT contract_id, count(*) FILTER (s) AS tp, count(*) FILTER (i) AS fp, count(*) FILTER (m) AS fn FROM j GROUP BY ALL)
SELECT contract_id, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM c""")
def list_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of the services an earlier run named, per contract."""
    a = table(spark, sf, "resolution").where("service is not null").select("contract_id", "service")
    return scores.set_scores(a, table(spark, sf, "dim_service"), ["contract_id", "service"], ["contract_id"])


@query(r"""SELECT contract_number, min(regexp_extract(text, 'clause ([0-9]+)\.', 1)) FILTER (regexp_matches(text, 'clause ([0-9]+)\.')) AS clause, min(regexp_extract(text, 'RPA-H([0-9]+)-', 1)) FILTER (regexp_matches(text, 'RPA-H([0-9]+)-')) AS party,
 (count(DISTINCT regexp_extract(text, 'clause ([0-9]+)\.', 1)) FILTER (regexp_matches(text, 'clause ([0-9]+)\.')) <= 1) AND (count(DISTINCT regexp_extract(text, 'RPA-H([0-9]+)-', 1)) FILTER (regexp_matches(text, 'RPA-H([0-9]+)-')) <= 1) AS agree FROM documents GROUP BY ALL""")
def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that the documents of one contract name, and whether they agree."""
    from ledgerloom.sources.documents import header_fields as read

    return read(table(spark, sf, "documents"), "contract_number", "text", {"clause": r"clause ([0-9]+)\.", "party": r"RPA-H([0-9]+)-"})


@query("""WITH {base}, c AS (SELECT contract_id, source_seq, count(*) AS n_lines, CAST(sum(line_total_cents) AS BIGINT) AS lines_total, count(DISTINCT description) AS n_descriptions, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, min(line_id) AS first_line FROM l WHERE source_seq IS NOT NULL GROUP BY ALL)
SELECT i.contract_id, i.source_seq, i.patient_id, i.invoice_total_cents, c.n_lines, c.lines_total, c.n_descriptions, c.first_day, c.last_day, c.first_line FROM i LEFT JOIN c USING (contract_id, source_seq)""")
def explained_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Every invoice beside what its lines come to."""
    lines = _lines(spark, sf, "contract_id", "source_seq", "line_total_cents", "description", "service_date").where("source_seq is not null").groupBy("contract_id", "source_seq").agg(F.count("*").alias("n_lines"), F.sum("line_total_cents").alias("lines_total"), F.countDistinct("description").alias("n_descriptions"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.min("line_id").alias("first_line"))
    return _invoices(spark, sf, "patient_id", "invoice_total_cents").join(lines, ["contract_id", "source_seq"], "left").select("contract_id", "source_seq", "patient_id", "invoice_total_cents", "n_lines", "lines_total", "n_descriptions", "first_day", "last_day", "first_line")


_OF_INVOICE = "('invoice_total', 'reused_id', 'contract_number')"


@query(f"""WITH {{base}}, f AS ({_RAISED}),
a AS (SELECT contract_id, source_seq, string_agg(category || ': ' || coalesce(detail, ''), '|' ORDER BY category) AS findings FROM f WHERE category IN {_OF_INVOICE} GROUP BY ALL),
b AS (SELECT detail AS line_id, string_agg(category, '|' ORDER BY category) AS line_findings FROM f WHERE category NOT IN {_OF_INVOICE} GROUP BY ALL)
SELECT i.contract_id, i.source_seq, i.invoice_id, i.patient_id, i.invoice_total_cents, coalesce(a.findings, '') AS findings, l.line_id, l.description, l.service_date, l.quantity, l.unit_price_cents, l.line_total_cents, coalesce(b.line_findings, '') AS line_findings
FROM i LEFT JOIN a USING (contract_id, source_seq) LEFT JOIN l USING (contract_id, source_seq) LEFT JOIN b ON l.line_id = b.line_id""")
def explained_invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every invoice with its findings, and each of its lines with the findings on the line."""
    key = ["contract_id", "source_seq"]
    lines = written(_lines(spark, sf, "contract_id", "invoice_id", "source_seq", "description", "service_date", "quantity", "unit_price_cents", "line_total_cents").drop("loaded_at"), "lines")
    invoices = written(_invoices(spark, sf, "invoice_id", "invoice_date", "invoice_total_cents", "contract_number", "patient_id").drop("loaded_at"), "invoices")
    contracts = table(spark, sf, "dim_contract")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "category", F.coalesce("detail", F.lit(""))))), "|")
    of_invoice = checks.invoice_checks(lines, invoices, contracts).groupBy(*key).agg(listed.alias("findings"))
    heads = written(lookup_join(invoices, written(of_invoice, "findings"), key, "left"), "heads").fillna("", ["findings"])
    shown = ["line_id", "description", "service_date", "quantity", "unit_price_cents", "line_total_cents"]
    # One join of lines and heads serves the checks of lines too; invoices with very many lines are spread.
    j = salted_join(lines.select(*key, *shown, F.col("day").alias("line_day")), heads, key, "inner", ["line_id"])
    j = j.unionByName(heads.join(lines.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    j = j.join(broadcast_if_bounded(contracts.select("contract_id", "eff_from", "eff_to")), "contract_id", "left")
    found = checks.line_categories("line_day", "day", "eff_from", "eff_to")
    return j.select(*key, "invoice_id", "patient_id", "invoice_total_cents", "findings", *shown, F.when(F.col("line_id").isNull(), "").otherwise(F.array_join(found, "|")).alias("line_findings"))


@query("""SELECT contract_id, 'service,unit_basis,daily_cap' || chr(10) || string_agg(service || ',' || unit_basis || ',' || coalesce(CAST(daily_cap AS VARCHAR), ''), chr(10) ORDER BY service_ord) AS text FROM dim_service GROUP BY ALL""")
def rules_as_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The services of each contract as CSV text."""
    from ledgerloom.sources.documents import csv_text

    return csv_text(table(spark, sf, "dim_service"), "contract_id", ["service", "unit_basis", "daily_cap"], "service_ord")


@query()
def vector_components(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors on their first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    p = vector_to_array("components")
    return PCA(k=2, inputCol="features", outputCol="components").fit(e).transform(e).select("vec_id", "label", p[0].alias("first"), p[1].alias("second"))


@query()
def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette (cosine) of k-means clusters of the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    s = ClusteringEvaluator(distanceMeasure="cosine").evaluate(KMeans(k=8, seed=7, maxIter=10).fit(e).transform(e))
    return spark.createDataFrame([(8, float(s))], "k int, silhouette double")
