"""The audit from lines and invoices to one row per invoice id, and the checks of that report before it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import checks, matching
from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join
from ledgerloom.session import written


def audit(line_items: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """(contract_id, invoice_id, source_seq, invoice_total_cents, n_units, flagged, categories, n_findings).

    Findings belong to the invoice id, so rows that share one share them; the row reported is the last by source_seq.
    categories are sorted and joined by a pipe, '' for an unflagged invoice. Invoices without an id aren't reported.
    """
    lines = checks.lines_once(line_items, ["contract_id", "invoice_id", "source_seq", "service_date", "quantity", "unit_price_cents", "line_total_cents"])
    lines, units = checks.prepared(lines, checks.invoices_once(invoices, ["invoice_id", "invoice_date", "invoice_total_cents", "contract_number"]))
    raised = checks.raised_by(lines, units, contracts)
    # Reduced per (invoice, category) before anything is gathered; there are seven categories.
    found = checks.findings(raised).groupBy("contract_id", "invoice_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"), F.sum("n").alias("n_findings"))
    last = units.where("invoice_id is not null").groupBy("contract_id", "invoice_id").agg(F.max("source_seq").alias("source_seq"), F.max_by("invoice_total_cents", "source_seq").alias("invoice_total_cents"), F.count("*").alias("n_units"))
    j = last.join(found, ["contract_id", "invoice_id"], "left")
    return j.select("contract_id", "invoice_id", "source_seq", "invoice_total_cents", "n_units", F.when(F.col("categories").isNull(), 0).otherwise(1).alias("flagged"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def description_confidence(resolution: DataFrame, services: DataFrame) -> DataFrame:
    """(contract_id, description, confidence): 1 for what is exactly a service, else the best that the earlier run gave it."""
    exact = services.select("contract_id", F.col("service").alias("description"), F.lit(1.0).alias("confidence"))
    run = resolution.where("description is not null and service is not null").select("contract_id", "description", F.col("confidence").cast("double").alias("confidence"))
    return exact.unionByName(run).groupBy("contract_id", "description").agg(F.max("confidence").alias("confidence"))


def least_confidence(units: DataFrame, lines: DataFrame, known: DataFrame) -> DataFrame:
    """(contract_id, source_seq, confidence): the weakest match among a unit's lines; 0 for a description nobody knows and for units without lines."""
    key = ["contract_id", "source_seq"]
    j = lookup_join(lines.select(*key, "line_id", "description"), known, ["contract_id", "description"], "left", ["line_id"])
    least = j.groupBy(*key).agg(F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return units.select(*key).join(least, key, "left").select(*key, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def expected_totals(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """(contract_id, source_seq, expected_total_cents): per unit the quantities at the rates in force, or as billed where there is none."""
    periods = rates.withColumnRenamed("service", "description")
    priced = matching.interval_lookup(lines.select("contract_id", "source_seq", "description", "day", "quantity", "line_total_cents"), periods, ["contract_id", "description"], "day", "valid_from", "valid_to", "rate_ord", ["rate_cents"])
    return priced.groupBy("contract_id", "source_seq").agg(F.sum(F.coalesce(F.col("rate_cents") * F.col("quantity"), F.col("line_total_cents"))).alias("expected_total_cents"))


#: The columns of a report, in order, with their kinds.
REPORT = {"contract_id": "string", "invoice_id": "string", "flagged": "integer", "categories": "string", "expected_total_cents": "integer", "billed_total_cents": "integer", "confidence": "number"}


def report(line_items: DataFrame, invoices: DataFrame, contracts: DataFrame, services: DataFrame, rates: DataFrame, resolution: DataFrame) -> DataFrame:
    """One row of REPORT per invoice id: the audit with the expected total and the least match confidence of the unit reported."""
    key = ["contract_id", "source_seq"]
    lines = written(checks.lines_once(line_items, ["contract_id", "invoice_id", "source_seq", "description", "service_date", "quantity", "unit_price_cents", "line_total_cents"]), "lines")
    base = audit(lines, invoices, contracts)
    expected = expected_totals(lines, rates)
    known = description_confidence(resolution, services)
    conf = least_confidence(base.select(*key), lines, written(known, "known"))
    j = base.join(expected, key, "left").join(conf, key, "left")
    return j.select("contract_id", "invoice_id", "flagged", "categories", F.coalesce("expected_total_cents", F.lit(0)).cast("long").alias("expected_total_cents"), F.col("invoice_total_cents").alias("billed_total_cents"), F.round("confidence", 3).alias("confidence"))


def violations(result: DataFrame, units: DataFrame, columns: dict[str, str] = REPORT) -> DataFrame:
    """(violation, n): everything for which a report would be rejected; no row if all is well.

    columns: other columns or another order than asked for (then nothing else is looked at). not_integer: columns of
    another type. repeated, missing, foreign: ids against the units'. bad_flag: neither 0 nor 1, or null. bad_confidence:
    outside 0..1, or null. null_total. flagged_without_category and category_without_flag (null categories are empty).
    """
    spark = result.sparkSession
    if result.columns != list(columns):
        return spark.createDataFrame([("columns", len(set(columns) ^ set(result.columns)) or 1)], "violation string, n long")
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    types = sum(kind == "integer" and not isinstance(result.schema[c].dataType, whole) for c, kind in columns.items())
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    flag, category = F.col("flagged"), F.coalesce("categories", F.lit(""))
    ids = units.where("invoice_id is not null").select("contract_id", "invoice_id").distinct().withColumn("known", F.lit(1))
    own = result.groupBy("contract_id", "invoice_id").agg(
        F.count("*").alias("k"),
        count(flag.isNull() | ~flag.isin(0, 1), "bad_flag"),
        count(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "bad_confidence"),
        count(F.col("expected_total_cents").isNull() | F.col("billed_total_cents").isNull(), "null_total"),
        count((flag == 1) & (category == ""), "flagged_without_category"),
        count(~flag.eqNullSafe(1) & (category != ""), "category_without_flag"),
    )
    sums = ["bad_flag", "bad_confidence", "null_total", "flagged_without_category", "category_without_flag"]
    j = own.join(ids, ["contract_id", "invoice_id"], "full_outer")
    counts = j.agg(count(F.col("k") > 1, "repeated"), count(F.col("k").isNull(), "missing"), count(F.col("known").isNull(), "foreign"), F.lit(types).alias("not_integer"), *[F.sum(x).alias(x) for x in sums])
    names = ["not_integer", "repeated", "missing", "foreign", *sums]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in names]))).where("n > 0")
