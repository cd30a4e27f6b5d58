"""Integrity checks on records and their details: each gives (contract_id, invoice_id, source_seq, category, detail).

Checks compare what a record says with itself or with its neighbours; null operands raise nothing unless said.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import iso_day, key_of
from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join
from ledgerloom.operators.ordered import earliest, place
from ledgerloom.session import written

KEY = ("contract_id", "invoice_id", "source_seq")


def lines_once(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each line by its earliest copy, with its day; only `columns` (all, if not given) are read, ties are broken by them."""
    d = lines if columns is None else lines.select(*dict.fromkeys(["line_id", "loaded_at", *columns]))
    once = earliest(d.where("line_id is not null"), ["line_id"], "loaded_at")
    return once.withColumn("day", iso_day(F.col("service_date"))) if "service_date" in once.columns else once


def invoices_once(invoices: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each invoice row by its earliest copy, with its day; only `columns` (all, if not given) are read, ties are broken by them."""
    d = invoices if columns is None else invoices.select(*dict.fromkeys(["contract_id", "source_seq", "loaded_at", *columns]))
    once = earliest(d.where("source_seq is not null"), ["contract_id", "source_seq"], "loaded_at")
    return once.withColumn("day", iso_day(F.col("invoice_date"))) if "invoice_date" in once.columns else once


def _found(df: DataFrame, category: str, detail: Column) -> DataFrame:
    return df.select(*KEY, F.lit(category).alias("category"), detail.cast("string").alias("detail"))


def line_arithmetic(lines: DataFrame) -> DataFrame:
    """Lines whose total isn't quantity x unit price."""
    return _found(lines.where("line_total_cents <> quantity * unit_price_cents"), "line_arithmetic", F.col("line_id"))


def invoice_total(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices whose total isn't the sum of their lines; invoices without lines raise nothing."""
    sums = lines.groupBy("contract_id", "source_seq").agg(F.sum("line_total_cents").alias("__sum"))
    return _found(invoices.join(sums, ["contract_id", "source_seq"]).where("invoice_total_cents <> __sum"), "invoice_total", F.col("__sum"))


def reused_id(invoices: DataFrame) -> DataFrame:
    """The second and later rows of one invoice id, in the order of day (none last) and source_seq."""
    named = invoices.where(key_of(F.col("invoice_id")).isNotNull())
    n = place(named, ["contract_id", "invoice_id"], "day", [F.col("source_seq")], "__n")
    return _found(n.where("__n > 1"), "reused_id", F.col("__n"))


def malformed_date(lines: DataFrame) -> DataFrame:
    """Lines without a readable day; no date at all counts."""
    return _found(lines.where("day is null"), "malformed_date", F.col("line_id"))


def out_of_term(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Lines before or after the term of their contract, whose ends belong to it."""
    j = lines.join(broadcast_if_bounded(contracts.select("contract_id", "eff_from", "eff_to")), "contract_id")
    return _found(j.where("day < eff_from or day > eff_to"), "out_of_term", F.col("line_id"))


def after_invoice(lines: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """Lines inside the term, yet after the day of their invoice."""
    days = invoices.select("contract_id", "source_seq", F.col("day").alias("__invoiced"))
    j = lines.join(days, ["contract_id", "source_seq"]).join(broadcast_if_bounded(contracts.select("contract_id", "eff_from", "eff_to")), "contract_id")
    return _found(j.where("day between eff_from and eff_to and day > __invoiced"), "after_invoice", F.col("line_id"))


def contract_number(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """Invoices with another contract number than their contract's; a missing one counts."""
    j = invoices.join(broadcast_if_bounded(contracts.select("contract_id", F.col("contract_number").alias("__own"))), "contract_id")
    return _found(j.where(~F.col("contract_number").eqNullSafe(F.col("__own"))), "contract_number", F.col("contract_number"))


#: The columns of lines and invoices (each once) that the checks read.
LINE_COLUMNS = (*KEY, "line_id", "day", "quantity", "unit_price_cents", "line_total_cents")
INVOICE_COLUMNS = (*KEY, "day", "invoice_total_cents", "contract_number")


def line_categories(day: str, invoiced: str, first: str, last: str) -> Column:
    """The sorted categories that a line raises by itself, given the columns of its day, its invoice's day and its contract's term."""
    kinds = {
        "after_invoice": f"{day} between {first} and {last} and {day} > {invoiced}",
        "line_arithmetic": "line_total_cents <> quantity * unit_price_cents",
        "malformed_date": f"{day} is null",
        "out_of_term": f"{day} < {first} or {day} > {last}",
    }
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in kinds.items()]))


def lines_with_findings(lines: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """lines with `found`, the sorted categories of the four line checks: all in one pass over the lines.

    Lines whose invoice or contract isn't there can't be late or out of term.
    """
    days = invoices.select("contract_id", "source_seq", F.col("day").alias("__invoiced"))
    terms = contracts.select("contract_id", F.col("eff_from").alias("__from"), F.col("eff_to").alias("__to"))
    j = lines.join(days, ["contract_id", "source_seq"], "left").join(broadcast_if_bounded(terms), "contract_id", "left")
    return j.select(*lines.columns, line_categories("day", "__invoiced", "__from", "__to").alias("found"))


def invoice_checks(lines: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """The findings of the three checks on invoices, one under the other."""
    return invoice_total(invoices, lines).unionByName(reused_id(invoices)).unionByName(contract_number(invoices, contracts))


def prepared(lines: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and invoices (each once) written with the columns that the checks need, so that repeats are looked for once."""
    return written(lines.select(*LINE_COLUMNS), "lines"), written(invoices.select(*INVOICE_COLUMNS), "invoices")


def raised_by(lines: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """The findings of all seven checks on prepared tables; one pass over the lines makes all of theirs."""
    of_lines = lines_with_findings(lines, invoices, contracts).select(*KEY, F.explode("found").alias("category"), F.col("line_id").alias("detail"))
    return of_lines.unionByName(invoice_checks(lines, invoices, contracts))


def all_checks(lines: DataFrame, invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """The findings of all seven checks, one under the other."""
    return raised_by(*prepared(lines, invoices), contracts)


def rate_checks(lines: DataFrame, invoices: DataFrame, services: DataFrame, rates: DataFrame) -> DataFrame:
    """Findings on lines whose description is a service of their contract: unit_price (none of the service's rates),
    unit_basis (another than the service's) and daily_cap (more units of one patient and day than the service's cap).

    Null operands and services without rates raise nothing; a line without patient or day can't exceed a cap.
    """
    key = ["contract_id", "description"]
    listed = rates.where("rate_cents is not null").groupBy("contract_id", "service").agg(F.collect_set("rate_cents").alias("__rates"))
    s = services.join(broadcast_if_bounded(listed), ["contract_id", "service"], "left").select("contract_id", F.col("service").alias("description"), F.col("unit_basis").alias("__basis"), F.col("daily_cap").alias("__cap"), "__rates")
    j = lookup_join(lines.select(*KEY, "line_id", "description", "day", "quantity", "unit_price_cents", "unit_basis_as_billed"), s, key, "inner", ["line_id"])
    j = j.join(invoices.select("contract_id", "source_seq", F.col("patient_id").alias("__patient")), ["contract_id", "source_seq"], "left")
    per_day = ["contract_id", "__patient", "description", "day"]
    used = j.where("__cap is not null").dropna(subset=per_day).groupBy(*per_day).agg(F.sum("quantity").alias("__used"))
    j = j.join(used, per_day, "left")
    kinds = {"daily_cap": "__used > __cap", "unit_basis": "unit_basis_as_billed <> __basis", "unit_price": "not array_contains(__rates, unit_price_cents)"}
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in kinds.items()]))
    return j.select(*KEY, F.explode(found).alias("category"), F.col("line_id").alias("detail"))


def findings(raised: DataFrame) -> DataFrame:
    """(contract_id, invoice_id, category, detail, n): per invoice id and category the first detail and the number."""
    return raised.groupBy("contract_id", "invoice_id", "category").agg(F.min("detail").alias("detail"), F.count("*").alias("n"))


#: Faults that the checks above can find, by the category that each must raise.
FAULTS = ("line_arithmetic", "invoice_total", "malformed_date", "out_of_term", "contract_number", "unit_price", "unit_basis", "daily_cap")


def seeded(seed: int, *columns: str) -> Column:
    """A number from 0 to 2^32 - 1 of columns and a seed, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *columns)), 1, 8), 16, 10).cast("long")


def injected_faults(lines: DataFrame, invoices: DataFrame, contracts: DataFrame, services: DataFrame, rates: DataFrame, seed: int = 0, one_in: int = 20) -> DataFrame:
    """(fault, injected, detected, named, false_alarms): faults of each kind put into clean invoices, and what the checks find.

    Clean invoices raise nothing, have a total, a patient and a term, and a line with all its amounts, a day and a service
    with a rate (for daily_cap one with a cap). By a seeded hash one in `one_in` of them gets each kind, and none gets
    two. detected: any finding on the invoice; named: one of the right kind; a false alarm is a clean invoice left as it
    is that raises the kind.
    """
    key = ["contract_id", "source_seq"]
    check = lambda li, iv: all_checks(li, iv, contracts).unionByName(rate_checks(li, iv, services, rates))
    lines, invoices = written(lines, "lines"), written(invoices, "invoices")
    known = services.join(rates.where("rate_cents is not null").select("contract_id", "service").distinct(), ["contract_id", "service"], "left_semi").select("contract_id", F.col("service").alias("description"), F.col("daily_cap").alias("__cap"))
    whole = lookup_join(lines.where("quantity * unit_price_cents is not null and line_total_cents is not null and unit_basis_as_billed is not null and day is not null"), known, ["contract_id", "description"], "inner", ["line_id"])
    victims = whole.groupBy(*key).agg(F.min("line_id").alias("__any"), F.min(F.when(F.col("__cap").isNotNull(), F.struct("line_id", "__cap"))).alias("__capped"))
    terms = contracts.where("eff_from is not null and contract_number is not null").select("contract_id", "eff_from")
    clean = invoices.where("invoice_total_cents is not null and patient_id is not null").join(check(lines, invoices), key, "left_anti").join(victims, key).join(broadcast_if_bounded(terms), "contract_id")
    fault = F.get(F.array(*map(F.lit, FAULTS)), (seeded(seed, *key) % one_in).cast("int"))
    clean = clean.select(*key, "__any", "__capped", F.date_sub("eff_from", 1).cast("string").alias("__before"), fault.alias("__kind"))
    clean = clean.select(*key, "__before", F.when((F.col("__kind") != "daily_cap") | F.col("__capped").isNotNull(), F.col("__kind")).alias("__fault"), F.when(F.col("__kind") == "daily_cap", F.col("__capped.line_id")).otherwise(F.col("__any")).alias("__victim"), F.col("__capped.__cap").alias("__cap"))
    clean = written(clean, "clean")
    hit = clean.where("__fault is not null")
    is_ = lambda k: F.coalesce(F.col("__fault") == k, F.lit(False))
    spoiled = lines.join(hit.select(F.col("__victim").alias("line_id"), "__before", "__fault", "__cap"), "line_id", "left")
    price = F.col("unit_price_cents") + F.when(is_("unit_price"), 10_000_019).otherwise(0)
    quantity = F.when(is_("daily_cap"), F.col("__cap") + 5).otherwise(F.col("quantity"))
    total = F.when(is_("unit_price") | is_("daily_cap"), price * quantity).otherwise(F.col("line_total_cents") + F.when(is_("line_arithmetic"), 137).otherwise(0))
    basis = F.when(is_("unit_basis"), F.concat(F.col("unit_basis_as_billed"), F.lit("_other"))).otherwise(F.col("unit_basis_as_billed"))
    date = F.when(is_("malformed_date"), "2025-02-30").when(is_("out_of_term"), F.col("__before")).otherwise(F.col("service_date"))
    spoiled = spoiled.withColumns({"unit_price_cents": price, "quantity": quantity, "line_total_cents": total, "unit_basis_as_billed": basis, "service_date": date})
    # The invoice's total follows its lines, so that each fault is the only one of its invoice.
    grown = spoiled.where(is_("unit_price") | is_("daily_cap") | is_("line_arithmetic")).select(*key, F.col("line_total_cents").alias("__new"), "line_id").join(lines.select("line_id", F.col("line_total_cents").alias("__old")), "line_id").select(*key, (F.col("__new") - F.col("__old")).alias("__more"))
    spoiled = spoiled.withColumn("day", iso_day(F.col("service_date"))).drop("__before", "__fault", "__cap")
    heads = invoices.join(hit.select(*key, "__fault"), key, "left").join(grown, key, "left")
    heads = heads.withColumn("invoice_total_cents", F.col("invoice_total_cents") + F.coalesce("__more", F.lit(0)) + F.when(is_("invoice_total"), 500).otherwise(0))
    heads = heads.withColumn("contract_number", F.when(is_("contract_number"), "INS-XX-0000-0000").otherwise(F.col("contract_number"))).drop("__fault", "__more")
    raised = check(spoiled, heads).groupBy(*key).agg(F.collect_set("category").alias("__raised"))
    j = clean.select(*key, "__fault").join(raised, key, "left")
    found = lambda k: F.coalesce(F.array_contains("__raised", k), F.lit(False))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    kinds = [F.struct(F.lit(k).alias("fault"), count(is_(k), "injected"), count(is_(k) & F.col("__raised").isNotNull(), "detected"), count(is_(k) & found(k), "named"), count(F.col("__fault").isNull() & found(k), "false_alarms")) for k in FAULTS]
    return j.agg(F.array(*kinds).alias("k")).select(F.inline("k"))
