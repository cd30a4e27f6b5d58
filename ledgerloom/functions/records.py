"""Records in model replies: the envelope they come in, what each says, whether it holds, and their assembly into one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.loose import canonical_basis, lenient_day, lenient_fraction, lenient_integer
from ledgerloom.functions.markup import normal

#: Other names under which replies carry their records, in the order in which they are looked for.
OTHER_KEYS = ("data", "items", "rows", "results")
#: Characters of a quotation that are looked for in the source.
QUOTED = 80


def envelope_tag(v: Column, key: str = "services", record_key: str = "service") -> Column:
    """How a variant carries its records: ok, bare_list, key_<name>, single_object or unrecognised."""
    out = F.when(v.isNull(), "unrecognised").when(F.schema_of_variant(v).startswith("ARRAY"), "bare_list").when(_part(v, key).isNotNull(), "ok")
    for k in OTHER_KEYS:
        out = out.when(F.schema_of_variant(_part(v, k)).startswith("ARRAY"), f"key_{k}")
    return out.when(_part(v, record_key).isNotNull(), "single_object").otherwise("unrecognised")


def payload_records(v: Column, key: str = "services", record_key: str = "service") -> Column:
    """The records of a variant as an array of variants, whatever envelope they are in; empty if it has none."""
    tag, none = envelope_tag(v, key, record_key), F.array().cast("array<variant>")
    listed = F.coalesce(*[F.when(tag == f"key_{k}", F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in OTHER_KEYS])
    out = F.when(tag == "ok", F.try_variant_get(v, f"$.{key}", "array<variant>")).when(tag == "bare_list", F.try_variant_get(v, "$", "array<variant>")).when(tag == "single_object", F.array(v)).otherwise(listed)
    return F.coalesce(out, none)


def _part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text(v: Column, key: str) -> Column:
    return F.trim(F.try_variant_get(v, f"$.{key}", "string"))


def _whole(v: Column, key: str) -> Column:
    return lenient_integer(F.try_variant_get(v, f"$.{key}", "string"))


def rate_periods(v: Column) -> Column:
    """The dated rates of a record in any of three forms, as array<struct<cents, valid_from, valid_to>>; empty if there are none.

    rate_cents with rate_cents_after and rate_change_date: two periods, the first ending the day before; else a list
    rates of {rate_cents or cents, valid_from, valid_to}; else rate_cents alone, one open period. Only positive whole
    amounts count; a list without any leaves the record without a rate.
    """
    kind = "array<struct<cents:bigint,valid_from:date,valid_to:date>>"
    none = F.lit(None).cast("date")
    period = lambda c, a, b: F.struct(c.alias("cents"), a.alias("valid_from"), b.alias("valid_to"))
    flat, later, change = _whole(v, "rate_cents"), _whole(v, "rate_cents_after"), lenient_day(_text(v, "rate_change_date"))
    entries = F.try_variant_get(v, "$.rates", "array<variant>")
    listed = F.transform(entries, lambda r: period(F.coalesce(_whole(r, "rate_cents"), _whole(r, "cents")), lenient_day(_text(r, "valid_from")), lenient_day(_text(r, "valid_to"))))
    two = F.array(period(flat, none, F.date_sub(change, 1)), period(later, change, none))
    out = F.when((flat > 0) & (later > 0) & change.isNotNull(), two).when(F.size(entries) > 0, F.filter(listed, lambda r: r["cents"] > 0)).when(flat > 0, F.array(period(flat, none, none))).otherwise(F.array())
    return out.cast(kind)


def read_record(v: Column, source: Column) -> Column:
    """A record (variant) as a struct, with `problems`: why it can't be used (empty if it can).

    no_name alone, or any of unit_basis (not one of the bases), no_rate and not_in_source (its name isn't in the source,
    letters and digits compared). quote_verbatim: whether the first QUOTED characters of its quotation are in the
    source; null without a quotation or source. Discounts go down by threshold; parts that can't be read are left out.
    """
    name = F.coalesce(_text(v, "service"), F.lit(""))
    basis, rates, quote = canonical_basis(_text(v, "unit_basis")), rate_periods(v), F.coalesce(_text(v, "source_quote"), F.lit(""))
    has = lambda t: F.contains(F.concat(F.lit(" "), normal(source), F.lit(" ")), normal(t))
    problems = F.when(name == "", F.array(F.lit("no_name"))).otherwise(F.array_compact(F.array(F.when(basis.isNull(), "unit_basis"), F.when(F.size(rates) == 0, "no_rate"), F.when(source.isNotNull() & ~has(name), "not_in_source"))))
    tier = lambda r, a, b: F.struct(_whole(r, a).alias("threshold"), lenient_fraction(_text(r, b)).alias("share"))
    premium = tier(_part(v, "threshold_premium"), "threshold", "uplift_pct")
    tiers = F.transform(F.try_variant_get(v, "$.volume_discounts", "array<variant>"), lambda r: tier(r, "threshold", "discount_pct"))
    discounts = F.coalesce(F.reverse(F.array_sort(F.filter(tiers, lambda t: (t["threshold"] > 0) & (t["share"] > 0)))), F.array().cast("array<struct<threshold:bigint,share:decimal(16,6)>>"))
    other = _part(v, "bundle")
    bundle = F.struct(_text(other, "partner_service").alias("partner"), _whole(other, "this_rate_cents").alias("this_cents"), _whole(other, "partner_rate_cents").alias("partner_cents"))
    return F.struct(
        problems.alias("problems"), name.alias("service"), basis.alias("unit_basis"), rates.alias("rates"), _whole(v, "daily_cap").alias("daily_cap"), lenient_fraction(_text(v, "nbd_uplift_pct")).alias("uplift"),
        F.when((premium["threshold"] > 0) & (premium["share"] > 0), premium).alias("premium"), discounts.alias("discounts"),
        F.when((bundle["partner"] != "") & (bundle["this_cents"] > 0) & (bundle["partner_cents"] > 0), bundle).alias("bundle"),
        _text(v, "clause").alias("clause"), _text(v, "confidence").try_cast("double").alias("confidence"), quote.alias("quote"), F.when((quote != "") & source.isNotNull(), has(F.substring(quote, 1, QUOTED))).alias("quote_verbatim"),
    )


def assembled(records: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of the usable records (columns of read_record) of each (keys, service) the one with most rates, the later by `at` on a tie."""
    rest = [c for c in records.columns if c not in (*keys, "service")]
    best = F.max_by(F.struct(*rest), F.struct(F.size("rates"), F.col(at)))
    return records.where(F.size("problems") == 0).groupBy(*keys, "service").agg(best.alias("b")).select(*keys, "service", *[F.col(f"b.{c}").alias(c) for c in rest])


def assembled_bundles(records: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, first, second, this_cents, partner_cents, stated): bundles stated by usable records, each unordered pair once.

    The first statement by `at` whose partner was read as a service too counts. Pairs whose partner never was come out
    with stated 'no_partner', others with 'kept'.
    """
    good = records.where(F.size("problems") == 0)
    names = good.select(*keys, F.col("service").alias("partner")).distinct().withColumn("__there", F.lit(True))
    b = good.where("bundle is not null").select(*keys, "service", F.col("bundle.partner").alias("partner"), "bundle.this_cents", "bundle.partner_cents", F.col(at).alias("__at"))
    b = b.join(names, [*keys, "partner"], "left")
    pair = F.array_sort(F.array("service", "partner"))
    g = b.groupBy(*keys, pair.alias("pair")).agg(F.min_by(F.struct("service", "partner", "this_cents", "partner_cents"), F.struct(F.col("__there").isNull(), F.col("__at"))).alias("m"), F.bool_or(F.coalesce("__there", F.lit(False))).alias("kept"))
    return g.select(*keys, F.col("m.service").alias("first"), F.col("m.partner").alias("second"), "m.this_cents", "m.partner_cents", F.when(F.col("kept"), "kept").otherwise("no_partner").alias("stated"))


def question_kind(questions: DataFrame, payload: str, block: str, names: DataFrame, name: str) -> DataFrame:
    """questions with `kind`: cost (a listed service and a whole quantity over 0), compare (two listed services) or other.

    payload: a variant, null if nothing could be read. names: the services of each block. The names asked for (at most
    two are looked at) are joined with the list; each question comes out once.
    """
    v = F.col(payload)
    said = F.coalesce(_text(v, "kind"), F.lit(""))
    quantity = _part(v, "quantity")
    whole = F.coalesce(F.schema_of_variant(quantity) == "BIGINT", F.lit(False)) & (F.try_variant_get(v, "$.quantity", "bigint") > 0)
    both = F.try_variant_get(v, "$.services", "array<string>")
    asked = F.when((said == "cost") & whole, F.array(_text(v, "service"))).when((said == "compare") & (F.size(both) == 2), both)
    listed = names.select(F.col(block).alias("__b"), F.col(name).alias("__n")).distinct().withColumn("__l", F.lit(1))
    q = questions.withColumn("__asked", asked)
    for k in (0, 1):
        one = listed.select(F.col("__b").alias(f"__b{k}"), F.col("__n").alias(f"__n{k}"), F.col("__l").alias(f"__l{k}"))
        q = q.join(one, (F.col(block) == F.col(f"__b{k}")) & (F.get("__asked", F.lit(k)) == F.col(f"__n{k}")), "left")
    known = F.col("__l0").isNotNull() & ((F.size("__asked") < 2) | F.col("__l1").isNotNull())
    return q.select(*questions.columns, F.when(F.coalesce(known, F.lit(False)), said).otherwise("other").alias("kind"))
