"""Queries on model replies, rule lists, trials and files, each with its SQL.

Replies are built from the lists of services in many shapes, chosen by MD5 of the keys, so that SQL can say what must come
out of them without reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import loose, records
from ledgerloom.operators import ordered, scores, similarity
from ledgerloom.queries import reference
from ledgerloom.queries.reference import SQL, _invoices, _lines, query
from ledgerloom.session import shared_folder, written
from ledgerloom.sources import documents as files
from ledgerloom.sources.tables import read_csv_typed, table


def _digit(*columns: str) -> Column:
    """A hexadecimal digit of some columns; in SQL substr(md5(concat_ws('/', ...)), 1, 1)."""
    return F.substring(F.md5(F.concat_ws("/", *columns)), 1, 1)


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Each service with its least and largest rate and its digit."""
    r = table(spark, sf, "dim_rate").groupBy("contract_id", "service").agg(F.min("rate_cents").alias("lo"), F.max("rate_cents").alias("hi"))
    return table(spark, sf, "dim_service").join(r, ["contract_id", "service"]).withColumn("d", _digit("contract_id", "service"))


_BASE_SQL = "b AS (SELECT s.contract_id, s.service, s.service_ord, s.unit_basis, s.daily_cap, r.lo, r.hi, substr(md5(concat_ws('/', s.contract_id, s.service)), 1, 1) AS d FROM dim_service s JOIN (SELECT contract_id, service, min(rate_cents) AS lo, max(rate_cents) AS hi FROM dim_rate GROUP BY ALL) r USING (contract_id, service))"


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply about each service, in shapes that depend on its digit, with the text that it was read from."""
    d, s = F.col("d"), F.col("service")
    q = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    comma = lambda c: F.format_number(c, 0)
    name = F.when(d == "0", " ").when(d == "3", F.concat(F.lit("Imaginary "), s)).otherwise(s)
    basis = F.when(d == "1", "per fortnight").when(d == "7", F.concat(F.lit(" "), F.upper(F.regexp_replace("unit_basis", "_", "-")))).otherwise(F.col("unit_basis"))
    rate = (
        F.when(d == "2", F.lit('"rate_cents": null'))
        .when(d == "4", F.concat(F.lit('"rate_cents": "'), comma(F.col("lo")), F.lit('"')))
        .when(d == "5", F.concat(F.lit('"rates": [{"cents": '), F.col("lo"), F.lit(', "valid_to": "2024-12-31"}, {"rate_cents": "'), F.col("hi"), F.lit('", "valid_from": "2025-01-01T00:00:00"}, {"cents": "none"}]')))
        .when(d == "6", F.concat(F.lit('"rate_cents": '), F.col("lo"), F.lit(', "rate_cents_after": '), F.col("hi"), F.lit(', "rate_change_date": "2025-01-01"')))
        .when(d == "a", F.lit('"rate_cents": true'))
        .otherwise(F.concat(F.lit('"rate_cents": '), F.col("lo")))
    )
    cap = F.when(d == "4", F.concat(F.lit('"'), comma(F.col("daily_cap") * 1000), F.lit('"'))).when(d == "9", "12.5").otherwise(F.col("daily_cap").cast("string"))
    quote = F.when(d == "8", F.lit("nowhere stated")).when(d == "b", F.lit("")).otherwise(F.concat(s, F.lit(" is charged at")))
    extra = F.concat(F.lit(', "threshold_premium": {"threshold": '), F.col("service_ord"), F.lit(', "uplift_pct": "15%"}, "volume_discounts": [{"threshold": 100, "discount_pct": 5}, {"threshold": "1,000", "discount_pct": 0.1}, {"threshold": 0, "discount_pct": 9}], "nbd_uplift_pct": '), F.when(d == "c", "0.25").otherwise("25"))
    reply = F.concat(F.lit('{"service": '), q(name), F.lit(', "unit_basis": '), q(basis), F.lit(", "), rate, F.lit(', "daily_cap": '), F.coalesce(cap, F.lit("null")), F.lit(', "source_quote": '), q(quote), extra, F.lit("}"))
    source = F.concat(F.lit("Clause "), F.col("service_ord"), F.lit(". "), F.upper("service"), F.lit(" is  charged at GBP "), F.col("lo"))
    return _base(spark, sf).select("contract_id", "service_ord", "d", reply.alias("reply"), source.alias("source"))


@query(f"""WITH {_BASE_SQL}, p AS (SELECT *, CASE WHEN d = '0' THEN 'no_name' ELSE concat_ws('|', CASE WHEN d = '1' THEN 'unit_basis' END, CASE WHEN d IN ('2', 'a') THEN 'no_rate' END, CASE WHEN d = '3' THEN 'not_in_source' END) END AS problems FROM b)
SELECT contract_id, service_ord, problems, CASE WHEN problems = '' THEN service END AS service, CASE WHEN problems = '' THEN unit_basis END AS unit_basis, CASE WHEN problems = '' THEN CASE WHEN d IN ('5', '6') THEN 2 ELSE 1 END END AS n_rates, CASE WHEN problems = '' THEN lo END AS first_cents, CASE WHEN problems = '' AND d IN ('5', '6') THEN '2025-01-01' END AS last_from,
 CASE WHEN problems = '' THEN CASE WHEN d = '4' THEN daily_cap * 1000 WHEN d <> '9' THEN daily_cap END END AS daily_cap, CASE WHEN problems = '' AND d <> 'b' THEN CASE WHEN d = '8' THEN 0 ELSE 1 END END AS verbatim, CASE WHEN problems = '' AND service_ord > 0 THEN service_ord END AS premium_from, CASE WHEN problems = '' THEN '1000:0.1|100:0.05' END AS discounts, CASE WHEN problems = '' THEN CAST(0.25 AS DOUBLE) END AS uplift FROM p""")
def validated_records(spark: SparkSession, sf: str) -> DataFrame:
    """Replies read as records: what is wrong with each, or what it says."""
    r = _replies(spark, sf).withColumn("r", records.read_record(loose.json_payload(F.col("reply")), F.col("source")))
    good = F.size("r.problems") == 0
    of = lambda c: F.when(good, c)
    tiers = F.array_join(F.transform("r.discounts", lambda t: F.concat_ws(":", t["threshold"].cast("string"), t["share"].cast("double").cast("string"))), "|")
    return r.select("contract_id", "service_ord", F.array_join("r.problems", "|").alias("problems"), of(F.col("r.service")).alias("service"), of(F.col("r.unit_basis")).alias("unit_basis"), of(F.size("r.rates")).alias("n_rates"), of(F.get("r.rates", F.lit(0))["cents"]).alias("first_cents"), of(F.element_at("r.rates", -1)["valid_from"].cast("string")).alias("last_from"),
        of(F.col("r.daily_cap")).alias("daily_cap"), of(F.col("r.quote_verbatim").cast("int")).alias("verbatim"), of(F.col("r.premium.threshold")).alias("premium_from"), of(tiers).alias("discounts"), of(F.col("r.uplift").cast("double")).alias("uplift"))


_SHAPE = "CAST('0x' || substr(md5(concat_ws('/', contract_id, chunk)), 1, 8) AS BIGINT) % 7"


@query(f"""WITH {_BASE_SQL}, c AS (SELECT contract_id, service_ord // 15 AS chunk, count(*) AS n, arg_min(service, service_ord) AS first FROM b GROUP BY ALL), s AS (SELECT *, {_SHAPE} AS e FROM c)
SELECT contract_id, CAST(chunk AS BIGINT) AS chunk, list_extract(['ok', 'bare_list', 'key_data', 'key_items', 'single_object', 'unrecognised', 'unrecognised'], CAST(e AS INT) + 1) AS envelope, list_extract(['plain', 'fenced', 'chatty', 'fenced', 'plain', 'chatty', 'none'], CAST(e AS INT) + 1) AS wrapping,
 CASE WHEN e < 4 THEN n WHEN e = 4 THEN 1 ELSE 0 END AS n_records, CASE WHEN e < 5 THEN first END AS first_service FROM s""")
def reply_records(spark: SparkSession, sf: str) -> DataFrame:
    """Replies about lots of services in seven envelopes and wrappings: how each came, and the records in it."""
    record = F.to_json(F.struct("service"))
    lots = _base(spark, sf).groupBy("contract_id", F.floor(F.col("service_ord") / 15).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("service_ord", record.alias("r")))).alias("l"))
    all_, first = F.array_join(F.transform("l", lambda x: x["r"]), ", "), F.get("l", F.lit(0))["r"]
    e = F.conv(F.substring(F.md5(F.concat_ws("/", "contract_id", "chunk")), 1, 8), 16, 10).cast("long") % 7
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    reply = (
        F.when(e == 0, say('{"services": [', all_, "]}")).when(e == 1, say("Here they are:\n```json\n[", all_, "]\n```\nDone.")).when(e == 2, say('The rows are {"data": [', all_, "]}, as asked."))
        .when(e == 3, say('```\n{"items": [', all_, "]}\n```")).when(e == 4, first).when(e == 5, say('I found {"nothing": 1} of use.')).otherwise(F.lit("There are no braces in this."))
    )
    r = lots.select("contract_id", "chunk", reply.alias("reply")).withColumn("v", loose.json_payload(F.col("reply")))
    got = records.payload_records(F.col("v"))
    return r.select("contract_id", "chunk", records.envelope_tag(F.col("v")).alias("envelope"), loose.payload_kind(F.col("reply")).alias("wrapping"), F.size(got).cast("long").alias("n_records"), F.try_variant_get(F.get(got, F.lit(0)), "$.service", "string").alias("first_service"))


@query("""WITH r AS (SELECT contract_id, service, min(rate_cents) AS lo, count(*) AS n FROM dim_rate GROUP BY ALL), d AS (SELECT *, substr(md5(concat_ws('/', contract_id, service)), 1, 1) AS d FROM r)
SELECT contract_id, service, n AS n_rates, CASE WHEN n > 1 THEN CASE WHEN d < '8' THEN 1 ELSE 2 END ELSE 2 END AS kept_from FROM d""")
def assembled_services(spark: SparkSession, sf: str) -> DataFrame:
    """Services stated twice, once with one rate and once with all, in either order: the richer statement is kept, the later of equal ones."""
    period = F.struct(F.col("rate_cents").alias("cents"), F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"))
    r = table(spark, sf, "dim_rate").groupBy("contract_id", "service").agg(F.array_sort(F.collect_list(F.struct("rate_ord", period.alias("p")))).alias("all"))
    rates, rich_first = F.transform("all", lambda x: x["p"]), _digit("contract_id", "service") < "8"
    stated = lambda at: r.select("contract_id", "service", F.when(rich_first if at == 1 else ~rich_first, rates).otherwise(F.slice(rates, 1, 1)).alias("rates"), F.lit(at).alias("at"), F.array().cast("array<string>").alias("problems"))
    out = records.assembled(stated(1).unionByName(stated(2)), ["contract_id"], "at")
    return out.select("contract_id", "service", F.size("rates").cast("long").alias("n_rates"), F.col("at").alias("kept_from"))


@query("""WITH s AS (SELECT contract_id, service, service_ord, substr(md5(concat_ws('/', contract_id, service)), 1, 1) AS d FROM dim_service),
st AS (SELECT a.contract_id, a.service, a.service_ord AS o, a.d, b.service AS partner, b.d AS pd FROM s a JOIN s b ON a.contract_id = b.contract_id AND b.service_ord = xor(a.service_ord, 1)),
g AS (SELECT *, pd <> '0' AS there, list_sort([service, partner]) AS pair FROM st WHERE d <> '0'),
f AS (SELECT *, row_number() OVER (PARTITION BY contract_id, pair ORDER BY CASE WHEN there THEN 0 ELSE 1 END, o) AS n, bool_or(there) OVER (PARTITION BY contract_id, pair) AS kept FROM g)
SELECT contract_id, service AS first, partner AS second, CAST(o + 1 AS BIGINT) AS this_cents, CAST(xor(o, 1) + 1 AS BIGINT) AS partner_cents, CASE WHEN kept THEN 'kept' ELSE 'no_partner' END AS stated FROM f WHERE n = 1""")
def assembled_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles that both partners state, once each; partners that weren't read (one in sixteen) are told."""
    s = table(spark, sf, "dim_service").select("contract_id", "service", "service_ord")
    other = s.select("contract_id", F.col("service").alias("partner"), F.col("service_ord").bitwiseXOR(F.lit(1)).cast("int").alias("service_ord"))
    st = s.join(other, ["contract_id", "service_ord"])
    bundle = F.struct("partner", (F.col("service_ord") + 1).cast("long").alias("this_cents"), (F.col("service_ord").bitwiseXOR(F.lit(1)) + 1).cast("long").alias("partner_cents"))
    problems = F.when(_digit("contract_id", "service") == "0", F.array(F.lit("no_rate"))).otherwise(F.array().cast("array<string>"))
    return records.assembled_bundles(st.select("contract_id", "service", bundle.alias("bundle"), problems.alias("problems"), F.col("service_ord").alias("at")), ["contract_id"], "at")


@query(f"""WITH {_BASE_SQL} SELECT contract_id, service, unit_basis, lo AS rate_cents, CASE WHEN d IN ('5', '6') THEN 2 ELSE 1 END AS n_rates, CASE WHEN service_ord > 0 THEN service_ord || ':0.15' ELSE '' END AS premium, '1000:0.1|100:0.05' AS discounts FROM b WHERE d NOT IN ('0', '1', '2', '3', 'a')""")
def extraction_table(spark: SparkSession, sf: str) -> DataFrame:
    """The usable records of all replies as a flat table."""
    r = _replies(spark, sf).select("contract_id", records.read_record(loose.json_payload(F.col("reply")), F.col("source")).alias("r")).where(F.size("r.problems") == 0)
    tier = lambda t: F.concat_ws(":", t["threshold"].cast("string"), t["share"].cast("double").cast("string"))
    return r.select("contract_id", "r.service", "r.unit_basis", F.get("r.rates", F.lit(0))["cents"].alias("rate_cents"), F.size("r.rates").alias("n_rates"), F.when(F.col("r.premium").isNotNull(), tier(F.col("r.premium"))).otherwise("").alias("premium"), F.array_join(F.transform("r.discounts", tier), "|").alias("discounts"))


@query("""WITH s AS (SELECT contract_id, service, service_ord, CAST('0x' || substr(md5(concat_ws('/', contract_id, service)), 1, 8) AS BIGINT) % 8 AS e FROM dim_service)
SELECT contract_id, service_ord, CASE WHEN e = 0 THEN 'cost' WHEN e = 3 THEN 'compare' ELSE 'other' END AS kind FROM s""")
def question_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What a reading of a question is good for: eight shapes, of which one is a cost and one a comparison."""
    e = F.conv(F.substring(F.md5(F.concat_ws("/", "contract_id", "service")), 1, 8), 16, 10).cast("long") % 8
    js = F.to_json(F.struct("service"))
    name = F.substring(js, F.lit(12), F.length(js) - 12)
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    reply = (
        F.when(e == 0, say('{"kind": "cost", "quantity": 3, "service": ', name, "}")).when(e == 1, say('{"kind": "cost", "quantity": 0, "service": ', name, "}")).when(e == 2, say('{"kind": "cost", "quantity": "3", "service": ', name, "}"))
        .when(e == 3, say('{"kind": "compare", "services": [', name, ", ", name, "]}")).when(e == 4, say('{"kind": "compare", "services": [', name, ', "No Such Service"]}')).when(e == 5, say('{"kind": "compare", "services": [', name, "]}"))
        .when(e == 6, F.lit("no idea")).otherwise(say('{"kind": "cost", "quantity": 2, "service": "No Such Service"}'))
    )
    s = table(spark, sf, "dim_service").select("contract_id", "service", "service_ord")
    q = s.select("contract_id", "service_ord", loose.json_payload(reply).alias("v"))
    return records.question_kind(q, "v", "contract_id", s.withColumnRenamed("contract_id", "contract_id"), "service").select("contract_id", "service_ord", "kind")


# --- lists of rules against each other ------------------------------------------------------------------------------------

_GOLD_SQL = """gold AS (SELECT contract_id, 'service' AS family, service AS item, '' AS value FROM dim_service UNION ALL SELECT contract_id, 'unit_basis', service, unit_basis FROM dim_service UNION ALL SELECT contract_id, 'daily_cap', service, CAST(daily_cap AS VARCHAR) FROM dim_service WHERE daily_cap IS NOT NULL
 UNION ALL SELECT contract_id, 'rate', service || '|' || rate_ord, CAST(rate_cents AS VARCHAR) FROM dim_rate UNION ALL SELECT contract_id, 'valid_from', service || '|' || rate_ord, CAST(valid_from AS VARCHAR) FROM dim_rate WHERE valid_from IS NOT NULL
 UNION ALL SELECT contract_id, 'valid_to', service || '|' || rate_ord, CAST(valid_to AS VARCHAR) FROM dim_rate WHERE valid_to IS NOT NULL UNION ALL SELECT contract_id, 'known_from', service || '|' || rate_ord, CAST(known_from AS VARCHAR) FROM dim_rate WHERE known_from IS NOT NULL),
dg AS (SELECT *, substr(md5(concat_ws('/', contract_id, family, item)), 1, 1) AS d FROM gold),
pred AS (SELECT contract_id, family, item, CASE WHEN d = '1' AND family <> 'service' THEN value || '0' ELSE value END AS value FROM dg WHERE d <> '0' UNION ALL SELECT contract_id, family, 'Invented ' || item, value FROM dg WHERE d = '2')"""


def _rules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All rules as (contract_id, family, item, value), and the same with one in sixteen dropped, changed and invented."""
    s, r = table(spark, sf, "dim_service"), table(spark, sf, "dim_rate")
    row = lambda d, family, item, value: d.select("contract_id", F.lit(family).alias("family"), item.alias("item"), value.cast("string").alias("value")).where("value is not null")
    service, dated = F.col("service"), F.concat_ws("|", "service", "rate_ord")
    gold = row(s, "service", service, F.lit(""))
    for part in (row(s, "unit_basis", service, F.col("unit_basis")), row(s, "daily_cap", service, F.col("daily_cap")), *[row(r, f, dated, F.col(c)) for f, c in (("rate", "rate_cents"), ("valid_from", "valid_from"), ("valid_to", "valid_to"), ("known_from", "known_from"))]):
        gold = gold.unionByName(part)
    d = gold.withColumn("d", _digit("contract_id", "family", "item"))
    changed = F.when((F.col("d") == "1") & (F.col("family") != "service"), F.concat("value", F.lit("0"))).otherwise(F.col("value"))
    invented = d.where("d = '2'").select("contract_id", "family", F.concat(F.lit("Invented "), "item").alias("item"), "value")
    return gold, d.where("d <> '0'").select("contract_id", "family", "item", changed.alias("value")).unionByName(invented)


@query(f"""WITH {_GOLD_SQL}, j AS (SELECT coalesce(g.contract_id, p.contract_id) AS contract_id, coalesce(g.family, p.family) AS family, coalesce(g.item, p.item) AS item, CASE WHEN p.item IS NULL THEN 'MISSED' WHEN g.item IS NULL THEN CASE WHEN p.family = 'service' THEN 'HALLUCINATED' ELSE 'INVENTED' END WHEN g.value IS DISTINCT FROM p.value THEN 'WRONG' END AS kind, g.value AS wanted, p.value AS got
 FROM gold g FULL JOIN pred p ON g.contract_id = p.contract_id AND g.family = p.family AND g.item = p.item) SELECT * FROM j WHERE kind IS NOT NULL""")
def rule_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Rules missed, invented and wrong, item by item over seven families."""
    gold, predicted = _rules(spark, sf)
    return scores.rule_defects(gold, predicted, ["contract_id"], "family", "item", "value")


@query(f"""WITH {_GOLD_SQL}, j AS (SELECT coalesce(g.contract_id, p.contract_id) AS contract_id, coalesce(g.family, p.family) AS family, g.item IS NOT NULL AS t, p.item IS NOT NULL AS p FROM gold g FULL JOIN pred p ON g.contract_id = p.contract_id AND g.family = p.family AND g.item = p.item AND g.value = p.value),
c AS (SELECT contract_id, family, count(*) FILTER (t) AS support, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1, round(fp / greatest(1, support), 4) AS invented_rate FROM c""")
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and rate of invention per family of rules."""
    gold, predicted = _rules(spark, sf)
    return scores.family_scores(gold, predicted, ["contract_id"], "family", "item", "value")


@query(f"""WITH {_GOLD_SQL}, j AS (SELECT coalesce(g.family, p.family) AS family, coalesce(g.contract_id, p.contract_id) || '/' || coalesce(g.item, p.item) AS item, CASE WHEN p.item IS NULL THEN 'MISSED' WHEN g.item IS NULL THEN CASE WHEN p.family = 'service' THEN 'HALLUCINATED' ELSE 'INVENTED' END WHEN g.value IS DISTINCT FROM p.value THEN 'WRONG' END AS kind
 FROM gold g FULL JOIN pred p ON g.contract_id = p.contract_id AND g.family = p.family AND g.item = p.item), n AS (SELECT *, row_number() OVER (PARTITION BY family, kind ORDER BY item) AS place FROM j WHERE kind IS NOT NULL) SELECT family, kind, item, place FROM n WHERE place <= 10""")
def first_defects(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten defects of each kind and family, as a report shows them."""
    d = rule_defects(spark, sf).select("family", "kind", F.concat_ws("/", "contract_id", "item").alias("item"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("family", "kind").orderBy("item"))).where("place <= 10")


@query("""WITH r AS (SELECT s.contract_id, s.service, r.rate_cents FROM dim_service s JOIN dim_rate r ON r.contract_id = s.contract_id AND r.service = s.service WHERE r.rate_ord = 0 AND r.rate_cents IS NOT NULL)
SELECT contract_id, arg_max(service, (rate_cents, service)) AS dearest, max(rate_cents) AS dearest_value, arg_min(service, (rate_cents, service)) AS cheapest, min(rate_cents) AS cheapest_value FROM r GROUP BY ALL""")
def dearest_and_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest and the cheapest service of each contract by its first rate; of equal ones the last and the first by name."""
    r = table(spark, sf, "dim_rate").where("rate_ord = 0").join(table(spark, sf, "dim_service").select("contract_id", "service"), ["contract_id", "service"], "left_semi")
    return scores.edge_items(r, ["contract_id"], "rate_cents", "service")


@query("""WITH r AS (SELECT contract_id, service, min(rate_cents) AS lo, max(rate_cents) AS hi, count(*) AS n FROM dim_rate WHERE rate_cents > 0 GROUP BY ALL), f AS (SELECT contract_id, service, CAST(10000 * (hi - lo) // hi AS BIGINT) AS fall FROM r WHERE n > 1 AND hi > lo)
SELECT contract_id, service, fall FROM f QUALIFY fall = max(fall) OVER (PARTITION BY contract_id)""")
def deepest_fall(spark: SparkSession, sf: str) -> DataFrame:
    """Services whose rates differ most of all of their contract (in hundredths of a percent of the higher), all that tie."""
    r = table(spark, sf, "dim_rate").where("rate_cents > 0").groupBy("contract_id", "service").agg(F.min("rate_cents").alias("lo"), F.max("rate_cents").alias("hi"), F.count("*").alias("n")).where("n > 1 and hi > lo")
    return scores.extremes(r.select("contract_id", "service", F.expr("10000 * (hi - lo) div hi").alias("fall")), ["contract_id"], "fall")


@query("""WITH n AS (SELECT contract_id, service, count(*) AS n FROM dim_rate GROUP BY ALL), x AS (SELECT contract_id, 'capped' AS family, service || ': ' || daily_cap AS t, service FROM dim_service WHERE daily_cap IS NOT NULL UNION ALL SELECT contract_id, 'several_rates', service || ': ' || n, service FROM n WHERE n > 1 UNION ALL SELECT contract_id, unit_basis, service, service FROM dim_service)
SELECT contract_id, family, count(*) AS n, string_agg(t, '; ' ORDER BY service) AS listed FROM x GROUP BY ALL""")
def rule_families(spark: SparkSession, sf: str) -> DataFrame:
    """Per contract and family of rules how many services have one, and which."""
    s = table(spark, sf, "dim_service")
    n = table(spark, sf, "dim_rate").groupBy("contract_id", "service").agg(F.count("*").alias("n")).where("n > 1")
    x = s.where("daily_cap is not null").select("contract_id", F.lit("capped").alias("family"), F.concat_ws(": ", "service", "daily_cap").alias("t"), "service")
    x = x.unionByName(n.select("contract_id", F.lit("several_rates").alias("family"), F.concat_ws(": ", "service", "n").alias("t"), "service")).unionByName(s.select("contract_id", F.col("unit_basis").alias("family"), F.col("service").alias("t"), "service"))
    return x.groupBy("contract_id", "family").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("service", "t"))), lambda r: r["t"]), "; ").alias("listed"))


# --- trials ----------------------------------------------------------------------------------------------------------------


@query("""WITH {base}, h AS (SELECT *, substr(md5(concat_ws('/', contract_id, source_seq)), 1, 1) < '8' AS fit FROM l WHERE description IS NOT NULL AND source_seq IS NOT NULL AND contract_id IS NOT NULL),
c AS (SELECT contract_id, description, unit_price_cents, count(*) AS n, min(line_id) AS f FROM h WHERE fit GROUP BY ALL), m AS (SELECT contract_id, description, unit_price_cents AS modal FROM c QUALIFY row_number() OVER (PARTITION BY contract_id, description ORDER BY n DESC, f) = 1),
j AS (SELECT h.*, m.modal, m.description IS NOT NULL AS seen FROM h LEFT JOIN m ON m.contract_id = h.contract_id AND m.description = h.description WHERE NOT fit)
SELECT contract_id, count(*) AS n_lines, round(count(*) FILTER (unit_price_cents = modal) / count(*), 6) AS reproduced, count(DISTINCT CASE WHEN NOT seen THEN description END) AS unseen_descriptions, count(*) FILTER (NOT seen) AS unseen_lines FROM j GROUP BY ALL""")
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    """The modal price of each description fitted on one half of the invoice rows, and how far it reproduces the other half."""
    lines = _lines(spark, sf, "contract_id", "source_seq", "description", "unit_price_cents").dropna(subset=["contract_id", "source_seq", "description"])
    h = written(lines.withColumn("fit", _digit("contract_id", "source_seq") < "8"), "halves")
    m = ordered.mode_of(h.where("fit"), ["contract_id", "description"], ["unit_price_cents"], [F.col("line_id")]).select("contract_id", "description", F.col("unit_price_cents").alias("modal"), F.lit(True).alias("seen"))
    j = h.where("not fit").join(m, ["contract_id", "description"], "left")
    return j.groupBy("contract_id").agg(F.count("*").alias("n_lines"), F.round(F.count(F.when(F.col("unit_price_cents") == F.col("modal"), 1)) / F.count("*"), 6).alias("reproduced"), F.countDistinct(F.when(F.col("seen").isNull(), F.col("description"))).alias("unseen_descriptions"), F.count(F.when(F.col("seen").isNull(), 1)).alias("unseen_lines"))


@query(f"""WITH {{base}}, e AS ({SQL['rate_in_force']}), m AS ({SQL['modal_price']}), j AS (SELECT l.contract_id, l.unit_price_cents = e.rate_cents AS same, coalesce(m.unit_price_cents = e.rate_cents, false) AS at_modal FROM l JOIN e USING (line_id) LEFT JOIN m ON m.contract_id = l.contract_id AND m.description = l.description WHERE e.rate_cents IS NOT NULL)
SELECT contract_id, at_modal, count(*) AS n_lines, round(count(*) FILTER (same) / count(*), 6) AS reproduced FROM j GROUP BY ALL""")
def modal_split(spark: SparkSession, sf: str) -> DataFrame:
    """How far the rates in force reproduce prices, on lines whose rate is their description's usual price and on the others."""
    lines = _lines(spark, sf, "contract_id", "description", "unit_price_cents")
    m = reference.modal_price(spark, sf).select("contract_id", "description", F.col("unit_price_cents").alias("modal"))
    j = lines.join(reference.rate_in_force(spark, sf).where("rate_cents is not null").select("line_id", "rate_cents"), "line_id").join(m, ["contract_id", "description"], "left")
    return j.groupBy("contract_id", F.coalesce(F.col("modal") == F.col("rate_cents"), F.lit(False)).alias("at_modal")).agg(F.count("*").alias("n_lines"), F.round(F.count(F.when(F.col("unit_price_cents") == F.col("rate_cents"), 1)) / F.count("*"), 6).alias("reproduced"))


@query(f"""WITH t AS ({SQL['nearest_vectors']}), e AS (SELECT vec_id, label FROM embeddings), r AS (SELECT q.vec_id AS query_id, v.vec_id FROM e q JOIN e v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY ALL), h AS (SELECT query_id, count(*) AS h FROM t JOIN r USING (query_id, vec_id) GROUP BY ALL) SELECT count(*) AS n_queries, round(avg(coalesce(h, 0) / n), 6) AS recall FROM n LEFT JOIN h USING (query_id)""")
def recall_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Of the vectors with a query's label, the share among its ten nearest, averaged."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    top = reference.nearest_vectors(spark, sf)
    labels = e.groupBy("label").agg((F.count("*") - 1).alias("n")).where("n > 0")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    # Only the number of relevant vectors is needed, not their pairs with the queries.
    hits = top.join(q, "query_id").join(e.withColumnRenamed("label", "l2"), "vec_id").where("label = l2").groupBy("query_id").agg(F.count("*").alias("h"))
    j = q.join(labels, "label").join(hits, "query_id", "left")
    return j.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall"))


@query(f"""WITH u AS (SELECT vec_id, label, {reference._UNIT} AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.label, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 4) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, label, max(score) AS score FROM s GROUP BY ALL HAVING max(score) >= 0.35""")
def relevant_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """For each query the indexes (here: labels) whose best entry is near enough to be asked."""
    e = table(spark, sf, "embeddings")
    return similarity.relevant_indexes(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label")


# --- files -----------------------------------------------------------------------------------------------------------------

_FILES_SQL = """f AS (SELECT 'in/' || coalesce(contract_number, 'none') AS folder, 'in/' || coalesce(contract_number, 'none') || '/' || (doc_id // 3) || '.' || list_extract(['md', 'pdf', 'PNG', 'txt', 'docx'], CAST(doc_id % 5 AS INT) + 1) AS path FROM documents),
r AS (SELECT *, regexp_replace(path, '\\.[^./]*$', '') AS stem, CASE regexp_extract(lower(path), '\\.([^./]*)$', 1) WHEN 'md' THEN 'text' WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf_text' WHEN 'png' THEN 'ocr' ELSE 'failed' END AS route FROM f),
k AS (SELECT * FROM r a WHERE route = 'text' OR NOT EXISTS (SELECT 1 FROM r b WHERE b.route = 'text' AND b.stem = a.stem))"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """A file name for each document: three of them share a stem, with five endings."""
    folder = F.concat(F.lit("in/"), F.coalesce("contract_number", F.lit("none")))
    ending = F.get(F.array(*map(F.lit, ("md", "pdf", "PNG", "txt", "docx"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select(folder.alias("folder"), F.concat(folder, F.lit("/"), F.expr("doc_id div 3"), F.lit("."), ending).alias("path"))


@query(f"WITH {_FILES_SQL} SELECT folder, path, route FROM k")
def routed_files(spark: SparkSession, sf: str) -> DataFrame:
    """How each file is read; files of which a text exists are left out."""
    return files.preferred_files(_files(spark, sf)).select("folder", "path", "route")


@query(f"WITH {_FILES_SQL} SELECT folder, CAST(min(CASE route WHEN 'ocr' THEN 0.7 WHEN 'failed' THEN 0.5 ELSE 1 END) AS DOUBLE) AS trust FROM k GROUP BY ALL")
def folder_trust(spark: SparkSession, sf: str) -> DataFrame:
    """How far what was read from each folder is trusted: as far as its worst file."""
    return files.folder_trust(files.preferred_files(_files(spark, sf)), "folder")


@query("""SELECT model, prompt_version, CAST(qa_id AS VARCHAR) AS chunk, answer AS reply, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens FROM qa_results WHERE answer IS NOT NULL AND model IS NOT NULL AND prompt_version IS NOT NULL""")
def recorded_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies written as recordings, one per model, prompt and lot of chunks, and read again."""
    q = table(spark, sf, "qa_results").where("answer is not null and model is not null and prompt_version is not null")
    usage = F.struct(F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), F.col("seconds_taken").alias("seconds"))
    # Recordings are kept small: a lot holds at most some hundred chunks, however many a model has.
    lots = q.withColumn("lot", F.expr("qa_id div 128"))
    recorded = files.record(lots, ["model", "prompt_version", "lot"], F.col("qa_id").cast("string"), F.col("answer"), usage)
    r = files.recordings(written(recorded, "recordings"), "recording", ["model", "prompt_version"])
    return r.select("model", "prompt_version", "chunk", "reply", "usage.input_tokens", "usage.output_tokens")


@query("SELECT prompt_version || '__' || model AS run, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) FILTER (passed) AS n_passed FROM qa_results WHERE model IS NOT NULL AND prompt_version IS NOT NULL GROUP BY ALL")
def tagged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as CSV files, one folder per run, and read again by a glob with the run's name beside them."""
    import uuid

    folder = f"{shared_folder(spark)}/ledgerloom-runs-{uuid.uuid4().hex}"
    q = table(spark, sf, "qa_results").where("model is not null and prompt_version is not null")
    kept = q.select("qa_id", "question", "answer", "output_tokens", "passed", F.concat_ws("__", "prompt_version", "model").alias("run"))
    files.write_tagged_csv(kept, folder, "run")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema.fields if f.name != "run"])
    return files.tagged_csv(spark, folder, schema, "run").groupBy("run").agg(F.count("*").alias("n"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"))


@query(f"SELECT line_id, CAST({reference._DAY.format('service_date')} AS VARCHAR) AS service_day, service_date AS service_date_raw, quantity, line_total_cents FROM line_items")
def lines_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written as CSV text and read again with types, the dates beside their text."""
    import uuid

    folder = f"{shared_folder(spark)}/ledgerloom-csv-{uuid.uuid4().hex}"
    table(spark, sf, "line_items").select("line_id", F.col("service_date"), "quantity", "line_total_cents").write.options(header="true", escape='"', nullValue="\\N").csv(folder)
    schema = T.StructType([T.StructField("line_id", T.StringType()), T.StructField("service_date", T.DateType()), T.StructField("quantity", T.LongType()), T.StructField("line_total_cents", T.LongType())])
    r = read_csv_typed(spark, folder, schema, nullValue="\\N")
    strict = F.when(F.col("service_date_raw").rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.col("service_date"))
    return r.select("line_id", strict.cast("string").alias("service_day"), "service_date_raw", "quantity", "line_total_cents")


# --- small things ----------------------------------------------------------------------------------------------------------


@query("WITH {base} SELECT contract_id, dayname(day) AS weekday, count(*) AS n FROM l WHERE isodow(day) >= 6 GROUP BY ALL")
def weekend_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on Saturdays and Sundays."""
    lines = _lines(spark, sf, "contract_id", "service_date").where(F.weekday("day") >= 5)
    return lines.groupBy("contract_id", F.when(F.weekday("day") == 5, "Saturday").otherwise("Sunday").alias("weekday")).agg(F.count("*").alias("n"))


@query("SELECT word, CASE WHEN lower(word) IN (SELECT contract_id FROM dim_contract) THEN lower(word) WHEN regexp_full_match(lower(word), 'h[0-9]+') AND 'hospital_' || substr(lower(word), 2) IN (SELECT contract_id FROM dim_contract) THEN 'hospital_' || substr(lower(word), 2) END AS contract_id FROM (SELECT DISTINCT w AS word FROM dim_contract, unnest([contract_id, replace(contract_id, 'hospital_', 'H'), replace(contract_id, 'hospital_', 'h9'), contract_number]) t(w))")
def named_providers(spark: SparkSession, sf: str) -> DataFrame:
    """The provider that a word names, in full or as h and its number; none for other words."""
    c = table(spark, sf, "dim_contract")
    words = c.select(F.explode(F.array("contract_id", F.regexp_replace("contract_id", "hospital_", "H"), F.regexp_replace("contract_id", "hospital_", "h9"), "contract_number")).alias("word")).distinct()
    full = F.when(F.lower("word").rlike(r"\Ah[0-9]+\z"), F.concat(F.lit("hospital_"), F.substring(F.lower("word"), 2, 100))).otherwise(F.lower("word"))
    known = c.select(F.col("contract_id").alias("__c"), F.col("contract_id"))
    return words.join(known, full == F.col("__c"), "left").select("word", "contract_id")


@query("SELECT resolution_id, row_number() OVER (ORDER BY match_method NULLS LAST, description NULLS LAST, resolution_id) AS place FROM resolution")
def resolution_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier run's rows in the order of method and description."""
    r = table(spark, sf, "resolution").select("resolution_id", "match_method", "description")
    # In two levels by method and the description's first letters, so that no method is one task.
    r = r.withColumns({"__all": F.lit(0), "lead": F.struct(F.col("match_method").isNull().alias("a"), F.col("match_method").alias("b"), F.col("description").isNull().alias("c"), F.substring("description", 1, 4).alias("d"))})
    return ordered.place(r, ["__all"], "lead", [F.col("description").asc_nulls_last(), F.col("resolution_id")], "place").select("resolution_id", "place")


_WORDS = "[" + ", ".join(f"'{w}'" for w in loose.NUMBER_WORDS) + "]"


@query(f"""SELECT contract_id, service, CASE WHEN daily_cap BETWEEN 0 AND 20 THEN daily_cap || '|' || list_extract({_WORDS}, CAST(daily_cap AS INT) + 1) ELSE CAST(daily_cap AS VARCHAR) END AS numbers, p || '%|' || p || ' %|' || p || ' percent|' || p || ' per cent' AS percents
FROM (SELECT *, CASE WHEN daily_cap % 2 = 0 THEN CAST(daily_cap // 2 AS VARCHAR) ELSE CAST(daily_cap // 2 AS VARCHAR) || '.5' END AS p FROM dim_service WHERE daily_cap IS NOT NULL)""")
def written_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Caps in digits and words, and half of each as a percentage in every form."""
    d = table(spark, sf, "dim_service").where("daily_cap is not null")
    return d.select("contract_id", "service", F.array_join(loose.number_forms(F.col("daily_cap")), "|").alias("numbers"), F.array_join(loose.percent_forms(F.col("daily_cap").cast("decimal(18,4)") / 200), "|").alias("percents"))


@query(r"""SELECT qa_id, regexp_matches(lower(answer), '(gbp|£)\s?\d|\d[\d,]*\.\d{2}\b|\b\d{3,}\s?cents') AS states_money, contains(lower(answer), 'cannot') OR contains(lower(answer), 'can''t') OR contains(lower(answer), 'not permitted') AS has_cue FROM qa_results WHERE answer IS NOT NULL""")
def answer_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether answers state an amount, and whether they have a cue of a refusal."""
    a = table(spark, sf, "qa_results").where("answer is not null")
    return a.select("qa_id", loose.has_money(F.col("answer")).alias("states_money"), loose.contains_any(F.col("answer"), F.array(*map(F.lit, ("cannot", "can't", "not permitted")))).alias("has_cue"))


@query("""SELECT qa_id, CASE WHEN d = '0' THEN CAST(n AS DOUBLE) / 100 WHEN d = '1' THEN CAST(n AS DOUBLE) / 100 WHEN d = '2' THEN CAST(n AS DOUBLE) / 1000 WHEN d IN ('3', '4') THEN NULL ELSE CAST(n AS DOUBLE) / 100 END AS fraction,
 CASE WHEN d = '3' THEN NULL WHEN d = '2' THEN 0 ELSE CAST(n AS BIGINT) END AS first_number, CASE WHEN d < '8' THEN CAST(DATE '2024-01-01' + CAST(n AS INT) AS VARCHAR) END AS day FROM (SELECT qa_id, 2 + qa_id % 90 AS n, substr(md5(CAST(qa_id AS VARCHAR)), 1, 1) AS d FROM qa_results)""")
def loose_values(spark: SparkSession, sf: str) -> DataFrame:
    """Shares, whole numbers and days in many spellings, read again."""
    n, d = F.lit(2) + F.col("qa_id") % 90, F.substring(F.md5(F.col("qa_id").cast("string")), 1, 1)
    thousandth = F.concat(F.lit("0."), F.lpad(n.cast("string"), 3, "0"))
    share = F.when(d == "0", F.concat(n.cast("string"), F.lit("%"))).when(d == "1", F.concat(F.lit(" "), n.cast("string"), F.lit(" % "))).when(d == "2", thousandth).when(d == "3", "about a tenth").when(d == "4", F.concat(n.cast("string"), F.lit(" in all"))).otherwise(n.cast("string"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    text = F.when(d < "4", F.concat(day, F.lit("T10:00:00Z"))).when(d < "8", day).when(d < "c", F.concat(F.lit("on "), day)).otherwise("2024-02-31")
    from ledgerloom.functions.markup import first_integer

    q = table(spark, sf, "qa_results").select("qa_id", share.alias("share"), text.alias("text"))
    return q.select("qa_id", loose.lenient_fraction(F.col("share")).cast("double").alias("fraction"), first_integer(F.col("share")).alias("first_number"), loose.lenient_day(F.col("text")).cast("string").alias("day"))


@query("WITH {base} SELECT contract_id, invoice_id, source_seq, line_id FROM l JOIN (SELECT contract_id, eff_from + 90 AS a, eff_to - 90 AS b FROM dim_contract) USING (contract_id) WHERE day < a OR day > b")
def out_of_shorter_term(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that a term shorter by ninety days at both ends would not hold."""
    from ledgerloom.operators import checks

    lines = _lines(spark, sf, "contract_id", "invoice_id", "source_seq", "service_date")
    c = table(spark, sf, "dim_contract").select("contract_id", F.date_add("eff_from", 90).alias("eff_from"), F.date_sub("eff_to", 90).alias("eff_to"))
    return checks.out_of_term(lines, c).select("contract_id", "invoice_id", "source_seq", F.col("detail").alias("line_id"))
