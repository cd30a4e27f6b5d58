"""Scores and summaries: precision and recall, quantiles, pivots, ties, agreement of two groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join
from ledgerloom.operators.ordered import prior_total


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(df: DataFrame, by: list[str], predicted: Column, truth: Column) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1), scores rounded to three places; null flags count as false."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    g = df.groupBy(*by).agg(F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p & ~t, 1)).alias("fp"), F.count(F.when(~p & t, 1)).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"))
    return g.select(*by, "tp", "fp", "fn", F.round(pr, 3).alias("precision"), F.round(rc, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def set_scores(predicted: DataFrame, truth: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Precision and recall of a set of rows against another, per `by` (some of the columns); repeats count once."""
    a = predicted.select(*columns).distinct().withColumn("__p", F.lit(True))
    b = truth.select(*columns).distinct().withColumn("__t", F.lit(True))
    return precision_recall(a.join(b, columns, "full_outer"), by, F.col("__p"), F.col("__t"))


def spread(df: DataFrame, by: list[str], value: str, shares: dict[str, float] = {"median": 0.5, "p95": 0.95}) -> DataFrame:
    """(by, n, mean, one column per share): exact quantiles with linear interpolation; nulls are left out.

    Rows are counted per different value first, and places are running counts over (group, value), in two levels (whole
    parts of the value's range, then inside one), so no group is one task or one state. Groups without values have n 0.
    """
    groups = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(F.col(value).cast("double")).alias("__lo"), F.max(F.col(value).cast("double")).alias("__hi"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    g = groups.select(*[F.col(c).alias(f"__{c}") for c in by], "n", "__lo", "__hi")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    counts = counts.join(broadcast_if_bounded(g), on).withColumn("__part", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 256), F.lit(0)))
    before = prior_total(counts.select(*by, "v", "c", "n", "__part"), by, "__part", [F.col("v")], F.col("c"), "before") if by else prior_total(counts.select("v", "c", "n", "__part").withColumn("__all", F.lit(0)), ["__all"], "__part", [F.col("v")], F.col("c"), "before")
    low, high = {}, {}
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("c"))
        low[name] = F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"__low_{name}")
        high[name] = F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"__high_{name}")
    picked = before.groupBy(*by).agg(*low.values(), *high.values())
    picked = picked.select(*[F.col(c).alias(f"__{c}") for c in by], *[f"__low_{x}" for x in shares], *[f"__high_{x}" for x in shares])
    out = groups.join(broadcast_if_bounded(picked), on, "left")
    between = {x: F.col(f"__low_{x}") + (F.col(f"__high_{x}") - F.col(f"__low_{x}")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))) for x, q in shares.items()}
    return out.select(*by, "n", "mean", *[F.round(c, 6).alias(x) for x, c in between.items()])


def pivoted(df: DataFrame, by: str, across: str, names: list[str], value: Column) -> DataFrame:
    """One row per `by` with a column per name of `across`; combinations that don't occur have 0."""
    return df.groupBy(by).pivot(across, names).agg(value).fillna(0, names)


def extremes(df: DataFrame, keys: list[str], value: str, largest: bool = True) -> DataFrame:
    """All rows of each group that hold its largest (smallest) value, ties included; null values and null keys hold none."""
    best = df.groupBy(*keys).agg((F.max if largest else F.min)(value).alias(value)).where(F.col(value).isNotNull())
    return lookup_join(df, best, [*keys, value], "left_semi")


def grouping_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(homogeneity, completeness, adjusted_rand) of two groupings from their contingency table.

    Only the counts per (a, b) are gathered; an empty table, and one with a single group on both sides, score 1.
    """
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    stats = lambda d, s: d.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(f"p_{s}"), F.coalesce(F.sum(F.col("n") * F.log("n")), F.lit(0.0)).alias(f"l_{s}"), F.coalesce(F.sum("n"), F.lit(0.0)).alias(f"n_{s}"))
    one = stats(cells, "ab").join(F.broadcast(stats(rows, "a"))).join(F.broadcast(stats(cols, "b")))
    n = F.col("n_ab")
    h_a, h_b, h_ab = (F.log(n) - F.col(f"l_{s}") / n for s in ("a", "b", "ab"))
    part = lambda own, other: F.when((n == 0) | (own < 1e-12), 1.0).otherwise(F.lit(1.0) - (h_ab - other) / own)
    expected = F.try_divide(F.col("p_a") * F.col("p_b"), pairs(n))
    top = (F.col("p_a") + F.col("p_b")) / 2
    rand = F.when((n < 2) | (F.abs(top - expected) < 1e-12), 1.0).otherwise((F.col("p_ab") - expected) / (top - expected))
    return one.select(F.round(part(h_a, h_b), 6).alias("homogeneity"), F.round(part(h_b, h_a), 6).alias("completeness"), F.round(rand, 6).alias("adjusted_rand"))


def rule_defects(gold: DataFrame, predicted: DataFrame, keys: list[str], family: str, item: str, value: str, whole: str = "service") -> DataFrame:
    """(keys, family, item, kind, wanted, got): how a list of rules differs from the true one, item by item.

    MISSED: only the true list has the item; INVENTED: only the other has it (HALLUCINATED in the family `whole`); WRONG:
    both have it with different values. Items are unique per family; null equals null.
    """
    on = [*keys, family, item]
    a = gold.select(*on, F.col(value).alias("wanted")).withColumn("__g", F.lit(True))
    b = predicted.select(*on, F.col(value).alias("got")).withColumn("__p", F.lit(True))
    j = a.join(b, on, "full_outer")
    kind = F.when(F.col("__p").isNull(), "MISSED").when(F.col("__g").isNull(), F.when(F.col(family) == whole, "HALLUCINATED").otherwise("INVENTED")).when(~F.col("wanted").eqNullSafe(F.col("got")), "WRONG")
    return j.select(*on, kind.alias("kind"), "wanted", "got").where("kind is not null")


def family_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], family: str, item: str, value: str) -> DataFrame:
    """(keys, family, support, tp, fp, fn, precision, recall, f1, invented_rate) over (item, value) pairs per family.

    invented_rate: pairs that the true list lacks in relation to its pairs (to 1, if it has none).
    """
    r = set_scores(predicted, gold, [*keys, family, item, value], [*keys, family])
    return r.select(*keys, family, (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", "precision", "recall", "f1", F.round(F.col("fp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 4).alias("invented_rate"))


def edge_items(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, dearest, dearest_value, cheapest, cheapest_value): the last and the first of each group in the order value, name."""
    d = df.where(F.col(value).isNotNull())
    order = F.struct(F.col(value), F.col(name))
    g = d.groupBy(*keys).agg(F.max(order).alias("a"), F.min(order).alias("b"))
    return g.select(*keys, F.col(f"a.{name}").alias("dearest"), F.col(f"a.{value}").alias("dearest_value"), F.col(f"b.{name}").alias("cheapest"), F.col(f"b.{value}").alias("cheapest_value"))


def recall_at(retrieved: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """(n_queries, recall): the share of each query's relevant items among those retrieved, averaged over queries that have any."""
    n = relevant.groupBy(query).agg(F.count("*").alias("n"))
    hits = retrieved.select(query, item).distinct().join(relevant.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.count("*").alias("h"))
    j = n.join(hits, query, "left")
    return j.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall"))
