"""Joins beyond plain equality: ordinal pairing, intervals with priority, neighbours in time, full differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import numbered


def ordinal_pairs(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """left joined with right on (key, place within the key); left rows without a partner stay, with nulls.

    Columns of right other than the key must have other names than those of left.
    """
    a, b = numbered(left, [key], left_order, "rank"), numbered(right, [key], right_order, "rank")
    return a.join(b, [key, "rank"], "left")


def interval_lookup(events: DataFrame, periods: DataFrame, on: list[str], day: str, valid_from: str, valid_to: str, order: str, values: list[str]) -> DataFrame:
    """events with `values` of the first covering period in list order, else of the first unbounded one, else null.

    A period without both bounds covers any day, but comes after dated ones; an event without a day matches only such.
    The periods of a key are folded into one array first, so an event meets its key once, and hot keys only split.
    """
    p = periods.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(valid_from).alias("a"), F.col(valid_to).alias("b"), *[F.col(v).alias(f"v_{v}") for v in values]))).alias("__periods"))
    e = events.join(p, on, "left")
    dated = F.filter("__periods", lambda x: (x["a"].isNotNull() | x["b"].isNotNull()) & (x["a"].isNull() | (x["a"] <= F.col(day))) & (x["b"].isNull() | (x["b"] >= F.col(day))))
    open_ = F.filter("__periods", lambda x: x["a"].isNull() & x["b"].isNull())
    best = F.coalesce(F.get(dated, F.lit(0)), F.get(open_, F.lit(0)))
    return e.withColumn("__p", best).select(*events.columns, *[F.col("__p")[f"v_{v}"].alias(v) for v in values])


def with_partner(df: DataFrame, group: list[str], item: str, partners: DataFrame, out: str) -> DataFrame:
    """df with a flag: whether the item's partner (partners: item, partner) occurs in the same group.

    Different (group, item) pairs are reduced before the join; null group keys have no partners.
    """
    there = df.select(*group, F.col(item).alias("partner")).dropna().distinct().withColumn("__there", F.lit(True))
    d = df.join(partners, [item], "left") if item in partners.columns else df
    return d.join(there, [*group, "partner"], "left").withColumn(out, F.coalesce("__there", F.lit(False))).drop("__there", "partner")


def with_neighbour(df: DataFrame, other: DataFrame, on: list[str], day: str, days: int, out: str) -> DataFrame:
    """df with a flag: whether `other` has a row of the same key within `days` days, both ends included.

    Days are cut into bins of the window's width: an event looks into its own bin and both next to it by equality, each
    bin of `other` reduced to its first and last day. So the join is an equi-join of bounded fan-out (3), not a product.
    """
    width = max(1, days)
    bin_ = lambda c: F.floor(F.unix_date(c) / width)
    o = other.select(*on, F.col(day).alias("__d")).dropna().groupBy(*on, bin_(F.col("__d")).alias("__bin")).agg(F.array_sort(F.collect_set("__d")).alias("__days"))
    here = df.select(*on, day).dropna().distinct()
    near = here.withColumn("__bin", F.explode(F.array(*[bin_(F.col(day)) + k for k in (-1, 0, 1)]))).join(o, [*on, "__bin"])
    hit = near.where(F.exists("__days", lambda d: F.abs(F.datediff(d, F.col(day))) <= days)).select(*on, day).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, [*on, day], "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def full_difference(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, state, changed): every key of either side as only_old, only_new, changed or same, with the changed fields.

    Null equals null in keys and fields. Keys should be unique on each side; repeated ones are compared with each other.
    """
    a = old.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("__a"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("__b"))
    j = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]), "full_outer")
    changed = F.concat_ws("|", *[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])
    state = F.when(F.col("__b").isNull(), "only_old").when(F.col("__a").isNull(), "only_new").when(changed != "", "changed").otherwise("same")
    return j.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], state.alias("state"), F.when(state == "changed", changed).otherwise("").alias("changed"))


def product_of_options(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Each row once per combination of the elements of its own arrays (null or empty arrays give none)."""
    for a in arrays:
        df = df.withColumn(a, F.explode(a))
    return df


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, agree, share) over the keys that both sides have; null agrees with null."""
    j = a.select(key, F.col(value).alias("__x")).join(b.select(key, F.col(value).alias("__y")), key)
    same = F.col("__x").eqNullSafe(F.col("__y"))
    return j.agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("agree")).withColumn("share", F.when(F.col("n") > 0, F.round(F.col("agree") / F.col("n"), 6)))


def any_of(df: DataFrame, keys: list[str], flag: Column, out: str) -> DataFrame:
    """df with whether any row of its group has the flag."""
    return df.withColumn(out, F.max(F.coalesce(flag, F.lit(False))).over(Window.partitionBy(*keys)))
