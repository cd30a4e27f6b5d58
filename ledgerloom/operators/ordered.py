"""Ordered and windowed operators: the running states of a sequential pass as exact windows.

All take the keys and the order explicitly; the caller adds columns that break ties, so results don't depend on how the
rows lie. Null keys form a group of their own, as in SQL. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of columns of both sides, null with null."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def prior_total(df: DataFrame, keys: list[str], lead: str, rest: list[Column], value: Column, out: str) -> DataFrame:
    """df with the sum of `value` over the rows of the group that come before each row, in the order lead, rest.

    lead null sorts last; null values count as 0; the first row has 0. Two levels: totals per (keys, lead) are summed
    over the leads before, and added to a running sum among the rows of one lead, so that a group which holds a third of
    all rows is spread over as many tasks as it has leads.
    """
    v = F.coalesce(value, F.lit(0))
    totals = df.groupBy(*keys, lead).agg(F.sum(v).alias("__t"))
    w = Window.partitionBy(*keys).orderBy(F.col(lead).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__{c}") for c in [*keys, lead]], F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*keys, lead).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("__here", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, lead]])
    return d.join(totals, on).select(*[F.col(c) for c in df.columns], (F.col("__before") + F.col("__here")).alias(out))


def place(df: DataFrame, keys: list[str], lead: str, rest: list[Column], out: str) -> DataFrame:
    """df with the place (from 1) of each row in its group in the order lead (nulls last), rest; in two levels as prior_total."""
    return prior_total(df, keys, lead, rest, F.lit(1), out).withColumn(out, F.col(out) + 1)


def group_total(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of `value` over each row's whole group; null where a key is null."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]), total))


def allowance(df: DataFrame, keys: list[str], order: list[Column], quantity: Column, cap: Column, out: str) -> DataFrame:
    """df with the part of each quantity that a cap per group still allows, taken greedily in order.

    Equal to the loop used += min(q, max(0, cap - used)), zero and negative quantities included: what the loop has used
    after a row is the running sum less the most by which it ever exceeded the cap. A null cap allows everything.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__cum", F.sum(quantity).over(w))
    d = d.withColumn("__used", F.col("__cum") - F.greatest(F.lit(0), F.max(F.col("__cum") - cap).over(w)))
    return d.withColumn(out, F.when(cap.isNull(), quantity).otherwise(F.col("__used") - F.coalesce(F.lag("__used").over(before), F.lit(0)))).drop("__cum", "__used")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with the place (from 1) of each row in its group, for groups that stay small; else see place."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def mode_of(df: DataFrame, keys: list[str], values: list[str], order: list[Column]) -> DataFrame:
    """(keys, values, n, share): the most frequent values of each group; on a tie those met first in `order`.

    Counted and reduced per (keys, values) first, so a hot group reaches the choice as its different values.
    """
    first = F.min(F.struct(*order)).alias("first")
    counts = df.groupBy(*keys, *values).agg(F.count("*").alias("n"), first)
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("all", total).withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*keys, *values, "n", (F.col("n") / F.col("all")).alias("share"))


def best_two(df: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """(keys, best, best_score, second, margin): the first two of each group by score, names break ties; a group of one has no second and its score as margin.

    Two stages: the best two of each group and salt (its names by hash), then of these few rows, so that no group is one task.
    """
    order = [F.desc(score), F.asc(name)]
    d = df.select(*keys, name, score).withColumn("__salt", F.pmod(F.xxhash64(name), F.lit(64)))
    for by in ([*keys, "__salt"], keys):
        w = Window.partitionBy(*by).orderBy(*order)
        d = d.withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    rows = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", F.col(name).alias("name"), F.col(score).alias("score")))).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return rows.select(*keys, first["name"].alias("best"), first["score"].alias("best_score"), second["name"].alias("second"), (first["score"] - F.coalesce(second["score"], F.lit(0))).alias("margin"))


def tier_of(value: Column, tiers: list[tuple[int, int]]) -> Column:
    """The label of the highest tier (threshold, label) whose threshold lies strictly below the value, else null."""
    out = F.lit(None).cast("long")
    for threshold, label in sorted(tiers):
        out = F.when(value > threshold, F.lit(label).cast("long")).otherwise(out)
    return out


def last_known(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, values): per group the last non-null value of every column by itself, in the order of `order`."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in values])


def earliest(df: DataFrame, keys: list[str], loaded: str) -> DataFrame:
    """One row per key: the one loaded first, ties by all other columns; map-side reduced, nothing is gathered."""
    rest = [c for c in df.columns if c not in keys and c != loaded]
    m = df.groupBy(*keys).agg(F.min(F.struct(F.col(loaded), *rest)).alias("__m"))
    return m.select(*[F.col(c) if c in keys else F.col(f"__m.{c}").alias(c) for c in df.columns])
