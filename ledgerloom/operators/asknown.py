"""Attributes as known at event time: periodic as-known snapshots plus change logs.

A version of an attribute row is valid from..to and known from a day on. For each period of the grid there is, per
entity, a snapshot (the versions known by the period's first day) and a change log (the versions that became known
later in the period). An event joins both of its own period by equality and replays only the changes known by its day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.bounded import lookup_join


def _last_period(versions: DataFrame, known_from: str, period: str) -> date:
    """The first day of the last period of the grid (of any period if nothing is known)."""
    return versions.agg(F.date_trunc(period, F.max(known_from)).cast("date").alias("d")).first().d or date(1970, 1, 1)


def as_known_snapshots(versions: DataFrame, keys: list[str], valid_from: str, valid_to: str, known_from: str, order: str, values: list[str], period: str = "month") -> DataFrame:
    """(keys, __period, __snapshot, __changes): arrays of versions, most preferred last known first.

    Versions that aren't valid on any day of the period are left out, so an entity's arrays hold the few that can win.
    Versions with a null key or a null known_from can never be known and are left out. valid_from and valid_to null: open.
    The grid runs from the first to the last known_from; its last period stays open.
    """
    v = versions.select(*[F.col(k).alias(k) for k in keys], F.struct(F.col(known_from).cast("date").alias("known"), F.col(order).alias("ord"), F.col(valid_from).cast("date").alias("a"), F.col(valid_to).cast("date").alias("b"), *[F.col(x).alias(f"v_{x}") for x in values]).alias("v"))
    v = v.where(" and ".join(["v.known is not null", *[f"`{k}` is not null" for k in keys]]))
    last = _last_period(versions, known_from, period)
    step = F.expr(f"interval 1 {period}")
    # The periods of a version are those from the one it became known in to the end of the grid.
    v = v.withColumn("__period", F.explode(F.sequence(F.date_trunc(period, "v.known").cast("date"), F.lit(last), step)))
    until = F.when(F.col("__period") < F.lit(last), (F.col("__period") + step).cast("date"))
    v = v.where((F.col("v.b").isNull() | (F.col("v.b") >= F.col("__period"))) & (F.col("v.a").isNull() | until.isNull() | (F.col("v.a") < until)))
    known = F.col("v.known") <= F.col("__period")
    return v.groupBy(*keys, "__period").agg(F.collect_list(F.when(known, F.col("v"))).alias("__snapshot"), F.collect_list(F.when(~known, F.col("v"))).alias("__changes"))


def as_known_join(events: DataFrame, versions: DataFrame, on: dict[str, str], day: Column, keep: list[str], valid_from: str, valid_to: str, known_from: str, order: str, values: list[str], period: str = "month") -> DataFrame:
    """`keep` columns of each event with the values of the version valid on `day` and known by then.

    on: event column -> version column, compared by equality. Of the versions that qualify the latest known_from wins,
    on a tie the highest `order`. Events without a day, with a null key or without such a version give no row; repeated
    events give a row each. An empty table on either side gives no rows. Versions known later are never seen.
    """
    keys = list(on.values())
    snaps = as_known_snapshots(versions, keys, valid_from, valid_to, known_from, order, values, period)
    renamed = snaps.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__period", "__snapshot", "__changes")
    e = events.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], day.alias("__day")).where("__day is not null")
    e = e.withColumn("__period", F.least(F.date_trunc(period, "__day").cast("date"), F.lit(_last_period(versions, known_from, period))))
    joined = lookup_join(e, renamed, [f"__k{i}" for i in range(len(keys))] + ["__period"])
    valid = lambda x: (x["a"].isNull() | (x["a"] <= F.col("__day"))) & (x["b"].isNull() | (x["b"] >= F.col("__day")))
    replayed = F.filter(F.concat("__snapshot", F.filter("__changes", lambda x: x["known"] <= F.col("__day"))), valid)
    best = joined.withColumn("__best", F.array_max(replayed)).where("__best is not null")
    return best.select(*[F.col(f"__e{i}").alias(c) for i, c in enumerate(keep)], *[F.col("__best")[f"v_{x}"].alias(x) for x in values])
