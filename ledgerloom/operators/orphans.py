"""References to records that do not exist, judged as of the time each referring record was loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join, salted_join
from ledgerloom.session import written


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _first() -> Column:
    """A time before all others, for null load times of parents."""
    return _at("0001-01-01 00:00:00")


def _last() -> Column:
    """A time after all others, for null load times of children and null deletions."""
    return _at("9999-12-31 00:00:00")


def existence(parents: DataFrame, key: Column, loaded: str, deleted: str) -> DataFrame:
    """(key, start, end): the disjoint stretches of time [start, end) in which some row of the key is there.

    Rows with a null key are left out; a null load time means there from the first, a null deletion never deleted. Rows
    deleted before they were loaded keep an empty stretch [start, start), so that the key itself is still known.
    Rows are merged in three steps (by deletion time while combining, by a salt of it, by key), so a key with very many
    rows reaches the last step as its disjoint stretches only.
    """
    p = parents.select(key.alias("key"), F.coalesce(F.col(loaded).cast("timestamp_ntz"), _first()).alias("start"), F.coalesce(F.col(deleted).cast("timestamp_ntz"), _last()).alias("end")).where("key is not null")
    p = p.withColumn("end", F.greatest("start", "end")).groupBy("key", "end").agg(F.min("start").alias("start"))
    for by in (["key", "salt"], ["key"]):
        if "salt" in by:
            p = p.withColumn("salt", F.pmod(F.xxhash64("end"), F.lit(16)))
        w = Window.partitionBy(*by).orderBy("start", "end")
        p = p.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        p = p.withColumn("n", F.sum(F.when(F.col("before").isNull() | (F.col("before") < F.col("start")), 1).otherwise(0)).over(w))
        p = p.groupBy(*by, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return p.select("key", "start", "end")


def orphan_references(children: DataFrame, parents: DataFrame, record: Column, ref: Column, parent_key: Column, child_loaded: str = "loaded_at", parent_loaded: str = "loaded_at", parent_deleted: str = "deleted_at") -> DataFrame:
    """(src_key, ref_key, orphan_kind, loaded): the records whose reference doesn't hold at their earliest load time t.

    A record is a (record, ref) pair; repeats count once, by the earliest t (null: after all others). Null refs refer to
    nothing. The reference holds if some parent row has loaded <= t < deleted; else it is `missing` (no row has the
    key), `late` (all rows come after t) or `deleted`. Distinct keys with their first and last t are anti-joined with the
    parents' keys first; only keys that are missing or not there all the time between go back to the records.
    An empty parent table makes every reference missing; an empty child table gives no rows.
    """
    c = children.select(record.cast("string").alias("src_key"), ref.alias("ref_key"), F.coalesce(F.col(child_loaded).cast("timestamp_ntz"), _last()).alias("t")).where("ref_key is not null")
    # The last t of all rows is that of a repeat at times; then a key is doubted that needn't be, and judged exactly below.
    keys = c.groupBy("ref_key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    # Read twice below: by all keys and by the doubtful ones.
    there = written(existence(parents, parent_key, parent_loaded, parent_deleted), "there")
    spans = there.groupBy("key").agg(F.min("start").alias("first"), F.count("*").alias("n"), F.max("end").alias("last"))
    doubtful = keys.join(spans, F.col("ref_key") == F.col("key"), "left").where(F.col("key").isNull() | ~((F.col("n") == 1) & (F.col("first") <= F.col("t0")) & (F.col("t1") < F.col("last"))))
    doubtful = written(doubtful.select("ref_key", F.col("key").isNotNull().alias("known"), "first"), "doubtful")
    back = lookup_join(c, doubtful, ["ref_key"], salt_of=["src_key"]).groupBy("src_key", "ref_key", "known", "first").agg(F.min("t").alias("t"))
    back = written(back, "back")  # the few records in doubt, read several times below
    missing = back.where("not known").select("src_key", "ref_key", "t", F.lit("missing").alias("orphan_kind"))
    kept = back.where("known")
    spans = there.withColumnRenamed("key", "ref_key").join(broadcast_if_bounded(doubtful.where("known").select("ref_key")), "ref_key", "left_semi")
    dead = salted_join(kept, spans, ["ref_key"], "left_anti", ["src_key"], (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
    dead = dead.select("src_key", "ref_key", "t", F.when(F.col("first") > F.col("t"), "late").otherwise("deleted").alias("orphan_kind"))
    return missing.unionByName(dead).select("src_key", "ref_key", "orphan_kind", F.when(F.col("t") < _last(), F.col("t")).alias("loaded"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphans per table, kind and month of (src_table, orphan_kind, load_month, ...)."""
    return orphans.groupBy("src_table", "orphan_kind", "load_month").agg(F.count("*").alias("n_references"))
