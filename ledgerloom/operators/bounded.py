"""Broadcasts only behind a check of the size, and joins that spread hot keys beyond it."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes (of all values written as text) up to which a side may be broadcast.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 64 * 1024 * 1024


def is_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; looks no further than one row more."""
    size = reduce(add, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in df.columns])
    r = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return r.n <= max_rows and (r.b or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, else df as it is, so that the join shuffles (and AQE splits hot keys)."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


#: Partitions over which a hot key is spread.
SALTS = 16
#: A key is hot if it has at least this share of the rows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """The keys that have at least this share of the rows (at most 1 / share of them), counted over all rows; null keys aren't."""
    keys = df.select(*on).dropna()
    least = max(2.0, share * keys.count())
    return [tuple(r[c] for c in on) for r in keys.groupBy(*on).count().where(F.col("count") >= least).limit(int(1 / share) + 1).collect()]


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_of: list[str] | None = None, also: Column | None = None, salts: int = SALTS) -> DataFrame:
    """big joined with small on equal columns; hot keys of big are spread over `salts` partitions and their rows of small repeated as often.

    how: inner, left, left_semi or left_anti. salt_of: columns of big that differ within a key (all, if not given).
    `also` is a further condition. Null keys match nothing. Nothing is dropped or repeated in the result. Counting the
    keys reads `big` once more; rows of small whose keys aren't hot are not repeated.
    """
    hot = hot_keys(big, on)
    kinds = [big.schema[c].dataType for c in on]
    listed = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, c, t in zip(k, on, kinds)]) for k in hot])
    is_hot = lambda d: F.coalesce(F.array_contains(listed, F.struct(*[d[c].cast(t).alias(c) for c, t in zip(on, kinds)])), F.lit(False)) if hot else F.lit(False)
    none = F.lit(0).cast("long")
    copies = small.withColumn("__salt", F.explode(F.when(is_hot(small), F.sequence(none, F.lit(salts - 1).cast("long"))).otherwise(F.array(none)))) if hot else small.withColumn("__salt", none)
    left = big.withColumn("__salt", F.when(is_hot(big), F.pmod(F.xxhash64(*(salt_of or big.columns)), F.lit(salts))).otherwise(none) if hot else none)
    if also is None:
        return left.join(copies, [*on, "__salt"], how).drop("__salt")
    renamed = copies.select(*[F.col(c).alias(f"__r_{c}") if c in [*on, "__salt"] else F.col(c) for c in copies.columns])
    condition = also
    for c in [*on, "__salt"]:
        condition = condition & (F.col(c) == F.col(f"__r_{c}"))
    return left.join(renamed, condition, how).drop("__salt", *[f"__r_{c}" for c in [*on, "__salt"]])


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_of: list[str] | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """big joined with small on equal columns: small is broadcast if it is bounded, else the join is salted.

    Checking the bound runs what makes `small`; write it first where that is dear.
    """
    if is_bounded(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt_of)
