"""Mixing sources to target weights by capped water-filling.

The tokens wanted of each source are its share of the mixture; a source that would be repeated more often than it may
is clamped at its cap and what it lacks goes to the others in proportion to their shares, until nothing exceeds a cap.
Each document of a source then comes a whole number of times, and once more if its seeded hash is among those that make
up the fraction. Sums per (source, hash bucket) find where the fraction ends; of the documents around that end those are
taken whose sizes together come nearest to what is wanted, as subset sums. No source, however large, is sorted or
gathered in one task, and documents that are the same in id and size are one row with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import strip_blanks
from ledgerloom.llm import tokens
from ledgerloom.operators.bounded import lookup_join
from ledgerloom.session import ship_package, written

#: Hash buckets per source.
BUCKETS = 16_384
#: Documents around the end of a fraction among which the nearest sum of sizes is looked for; the rest is taken in hash order.
POOL = 64
#: Copies of one document that the search may take or leave one by one; further ones come or stay as a whole.
FREE_COPIES = 16


def source_name(c: Column) -> Column:
    """A source however it is written: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(strip_blanks(c)), r"[\s -]+", "_")


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """df's other columns with the token count of `text` as `out`; both names go from the others; null texts have none, empty ones 0."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = pd.array([None if t is None else tokens.count(t, tokenizer) for t in b[text]], dtype="Int64")
            yield b[[f.name for f in keep]].assign(**{out: n})

    ship_package(df.sparkSession)
    tokens.ship_tokenizer(df.sparkSession, tokenizer)
    return df.mapInPandas(run, T.StructType([*keep, T.StructField(out, T.LongType())]))


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: as near to share x total as the caps allow, the excess shared out in proportion.

    Shares needn't sum to 1. Sources without a cap have none of their own (0). If all caps together are under the
    total, every source is at its cap.
    """
    want, open_, left = {s: 0.0 for s in shares}, {s for s, w in shares.items() if w > 0}, float(total)
    while open_ and left > 1e-9:
        weight = sum(shares[s] for s in open_)
        level = left / weight
        full = {s for s in open_ if shares[s] * level >= caps.get(s, 0.0)}
        if not full:
            for s in open_:
                want[s] = shares[s] * level
            break
        for s in full:
            want[s] = float(caps.get(s, 0.0))
            left -= want[s]
        open_ -= full
    return want


def water_levels(sources: DataFrame, total: float) -> DataFrame:
    """sources (source, share, cap, ...) with `want`: as water_fill, by one aggregation a round over any number of sources.

    The level that fills the mixture rises from round to round: what the sources below it can't give goes to the others.
    """
    below = F.coalesce(F.col("cap") <= F.col("share") * F.col("__level"), F.lit(False))
    level = 0.0
    while True:
        r = sources.withColumn("__level", F.lit(level)).agg(F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~below & (F.col("share") > 0), F.col("share"))), F.lit(0.0)).alias("open")).first()
        new = (total - r.full) / r.open if r.open > 0 else float("inf")
        if new <= level * (1 + 1e-12):
            break
        level = new
        if level == float("inf"):
            break
    want = F.when(F.col("share") <= 0, 0.0).when(F.col("cap") <= F.col("share") * F.lit(level), F.col("cap")).otherwise(F.col("share") * F.lit(level)) if level != float("inf") else F.when(F.col("share") > 0, F.col("cap")).otherwise(0.0)
    return sources.withColumn("want", want)


def nearest_sum(sizes: list[int], copies: list[int], target: int) -> list[int]:
    """How many copies of each size to take so that their sum comes nearest to the target, the smaller sum on a tie.

    Sums that can be reached are the bits of one number per item; the way back through them gives the choice.
    """
    items = [(k, n << b, 1 << b) for k, (n, c) in enumerate(zip(sizes, copies)) for b in range(c.bit_length()) if (c + 1) >> (b + 1)]
    items += [(k, sizes[k] * r, r) for k, c in enumerate(copies) if (r := c - (1 << (c.bit_length() - 1)) + 1 if c else 0) and (c + 1) & c]
    reach, most = [1], max(0, target) + max(sizes, default=0) + 1
    for _, n, _ in items:
        reach.append((reach[-1] | reach[-1] << n) & ((1 << most + 1) - 1))
    last = reach[-1]
    under = (last & ((1 << max(0, target) + 1) - 1)).bit_length() - 1
    above = last >> under + 1
    over = under + (above & -above).bit_length() if above else None
    at = over if over is not None and over - target < target - under else under
    take = [0] * len(sizes)
    for (k, n, c), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            at, take[k] = at - n, take[k] + c
    return take


def draw_mixture(documents: DataFrame, doc_id: str, source: Column, n_tokens: str, targets: DataFrame, seed: int = 17, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, plan): draws (doc_id, source, n_tokens, times, copies) of the documents that are drawn, plan one row per target.

    targets: source, target_share, max_repeats; of a source listed more than once the shares are added and the most
    repeats count. The mixture's size is total_tokens, or else the tokens that the listed sources have. Documents of
    other or null sources, and those without tokens, aren't drawn; documents with a null id are. Rows repeated under one
    id are documents of their own: those of one size are one row, `copies` of which come `times` times each. Null shares
    and repeats count as 0. The part of a source that comes once more is filled in hash order up to the last POOL
    documents around its end, and with those of them whose sizes bring it nearest. The same seed draws the same
    documents, however the table is partitioned.
    """
    spark = documents.sparkSession
    listed = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats")).where("source is not null")
    listed = listed.groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").cast("int").alias("repeats"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), source.alias("source"), F.col(n_tokens).cast("long").alias("n_tokens")).where("n_tokens > 0")
    docs = lookup_join(docs, listed.select("source"), ["source"], "left_semi", ["doc_id", "n_tokens"])
    docs = docs.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("c"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "n_tokens")
    docs = written(docs.select("*", h.alias("h"), F.pmod(F.shiftright(h, 17), F.lit(BUCKETS)).cast("int").alias("bucket")), "mixture")
    sums = written(docs.groupBy("source", "bucket").agg(F.sum(F.col("n_tokens") * F.col("c")).alias("t"), F.sum("c").alias("c"), F.count("*").alias("rows")), "buckets")
    have = sums.groupBy("source").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    levels = listed.join(have, "source", "left").fillna(0, ["t", "c"]).withColumn("cap", (F.col("t") * F.col("repeats")).cast("double"))
    levels = written(levels, "levels")
    total = float(total_tokens if total_tokens is not None else levels.agg(F.sum("t")).first()[0] or 0)
    levels = water_levels(levels, total)
    filled = levels.agg(F.sum("want").alias("filled"))
    whole = F.when(F.col("t") > 0, F.least(F.floor(F.col("want") / F.col("t")), F.col("repeats").cast("long"))).otherwise(0).cast("int")
    plan = levels.withColumn("whole", whole).withColumn("rest", F.when((F.col("t") > 0) & (F.col("whole") < F.col("repeats")), F.greatest(F.lit(0), F.round(F.col("want") - F.col("whole") * F.col("t")))).otherwise(0).cast("long"))
    plan = plan.join(F.broadcast(filled)).select("source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("t").alias("available_tokens"), F.col("c").alias("available_documents"), "whole", "rest", "want", F.coalesce(F.try_divide("want", "filled"), F.lit(0.0)).alias("feasible_share"))
    plan = written(plan, "plan")

    # The buckets from POOL rows before the end of each fraction to POOL rows after it; a source has at most BUCKETS rows here.
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = sums.join(F.broadcast(plan.where("rest > 0").select("source", "rest")), "source").withColumns({"cum": F.sum("t").over(by), "seen": F.sum("rows").over(by)})
    edge = F.min(F.when(F.col("cum") >= F.col("rest"), F.struct("bucket", (F.col("seen") - F.col("rows")).alias("first"), F.col("seen").alias("last")))).over(Window.partitionBy("source")).alias("edge")
    b = b.select("*", edge)
    near = F.coalesce((F.col("seen") > F.col("edge.first") - POOL) & (F.col("seen") - F.col("rows") < F.col("edge.last") + POOL), F.lit(False))
    b = written(b.select("source", "bucket", F.when(near, F.lit(None)).otherwise((F.col("bucket") < F.col("edge.bucket")).cast("int")).alias("once_more"), (F.col("cum") - F.col("t")).alias("before"), "rest"), "ends")
    d = lookup_join(docs, plan.select("source", "whole", F.col("rest").alias("part")), ["source"], "inner", ["h"])
    d = lookup_join(d, b, ["source", "bucket"], "left", ["h"])
    sure = d.where("part = 0 or once_more is not null").select("doc_id", "source", "n_tokens", "c", "whole", F.when(F.col("part") > 0, F.col("once_more") * F.col("c")).otherwise(0).alias("more"))

    # Around each end: whole documents in hash order up to the pool, and the copies within the pool that come nearest.
    row = Window.partitionBy("source").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = d.where("part > 0 and once_more is null")
    start = F.min("before").over(Window.partitionBy("source"))
    open_ = open_.withColumns({"n": F.row_number().over(row), "left": F.col("part") - start - (F.sum(F.col("n_tokens") * F.col("c")).over(row) - F.col("n_tokens") * F.col("c"))})
    # left: tokens that are still wanted when the row's turn comes.
    open_ = open_.withColumn("end", F.max(F.when(F.col("left") > 0, F.col("n"))).over(Window.partitionBy("source")))
    inside = (F.col("n") > F.col("end") - POOL // 2) & (F.col("n") <= F.col("end") + POOL // 2)
    open_ = open_.withColumn("in_pool", F.coalesce(inside, F.lit(False)))
    kept = open_.where("not in_pool").select("doc_id", "source", "n_tokens", "c", "whole", F.when(F.col("n") <= F.col("end"), F.col("c")).otherwise(0).alias("more"))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        target, sizes, most, sure = int(g["left"].iloc[0]), [int(x) for x in g["n_tokens"]], [int(x) for x in g["c"]], []
        for n, c in zip(sizes, most):  # in hash order, all but the copies that stay free
            k = max(0, min(c, target // n) - FREE_COPIES // 2)
            sure.append(k)
            target -= k * n
        more = nearest_sum(sizes, [min(c - k, FREE_COPIES) for c, k in zip(most, sure)], target)
        return g.assign(more=[k + m for k, m in zip(sure, more)])[["doc_id", "source", "n_tokens", "c", "whole", "more"]]

    ship_package(spark)
    kind = documents.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("c", T.LongType()), T.StructField("whole", T.IntegerType()), T.StructField("more", T.LongType())])
    picked = open_.where("in_pool").select("doc_id", "source", "n_tokens", "c", "whole", "n", "left").groupBy("source").applyInPandas(choose, schema)
    d = sure.unionByName(kept).unionByName(picked)
    times = F.filter(F.array(F.struct((F.col("whole") + 1).alias("times"), F.col("more").cast("long").alias("copies")), F.struct(F.col("whole").alias("times"), (F.col("c") - F.col("more")).cast("long").alias("copies"))), lambda x: (x["times"] > 0) & (x["copies"] > 0))
    draws = d.select("doc_id", "source", "n_tokens", F.explode(times).alias("x")).select("doc_id", "source", "n_tokens", "x.times", "x.copies")
    return draws, plan


def mixture_report(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target the shares wanted, feasible and reached, with tokens and documents available and drawn.

    `apart_tokens`: the tokens by which what was drawn differs from what is feasible.
    """
    drawn = draws.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_documents"), F.max("times").alias("most_repeats"))
    r = plan.join(drawn, "source", "left").fillna(0, ["drawn_tokens", "drawn_documents", "most_repeats"])
    all_ = drawn.agg(F.sum("drawn_tokens").alias("all_tokens"))
    return r.join(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", "available_tokens", "available_documents", "drawn_tokens", "drawn_documents", "most_repeats", F.round(F.abs(F.col("drawn_tokens") - F.col("want")), 1).alias("apart_tokens"),
        F.round("feasible_share", 6).alias("feasible_share"), F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )


def with_shares(draws: DataFrame, report: DataFrame) -> DataFrame:
    """The drawn documents, each with the shares wanted, feasible and reached of its source."""
    return lookup_join(draws, report.select("source", "target_share", "feasible_share", "actual_share"), ["source"], "inner", ["doc_id", "n_tokens"])
