"""Text and vector similarity from built-in expressions: character n-gram TF-IDF and cosine, filtered top-k, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.bounded import broadcast_if_bounded
from ledgerloom.session import written


def char_ngrams(c: Column, least: int = 2, most: int = 4) -> Column:
    """All character n-grams of the words of a text, lower case, each word with a blank on both sides.

    A word that is shorter than n with its blanks gives itself once and no longer ones. Null and blank texts give none.
    """
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


    def of_word(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))

    def of_length(n: int) -> Column:
        # With its blanks a word has two characters more; only the first n that reaches its length may give it whole.
        enough = words if n == least else F.filter(words, lambda w: F.length(w) + 2 > n - 1)
        return F.flatten(F.transform(enough, lambda w: of_word(w, n)))

    return F.concat(*[of_length(n) for n in range(least, most + 1)])


def tfidf(texts: DataFrame, key: list[str], text: str, fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, gram, weight), (gram, idf)): L2-normalised weights with smooth idf ln((1 + N) / (1 + df)) + 1.

    With `fitted` (gram, idf) of another corpus, grams it lacks are left out. Texts without grams have no rows.
    """
    g = texts.select(*key, F.explode(char_ngrams(F.col(text))).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("tf"))
    if fitted is None:
        n = texts.agg(F.count("*").alias("N"))
        fitted = g.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = g.join(broadcast_if_bounded(fitted), "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    return w.select(*key, "gram", (F.col("w") / norm).alias("weight")), fitted


class Encoder:
    """Turns texts into weighted n-grams by weights fitted once; given vectors of a better model, it hands those out instead."""

    def __init__(self, fitted: DataFrame, vectors: DataFrame | None = None):
        self.fitted, self.vectors = fitted, vectors

    @classmethod
    def fit(cls, texts: DataFrame, text: str, vectors: DataFrame | None = None) -> Encoder:
        """Fit on texts; the weights are written, so that every later encoding reads the same. vectors: (text, gram, weight)."""
        _, idf = tfidf(texts, texts.columns, text)
        return cls(written(idf, "idf"), vectors)

    def encode(self, texts: DataFrame, key: list[str], text: str) -> DataFrame:
        """(key, gram, weight): the vectors given for a text if there are any, else those of the fitted n-grams."""
        own = tfidf(texts, key, text, self.fitted)[0]
        if self.vectors is None:
            return own
        given = texts.select(*key, F.col(text).alias("__text")).join(self.vectors.withColumnRenamed("text", "__text"), "__text").select(*key, "gram", "weight")
        return given.unionByName(own.join(given.select(*key).distinct(), key, "left_anti"))


def lexical_rank(queries: DataFrame, names: DataFrame, block: str, query: str, name: str, order: str) -> DataFrame:
    """(block, query, name, score, rank): the names of the query's block by TF-IDF cosine, ties by `order`; idf is fitted on the names.

    Only pairs that share a gram are formed, by equality on (block, gram).
    """
    nv, idf = tfidf(names.select(block, name, order), [block, name, order], name)
    qv, _ = tfidf(queries.select(block, query).distinct(), [block, query], query, idf)
    pairs = qv.join(nv.withColumnRenamed("weight", "w2"), [block, "gram"]).groupBy(block, query, name, order).agg(F.round(F.sum(F.col("weight") * F.col("w2")), 4).alias("score"))
    w = Window.partitionBy(block, query).orderBy(F.desc("score"), F.asc(order))
    return pairs.select(block, query, name, "score", F.row_number().over(w).alias("rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, vec_id: str, vector: str, k: int, where: Column | None = None, block_rows: int = 2_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query by cosine, itself left out, ties by id.

    queries: a stated set of rows of the same columns; they are held against all rows in blocks of at most block_rows,
    sent to the executors. `where` filters the vectors before any score. A query moves k rows of each partition.
    """
    v = vectors.where(where) if where is not None else vectors
    v = v.select(F.col(vec_id).alias("vec_id"), unit(F.col(vector)).alias("__v"))
    q = queries.select(F.col(vec_id).alias("query_id"), unit(F.col(vector)).alias("__q"))
    blocks = max(1, -(-q.count() // block_rows))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        scored = v.join(F.broadcast(part), F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(dot(F.col("__q"), F.col("__v")), 4).alias("score"))
        # The filter on row_number lets Spark keep each partition's own k best before the shuffle.
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def relevant_indexes(vectors: DataFrame, queries: DataFrame, vec_id: str, vector: str, index: str, gate: float = 0.35, block_rows: int = 2_000) -> DataFrame:
    """(query_id, index, score): the indexes whose entry nearest to a query (itself left out) has at least the score `gate`.

    queries are held against all rows in blocks as in cosine_top_k; a query moves one row per index and partition.
    """
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(index), unit(F.col(vector)).alias("__v"))
    q = queries.select(F.col(vec_id).alias("query_id"), unit(F.col(vector)).alias("__q"))
    blocks, out = max(1, -(-q.count() // block_rows)), None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        scored = v.join(F.broadcast(part), F.col("query_id") != F.col("vec_id")).groupBy("query_id", index).agg(F.max(F.round(dot(F.col("__q"), F.col("__v")), 4)).alias("score")).where(F.col("score") >= gate)
        out = scored if out is None else out.unionByName(scored)
    return out
