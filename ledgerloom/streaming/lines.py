"""The line checks over a stream of lines: repeats dropped, findings counted per window of load time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import iso_day


def stream_of(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def lines_once_stream(lines: DataFrame, late: str = "7 days") -> DataFrame:
    """Each line once: repeats that come within `late` of the first are dropped; state is kept no longer than that."""
    timed = lines.where("line_id is not null").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["line_id"])


def finding_counts_stream(lines: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, contract_id, n_lines, n_arithmetic, n_dates) over lines once, per window of load time."""
    wrong = F.col("line_total_cents") != F.col("quantity") * F.col("unit_price_cents")
    once = lines_once_stream(lines, late)
    counts = once.groupBy(F.window("loaded_at", window).alias("w"), "contract_id").agg(F.count("*").alias("n_lines"), F.count(F.when(wrong, 1)).alias("n_arithmetic"), F.count(F.when(iso_day(F.col("service_date")).isNull(), 1)).alias("n_dates"))
    return counts.select(F.col("w.start").alias("window_start"), "contract_id", "n_lines", "n_arithmetic", "n_dates")
