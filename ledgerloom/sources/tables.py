"""Reading and writing of tables: Parquet, CSV, JSON, ORC and whole text files, always with a stated or stored schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder (one file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """CSV read as text and then cast column by column; what can't be cast becomes null and the text stays beside it.

    Every column of another type than string gets a neighbour `<name>_raw` with the text as it was written.
    An empty file yields no rows; a missing value is null in both columns.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text = spark.read.schema(raw).options(header="true", multiLine="true", escape='"', **options).csv(path)
    columns = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            columns.append(F.col(f.name))
        elif isinstance(f.dataType, T.DateType):
            columns += [F.try_to_date(F.trim(f.name), "yyyy-M-d").alias(f.name), F.col(f.name).alias(f"{f.name}_raw")]
        else:
            columns += [F.col(f.name).try_cast(f.dataType).alias(f.name), F.col(f.name).alias(f"{f.name}_raw")]
    return text.select(*columns)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_checked(df: DataFrame, violations: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write df only if `violations` has no row; otherwise raise with the first ten of them."""
    found = violations.limit(10).collect()
    if found:
        raise ValueError(f"not written, {len(found)} or more violations: {found}")
    df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
