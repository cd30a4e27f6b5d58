"""Contract documents and recorded replies: which file to read, headers that must agree, replies with their telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a file is read by its ending, and how far a reading by that way is trusted.
ROUTES = {"md": "text", "txt": "text", "pdf": "pdf_text", "png": "ocr", "jpg": "ocr", "jpeg": "ocr", "tif": "ocr", "tiff": "ocr"}
TRUST = {"text": 1.0, "pdf_text": 1.0, "ocr": 0.70, "failed": 0.50}


def _lookup(pairs: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key], F.lit(default))


def stem(path: Column) -> Column:
    """The file's path without its ending."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def route(path: Column) -> Column:
    """How a file is read, by its ending; unknown endings fail."""
    return _lookup(ROUTES, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), "failed")


def trust(routes: Column) -> Column:
    """How far a reading is trusted; unknown ways as failed ones."""
    return _lookup(TRUST, routes, TRUST["failed"])


def preferred_files(files: DataFrame, path: str = "path") -> DataFrame:
    """files without those of which a text file of the same stem exists, with `route`."""
    f = files.withColumn("route", route(F.col(path))).withColumn("__stem", stem(F.col(path)))
    texts = f.where("route = 'text'").select("__stem").distinct()
    return f.where("route = 'text'").unionByName(f.where("route <> 'text'").join(texts, "__stem", "left_anti")).drop("__stem")


def folder_trust(files: DataFrame, folder: str, routes: str = "route") -> DataFrame:
    """(folder, trust): the least trust of any file of a folder."""
    return files.groupBy(folder).agg(F.min(trust(F.col(routes))).alias("trust"))


def header_fields(documents: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, one column per pattern, agree): the first group of each pattern over all documents of a key.

    A field is null if no document has it; agree is false if two documents have different values of a field, and then
    the smallest is given. Null texts say nothing.
    """
    found = documents.select(key, *[F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1)).alias(n) for n, p in patterns.items()])
    g = found.groupBy(key).agg(*[F.min(n).alias(n) for n in patterns], *[F.max(n).alias(f"__{n}") for n in patterns])
    agree = F.lit(True)
    for n in patterns:
        agree = agree & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return g.select(key, *patterns, agree.alias("agree"))


def recordings(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, chunk, reply, usage): one row per chunk of a recording {chunk: reply} or {chunk: {reply, usage}}.

    Texts that aren't such JSON give no rows; a recording without telemetry has a null usage.
    """
    usage = "struct<input_tokens:bigint,output_tokens:bigint,seconds:double,retries:bigint,schema_enforced:boolean>"
    d = texts.select(*keep, F.explode(F.from_json(text, T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})).alias("chunk", "v"))
    whole = F.from_json("v", f"struct<reply:string,usage:{usage}>")
    return d.select(*keep, "chunk", F.when(F.trim("v").startswith("{") & whole["reply"].isNotNull(), whole["reply"]).otherwise(F.col("v")).alias("reply"), whole["usage"].alias("usage"))


def record(df: DataFrame, by: list[str], chunk: Column, reply: Column, usage: Column) -> DataFrame:
    """(by, recording): the replies of each group as one recording {chunk: {reply, usage}}, chunks in order; of a chunk met twice the last reply.

    A group is one text, so `by` should name groups of bounded size.
    """
    entry = F.to_json(F.struct(reply.alias("reply"), usage.alias("usage")))
    rows = F.array_sort(F.collect_list(F.struct(chunk.alias("c"), entry.alias("e"))))
    item = lambda x: F.concat(_quoted(x["c"]), F.lit(": "), x["e"])
    return df.groupBy(*by).agg(rows.alias("__r")).select(*by, F.concat(F.lit("{"), F.array_join(F.transform("__r", item), ", "), F.lit("}")).alias("recording"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def write_tagged_csv(df: DataFrame, folder: str, tag: str) -> None:
    """df as CSV files, a folder `tag=<run>` per run."""
    df.write.partitionBy(tag).options(header="true", escape='"', quoteAll="true", nullValue="\\N").csv(folder)


def tagged_csv(spark: SparkSession, glob: str, schema: T.StructType, tag: str | None = None) -> DataFrame:
    """All CSV files of a glob with the name of their run: that of their folder `tag=<run>`, else the file's stem."""
    pattern = rf"/{tag}=([^/]+)/" if tag else r"([^/]+?)(?:\.[^./]*)?$"
    r = spark.read.schema(schema).options(header="true", multiLine="true", escape='"', nullValue="\\N", recursiveFileLookup="true").csv(glob)
    return r.withColumn("run", F.url_decode(F.regexp_extract(F.input_file_name(), pattern, 1)) if tag else F.regexp_extract(F.input_file_name(), pattern, 1))


def csv_text(df: DataFrame, by: str, columns: list[str], order: str) -> DataFrame:
    """(by, text): the rows of a small group (such as one contract's rules) as CSV text in their order."""
    line = F.to_csv(F.struct(*columns))
    head = ",".join(columns)
    return df.groupBy(by).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")).alias("text"))
