"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.canonical import map_to_list
from ledgerloom.llm.leakage import leaked_passages
from ledgerloom.llm.mixing import draw_mixture, mixture_report, source_name, token_counts, with_shares
from ledgerloom.llm.pairs import defective_pairs
from ledgerloom.llm.splitting import split_oversized
from ledgerloom.operators.bounded import lookup_join
from ledgerloom.session import written
from ledgerloom.sources.tables import table


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Every different description that isn't exactly a service of its contract, with the service it stands for."""
    return map_to_list(table(spark, sf, "line_items"), "contract_id", "description", table(spark, sf, "dim_service"), "contract_id", "service")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The service of every line whose description isn't exactly one; '' if it is none of its contract's."""
    services = table(spark, sf, "dim_service").select("contract_id", F.col("service").alias("description")).distinct()
    lines = table(spark, sf, "line_items").select("line_id", "contract_id", "description", "loaded_at").where("line_id is not null and description is not null")
    # Copies of a line carry the same description; the earliest counts.
    lines = lookup_join(lines, services, ["contract_id", "description"], "left_anti", ["line_id"])
    mapped = _mapped(spark, sf).select(F.col("block").alias("contract_id"), F.col("value").alias("description"), F.coalesce("match", F.lit("")).alias("service"))
    found = lookup_join(lines, written(mapped, "mapped"), ["contract_id", "description"], "left", ["line_id"])
    return found.groupBy("line_id").agg(F.min(F.struct("loaded_at", F.coalesce("service", F.lit("")).alias("service"))).alias("m")).select("line_id", "m.service")


def p1_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping itself, in the columns of the table resolution."""
    m = _mapped(spark, sf)
    return m.select(F.col("block").alias("contract_id"), F.col("value").alias("description"), F.col("match").alias("service"), F.when(F.col("match").isNull(), "unmatched").otherwise("set_similarity").alias("match_method"), F.col("confidence").cast("decimal(4,3)").alias("confidence"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions that stand for no service of their contract, with the number of lines that carry them."""
    lines = table(spark, sf, "line_items").groupBy("contract_id", "description").agg(F.count("*").alias("n_lines"))
    m = _mapped(spark, sf).where("match is null").select(F.col("block").alias("contract_id"), F.col("value").alias("description"))
    return lines.join(m, ["contract_id", "description"])


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold a passage of an evaluation item."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation item the documents that it leaked into and the longest stretch in words."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("words").alias("longest"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The defective pairs of question and answer with their defect."""
    may_decline = F.col("qtype").isin("off_topic", "foreign_service")
    return defective_pairs(table(spark, sf, "qa_results"), "qa_id", "question", "answer", may_decline).select(F.col("pair_id").alias("qa_id"), "defect")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per kind, with how many of the pairs the automatic grader had passed."""
    graded = table(spark, sf, "qa_results").select("qa_id", "passed")
    return p5_found(spark, sf).join(graded, "qa_id").groupBy("defect").agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"))


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The drawn documents, written once, and the report on them by source."""
    d = table(spark, sf, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    draws, plan = draw_mixture(token_counts(d, "text"), "doc_id", F.col("source"), "n_tokens", table(spark, sf, "source_targets"))
    draws = written(draws, "draws")
    return draws, mixture_report(draws, plan)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture and how often each comes, with the shares wanted, feasible and reached of its source."""
    draws, report = _mixture(spark, sf)
    return with_shares(draws, written(report, "shares"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares wanted, feasible and reached by source."""
    return _mixture(spark, sf)[1]


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document over the limit of its source."""
    return split_oversized(table(spark, sf, "documents"), "doc_id", "text", source_name(F.col("source")), table(spark, sf, "source_targets"))


QUERIES = {"p1_found": p1_found, "p1_resolution": p1_resolution, "p1_unmatched": p1_unmatched, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_report": p6_report, "p7_shares": p7_shares, "p7_report": p7_report, "p8_pieces": p8_pieces}
SQL: dict[str, str] = {}
