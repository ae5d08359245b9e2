"""Queries on documents, benchmark and level_samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import leaks, levels, packing
from tidelog.functions.scale import spread, written
from tidelog.sources.tables import table


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(*columns))


def tokenizer(spark: SparkSession) -> str:
    """The file of the public tokenizer: the session's setting tidelog.tokenizer, or where this machine has it."""
    return spark.conf.get("tidelog.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of each text, or of each piece of a text that is larger than a container."""
    return packing.pack(texts(spark, folder, "doc_id", "text"), tokenizer(spark))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers made, their tokens, and the share of their room that is filled."""
    d = p6_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    return d.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("largest"), F.max("docs").alias("most_documents"), (F.sum("n") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("filled"))


def _checked(spark: SparkSession, folder: str, rows: DataFrame, documents: int, cost: float) -> DataFrame:
    """One row: texts packed, whether each is whole (its pieces follow one another from its first token on), and whether every container is within
    each of its three capacities."""
    rows = written(rows, "packed")
    text = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("first_token").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    text = text.agg(F.count(F.lit(1)).alias("n_documents"), F.bool_and((F.col("n") == F.col("end")) & (F.col("starts") == F.col("pieces"))).alias("whole"))
    bins = rows.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    bins = bins.agg(F.bool_and(F.col("n") <= packing.CAPACITY).alias("tokens_fit"), F.bool_and(F.col("docs") <= documents).alias("documents_fit"), F.bool_and(F.col("cost") <= cost).alias("cost_fits")).first()
    return text.select("n_documents", "whole", *[F.lit(bins[c]).alias(c) for c in ("tokens_fit", "documents_fit", "cost_fits")])


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """p6_containers: every text whole and once, every container within its capacities."""
    return _checked(spark, folder, p6_containers(spark, folder), packing.MOST_DOCUMENTS, packing.CAPACITY**2)


#: Capacities that all bind on texts like these: few documents, and the cost of four texts of a quarter of the tokens, and twice that.
BINDING = {"most_documents": 6, "cost": 2.0 * 4 * (packing.CAPACITY // 4) ** 2}


def p6_check_dot(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the rule of the largest dot product, where all three capacities bind."""
    rows = packing.pack(texts(spark, folder, "doc_id", "text"), tokenizer(spark), rule="dot", weights=(1.0, 1.0, 1.0), **BINDING)
    return _checked(spark, folder, rows, BINDING["most_documents"], BINDING["cost"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a stretch of a test item, with the item."""
    return p7_spans(spark, folder).where("longest").select("doc_id", "item_id")


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of a test item in a document, by words."""
    return leaks.leaks(texts(spark, folder, "doc_id", "text"), table(spark, folder, "benchmark"))


def p7_removals(spark: SparkSession, folder: str) -> DataFrame:
    """The passages that have to go from each document: the stretches of all items, merged."""
    return leaks.removals(texts(spark, folder, "doc_id", "text"), table(spark, folder, "benchmark"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Level of each English speech of at least a hundred words."""
    return levels.levels(texts(spark, folder, "doc_id", "text"), table(spark, folder, "level_samples"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and words by level and source; level null: no English speech of a hundred words."""
    d = levels.scored(texts(spark, folder, "text", "source"), table(spark, folder, "level_samples"))
    rated = (F.col("reading.n_words") >= levels.MIN_WORDS) & (F.col("reading.known") >= levels.KNOWN)
    d = d.select("source", F.when(rated, F.col("reading.level")).alias("reading_level"), "reading.n_words")
    return d.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p6_check, p6_check_dot, p7_found, p7_spans, p7_removals, p8_found, p8_profile)}
_WHOLE = "select count(*) as n_documents, true as whole, true as tokens_fit, true as documents_fit, true as cost_fits from documents where text is not null"
SQL: dict[str, str] = {"p6_check": _WHOLE, "p6_check_dot": _WHOLE}
