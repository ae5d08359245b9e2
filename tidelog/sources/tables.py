"""Tables of a data folder, and their views as log records."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.functions.scale import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_ulid(ts: Column, entropy: Column) -> Column:
    return U.ulid_of(U.ms_of_ts(ts), entropy)


def event_records(spark: SparkSession, folder: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """events as records: ulid, topic, payload, body, raw, and the event's id and time.

    Bounds (ULIDs or RFC 3339, with their whole millisecond) are also put on the table's own time, which its statistics can answer;
    a comparison of identifiers that are made here can't reach the scan.
    """
    e = table(spark, folder, "events")
    at = lambda ms: F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(" ")).cast("timestamp_ntz")
    if start is not None:
        e = e.where(F.col("ts") >= at(U.decode_ms(U.low_of(start))))
    if stop is not None:
        e = e.where(F.col("ts") < at(U.decode_ms(U.low_of(stop)) + 1))
    return (
        e.select(event_ulid(F.col("ts"), F.col("event_id")).alias("ulid"), F.col("event_type").alias("topic"), F.col("props").alias("payload"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
        .withColumn("body", F.concat_ws(" ", "topic", "payload"))
        .withColumn("raw", F.concat_ws(" ", "ulid", "body"))
    )


def document_lines(spark: SparkSession, folder: str, containing: str = "") -> DataFrame:
    """documents as records, one a line of text: doc_id, line_no, line. containing: texts without it are left out before they are split."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    d = d.where(F.contains("text", F.lit(containing))) if containing else spread(d)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
