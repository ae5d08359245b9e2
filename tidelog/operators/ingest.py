"""From lines to records: topics, identifiers, and the writing of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import ulid as U

TOPIC = "^[a-zA-Z0-9][a-zA-Z0-9_-]*\\z"


def valid_topic(topic: Column) -> Column:
    return F.coalesce(topic.rlike(TOPIC), F.lit(False))


def split_topic(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with topic, payload and topic_ok: a line needs a space, and a valid topic before it."""
    at = F.instr(line, " ")
    d = lines.withColumn("topic", F.when(at > 0, F.substring_index(line, " ", 1)))
    d = d.withColumn("payload", F.when(at > 0, F.expr(f"substring({line}, instr({line}, ' ') + 1)")))
    return d.withColumn("topic_ok", valid_topic(F.col("topic")))


def dynamic_topics(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines whose first word is their topic, and those set apart because it is none. Null and empty lines are set apart."""
    d = split_topic(lines, line)
    return d.where("topic_ok").drop("topic_ok"), d.where("not topic_ok").drop("topic_ok", "topic", "payload")


def static_topic(lines: DataFrame, topic: str, line: str = "value") -> DataFrame:
    """Lines as records of one topic; an empty line is a record with an empty payload, a null one is left out."""
    import re

    if not re.fullmatch(TOPIC.removesuffix("\\z").removeprefix("^"), topic):
        raise ValueError(f"no topic: {topic!r}")
    return lines.where(F.col(line).isNotNull()).withColumn("topic", F.lit(topic)).withColumn("payload", F.col(line))


def prefixed(lines: DataFrame, prefixes: list[str], line: str = "value") -> DataFrame:
    """Each line after the prefixes, joined by spaces, as a forwarder sends it."""
    return lines.withColumn(line, F.concat_ws(" ", *[F.lit(p) for p in prefixes], line)) if prefixes else lines


def with_ids(records: DataFrame, batch: int, now_ms: int | Column) -> DataFrame:
    """records (topic, payload) with ulid, body and raw. A retried micro-batch gives the same identifiers: they come from the batch,
    the partition and the position in it, so the input of a batch must be the same and in the same order when it is read again."""
    d = records.withColumn("_n", F.monotonically_increasing_id())
    partition, position = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    ms = U.encode(F.lit(now_ms) if isinstance(now_ms, int) else now_ms, 10)
    # six characters are 2^30 positions of a partition, four 2^20 partitions
    d = d.withColumn("ulid", F.concat(ms, U.stream_clock_entropy(batch, partition, position))).drop("_n")
    return d.withColumn("body", F.concat_ws(" ", "topic", "payload")).withColumn("raw", F.concat_ws(" ", "ulid", "body"))


def rolled(index: DataFrame, group: list[str], order: str, size: str, target: int) -> DataFrame:
    """index with `roll`: its rows in order fill files, and a file is closed by the row with which it reaches the target.

    Where a file ends depends on all before it in its group, so each group is one pass in order, streamed with constant memory;
    groups are what one writer holds, and are spread over tasks. Null sizes count as 0.
    """
    import pyarrow as pa

    keys = [index.columns.index(g) for g in group]
    at = index.columns.index(size)
    schema = T.StructType([*index.schema.fields, T.StructField("roll", T.LongType())])

    def apply(batches):
        key, filled, roll = None, 0, 0
        for b in batches:
            out = []
            columns = [b.column(k).to_pylist() for k in keys]
            for n, s in enumerate(b.column(at).to_pylist()):
                now = tuple(c[n] for c in columns)
                if now != key:
                    key, filled, roll = now, 0, 0
                out.append(roll)
                filled += s or 0
                if filled >= target:
                    filled, roll = 0, roll + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "roll"])

    return index.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(apply, schema)


# Shape of a line of the load generator (shortest and longest word).
WORDS = (5, 19)


def generated_lines(d: DataFrame, source: str = "0", size: int = 512) -> DataFrame:
    """Lines of a load generator from (id, at), a batch or a stream: time, source, number in nine digits, and words up to `size` bytes."""
    least, most = WORDS
    seed = lambda k: F.concat_ws("/", F.col("id").cast("string"), F.lit(source), k.cast("string"))
    letters = lambda k: F.translate(F.md5(seed(k)), "0123456789", "ghijklmnop")
    word = lambda k: F.substring(letters(k), F.lit(1), (F.lit(least) + F.pmod(F.xxhash64(seed(k)), F.lit(most - least + 1))).cast("int"))
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size // (least + 1))), word), " ")
    head = F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(source), F.lpad(F.col("id").cast("string"), 9, "0"))
    return d.select("id", F.substring(F.concat_ws(" ", head, filler), 1, size).alias("value"))


def generated(spark, n: int, source: str = "0", size: int = 512, start_ms: int = 0, per_second: int = 5) -> DataFrame:
    """n lines of a load generator, one every 1/per_second s from start_ms on."""
    return generated_lines(spark.range(n).select("id", U.ulid_ts(U.ulid_of(F.lit(start_ms) + F.expr(f"id * 1000 div {per_second}"))).alias("at")), source, size)


def generated_stream(spark, source: str = "0", size: int = 512, per_second: int = 5) -> DataFrame:
    """The same as a stream without end."""
    d = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return generated_lines(d.select(F.col("value").alias("id"), F.col("timestamp").alias("at")), source, size)
