"""Command line: python -m tidelog query|stream|ingest|ingeststore|forward|store|testsvc STORE ..."""

from __future__ import annotations

import argparse
import itertools
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tidelog.functions import ulid as U
from tidelog.operators import ingest as lines_in
from tidelog.operators import search
from tidelog.operators.search import LogQuery
from tidelog.operators.store import LogStore
from tidelog.streaming import ingest, metrics, tail


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, text: str) -> argparse.ArgumentParser:
        m = sub.add_parser(name, help=text)
        m.add_argument("store", help="URI of the folder that holds the segments")
        return m

    q = mode("query", "search a range of time")
    q.add_argument("--from", dest="start", default="1h", help="now, a duration ago, or an RFC 3339 time")
    q.add_argument("--to", dest="stop", default="now")
    q.add_argument("--q", default="")
    q.add_argument("--regex", action="store_true")
    q.add_argument("--stats", action="store_true", help="statistics only; no record is read")
    q.add_argument("--nocopy", action="store_true", help="run it, but print no records")
    q.add_argument("--ulid", action="store_true", help="print identifiers")
    q.add_argument("--time", action="store_true", help="print times")
    s = mode("stream", "print records as they come")
    s.add_argument("--q", default="")
    s.add_argument("--regex", action="store_true")
    s.add_argument("--window", default="3s")
    s.add_argument("--ulid", action="store_true")
    s.add_argument("--checkpoint", required=True)
    for name, text in (("ingest", "lines of a TCP server, or of files that appear in a folder, into segments"), ("ingeststore", "the same, with the upkeep of the store beside it")):
        i = mode(name, text)
        i.add_argument("--listen", help="host:port to read lines from")
        i.add_argument("--folder", help="URI of a folder to read files from")
        i.add_argument("--topic-mode", choices=["static", "dynamic"], default="static")
        i.add_argument("--topic", default="default")
        i.add_argument("--flush-size", type=int, default=ingest.FLUSH_SIZE)
        i.add_argument("--flush-age", default=ingest.FLUSH_AGE)
        i.add_argument("--checkpoint", required=True)
        i.add_argument("--rejected", required=True)
        i.add_argument("--mode", dest="mode_", choices=["fast", "durable"], default="fast")
        i.add_argument("--turn-seconds", type=float, default=10, help="ingeststore: time between turns of upkeep")
    f = mode("forward", "lines of standard input into segments, as they come")
    f.add_argument("--chunk", type=int, default=100_000, help="lines that are sent together")
    f.add_argument("--prefix", action="append", default=[])
    f.add_argument("--topic", help="topic of all lines; else each line has its own")
    m = mode("store", "upkeep: compaction and retention, a number of turns")
    m.add_argument("--turns", type=int, default=4)
    m.add_argument("--target-size", type=int, default=128 << 20)
    m.add_argument("--recover", action="store_true", help="after a crash, first")
    t = mode("testsvc", "made-up records into segments")
    t.add_argument("--id", default="0")
    t.add_argument("--size", type=int, default=512)
    t.add_argument("--rate", type=int, default=5)
    t.add_argument("--n", type=int, default=1000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tidelog {a.mode}").config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", tail.ROCKSDB).getOrCreate()
    store = LogStore(spark, a.store)
    if a.mode == "query":
        query = LogQuery.of_words(a.start, a.stop, a.q, a.regex, datetime.now(UTC))
        if a.stats:
            r = store.stats(query).first()
            print(f"{r.segments_queried} segments, {r.max_data_set_size} bytes")
            return 0
        d = store.query(query)
        if a.nocopy:
            d.write.format("noop").mode("overwrite").save()
            return 0
        for r in search.render(d, "raw" if a.ulid else "time" if a.time else "strip").toLocalIterator():
            print(r.line)
    elif a.mode == "stream":
        records = tail.new_segments(spark, a.store, a.checkpoint)
        show = lambda d, n: [print(f"{r.ulid} {r.body}" if a.ulid else r.body, flush=True) for r in d.toLocalIterator()]
        tail.in_order(tail.tail(records, LogQuery(q=a.q, is_regex=a.regex), a.window), show, a.checkpoint, processingTime="1 second").awaitTermination()
    elif a.mode in ("ingest", "ingeststore"):
        if bool(a.listen) == bool(a.folder):
            sys.exit("one of --listen and --folder")
        lines = ingest.file_lines(spark, a.folder) if a.folder else ingest.socket_lines(spark, a.listen.rpartition(":")[0], int(a.listen.rpartition(":")[2]))
        seen = metrics.Metrics().add_to(spark)
        how = {} if a.mode_ == "durable" else {"processingTime": a.flush_age}
        q = ingest.ingest_lines(lines, store, a.checkpoint, a.rejected, a.topic if a.topic_mode == "static" else None, a.flush_size, mode=a.mode_, **how)
        if a.mode == "ingeststore":
            while not q.awaitTermination(a.turn_seconds):
                print(*store.run_once())
        q.awaitTermination()
        print(seen.text(), file=sys.stderr)
    elif a.mode == "forward":
        for n, chunk in enumerate(iter(lambda: list(itertools.islice(sys.stdin, a.chunk)), [])):
            lines = lines_in.prefixed(spark.createDataFrame([(x.rstrip("\n"),) for x in chunk], "value string"), a.prefix)
            good, bad = (lines_in.static_topic(lines, a.topic), None) if a.topic else lines_in.dynamic_topics(lines)
            if bad is not None and (k := bad.count()):
                print(f"{k} lines have no topic", file=sys.stderr)
            now = U.ms_of(datetime.now(UTC))
            print(f"{store.append(lines_in.with_ids(good, (now + n) % (1 << 30), now))} segments", flush=True)
    elif a.mode == "testsvc":
        now = U.ms_of(datetime.now(UTC))
        good = lines_in.static_topic(lines_in.generated(spark, a.n, a.id, a.size, now, a.rate), "testsvc")
        print(f"{store.append(lines_in.with_ids(good, now % (1 << 30), now))} segments")
    else:
        if a.recover:
            print(f"recovered {store.recover()}")
        for _ in range(a.turns):
            print(*store.run_once(target=a.target_size))
    return 0


if __name__ == "__main__":
    sys.exit(main())
