"""Streams: nothing is lost, repeated ids are stored once, batches that failed are replayed, counters survive."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from logweave.sources import feed
from logweave.streaming import pipeline, progress


def line(at, what):
    return f"{at} web-01 app[1]: {what}"


def land(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp_path, **how):
    query = pipeline.to_table(pipeline.events(pipeline.landing(spark, str(tmp_path / "in"), 1), "2026-09-05", **how), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    query.awaitTermination()
    return query


def stored(spark, tmp_path):
    return sorted(r.raw_message for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_wrong_clocks_and_backfills_lose_nothing(spark, tmp_path):
    """One line of the future and old ones, before and after each other, over a restart, and one of no time at all."""
    counters = progress.Counters(spark, str(tmp_path / "counters"))
    spark.streams.addListener(counters)
    first = [line("2031-01-01T00:00:00Z", "future"), line("2024-01-01T00:00:00Z", "old")]
    second = [line("2024-01-02T00:00:00Z", "older news"), line("2024-01-01T12:00:00Z", "error: late"), "no time at all"]
    land(tmp_path / "in", "a.txt", *first)
    land(tmp_path / "in", "b.txt", *second)
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == sorted([*first, *second])
    land(tmp_path / "in", "c.txt", first[0], line("1999-01-01T00:00:00Z", "backfill"), line("1999-01-01T00:00:00Z", "backfill"))
    run(spark, tmp_path)
    run(spark, tmp_path)  # nothing new
    want = sorted([*first, *second, line("1999-01-01T00:00:00Z", "backfill")])
    assert stored(spark, tmp_path) == want
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.where("raw_message = 'no time at all'").first().event_ts is None and table.where("created_at is null").count() == 0
    for _ in range(100):
        got = progress.totals(spark, str(tmp_path / "counters")).collect()
        if got and got[0].batches == 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert len(got) == 1 and (got[0].rows, got[0].input, got[0].batches) == (len(want), 8, 3) and got[0].errors == table.where("severity_score <= 3").count()
    shown, after = [], None
    while rows := progress.tail(spark, str(tmp_path / "out"), after, 4).collect():
        shown += [r.raw_message for r in rows]
        after = (str(rows[-1].created_at), rows[-1].id)
    assert sorted(shown) == want


def test_live_series_counts_each_event_once(spark, tmp_path):
    land(tmp_path / "in", "a.txt", line("2031-01-01T00:00:00Z", "future"), line("2024-01-01T00:00:00Z", "error: old"))
    parsed = pipeline.events(pipeline.landing(spark, str(tmp_path / "in"), 1), "2026-09-05", trust=1, expiry=2)
    query = pipeline.series(parsed, "1 second").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    for n in range(3):
        time.sleep(3)
        land(tmp_path / "in", f"b{n}.txt", line("2024-01-01T00:00:00Z", f"more {n}"))
        query.processAllAvailable()
    query.stop()
    got = spark.table("live").agg(F.sum("total").alias("t"), F.sum("errors").alias("e"), F.sum("strays").alias("s")).first()
    assert got.t >= 4 and got.e == 1 and got.s == got.t
    with pytest.raises(ValueError):
        pipeline.events(pipeline.landing(spark, str(tmp_path / "in")), "2026-09-05", trust=5, expiry=5)


def test_feed_replays_what_failed(spark, tmp_path):
    """Bounded polls by partition; a batch that fails is read again, record for record, after a restart."""
    journal = feed.Journal(str(tmp_path / "journal"))
    records = lambda p, a, b: [{"raw": f"{p} {i} é", "source": p, "received_at": "2026-09-05", "tenant": "t", "more": 1} for i in range(a, b)]
    journal.append("east", records("east", 0, 7))
    journal.append("west", records("west", 0, 3))
    spark.dataSource.register(feed.feed(journal, "journal_feed"))
    seen, fail = {}, threading.Event()

    def batch(df, n):
        rows = sorted((r.partition, r.offset, r.raw, r.source, r.tenant) for r in df.collect())
        seen.setdefault(n, []).append(rows)
        if n == 1 and not fail.is_set():
            fail.set()
            raise RuntimeError("sink is down")

    def start():
        rows = spark.readStream.format("journal_feed").option("position", str(tmp_path / "position.json")).option("per_trigger", 4).option("per_task", 1).load()
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).start()

    query = start()
    with pytest.raises(Exception, match="sink is down"):
        query.processAllAvailable()
    query.stop()
    journal.append("west", records("west", 3, 6))
    query = start()
    query.processAllAvailable()
    query.stop()
    assert len(seen[1]) == 2 and seen[1][0] == seen[1][1] and all(len(tries) == 1 for n, tries in seen.items() if n != 1)
    assert all(len(tries[-1]) <= 4 for tries in seen.values())
    got = sorted(r for tries in seen.values() for r in tries[-1])
    assert got == sorted((p, i, f"{p} {i} é", p, "t") for p, n in (("east", 7), ("west", 6)) for i in range(n))
    journal.append("north", records("north", 0, 2))  # a partition that was not there
    query = start()
    query.processAllAvailable()
    assert json.loads(progress.latest(query)["sources"][0]["endOffset"] if isinstance(progress.latest(query)["sources"][0]["endOffset"], str) else json.dumps(progress.latest(query)["sources"][0]["endOffset"]))["north"] == 2
    query.stop()
    assert sum(len(tries[-1]) for tries in seen.values()) == 15


def test_feed_through_the_pipeline(spark, tmp_path):
    journal = feed.Journal(str(tmp_path / "journal"))
    journal.append("p", [{"raw": line("2026-09-05T10:00:00Z", f"event {i % 5}"), "source": "s"} for i in range(10)])
    spark.dataSource.register(feed.feed(journal, "piped_feed"))
    rows = spark.readStream.format("piped_feed").option("position", str(tmp_path / "position.json")).load().select("raw", F.col("source").alias("source_file"))
    query = pipeline.to_table(pipeline.events(rows, "2026-09-05"), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    query.awaitTermination()
    assert len(stored(spark, tmp_path)) == 5
