"""Records by ranges of bytes and files rotated by bytes, against plain readings."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.rules import RECORD_START
from logweave.operators import exports
from logweave.sources import readers, records, writers


def plain(data: bytes, longest: int):
    """The rule of records in one go over a whole file."""
    out, last, at, own = [], None, 0, None
    for line in data.split(b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r")
        here, at = at, at + len(line) + 1
        if not text.strip(" "):
            continue
        if re.match(RECORD_START, text):
            last, own = here, ("start", here)
        elif last is None or here - last >= longest:
            own, last = ("cell", here // longest), None
        if out and out[-1][0] == own:
            out[-1][1].append(text)
        else:
            out.append((own, [text]))
    return ["\n".join(t) for _, t in out]


def stack(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice([f"2026-09-03T09:00:{rng.randrange(60):02d}Z h message {rng.randrange(9)}", "  at frame " + "x" * rng.randrange(60), "", "plain é", "\ttab\r"]))
    return "\n".join(out).encode()


@pytest.mark.parametrize(("size", "longest"), [(64, 40), (97, 200), (1000, 100), (10**6, 2**20), (50, 1)])
def test_ranges_give_the_records_of_the_whole(size, longest):
    rng, opens = random.Random(size), re.compile(RECORD_START)
    for n in (1, 5, 60, 200):
        data = stack(rng, n)
        got = []
        for a in range(0, max(1, len(data)), size):
            back = max(0, a - 2 * longest)
            import io

            f = io.BytesIO(data)
            f.seek(max(0, back - 1))
            own = records.lines(f, back - 1 if back else 0)
            if back:
                next(own, None)
            got += [t for _, t in records.records(own, a, a + size, longest, opens)]
        assert got == plain(data, longest)


def test_records_source(spark, tmp_path, monkeypatch):
    """A file of several ranges, one without a start, an empty one, a packed one, numbered as by the form that shuffles."""
    text = "\n".join(f"2026-09-03T09:00:{i % 60:02d}Z h event {i}\n  more {i}" for i in range(300)) + "\n"
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("head of no record\n" + text)
    (tmp_path / "in/deep/b.txt").write_text("".join(f"nothing starts here {i}\n" for i in range(200)))
    (tmp_path / "in/empty.txt").write_text("")
    (tmp_path / "in/c.txt.gz").write_bytes(gzip.compress(text.encode()))
    got = records.read_records(spark, str(tmp_path / "in"), "*.txt*", range_bytes=1000, longest=400)
    assert "Exchange" not in got._jdf.queryExecution().toString().split("Physical Plan")[-1]
    rows = got.collect()
    by = lambda f: [r.raw for r in sorted((r for r in rows if r.source_file == f), key=lambda r: r.source_record)]
    want = [f"2026-09-03T09:00:{i % 60:02d}Z h event {i}\n  more {i}" for i in range(300)]
    assert by("a.txt") == ["head of no record", *want] and by("c.txt.gz") == want
    assert 1 < len(by("deep/b.txt")) < 200 and "\n".join(by("deep/b.txt")).count("nothing starts") == 200
    for f in ("a.txt", "c.txt.gz", "deep/b.txt"):
        assert sorted(r.source_record for r in rows if r.source_file == f) == list(range(1, len(by(f)) + 1))
    assert {r.source_folder for r in rows} == {"in", "deep"}
    other = readers.reassemble(readers.scan(spark, str(tmp_path / "in"), "a.txt"))
    assert sorted((r.source_record, r.raw) for r in other.collect()) == sorted((r.source_record, r.raw) for r in rows if r.source_file == "a.txt")
    (tmp_path / "none").mkdir()
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0


def test_texts_of_a_tree_are_not_moved(spark, tmp_path, monkeypatch):
    """Records of ``read_any`` are those of the form that shuffles, over blocks of a few lines: files with and without starts,
    blank ones, one that goes on over many blocks. No record is sorted or shuffled to be numbered."""
    rng = random.Random(8)
    (tmp_path / "in/deep").mkdir(parents=True)
    for n in range(3):
        (tmp_path / f"in/deep/{n}.log").write_bytes(stack(rng, 150 + n))
    (tmp_path / "in/none.log").write_text("".join(f"nothing starts here {i}\n" for i in range(60)))
    (tmp_path / "in/late.log").write_text("\n \n" + "  more\n" * 50 + "2026-09-03T09:00:00Z h a\n" + "  more\n" * 90 + "2026-09-03T09:00:01Z h b")
    (tmp_path / "in/one.log").write_text("2026-09-03T09:00:00Z h alone\n")
    (tmp_path / "in/empty.log").write_text("")
    (tmp_path / "in/packed.log.gz").write_bytes(gzip.compress(stack(rng, 99)))
    (tmp_path / "in/rows.csv").write_text("host,user,code\n" + "".join(f"h{i},u{i},{i}\n" for i in range(100)))
    (tmp_path / "in/lines.jsonl").write_text("".join(f'{{"a":{i}}}\n' for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    monkeypatch.setattr(readers, "BATCH_ROWS", 20, raising=False)
    try:
        got = readers.read_any(spark, str(tmp_path / "in"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        by = lambda df: sorted((r.source_file, r.source_record, r.raw) for r in df.collect())
        found, want = by(got), by(readers.reassemble(readers.scan(spark, str(tmp_path / "in"), "*.log*")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r for r in found if ".log" in r[0]] == want and len(want) > 60 and max(r[2].count("\n") for r in want) >= 90
    assert [r[1:] for r in found if r[0] == "rows.csv"] == [(i + 1, f'{{"host":"h{i}","user":"u{i}","code":"{i}"}}') for i in range(100)]
    assert [r[1:] for r in found if r[0] == "lines.jsonl"] == [(i + 1, f'{{"a":{i}}}') for i in range(100)]
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_rotation_and_abort(spark, tmp_path):
    lines = spark.range(500).select(F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value")).unionAll(spark.createDataFrame([("y" * 900,), (None,)], "value string"))
    writers.write_rotating(lines.repartition(3), str(tmp_path / "out"), largest=700)
    sizes = [len(p.read_bytes()) for p in (tmp_path / "out").iterdir()]
    assert sorted(sizes)[-1] == 901 and sorted(sizes)[-2] <= 700 and len(sizes) >= 9
    assert spark.read.text(str(tmp_path / "out")).count() == 501
    writers.write_rotating(lines.limit(1), str(tmp_path / "out"), mode="overwrite", compression="gzip")
    assert [p.suffix for p in (tmp_path / "out").iterdir()] == [".gz"] and spark.read.text(str(tmp_path / "out")).count() == 1
    bad = lines.select(F.when(F.col("value").contains("99"), F.raise_error(F.lit("broken"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        writers.write_rotating(bad, str(tmp_path / "out"), largest=700)
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_dead_letters_are_kept(spark, tmp_path):
    def post(lines):
        if any("bad" in x for x in lines):
            raise OSError("no")

    lines = spark.createDataFrame([("ok",)] * 5 + [("bad",)], "value string").coalesce(1)
    for n in (1, 2):
        sent = exports.send(lines, post, batch=2, retries=2, backoff=0, dead_letters=str(tmp_path / "dead")).first()
        assert (sent.sent, sent.dead) == (4, 2)
        kept = spark.read.parquet(str(tmp_path / "dead"))
        assert sorted(r.value for r in kept.collect()) == sorted(["bad", "ok"] * n) and {r.error for r in kept.collect()} == {"OSError: no"}
    assert exports.send(lines.limit(0), post).first().sent == 0


def test_many_dead_letters(spark, tmp_path):
    """What is told of single lines goes back to Spark in batches, not each as a table of its own."""
    import time

    def post(part):
        if part[0].endswith("7"):
            raise OSError("refused")

    lines = spark.range(30_000).selectExpr("cast(id as string) as value").coalesce(1)
    exports.send(lines.limit(10), post, batch=1, retries=1, backoff=0).collect()  # workers are up
    start = time.monotonic()
    sent = exports.send(lines, post, batch=1, retries=2, backoff=0, dead_letters=str(tmp_path / "dead")).first()
    assert time.monotonic() - start < 25
    assert (sent.sent, sent.dead) == (27_000, 3_000)
    assert spark.read.parquet(str(tmp_path / "dead")).where("value like '%7' and error = 'OSError: refused'").count() == 3_000
