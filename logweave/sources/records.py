"""S3: records of several lines, read by ranges of bytes as a text input reads lines: no text is shuffled.

A line that looks like a start opens a record; the lines behind it, up to LONGEST bytes from where it begins, belong to it, and blank ones are
dropped. Lines that no start is near enough to are records of their own, those of one stretch of LONGEST bytes together: so
a file without any start is no single record, and neither are the lines at the head of a file lost. To which record a
line belongs is told by the 2 * LONGEST bytes before it, so each range is read alone: a task looks back so far, and past its end
to where its last record ends.

Records are numbered within their file: ranges are counted first, a row for each, and each range is told the number of
records before it.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logweave.functions.rules import RECORD_START
from logweave.storage import new_path

#: Bytes of a range, from a record's first line to its last, of a read, of a batch given to Spark, and of the ranges of a task: short
#: ranges are read one after the other.
RANGE, LONGEST, READ, BATCH, TASK = 128 * 2**20, 2**20, 2**20, 8 * 2**20, 8 * 2**20
PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Range(InputPartition):
    """Ranges of ``step`` bytes of a file from ``start`` on, the last of which begins before ``stop``."""

    file: str
    name: str
    start: int
    stop: int
    step: int
    before: int = 0


def lines(stream, at: int, read: int = READ) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of all lines from where ``stream`` stands, at ``at``."""
    held, parts = at, []
    while data := stream.read(read):
        first, *others = data.split(b"\n")
        parts.append(first)
        for nxt in others:
            line = b"".join(parts)
            yield held, line
            held, parts = held + len(line) + 1, [nxt]
    if line := b"".join(parts):
        yield held, line


def records(found: Iterator[tuple[int, bytes]], start: int, end: int, longest: int, opens: re.Pattern) -> Iterator[tuple[int, str]]:
    """(offset, text) of the records that begin in [start, end)."""
    first, strong, texts = -1, False, []
    for at, line in found:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if not text.strip(" "):
            continue
        begins = opens.match(text) is not None
        near = first >= 0 and (at - first < longest if strong else at // longest == first // longest)
        if begins or not near:
            if first >= start:
                yield first, "\n".join(texts)
            if at >= end:
                return
            first, strong, texts = at, begins, [text]
        elif first >= start:
            texts.append(text)
    if first >= start:
        yield first, "\n".join(texts)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")
        self.range, self.longest = int(options.get("range_bytes", RANGE)), int(options.get("longest", LONGEST))
        self.counts, self.opens = options.get("counts"), options.get("opens", RECORD_START)

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self.root)
        before = {}
        if self.counts:
            at, folder = fs.FileSystem.from_uri(self.counts)
            t = pq.read_table(folder, filesystem=at)
            before = {(f, b): n for f, b, n in zip(*(t.column(c).to_pylist() for c in ("source_file", "block", "before")), strict=True)}
        out = []
        for f in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path):
            base = posixpath.basename(f.path)
            if f.type != fs.FileType.File or base.startswith((".", "_")) or not fnmatch.fnmatch(base, self.pattern):
                continue
            name = posixpath.relpath(f.path, path)
            step = max(1, f.size) if base.endswith(PACKED) else self.range
            task = step * max(1, TASK // step)
            out += [Range((f.path), name, a, min(a + task, f.size), step, before.get((name, a), 0)) for a in range(0, f.size, task)]
        return out or [Range("", "", 0, 0, 1)]

    def _found(self, p: Range, start: int) -> Iterator[tuple[int, str]]:
        """The records of one range."""
        store, _ = fs.FileSystem.from_uri(self.root)
        end, read = start + p.step, min(READ, p.step + 2 * self.longest)
        opens = re.compile(self.opens)
        if p.file.endswith(PACKED):
            with store.open_input_stream(p.file) as f:  # unpacked by its name
                yield from records(lines(f, 0), 0, 1 << 62, self.longest, opens)
            return
        with store.open_input_file(p.file) as f:
            back = max(0, start - 2 * self.longest)
            if back:
                f.seek(back - 1)  # from the first line that begins at or behind ``back``
            own = lines(f, back - 1 if back else 0, read)
            if back:
                next(own, None)
            yield from records(own, start, end, self.longest, opens)

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if p.file:
            yield from (self._numbered(p) if self.counts else self._counted(p))

    def _counted(self, p: Range) -> Iterator[pa.RecordBatch]:
        starts = range(p.start, p.stop, p.step)
        counts = [sum(1 for _ in self._found(p, a)) for a in starts]
        yield pa.RecordBatch.from_pydict({"source_file": [p.name] * len(counts), "block": pa.array(starts, pa.int64()), "records": pa.array(counts, pa.int64())})

    def _numbered(self, p: Range) -> Iterator[pa.RecordBatch]:
        texts, size, n = [], 0, p.before

        def batch() -> pa.RecordBatch:
            numbers = pa.array(range(n - len(texts) + 1, n + 1), pa.int64())
            folder = posixpath.basename(posixpath.dirname(p.file))
            return pa.RecordBatch.from_pydict({"source_file": [p.name] * len(texts), "source_folder": [folder] * len(texts), "source_record": numbers, "raw": texts})

        for text in (t for a in range(p.start, p.stop, p.step) for _, t in self._found(p, a)):
            texts.append(text)
            size, n = size + len(text), n + 1
            if size > BATCH:
                yield batch()
                texts, size = [], 0
        if texts:
            yield batch()


class Records(DataSource):
    """Options: ``path``, ``pattern``, ``range_bytes``, ``longest``, ``opens``; with ``counts``, a table of (source_file, block,
    before), records, else the number of records of each range."""

    @classmethod
    def name(cls) -> str:
        return "logweave_records"

    def schema(self) -> str:
        if self.options.get("counts"):
            return "source_file string, source_folder string, source_record long, raw string"
        return "source_file string, block long, records long"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, root: str, pattern: str = "*", range_bytes: int = RANGE, longest: int = LONGEST) -> DataFrame:
    """(source_file, source_folder, source_record, raw) of a tree of text files."""
    spark.dataSource.register(Records)
    options = {"pattern": pattern, "range_bytes": str(range_bytes), "longest": str(longest)}
    uri = root if re.match(r"^\w+:", root) else f"file://{root}"
    counts = spark.read.format("logweave_records").options(**options).load(uri)
    order = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    place = new_path(spark, "ranges")
    counts.select("source_file", "block", F.coalesce(F.sum("records").over(order), F.lit(0)).alias("before")).write.parquet(place)
    return spark.read.format("logweave_records").options(**options).option("counts", place).load(uri)
