"""Files of any shape as records (source_file, source_record, raw)."""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logweave.functions.normalize import to_map
from logweave.functions.rules import RECORD_START
from logweave.storage import stored

#: Rows and bytes of a batch of records given to Spark, about; bytes of a row group of stored records.
BATCH_ROWS, BATCH_BYTES, GROUP = 10_000, 8 * 2**20, 16 * 2**20


def relative(path, root: str):
    """A path below ``root``, which may have a scheme or not."""
    plain, top = F.regexp_replace(path, r"^\w+:/*", "/"), re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    return F.when(plain.startswith(top), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)


def scan(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """The lines of a tree of files, with file, folder and where in the file they stand."""
    text = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = text.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return out.withColumn("source_file", relative(F.col("_path"), root)).withColumn("source_folder", F.element_at(F.split("_path", "/"), -2)).drop("_path")


def reassemble(lines: DataFrame) -> DataFrame:
    """S3: records of several lines: a line that looks like a start opens one, blank ones are dropped.

    Each block of a file is a window of its own, so a large file is many tasks; what a block holds before its
    first start is given to the last record of the blocks before. Records are numbered by running sums: a count for
    each block, whose sums by file are a row for each block, and a place within the block. Text moves once, to
    its record; only blocks' ends meet.
    """
    known = lines.where(F.trim("line") != "").withColumn("_start", F.col("line").rlike(RECORD_START).cast("int"))
    order = Window.partitionBy("source_file", "block").orderBy("line_no")
    own = known.withColumn("_n", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the first lines of a file open a record even if they do not look like a start
    blocks = known.groupBy("source_file", "block").agg(F.sum("_start").alias("_starts"), F.min_by("_start", "line_no").alias("_opens"))
    by_file = Window.partitionBy("source_file").orderBy("block")  # a row for each block
    before = blocks.select(
        "source_file", "block", F.coalesce(F.sum("_starts").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        (1 - F.first("_opens").over(by_file.rowsBetween(Window.unboundedPreceding, 0))).alias("_orphan"),
    )
    numbered = own.join(before, ["source_file", "block"]).withColumn("source_record", (F.col("_before") + F.col("_n") + F.col("_orphan")).cast("long"))
    whole = numbered.groupBy("source_file", "source_record").agg(F.array_sort(F.collect_list(F.struct("block", "line_no", "line"))).alias("l"))
    return whole.select("source_file", "source_record", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw"))


def _pieces():
    """The records of each block of each file, from its lines in their order, as ``mapInArrow`` gives them: numbered from 1 within
    the block, and as 0 what it holds before its first start. Only the record that is open is held."""

    def piece(file: str, block: int, numbers, raw) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(raw)), pa.repeat(pa.scalar(block, pa.int64()), len(raw)), pa.array(numbers, pa.int64()), raw], ["source_file", "_block", "_n", "raw"])

    def found(batches):
        file, block, n, held = None, None, 0, []  # held: lines of the open record, which is the n-th of its block
        for b in batches:
            files, blocks, starts, lines = (b.column(c) for c in ("source_file", "_block", "_start", "line"))
            if not b.num_rows:
                continue
            other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
            ends = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
            opens = starts.to_numpy(zero_copy_only=False)
            for i, j in zip(ends, ends[1:]):  # a block of a file
                if (files[i].as_py(), blocks[i].as_py()) != (file, block):
                    if held:
                        yield piece(file, block, [n], pa.array(["\n".join(held)]))
                    file, block, n, held = files[i].as_py(), blocks[i].as_py(), 0, []
                at = np.flatnonzero(opens[i:j]) + i
                if not len(at):
                    held += lines[i:j].to_pylist()
                    continue
                held += lines[i : at[0]].to_pylist()
                if held:
                    yield piece(file, block, [n], pa.array(["\n".join(held)]))
                if len(at) > 1:
                    own = lines[at[0] : at[-1]]
                    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.concat_arrays([own])), "\n")
                    yield piece(file, block, np.arange(n + 1, n + len(at)), whole)
                n, held = n + len(at), lines[at[-1] : j].to_pylist()
        if held:
            yield piece(file, block, [n], pa.array(["\n".join(held)]))

    def together(batches):
        some, rows, size = [], 0, 0
        for p in found(batches):
            some.append(p)
            rows, size = rows + p.num_rows, size + p.nbytes
            if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, rows, size = [], 0, 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return together


def read_text(spark: SparkSession, paths, root: str) -> DataFrame:
    """The records of ``reassemble``, of files read where they lie: a task puts the lines of a block together as it reads
    them, so none is sorted or moved. Only pieces of records that go on in the next block meet."""
    text = spark.read.text(paths).where(F.trim("value") != "")
    lines = text.select(relative(F.col("_metadata.file_path"), root).alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").rlike(RECORD_START).alias("_start"), F.col("value").alias("line"))
    pieces = stored(lines.mapInArrow(_pieces(), "source_file string, _block long, _n long, raw string"), "pieces", GROUP)
    blocks = pieces.groupBy("source_file", "_block").agg(F.max("_n").alias("_starts"), (F.min("_n") == 0).alias("_goes_on"))
    by_file = Window.partitionBy("source_file").orderBy("_block")  # a row for each block
    before = F.coalesce(F.sum("_starts").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first lines of a file open a record even if they do not look like a start
    orphan = F.first("_goes_on").over(by_file.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    known = blocks.select(
        "source_file", "_block", "_starts", (before + orphan).alias("_before"), (F.col("_goes_on") & F.lag("_block").over(by_file).isNotNull()).alias("_head"),
        F.coalesce(F.lead("_goes_on").over(by_file), F.lit(False)).alias("_tail"),
    )
    numbered = pieces.join(stored(known, "blocks"), ["source_file", "_block"])
    cut = ((F.col("_n") == 0) & F.col("_head")) | ((F.col("_n") == F.col("_starts")) & F.col("_tail"))
    numbered = numbered.select("source_file", "_block", (F.col("_n") + F.col("_before")).cast("long").alias("source_record"), "raw", cut.alias("_cut"))
    parts = numbered.where("_cut").groupBy("source_file", "source_record").agg(F.array_sort(F.collect_list(F.struct("_block", "raw"))).alias("l"))
    joined = parts.select("source_file", "source_record", F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("raw"))
    return numbered.where("not _cut").select("source_file", "source_record", "raw").unionByName(joined)


def sniff(name, head):
    """The format of a file by its name, if that is telling, else by its first letters."""
    ext = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    t = F.ltrim(F.regexp_replace(head, "^﻿", ""))
    first = F.split(t, "\n")[0]
    commas = F.length(first) - F.length(F.replace(first, F.lit(","), F.lit("")))
    second = F.get(F.split(t, "\n"), 1)
    return (
        F.when(ext.isin("csv", "tsv", "xml"), ext).when(ext == "json", "json").when(ext.isin("jsonl", "ndjson"), "jsonl")
        .when(t.startswith("<") & ~t.rlike(r"^<\d{1,3}>"), "xml").when(t.startswith("["), F.when(t.rlike(r"^\[\s*\{"), "json").otherwise("text"))
        .when(t.startswith("{"), F.when(second.startswith("{"), "jsonl").otherwise("json")).when(F.substring(t, 1, 200).rlike(r"(CEF|LEEF):\d"), "text")
        .when((commas >= 2) & first.rlike(r"^[A-Za-z_][\w ]*(,[A-Za-z_][\w ]*)+\s*$") & (F.length(second) - F.length(F.replace(second, F.lit(","), F.lit(""))) >= commas), "csv").otherwise("text")
    )


def file_formats(spark: SparkSession, root: str, head: int = 2048) -> DataFrame:
    """The format of each file by its name or first letters. Contents are not read whole: of each file the block
    that begins it is scanned, and its first lines are kept."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return names.join(_heads(spark, root, head), "path", "left").select("path", sniff(F.col("path"), F.coalesce("head", F.lit(""))).alias("format"))


def _heads(spark: SparkSession, root: str, head: int) -> DataFrame:
    """(path, head): the first lines of each file. Where they begin is a row for each file, stored, so that its size is known
    and lines that are not kept are neither sorted nor moved."""
    text = spark.read.format("text").option("recursiveFileLookup", True).load(root)
    first = text.where(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.substring("value", 1, head).alias("value"))
    least = stored(first.groupBy("path").agg(F.min("at").alias("least")), "least")
    early = first.join(least, "path").where(F.col("at") < F.col("least") + 64)
    lines = early.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("l"))
    return lines.select("path", F.substring(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), 1, head).alias("head"))


def _records(df: DataFrame, root: str, raw) -> DataFrame:
    """Numbers the records of each file: a place within its block, and running sums of the blocks' counts, so that a large
    file is many tasks where its format can be split.

    A block is read by one task from its first record to its last, so its records are numbered as they are read: they are
    stored with that, and only counts of blocks are put in order. These are stored too: their size is known then, and if it is
    small, no record is moved to meet them."""
    block = F.coalesce("_block", F.lit(0)) if "_block" in df.columns else F.lit(0)
    named = df.select(relative(F.col("_path"), root).alias("source_file"), block.cast("long").alias("_block"), F.monotonically_increasing_id().alias("_at"), raw.alias("raw"))
    named = stored(named, "records", GROUP)
    counts = named.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    shifts = stored(counts.select("source_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift")), "shifts")
    out = named.join(shifts, ["source_file", "_block"])
    return out.select("source_file", (F.col("_at") + F.col("_shift")).cast("long").alias("source_record"), "raw")


def _headers(spark: SparkSession, paths) -> list[list[str]]:
    """Paths of CSV files, those with the same header together; a file without a line is left out."""
    head = spark.read.text(paths).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    text = head.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    least = stored(text.groupBy("path").agg(F.min("at").alias("at")), "least")  # and then its line: texts are grouped by sorting them
    groups: dict[tuple[str, str], list[str]] = {}
    for r in text.join(least, ["path", "at"]).select("path", F.col("value").alias("first")).sort("path").toLocalIterator():  # a row for each file
        own = r.path if r.first.count('"') % 2 else ""  # goes on in the next line
        groups.setdefault((r.first, own), []).append(unquote(r.path))
    return list(groups.values())


def _surplus(n: int, sep: str):
    """The cells of a record behind the first ``n``, a batch at a time; only rows of another length are split."""

    @F.pandas_udf("array<string>")
    def cells(records: pd.Series) -> pd.Series:
        behind = lambda r: next(csv.reader(io.StringIO(r, newline=""), delimiter=sep), [])[n:] or None
        return records.map(behind, na_action="ignore").astype(object).where(records.notna(), None)

    return cells


def read_csv(spark: SparkSession, paths, root: str, sep: str = ",") -> DataFrame:
    """Rows as JSON records under the header of their own file; what a row has beyond it goes to
    ``_extra_columns``, a list."""
    out = None
    for own in _headers(spark, paths):
        reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE")
        columns = reader.csv(own[0]).columns
        n = len(columns)

        # Spark keeps the record where the number of cells is not that of the header
        schema = StructType([StructField(c, StringType()) for c in [*columns, "_logweave_record"]])
        df = reader.schema(schema).option("columnNameOfCorruptRecord", "_logweave_record").csv(own)
        extra = _surplus(n, sep)(F.col("_logweave_record")).alias("_extra_columns")
        named = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
        rows = df.select(F.to_json(F.struct(*named, extra)).alias("raw"), F.col("_metadata.file_path").alias("_path"))
        part = _records(rows, root, F.col("raw"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "source_file string, source_record long, raw string") if out is None else out


def read_xml(spark: SparkSession, paths, root: str, row_tag: str = "Event") -> DataFrame:
    """A JSON record for each ``row_tag``: one level flat, and named values under their names."""
    from pyspark.sql.types import ArrayType

    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(paths)
    df = df.select("*", F.col("_metadata.file_path").alias("_path"))
    entries = []

    def walk(kind, path: str) -> None:
        for f in kind.fields:
            c = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            key = f.name.lstrip("_")
            if key == "path" and not path:
                continue
            if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType) and {"_Name", "_VALUE"} <= set(f.dataType.elementType.names):
                entries.append(F.transform(F.col(c), lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value"))))
            elif isinstance(f.dataType, StructType):
                walk(f.dataType, c)
            else:
                value = F.col(c).cast("string") if not isinstance(f.dataType, ArrayType) else F.to_json(F.col(c))
                name = path.split(".")[-1].strip("`") if key == "VALUE" else key
                entries.append(F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))))

    walk(StructType([f for f in df.schema.fields if f.name != "_path"]), "")
    pairs = F.filter(F.concat(*(F.coalesce(e, F.array().cast("array<struct<key:string,value:string>>")) for e in entries)), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return _records(df, root, F.to_json(to_map(pairs, last=False)))


def read_json(spark: SparkSession, paths, root: str) -> DataFrame:
    """A document, an array, or a wrapper with ``logs``, ``records`` or ``events``; a record each."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("value"))
    wrapped = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in ("logs", "records", "events")))
    array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(wrapped)
    each = F.coalesce(F.from_json(array, "array<string>"), F.array("value"))
    return _records(text.select("_path", F.explode(each).alias("_r")), root, F.col("_r"))


def read_lines(spark: SparkSession, paths, root: str) -> DataFrame:
    """JSON lines; blank ones are dropped."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"))
    return _records(text.where(F.trim("value") != ""), root, F.col("value"))


def read_any(spark: SparkSession, root: str) -> DataFrame:
    """Every file of a tree by its own format, as one table. Paths of a format go to its reader."""
    found: dict[str, list[str]] = {}
    for r in file_formats(spark, root).toLocalIterator():  # a row for each file
        found.setdefault(r.format, []).append(r.path)
    parts = []
    for kind, paths in sorted(found.items()):
        if kind in ("csv", "tsv"):
            parts.append(read_csv(spark, paths, root, "\t" if kind == "tsv" else ","))
        elif kind == "xml":
            parts.append(read_xml(spark, paths, root))
        elif kind == "json":
            parts.append(read_json(spark, paths, root))
        elif kind == "jsonl":
            parts.append(read_lines(spark, paths, root))
        else:
            parts.append(read_text(spark, paths, root))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_parsed(spark: SparkSession, paths, schema) -> DataFrame:
    """Parsed events from JSON lines, compressed or not; lines that cannot be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
