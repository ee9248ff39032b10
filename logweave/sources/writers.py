"""Lines as files that are rotated by bytes, with a commit of the whole job.

Tasks write under a folder of the job; the files appear in the target when all tasks are done, and vanish if the job fails. A
task that is run twice leaves nothing twice: only the files that its successful attempt names are moved.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed value: bytes of a file at most, but for a line that is longer.
LARGEST = 64 * 2**20


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    lines: int


class RotatingWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.largest, self.suffix = int(options.get("largest", LARGEST)), options.get("suffix", ".jsonl")
        self.packed, self.job = options.get("compression", "none") == "gzip", uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, path = fs.FileSystem.from_uri(self.root)
        return store, path, f"{path}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, place = self._place()
        store.create_dir(place, recursive=True)
        task, files, count, size, out = TaskContext.get(), [], 0, 0, None
        for b in iterator:
            for v in b.column(0).to_pylist():
                if v is None:
                    continue
                line = v.encode("utf-8", "surrogatepass") + b"\n"
                if out is None or size + len(line) > self.largest:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{len(files):04d}-{task.taskAttemptId()}{self.suffix}{'.gz' if self.packed else ''}"
                    files.append(f"{place}/{name}")
                    out, size = store.open_output_stream(files[-1], compression="gzip" if self.packed else None), 0
                out.write(line)
                size, count = size + len(line), count + 1
        if out is not None:
            out.close()
        return Written(files, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, place = self._place()
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            for f in m.files if m else []:
                store.move(f, f"{path}/{posixpath.basename(f)}")
        store.create_dir(place, recursive=True)
        store.delete_dir(place)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, place = self._place()
        store.create_dir(place, recursive=True)
        store.delete_dir(place)


class Rotating(DataSource):
    """Options: ``path``, ``largest`` (bytes before compression), ``suffix``, ``compression`` (none or gzip)."""

    @classmethod
    def name(cls) -> str:
        return "logweave_rotating"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> RotatingWriter:
        return RotatingWriter(dict(self.options), overwrite)


def write_rotating(lines: DataFrame, path: str, largest: int = LARGEST, compression: str = "none", suffix: str = ".jsonl", mode: str = "append") -> None:
    """The column ``value`` of ``lines`` as files of at most ``largest`` bytes."""
    lines.sparkSession.dataSource.register(Rotating)
    uri = path if ":/" in path else f"file://{path}"
    out = lines.select("value").write.format("logweave_rotating").options(largest=str(largest), compression=compression, suffix=suffix)
    out.mode(mode).save(uri)
