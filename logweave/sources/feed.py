"""Records of any broker as a stream: offsets, replay, bounded polls.

A poller is injected. It has ``partitions()``, names; ``latest(partition)``, the offset behind the last record; and
``read(partition, start, end)``, the records of these offsets, the same each time it is asked: what a broker with
offsets gives by itself, and ``Journal`` to any other. Records are read by tasks, a partition each, never by the driver.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from typing import Protocol

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIELDS = ("raw", "source", "received_at", "tenant")


class Poller(Protocol):
    def partitions(self) -> list[str]: ...

    def latest(self, partition: str) -> int: ...

    def read(self, partition: str, start: int, end: int) -> Iterator[dict]: ...


class Slice(InputPartition):
    def __init__(self, partition: str, start: int, end: int):
        super().__init__((partition, start, end))
        self.partition, self.start, self.end = partition, start, end


class FeedReader(DataSourceStreamReader):
    def __init__(self, poller: Poller, per_trigger: int, per_task: int, position: str):
        self.poller, self.per_trigger, self.per_task, self.position = poller, per_trigger, per_task, position
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: 0 for p in self.poller.partitions()}

    def _known(self) -> dict:
        """Where the query stands, after a restart by what it last told. That is one batch behind at most, and a
        poll is no shorter than a batch, so what is polled next is not before where the query stands."""
        store, path = fs.FileSystem.from_uri(self.position)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return self.initialOffset()
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:  # noqa: N802
        start = self._known() if self.last is None else self.last
        names = sorted({*self.poller.partitions(), *start})
        share = max(1, self.per_trigger // max(1, len(names)))
        self.last = {p: max(start.get(p, 0), min(self.poller.latest(p), start.get(p, 0) + share)) for p in names}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for p in sorted(end):
            a, b = start.get(p, 0), end[p]
            out += [Slice(p, at, min(b, at + self.per_task)) for at in range(a, b, self.per_task)]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        n = 0
        for r in self.poller.read(partition.partition, partition.start, partition.end):
            n += 1
            yield (*(r.get(f) for f in FIELDS), partition.partition, partition.start + n - 1)
        if n != partition.end - partition.start:
            raise OSError(f"{partition.partition}: {n} records of {partition.start} to {partition.end}")

    def commit(self, end: dict) -> None:
        store, path = fs.FileSystem.from_uri(self.position)
        store.create_dir(posixpath.dirname(path), recursive=True)
        name = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(name) as f:
            f.write(json.dumps(end).encode())
        store.move(name, path)


def feed(poller: Poller, name: str = "logweave_feed") -> type[DataSource]:
    """A stream format over ``poller``, for ``spark.dataSource.register``. Options: ``position``, a path of its own for each
    query; ``per_trigger``, records of a batch at most (10,000); ``per_task``, records of a task at most (5,000)."""

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "raw string, source string, received_at string, tenant string, partition string, offset long"

        def streamReader(self, schema) -> FeedReader:  # noqa: N802
            get = self.options.get
            return FeedReader(poller, int(get("per_trigger", 10_000)), int(get("per_task", 5_000)), self.options["position"])

    return Feed


class Journal:
    """A poller over records that were pushed once: each batch is a file, named by the offsets it holds, and is seen whole or
    not at all. One process appends to a partition."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _files(self, partition: str | None = None) -> list[tuple[str, int, int, str]]:
        store, path = fs.FileSystem.from_uri(self.root)
        out = []
        for f in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            folder, base = posixpath.split(f.path)
            if f.type == fs.FileType.File and base.endswith(".jsonl") and not base.startswith(".") and partition in (None, posixpath.basename(folder)):
                a, b = base.removesuffix(".jsonl").split("-")
                out.append((posixpath.basename(folder), int(a), int(b), f.path))
        return sorted(out)

    def append(self, partition: str, records: list[dict]) -> int:
        start = self.latest(partition)
        store, path = fs.FileSystem.from_uri(self.root)
        store.create_dir(f"{path}/{partition}", recursive=True)
        hidden = f"{path}/{partition}/.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write("".join(json.dumps(r) + "\n" for r in records).encode())
        store.move(hidden, f"{path}/{partition}/{start:020d}-{start + len(records):020d}.jsonl")
        return start + len(records)

    def partitions(self) -> list[str]:
        return sorted({p for p, *_ in self._files()})

    def latest(self, partition: str) -> int:
        return max((b for _, _, b, _ in self._files(partition)), default=0)

    def read(self, partition: str, start: int, end: int) -> Iterator[dict]:
        store, _ = fs.FileSystem.from_uri(self.root)
        for _, a, b, path in self._files(partition):
            if a < end and b > start:
                with store.open_input_stream(path) as f:
                    for n, line in enumerate(f.read().decode().splitlines(), a):
                        if start <= n < end:
                            yield json.loads(line)
