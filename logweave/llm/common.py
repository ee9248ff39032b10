"""What the operators share: Arrow-batched text maps and tables in the shared folder.

Every text map reads two columns, an id and a text, so extra columns of the input
(whatever their names) never reach Python and cannot clash with an operator's own.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Rows and bytes of one Arrow batch at most (and one row): whole texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def configure(spark: SparkSession) -> SparkSession:
    """Sets the Arrow batch size that the text maps count on (it is read when a plan runs, so it stays set),
    and sends this package to the executors once for each context, for clusters where it is not installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if not getattr(context, "_logweave_sent", False):
        root = Path(__file__).resolve().parents[2]
        to = Path(tempfile.mkdtemp(prefix="logweave-")) / "logweave.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((root / "logweave").rglob("*.py")):
                z.write(p, p.relative_to(root))
        context.addPyFile(str(to))
        context._logweave_sent = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set, one of this
    machine, if driver and executors are one process on it; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='logweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/logweave/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fields(**types) -> StructType:
    return StructType([StructField(k, v) for k, v in types.items()])


def map_rows(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: StructType) -> DataFrame:
    """mapInArrow where ``make()``, called once a task, gives a function from a batch's columns
    (Python lists, in order) to a dict of equally long lists, or None for no rows."""
    arrow = to_arrow_schema(schema)
    configure(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(*(c.to_pylist() for c in batch.columns))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row out for each row in: the id, then the columns that ``make()`` gives for the texts."""
    chosen = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    full = StructType([StructField("doc_id", chosen.schema["doc_id"].dataType), *schema.fields])

    def both():
        work = make()
        return lambda ids, texts: {"doc_id": ids} | work(texts)

    return map_rows(chosen, both, full)


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def row_key(*cols) -> F.Column:
    """A 64-bit key of a row that is the same however often the row is read."""
    return F.xxhash64(*cols).cast(LongType())
