"""Tables that jobs write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, a folder of this machine, if driver and executors are one
    process on it; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='logweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/logweave/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """``df`` written and read again: cuts lineage, and survives lost executors. A task holds a row group as it writes or reads
    it, on the heap and once more outside of it: ``group`` is its bytes, if others than Spark's 128 MB."""
    path = new_path(df.sparkSession, name)
    (df.write if group is None else df.write.option("parquet.block.size", group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, whole, or None if there is none."""
    at, store = _path(spark, path)
    if not store.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first().value


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in the place of another; a reader finds one of them."""
    at, store = _path(spark, path)
    new, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(new, True)
    stream.write(text.encode())
    stream.close()
    # a rename does not replace on every file system
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context.rename(store.makeQualified(new), store.makeQualified(at), how)
