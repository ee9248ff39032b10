"""Secret scan over an incremental ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger, Parquet at
a path of the caller's, holds one row for each (blob, rule version) pair already scanned. ``update`` finds the
pairs that the ledger lacks, reads each such blob once (the version with the smallest key stands for all
equal ones), scans it and appends its findings; ``findings`` joins them back to every path that holds the
blob. An update that fails appends nothing, and one that is repeated scans nothing twice.

Only keys and digests are shuffled to find what is unseen; texts of new versions move once, to meet the list of
blobs to scan. The join back is from many paths to one row for each blob, whose hot keys
adaptive execution may split.

Defined results: a null text counts as empty, an empty text has no finding, equal rows give equal
rows, an empty table gives an empty result, a null id is kept. Spans count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from .common import fields, map_rows, sha, spans_text

#: Changing a rule means a new version, so that old blobs are scanned again.
RULE_VERSION = "2"
#: Base kinds in their order, pattern and least length of the part that counts.
BASE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Kinds beyond the base ones.
EXTRA = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "bearer": r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}",
}
FINDINGS = fields(blob=BinaryType(), rule_version=StringType(), n_assign=LongType(), n_access=LongType(), n_hex=LongType(), base_sha256=StringType(), spans=StringType())


def scanner():
    """A function from a text to its base spans and its further ones, each by start, then kind.

    Runs of key characters are taken greedily and whole, so ``{16,}`` and ``{24,}`` keep exactly
    the long ones; an assignment that is too short still uses up its characters.
    """
    assign, least = re.compile(BASE["assign"][0]), BASE["assign"][1]
    runs = [(k, re.compile(BASE[k])) for k in ("access", "hex")]
    extra = [(k, re.compile(p)) for k, p in EXTRA.items()]
    order = {k: i for i, k in enumerate([*BASE, *EXTRA])}

    def scan(text: str):
        base = [("assign", m.start(), m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= least]
        for kind, p in runs:
            base += [(kind, m.start(), m.end()) for m in p.finditer(text)]
        more = [(kind, m.start(), m.end()) for kind, p in extra for m in p.finditer(text)]
        by = lambda s: (s[1], order[s[0]], s[2])
        return sorted(base, key=by), sorted(base + more, key=by)

    return scan


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of each row of ``blobs(blob, text)``."""

    def make():
        scan = scanner()

        def work(ids, texts):
            found = [scan(t or "") for t in texts]
            count = lambda kind: [sum(s[0] == kind for s in base) for base, _ in found]
            return {
                "blob": ids, "rule_version": [rule_version] * len(ids), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "base_sha256": [sha(spans_text(b)) for b, _ in found], "spans": [spans_text(a) for _, a in found],
            }

        return work

    return map_rows(blobs.select("blob", "text"), make, FINDINGS)


def addressed(versions: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, blob): every version with its content's digest."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(F.col(key).alias("doc_id"), content.alias("text")).withColumn("blob", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows, none if nothing has been scanned yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FINDINGS)
    return spark.read.schema(FINDINGS).parquet(path)


def update(versions: DataFrame, path: str, key: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scans the blobs of ``versions`` that the ledger at ``path`` lacks for this rule version, and appends them."""
    spark = versions.sparkSession
    held = addressed(versions, key, text).withColumn("place", F.xxhash64("doc_id", "blob"))
    seen = ledger(spark, path).where(F.col("rule_version") == rule_version).select("blob")
    unseen = held.groupBy("blob").agg(F.min("place").alias("place")).join(seen, "blob", "left_anti")
    # equal versions of one path meet here as equal rows: one of them counts
    wanted = held.join(unseen, ["blob", "place"]).select("blob", "text")
    scan_blobs(wanted, rule_version).dropDuplicates(["blob"]).write.mode("append").option("compression", "zstd").parquet(path)


def findings(versions: DataFrame, path: str, key: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger's findings for every version; null where its blob has not been scanned."""
    paths = addressed(versions, key, text).select("doc_id", "blob")
    known = ledger(versions.sparkSession, path).where(F.col("rule_version") == rule_version)
    return paths.join(known, "blob", "left").select("doc_id", *FINDINGS.names[2:], F.hex("blob").alias("blob"), "rule_version")
