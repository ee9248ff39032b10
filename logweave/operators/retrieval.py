"""Vector, keyword and substring search over events or texts, and what is made of their hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.storage import stored


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*map(F.lit, map(float, query)))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / (norm * float(sum(x * x for x in query) ** 0.5))


def vector_search(rows: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest by cosine among those that pass ``where``; exact, so nothing is fetched in excess."""
    rows = rows if where is None else rows.where(where)
    scored = rows.where(F.size(vector) == len(query)).select(key, cosine(F.col(vector), query).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)


def keyword_search(rows: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R2: BM25 over the words of ``query`` longer than two letters; a row needs one of them.

    Texts are split once: what is stored of a row is its length and how often it holds each word of the query. Lengths
    are summed over all rows, and only rows that hold a word are shuffled.
    """
    words = sorted(set(re.findall(r"[a-z0-9]{3,}", query.lower())))
    own = rows.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    held = F.transform(F.array(*map(F.lit, words)), lambda w: F.struct(w.alias("w"), F.size(F.filter("t", lambda x: x == w)).alias("tf")))
    own = stored(own.select(key, F.size("t").alias("len"), F.filter(held, lambda x: x["tf"] > 0).alias("held")), "term_counts")
    stats = own.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    tf = own.select(key, "len", F.explode("held").alias("s")).select(key, "len", "s.w", "s.tf")
    df = tf.groupBy("w").agg(F.count("*").alias("df"))  # a row for each word of the query
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(df), "w").join(F.broadcast(stats)).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("words")).orderBy(F.desc("score"), key).limit(k)


def longest_word(query: str) -> str:
    """The longest word of more than three letters in lower case, or all of the query."""
    words = [w for w in re.findall(r"\w+", query) if len(w) > 3]
    return max(words, key=len).lower() if words else query.lower()


def substring_search(log: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Events that hold the longest word of the query of more than three letters, the worst first."""
    return log.where(F.lower("message").contains(longest_word(query))).select("id", "timestamp", "hostname", "severity", "severity_score", "message").orderBy("severity_score", "timestamp", "id").limit(limit)


def retrieve(searches: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame | None]:
    """The first search, in order, that finds anything."""
    for name, found in searches:
        if not found.isEmpty():
            return name, found
    return "none", None


#: Failure signatures; every alternative of a name is a list of patterns that must all be found.
SIGNATURES = {
    "ha_restart": ((r"\bHA\b", r"\brestart"), (r"vSphere HA",)), "apd": ((r"\bAPD\b",), (r"All Paths Down",)), "host_isolation": ((r"\bisolat", r"\bhost\b"),),
    "network_partition": ((r"\bpartition", r"\bnetwork\b"),), "snapshot_failure": ((r"\bsnapshot", r"\b(fail|error)"),),
}


def pattern_match(log: DataFrame, name: str, text: str = "message") -> DataFrame:
    """Events of a named failure signature."""
    hit = F.lit(False)
    for every in SIGNATURES[name]:
        one = F.lit(True)
        for p in every:
            one &= F.col(text).rlike(f"(?i){p}")
        hit |= one
    return log.where(hit)


def embed_missing(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "id", text: str = "message", vector: str = "embedding", dimension: int = 1024) -> DataFrame:
    """Vectors for the rows that lack one, cut or filled up to ``dimension``; ``encode`` is injected."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [list(map(float, v))[:dimension] for v in encode(b[text].fillna("").tolist())]
            yield pd.DataFrame({key: b[key], vector: [v + [0.0] * (dimension - len(v)) for v in found]})

    todo = rows.where(F.col(vector).isNull()).select(key, text)
    return todo.mapInPandas(run, f"{key} {todo.schema[key].dataType.simpleString()}, {vector} array<float>")


def evidence(pools: list[DataFrame], key: str = "id", limit: int = 15) -> DataFrame:
    """Results of several searches as one: each row once, from the first that found it, by score."""
    out = None
    for n, p in enumerate(pools):
        p = p.select(key, F.col("score").cast("double").alias("score"), F.lit(n).alias("pool"))
        out = p if out is None else out.unionByName(p)
    first = F.row_number().over(Window.partitionBy(key).orderBy("pool", F.desc("score")))
    return out.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("score"), key).limit(limit)


def context(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """A bounded result as one block of lines, cut at ``budget`` letters."""
    line = F.format_string("[%s] %s %s/%s: %s", "timestamp", "severity", "hostname", "process", "message")
    lines = hits.select("timestamp", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("timestamp", "line"))).alias("l"))
    return lines.select(F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, budget).alias("context"))


def chart_spec(result: DataFrame) -> DataFrame:
    """Whether a result of 2 to 40 rows can be charted: its label, its measures (three at most), and the kind."""
    numeric = [f.name for f in result.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "decimal", "short")]
    labels = [f.name for f in result.schema if f.name not in numeric]
    measures = numeric[:3]
    label = labels[0] if labels else None
    one = result.agg(F.count("*").alias("rows"), (F.countDistinct(label) if label else F.lit(0)).alias("labels"), (F.every(F.col(label).cast("string").rlike(r"^\d{4}-\d{2}(-\d{2})?|^\d{2}:\d{2}")) if label else F.lit(False)).alias("timelike"))
    ok = F.col("rows").between(2, 40) & (F.col("labels") == F.col("rows")) & F.lit(bool(measures))
    return one.select(F.lit(label).alias("label"), F.lit(",".join(measures)).alias("measures"), ok.alias("chartable"), F.when(F.col("timelike"), "line").otherwise("bar").alias("kind"))
