"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives the
columns of documents; the last gives packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import langid, neardup, packing, pii, suffixdedup
from logweave.llm.common import stored
from logweave.llm.queries import table, tokenizer_file

#: A text whose best language has less than this share of its words' probability is rejected, and one whose letters
#: are less likely than those of every labelled text of its language, by this much (natural logarithm) on average.
LEAST_SHARE, MARGIN = 0.3, 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a language; ``lang`` is the one found. Rejects texts without a letter, null
    texts, texts that no language fits better than the others, and texts that fit no language."""
    labelled = docs.where(~langid.held_out())
    learned = langid.learn(labelled, tokenizer_file("piece_bpe_32k.model"))
    least = stored(langid.least_fit(labelled, learned), "least_fit")
    found = langid.annotate(docs, learned)
    # a row for each language; small as a name and a number
    known = found.join(F.broadcast(least), "lang_pred", "left")
    strange = F.coalesce(F.col("fit") < F.col("least") - MARGIN, F.lit(False))
    kept = known.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE) & ~strange)
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, once."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    # five words and a similarity of 0.8: copies that differ more stay
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every string of 200 bytes that is found more than once."""
    return suffixdedup.strip_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in brackets in its place."""
    return pii.mask_texts(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: Learned probabilities and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
