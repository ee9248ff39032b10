"""The operators applied to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, hardneg, langid, licenses, media, neardup, packing, pii, secrets, sentencepiece_scan, suffixdedup, topk, whitening
from .common import new_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    found = langid.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "words")


def op2_media(spark, sf_dir):
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    """The history in two commits: versions up to the middle id, then the others against the ledger
    of the first, which lies under the shared folder; findings go back to all."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "secret_ledger")
    number = F.col("doc_id").try_cast("double")  # ids that are no numbers come second
    older = F.coalesce(number <= F.lit(docs.agg(F.avg(number)).first()[0]), F.lit(False))
    secrets.update(docs.where(older), path)
    secrets.update(docs.where(~older), path)
    return secrets.findings(docs, path)


def op4_license_scan(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_scan.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_duplicates(spark, sf_dir):
    return exactdedup.mark(table(spark, sf_dir, "documents"))


_ALL = (
    op1_language_id, op2_media, op3_secret_scan, op4_license_scan, op5_pii, op6_suffix_dedup, op7_sentencepiece, op8_top_k, op9_near_duplicates, op10_packing,
    op11_hard_negatives, op12_whitening, op13_exact_duplicates,
)
QUERIES = {f.__name__: f for f in _ALL}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a text in lower case, as near-duplicates take them.
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def near_duplicate_sql(width: int, percent: int, docs: str = "documents") -> str:
    """Components of ``docs`` by exact comparison of all sets that share a shingle."""
    shingle = "list_transform(range(1, len(w) - {k} + 2), lambda i: list_aggregate(w[i:i + {k} - 1], 'string_agg', ' '))".format(k=width)
    return f"""
WITH RECURSIVE nd_words AS (SELECT doc_id, {_WORDS} AS w FROM {docs}),
nd_all AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {width} THEN {shingle} WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM nd_words),
nd_set AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM nd_all),
nd_link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM nd_set a JOIN nd_set b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
nd_reach(doc_id, r) AS (SELECT doc_id, doc_id FROM nd_all UNION SELECT l.v, p.r FROM nd_reach p JOIN nd_link l ON l.u = p.doc_id),
nd_min AS (SELECT doc_id, min(r) AS component_id FROM nd_reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM nd_all JOIN nd_min USING (doc_id)"""


ORACLE_SQL = {
    # bytes as hexadecimal digits, two for each
    "op6_suffix_dedup": """
WITH sd AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sw AS (SELECT rid, s, md5(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(0, greatest(0, len(h) // 2 - 199))) AS s FROM sd)),
st AS (SELECT rid, s FROM sw JOIN (SELECT m FROM sw GROUP BY m HAVING count(*) > 1) USING (m)),
sg AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS g FROM (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM st)),
sr AS (SELECT rid, min(s) AS a, max(s) + 200 AS b FROM sg GROUP BY rid, g),
sp AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM sr),
sk AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM sp JOIN sd USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM sd LEFT JOIN sk USING (rid)""",
    "op9_near_duplicates": near_duplicate_sql(2, 80),
    "op13_exact_duplicates": f"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, s AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS s FROM documents) WINDOW w AS (PARTITION BY s ORDER BY doc_id DESC NULLS LAST)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (a.label <> c.label OR a.vec_id <> c.vec_id) AND len(a.e) = len(c.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
