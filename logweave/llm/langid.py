"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one. Each language has a probability for every piece. The
probability of a word is the sum over all its segmentations into pieces, which a forward pass over
its letters gives; a text's is the product over its words. Learning is one step of expectation
and maximisation: from a uniform model, a forward-backward pass gives the expected use of every
piece in every word; summed by language, these become probabilities.

Learning reads whole texts of all labelled rows. What a word gives depends on the word alone, so words are counted by language
first, inside each task before they are shuffled, and each different word goes through the passes once, times its count. Words of
equal length go through the passes together, and a task keeps the scores of words it has seen.

Languages are scored in blocks of ``MOST``, each a pass over the texts that takes along the best language so far, so what reaches the
driver and each task at a time is bounded by vocabulary times ``MOST``, and no number of languages is too large.

Defined results: a null text or one without a letter (of a category of letters in Unicode; numerals such as \u00bd or \u2167 are none) is
``und`` with score 0; equal texts get equal
predictions; ties go to the first language in order; rows whose language is null teach nothing;
without any labelled row every text is ``und``; letters that
no piece covers count alike for all languages; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .common import configure, fields, stored
from .vocabulary import Vocabulary, by_length

UND = "und"
#: Languages of a block: the model that goes to every task has a column for each.
MOST = 200
#: Words kept by a task with their scores; then it starts anew, which changes no result.
CACHE = 1_000_000
#: Different words that a task holds while it learns, letters that it has read of them, and letters that go through the passes together.
HELD, READ, PASSED = 200_000, 1 << 25, 200_000
#: Letters after which the sums of a word are scaled anew.
RESCALE = 8
#: Pseudo-count of each piece, and the probability of a letter that no piece covers.
SMOOTH, UNKNOWN = 0.05, 1e-9


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(1)
def numerals() -> tuple[re.Pattern, dict[int, str]]:
    """What count as parts of words, without being letters: a pattern that finds all of them (and more beyond the first
    65,536 characters, where a list would be slow), and their places taken by blanks."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")]
    near = "".join(c for c in found if c <= "\uffff")
    return re.compile(rf"[{near}\U00010000-\U0010ffff]"), {ord(c): " " for c in found}


@lru_cache(4)
def vocabulary(model: str) -> Vocabulary:
    """All ordinary pieces of a SentencePiece model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    kinds = (p.is_control, p.is_unknown, p.is_byte, p.is_unused)
    return Vocabulary([p.id_to_piece(i) for i in range(p.get_piece_size()) if not any(k(i) for k in kinds)])


def words(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        pattern, blanks = numerals()
        if pattern.search(text):
            text = text.translate(blanks)
    return ["▁" + w for w in _WORD.findall(text)]


def forward(found: list[str], n: int, voc: Vocabulary, weights: np.ndarray, trail: list | None = None) -> np.ndarray:
    """Log-probability of each word of n letters under each column of ``weights``, which has a row for
    each piece, one of zeros, and one for unknown letters. ``trail`` takes those of all beginnings.

    Sums are kept for as many letters as the longest piece has, and scaled anew every few letters, so
    words of any length neither run out of range nor out of memory.
    """
    shape = (len(found), weights.shape[1])
    ahead, scale = {0: np.ones(shape)}, np.zeros(shape)
    for i, spans in voc.starting(found, n):
        here = ahead.pop(i)
        if i % RESCALE == 0:
            for later in ahead.values():
                later /= here
            scale += np.log(here)
            here = np.ones(shape)
        if trail is not None:
            trail.append(np.log(here) + scale)
        for size, ids in spans:
            own = np.flatnonzero(ids != voc.size)
            into = ahead.setdefault(i + size, np.zeros(shape))
            into[own] += here[own] * weights[ids[own]]
    return np.log(ahead.pop(n, np.ones(shape))) + scale


def expected(found: list[str], times: np.ndarray, n: int, voc: Vocabulary, weight: np.ndarray) -> np.ndarray:
    """Expected uses of all pieces in the words of n letters, each word counted ``times``."""
    before: list[np.ndarray] = []
    total = forward(found, n, voc, weight[:, None], before)[:, 0]
    behind, scale = {n: np.ones(len(found))}, np.zeros(len(found))
    uses = np.zeros(len(weight))
    for i, spans in voc.starting(found, n, backwards=True):
        behind.pop(i + voc.longest + 1, None)
        here = np.zeros(len(found))
        share = np.exp(before[i][:, 0] + scale - total) * times
        for size, ids in spans:
            own = np.flatnonzero(ids != voc.size)
            part = weight[ids[own]] * behind[i + size][own]
            here[own] += part
            np.add.at(uses, ids[own], part * share[own])
        if i % RESCALE == 0:
            for later in behind.values():
                later /= here
            scale += np.log(here)
            here = np.ones(len(found))
        behind[i] = here
    return uses


def sampled(labelled: DataFrame, key: str, lang: str, rows: int) -> DataFrame:
    """All rows of a language with at most ``rows``, else about so many, by a hash of the id."""
    counts = labelled.groupBy(lang).count().where(F.col("count") > rows)
    share = F.broadcast(counts.select(F.col(lang).alias("_lang"), (F.lit(rows) / F.col("count")).alias("_share")))  # a row for each language
    known = F.xxhash64(F.col(key).cast("string"))
    drawn = F.when(F.col(key).isNull(), F.xxhash64("text")).otherwise(known)
    draw = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(share, labelled[lang] == F.col("_lang"), "left").where(F.col("_share").isNull() | (draw < F.col("_share"))).drop("_lang", "_share")


@dataclass
class Learned:
    """The languages in order, and expected uses ``n`` of each piece by language, stored."""

    model: str
    langs: list[str]
    counts: DataFrame

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """At most MOST languages at a time, with a column of piece probabilities for each."""
        voc = vocabulary(self.model)
        for at in range(0, max(1, len(self.langs)), MOST):
            langs = self.langs[at : at + MOST]
            weights = np.zeros((voc.size + 2, len(langs)))
            if langs:
                own = self.counts if len(self.langs) <= MOST else self.counts.where(F.col("lang").between(langs[0], langs[-1]))
                column = {g: k for k, g in enumerate(langs)}
                for r in own.toLocalIterator():  # at most one row for each language of the block and piece
                    weights[r.piece, column[r.lang]] = r.n
            # rounded, so that the order in which counts were added up does not show
            used = weights[: voc.size]
            weights[: voc.size] = np.round((used + SMOOTH) / (used.sum(axis=0) + SMOOTH * voc.size), 12)
            weights[voc.size + 1] = UNKNOWN
            yield langs, weights


def _labelled(labelled: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    chosen = labelled.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return chosen.where("lang is not null and text is not null")


def _chosen(labelled: DataFrame, key: str, text: str, lang: str, rows: int | None) -> DataFrame:
    known = _labelled(labelled, key, text, lang)
    return known if rows is None else sampled(known, "key", "lang", rows)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, times) of rows (lang, text), counted over many batches."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("times", pa.int64())])
    times: dict[str, Counter] = {}
    letters = 0

    def give() -> Iterator[pa.RecordBatch]:
        for lang, own in times.items():
            for found, counts in zip(_parts(list(own)), _parts(list(own.values())), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(counts, pa.int64())], schema=schema)
        times.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            times.setdefault(lang, Counter()).update(words(text))
            letters += len(text)
        if letters > READ or sum(map(len, times.values())) > HELD:
            yield from give()
            letters = 0
    yield from give()


def _parts(rows: list, many: int = 10_000) -> Iterator[list]:
    return (rows[k : k + many] for k in range(0, len(rows), many))


def piece_uses(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows (lang, piece, n) of rows (lang, word, times), each word once: words of many batches go through the passes together."""
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())])
    uniform = np.r_[np.full(voc.size, 1 / voc.size), 0.0, UNKNOWN]
    held: dict[str, dict[str, int]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, times in held.items():
            uses = np.zeros(voc.size + 2)
            for n, found in by_length(list(times)):
                # beginnings of all words are kept
                for own in _parts(found, max(1, PASSED // n)):
                    uses += expected(own, np.array([times[w] for w in own], float), n, voc, uniform)
            pieces = np.flatnonzero(uses[: voc.size])
            for at in _parts(pieces):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(uses[at], pa.float64())], schema=schema)
        held.clear()

    rows = letters = 0
    for b in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.setdefault(lang, {})[word] = n
            letters += len(word)
        rows += b.num_rows
        if rows > HELD or letters > READ:
            yield from give()
            rows = letters = 0
    yield from give()


def learn(labelled: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = None) -> Learned:
    """What ``predict`` needs to know of the languages of ``labelled``: of all rows, or, for trials, of about ``rows`` of each."""
    configure(labelled.sparkSession)
    counted, used = fields(lang=StringType(), word=StringType(), times=LongType()), fields(lang=StringType(), piece=LongType(), n=DoubleType())
    chosen = _chosen(labelled, key, text, lang, rows)
    of_words = chosen.select("lang", "text").mapInArrow(counted_words, counted).groupBy("lang", "word").agg(F.sum("times").alias("times"))
    of_pieces = of_words.mapInArrow(lambda batches: piece_uses(batches, vocabulary(model)), used)
    counts = stored(of_pieces.groupBy("lang", "piece").agg(F.sum("n").alias("n")), "piece_counts")
    return Learned(model, sorted(r.lang for r in counts.select("lang").distinct().collect()), counts)  # a name for each language


def scorer(model: str, weights: np.ndarray):
    """A function from texts to (words, letters, each language's log-probability) for each."""
    voc, index, held = vocabulary(model), {}, [np.zeros((1 << 16, weights.shape[1]))]

    def learn_words(new: list[str]) -> None:
        if len(index) + len(new) > CACHE:
            index.clear()
        first = len(index)
        while first + len(new) > len(held[0]):
            held[0] = np.concatenate([held[0], np.zeros_like(held[0])])
        index.update((w, first + k) for k, w in enumerate(new))
        step = max(1, 1_000_000 // (voc.longest * max(1, weights.shape[1])))
        for n, own in by_length(new):
            for k in range(0, len(own), step):
                held[0][[index[w] for w in own[k : k + step]]] = forward(own[k : k + step], n, voc, weights)

    def score(texts):
        split = [words(t or "") for t in texts]
        distinct = set().union(*split)
        if len(index) + len(distinct) > CACHE:
            index.clear()
        learn_words([w for w in distinct if w not in index])
        sums = [held[0][list(map(index.__getitem__, own))].sum(axis=0) for own in split]
        return list(zip(map(len, split), (sum(map(len, own)) for own in split), sums, strict=True))

    return score


#: The best language so far, its log-probability, the sum of all languages' shares against it, words and letters.
STATE = fields(_lang=StringType(), _top=DoubleType(), _z=DoubleType(), _words=LongType(), _letters=LongType())


def _better(old: tuple, new: tuple) -> tuple:
    """The state after one more block of languages."""
    (lang, top, z, n, letters), (lang2, top2, z2, _, _) = old, new
    if lang is None or lang2 is None:
        return new if lang is None else old
    if top2 > top:
        return lang2, top2, float(z2 + z * np.exp((top - top2) / n)), n, letters
    return lang, top, float(z + z2 * np.exp((top2 - top) / n)), n, letters


def _scored(rows: DataFrame, text: str, learned: Learned) -> DataFrame:
    """``rows`` with the columns of STATE. Other columns pass through Arrow as they are; a text goes there once."""
    spark = configure(rows.sparkSession)
    plain, at = len(rows.columns), rows.columns.index(text)
    schema = StructType([*rows.schema.fields, *STATE.fields])
    types = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    out, model = rows, learned.model
    for langs, weights in learned.blocks():
        shared = spark.sparkContext.broadcast(weights)  # vocabulary times MOST

        def run(batches: Iterator[pa.RecordBatch], langs=langs, shared=shared) -> Iterator[pa.RecordBatch]:
            score = scorer(model, shared.value)

            def one(n, letters, sums):
                if not n or not langs:
                    return None, 0.0, 0.0, n, letters
                best = int(np.argmax(sums))
                return langs[best], float(sums[best]), float(np.exp((sums - sums[best]) / n).sum()), n, letters

            for b in batches:
                if b.num_rows:
                    found = [one(*x) for x in score(b.column(at).to_pylist())]
                    if b.num_columns > plain:
                        old = zip(*(c.to_pylist() for c in b.columns[plain:]), strict=True)
                        found = [_better(o, f) for o, f in zip(old, found, strict=True)]
                    state = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:plain], *state], names=schema.names)

        out = out.mapInArrow(run, schema)
        if len(learned.langs) > MOST:
            out = stored(out, "scored")
    return out


def _told() -> list[F.Column]:
    known = F.col("_lang").isNotNull()
    return [
        F.coalesce("_lang", F.lit(UND)).alias("lang_pred"), F.when(known, 1 / F.col("_z")).otherwise(0.0).alias("score"), F.col("_words").alias("words"),
        F.when(known, F.col("_top") / F.col("_letters")).otherwise(0.0).alias("fit"),
    ]


def predict(docs: DataFrame, learned: Learned, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of each text; ``score``: its share of the languages' mean probabilities of a
    word; ``fit``: its mean log-probability of a letter."""
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _scored(chosen, "text", learned).select("doc_id", *_told())


def annotate(docs: DataFrame, learned: Learned, text: str = "text") -> DataFrame:
    """(row, lang_pred, score, words, fit): the rows of ``docs`` as structures, whatever their columns are called."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.withColumn(text, F.col(text).cast("string")).toDF(*names)
    row = F.struct(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
    return _scored(plain, names[docs.columns.index(text)], learned).select(row.alias("row"), *_told())


def least_fit(labelled: DataFrame, learned: Learned, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = None) -> DataFrame:
    """(lang_pred, least): the least fit of labelled rows that are told right, by language; of the rows it is learned from."""
    known = _chosen(labelled, key, text, lang, rows).select(F.col("lang").alias("key"), "text")
    return predict(known, learned, key="key").where("doc_id = lang_pred").groupBy("lang_pred").agg(F.min("fit").alias("least"))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    return predict(docs, learn(docs.where(~held_out(key)), model, key, text, lang), key, text).withColumn("held_out", held_out("doc_id"))
