"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams of a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by a
hash of doc_id); the counts meet in a languages x BUCKETS matrix of log-probabilities,
whose size the parameters fix and which is broadcast.  Scoring reads every whole text
once: hash all n-grams of a slice of texts, gather matrix rows, add them up per text.

Defined results: a null text or one without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from; a null doc_id is neither held out nor
learned from; ties go to the smaller language name; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk
from .codepoints import code_points, is_letter, lowered
from .scratch import ship

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
TRAIN_ROWS = 20000
SMOOTHING = 0.1
GRAM_KEYS = tk.keys64(8, 31) | np.uint64(1)
UNKNOWN = "und"
LEAST_SCORE = 0.3  # below it no language stands out: four languages share the rest


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the key; all of a smaller table."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at every code point, and the points at which none begins."""
    points = points.astype(np.uint64)
    for n in ORDERS:
        h = np.full(len(points), GRAM_KEYS[n], dtype=np.uint64)
        for i in range(n):
            h[: len(points) - i] += points[i:] * GRAM_KEYS[i + 4]
        ends = [offsets[1:] - i for i in range(1, n)]
        cut = np.concatenate([e[e >= offsets[:-1]] for e in ends]) if ends else np.empty(0, np.int64)
        yield (tk.mix64(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), cut


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for lo, hi, data, offsets in tk.slices(batch.column(0)):
            points, at = code_points(data, offsets)
            owner = np.repeat(np.arange(hi - lo), np.diff(at))
            found = list(grams(lowered(points), at))
            for lang in set(langs[lo:hi]):
                mine = (langs[lo:hi] == lang)[owner]
                for bucket, cut in found:
                    use = mine.copy()
                    use[cut] = False
                    counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    counts[lang] += np.bincount(bucket[use], minlength=1 << BUCKET_BITS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names in order and log-probabilities [bucket, language] from labelled(doc_id, text, lang)."""
    ship(labelled.sparkSession)
    wanted = labelled.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    found = sampled(wanted, rows).select("text", "lang").mapInArrow(_counted, "lang string, bucket long, n long")
    found = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    langs = np.array(found["lang"].to_pylist(), dtype=object)
    names = sorted(set(langs))
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    for i, name in enumerate(names):
        counts[bucket[langs == name], i] = n[langs == name]
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def classified(texts: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Predicted language and score of each text."""
    best, score = [], []
    for lo, hi, data, offsets in tk.slices(texts):
        if not names:
            best += [UNKNOWN] * (hi - lo)
            score += [0.0] * (hi - lo)
            continue
        points, at = code_points(data, offsets)
        letters = np.concatenate(([0], np.cumsum(is_letter(points))))
        total = np.zeros((hi - lo, len(names)))
        for bucket, cut in grams(lowered(points), at):
            for k in range(len(names)):
                part = table[:, k][bucket]
                part[cut] = 0
                total[:, k] += np.diff(np.concatenate(([0.0], np.cumsum(part, dtype=np.float64)))[at])
        known = letters[at[1:]] > letters[at[:-1]]
        top = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        best += [names[i] if k else UNKNOWN for i, k in zip(top, known)]
        score += np.where(known, chance, 0.0).tolist()
    return best, score


def classifier(names: list[str], model):
    """The mapInArrow function that scores (doc_id, text, ...) with a broadcast matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = classified(batch.column(1), names, model.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:1], *batch.schema.names[2:], "lang_pred", "score"],
            )

    return run


def predict(texts: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, further columns, lang_pred, score for texts(doc_id, text, further columns)."""
    model = texts.sparkSession.sparkContext.broadcast(np.asfortranarray(matrix))
    rest = [f for f in texts.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return texts.mapInArrow(classifier(names, model), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score.  Rows whose crc32(doc_id) mod ``folds`` is 0 are held out."""
    fold = remainder(F.col("doc_id"), folds)
    names, matrix = fit(docs.where(fold != 0), rows)
    texts = docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return predict(texts, names, matrix).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, wanted: Collection[str] | None = None, least_score: float = LEAST_SCORE, folds: int = 5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, that are not rejected.

    A text goes if no language can be told (no letter), if its best language has less than
    ``least_score`` of the probability, or if that language is not ``wanted`` (None: every
    learned language is).  With nothing to learn from, every text with a letter stays.
    """
    names, matrix = fit(docs.where(remainder(F.col("doc_id"), folds) != 0), rows)
    model = docs.sparkSession.sparkContext.broadcast(np.asfortranarray(matrix))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if names:
                best, score = classified(batch.column(text), names, model.value)
                keep = [x != UNKNOWN and s >= least_score and (wanted is None or x in wanted) for x, s in zip(best, score)]
            else:
                keep = []
                for _, _, data, offsets in tk.slices(batch.column(text)):
                    points, at = code_points(data, offsets)
                    letters = np.concatenate(([0], np.cumsum(is_letter(points))))
                    keep += (letters[at[1:]] > letters[at[:-1]]).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
