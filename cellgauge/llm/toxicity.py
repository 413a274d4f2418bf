"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

Tokens (runs of letters, A-Z lower-cased) are hashed into 2**BUCKET_BITS buckets.  A
bucket's score is the log-odds of its document frequency in toxic against other labelled
texts, with an informative Dirichlet prior of PRIOR pseudo-occurrences split as the classes
are; it counts if it is Z standard deviations over 0, every other token scores -DRIFT.
All maximal segments of positive score are found in one scan over the positive tokens.
A segment's score S in a text of n tokens becomes the extreme-value statistic
lambda * S - log(n), with lambda from the token distribution of texts not labelled toxic;
the best of them, and their sum, become a probability through a logistic fit.  The fit
uses texts scored by the counts of the other half of the sample.

Learning reads a bounded sample (``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id).

Defined results: empty and null texts get the probability of a text without segments;
without labels of both classes all scores are 0; a document labelled twice is toxic if
either label says so; a null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .language import remainder, sampled
from .scratch import ship

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
TRAIN_ROWS = 20000
PRIOR, Z, DRIFT = 4.0, 3.3, 0.15
THRESHOLD = 0.3
GAPS = np.ones(256, dtype=bool)
GAPS[128:] = False
GAPS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False


@dataclass(frozen=True)
class Model:
    scores: np.ndarray
    rate: float
    weights: np.ndarray | None


def token_buckets(data: np.ndarray, offsets: np.ndarray):
    starts, ends, owner = tk.word_spans(data, offsets, GAPS)
    buckets = tk.span_hashes(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)
    return starts, ends, owner, buckets.astype(np.int64)


def maximal_segments(scores: list[float], cumulative: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa) as (first, last, score).

    ``scores`` are the positive items; ``cumulative`` is the sum of everything before each.
    """
    found: list[tuple[int, int, float, float]] = []
    for i, (s, before) in enumerate(zip(scores, cumulative)):
        first, left, right = i, before, before + s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
        found.append((first, i, left, right))
    return [(a, b, r - l) for a, b, l, r in found]


def segments(data: np.ndarray, offsets: np.ndarray, scores: np.ndarray):
    """For each text: its tokens' number and its segments (first byte, byte after the last, score)."""
    starts, ends, owner, buckets = token_buckets(data, offsets)
    n = len(offsets) - 1
    tokens = np.bincount(owner, minlength=n)
    value = scores[buckets]
    sums = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
    hits = np.flatnonzero(value > 0)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for text in np.unique(owner[hits]):
        lo, hi = np.searchsorted(owner[hits], [text, text + 1])
        at = hits[lo:hi]
        for a, b, s in maximal_segments(value[at].tolist(), sums[at].tolist()):
            out[text].append((int(starts[at[a]] - offsets[text]), int(ends[at[b]] - offsets[text]), s))
    return tokens, out


def features(tokens: np.ndarray, found: list, rate: float) -> np.ndarray:
    """Bias, any significant segment, best statistic, sum of statistics (both as logs)."""
    out = np.zeros((len(found), 4))
    out[:, 0] = 1
    for i, spans in enumerate(found):
        if spans:
            x = rate * np.array([s for _, _, s in spans]) - np.log(tokens[i] + 1)
            x = x[x > 0]
            if len(x):
                out[i, 1:] = 1, np.log1p(x.max()), np.log1p(x.sum())
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((4, BUCKETS), np.int64)
    for batch in batches:
        kind = np.array(batch.column(1)) * 2 + np.array(batch.column(2))
        for lo, hi, data, offsets in tk.slices(batch.column(0)):
            _, _, owner, buckets = token_buckets(data, offsets)
            once = np.unique(owner * BUCKETS + buckets)
            np.add.at(counts, (kind[lo + once // BUCKETS], once % BUCKETS), 1)
    kinds, at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at), pa.array(counts[kinds, at])], ["kind", "bucket", "n"])


def token_scores(toxic: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores of all buckets and the lambda at which the others' expected exp(lambda * score) is 1."""
    nt, nc = toxic.sum(), other.sum()
    if not nt or not nc:
        return np.full(BUCKETS, -DRIFT, np.float32), 1.0
    at, ac = PRIOR * nt / (nt + nc), PRIOR * nc / (nt + nc)
    odds = np.log((toxic + at) / (nt - toxic + at)) - np.log((other + ac) / (nc - other + ac))
    sure = odds >= Z * np.sqrt(1 / (toxic + at) + 1 / (other + ac))
    scores = np.where(sure, np.maximum(odds, 0.5), -DRIFT)
    chance = np.where(sure, (other + 0.5) / (nc + 0.5), 0)
    chance_rest = 1 - min(0.999, chance.sum())
    lo, hi = 0.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            total = (chance * np.exp(mid * scores)).sum() + chance_rest * np.exp(-mid * DRIFT)
        lo, hi = (lo, mid) if total > 1 else (mid, hi)
    return scores.astype(np.float32), max(lo, 0.1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(models):
    """(text, fold, toxic) to features under the counts of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array(batch.column(1))
            rows, labels = [], np.array(batch.column(2))
            for lo, hi, data, offsets in tk.slices(batch.column(0)):
                both = []
                for scores, rate in models.value:
                    tokens, found = segments(data, offsets, scores)
                    both.append(features(tokens, found, rate))
                rows.append(np.where((fold[lo:hi] == 0)[:, None], both[1], both[0]))
            x = np.concatenate(rows) if rows else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(1, 4)), pa.array(labels)], ["f1", "f2", "f3", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs: (doc_id, text) to learn from; labels: (doc_id, toxic)."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = sampled(known, rows).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))
    # The sample is bounded by ``rows``, so it may be broadcast.
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "fold", "toxic")
    found = train.mapInArrow(_counted, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((4, BUCKETS))
    counts[found["kind"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    halves = [token_scores(counts[2 * f + 1], counts[2 * f]) for f in (0, 1)]
    scores, rate = token_scores(counts[1] + counts[3], counts[0] + counts[2])
    shared = sc.broadcast(halves)
    rows_ = train.mapInArrow(_featured(shared), "f1 double, f2 double, f3 double, toxic int").toArrow()
    y = rows_["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(scores, rate, None)
    x = np.column_stack([np.ones(len(y)), *(rows_[f].to_numpy() for f in ("f1", "f2", "f3"))])
    return Model(scores, rate, logistic(x, y))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score, spans = [], []
            for _, _, data, offsets in tk.slices(batch.column(1)):
                tokens, found = segments(data, offsets, model.scores)
                x = features(tokens, found, model.rate)
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))) if model.weights is not None else np.zeros(len(x))
                score.append(p)
                spans += [[{"start": a, "stop": b, "score": s} for a, b, s in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(score) if score else np.zeros(0)), pa.array(spans, kind)],
                ["doc_id", "held_out", "score", "segments"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, segments (byte spans) for every row of docs(doc_id, text)."""
    fold = remainder(F.col("doc_id"), folds)
    model = fit(docs.where(fold != held), labels.where(fold != held), rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select("doc_id", "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, segments array<struct<start:long,stop:long,score:double>>"
    out = texts.mapInArrow(_scored(shared), schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
