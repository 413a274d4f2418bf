"""Exact top-k inner products: norm-bucketed retrieval with local cosine thresholds.

Vectors become integers and are dealt by length, longest first, into blocks of bounded
rows (the buckets).  Queries, in blocks too, first meet the longest block, which gives
each a bound: its k-th score so far.  In any other block a score needs a cosine of at
least bound / (query length * longest vector's length).  Over 1 the block is skipped for
the query; a high threshold prunes by coordinates (the feasible range of the query's
largest coordinates), a low one by length (only vectors long enough).  What is left is
verified by exact products.  Pruning is strict, so equal scores survive to the tie rule.

Blocks are rows: a query block and a candidate block meet in one task, nothing is
broadcast or collected, and each query keeps at most k rows from a block.

Defined results: vectors that are null or hold nulls or non-finite components, and rows
without an id, take no part; of rows that repeat an id the least vector counts; missing
components count as 0; scores must fit a long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

K = 5
SCALE = 256
BLOCK_ROWS = 2048
QUERY_ROWS = 512
COSINE_SWITCH = 0.7
FOCUS = 4
EXACT = float(1 << 53)


def _integers(vector: list[float]) -> np.ndarray:
    return np.floor(SCALE * np.asarray(vector, dtype=np.float64))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [_integers(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([float(np.sqrt(v @ v)) for v in vectors], pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())],
            ["vec_id", "length", "vector"],
        )


def _packed(rows: int):
    """Runs of rows, as they come, as one row: ids, lengths and a matrix."""

    def emit(ids, lengths, vectors):
        width = max(len(v) for v in vectors) // 8
        matrix = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            matrix[i, : len(v) // 8] = np.frombuffer(v)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([max(lengths)]), pa.array([min(ids)]), pa.array([len(ids)]), pa.array([width]),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([np.array(lengths).tobytes()], pa.binary()),
                pa.array([matrix.tobytes()], pa.binary()),
            ],
            ["longest", "first_id", "n", "width", "ids", "lengths", "matrix"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, vectors = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            lengths += batch.column(1).to_pylist()
            vectors += batch.column(2).to_pylist()
            while len(ids) >= rows:
                yield emit(ids[:rows], lengths[:rows], vectors[:rows])
                ids, lengths, vectors = ids[rows:], lengths[rows:], vectors[rows:]
        if ids:
            yield emit(ids, lengths, vectors)

    return run


PACKED = "longest double, first_id long, n long, width long, ids binary, lengths binary, matrix binary"


def _unpacked(row: dict, prefix: str):
    n, width = row[prefix + "n"], row[prefix + "width"]
    return (
        np.frombuffer(row[prefix + "ids"], np.int64),
        np.frombuffer(row[prefix + "lengths"]),
        np.frombuffer(row[prefix + "matrix"]).reshape(n, width),
    )


def _products(matrix: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: in doubles if every partial sum is exact, else in integers."""
    if bound < EXACT:
        return (matrix @ query).astype(np.int64)
    return matrix.astype(np.int64) @ query.astype(np.int64)


def best_in_block(query_id, query, length, least, ids, lengths, matrix, unit, k):
    """Up to k (score, id) of a block that may reach ``least`` (None: no bound yet)."""
    pick = np.arange(len(ids))
    longest = lengths[0] if len(lengths) else 0.0
    if least is not None and least > 0:
        reach = length * longest
        if reach * (1 + 1e-9) < least:
            return []
        cosine = least / reach
        if cosine > COSINE_SWITCH:
            q = query / length
            slack = np.sqrt(max(0.0, 1 - cosine * cosine))
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                spread = slack * np.sqrt(max(0.0, 1 - q[f] * q[f])) + 1e-9
                # A vector at the least cosine or above: its unit coordinate f lies around q[f] * cosine, or nearer q[f].
                low = q[f] * cosine - spread if q[f] > -cosine else -1.0
                high = q[f] * cosine + spread if q[f] < cosine else 1.0
                low, high = min(low, q[f] - 1e-9), max(high, q[f] + 1e-9)
                pick = pick[(unit[pick, f] >= low) & (unit[pick, f] <= high)]
        else:
            pick = pick[: np.searchsorted(-lengths, -least / length * (1 - 1e-9), side="right")]
    pick = pick[ids[pick] != query_id]
    scores = _products(matrix[pick], query, length * longest)
    if least is not None:
        over = scores >= least
        pick, scores = pick[over], scores[over]
    top = np.lexsort((ids[pick], -scores))[:k]
    return [(int(scores[t]), int(ids[pick[t]])) for t in top]


def _met(k: int, bounded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                q_ids, q_lengths, queries = _unpacked(row, "q_")
                ids, lengths, matrix = _unpacked(row, "c_")
                width = max(queries.shape[1], matrix.shape[1])
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                matrix = np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
                order = np.lexsort((ids, -lengths))
                ids, lengths, matrix = ids[order], lengths[order], matrix[order]
                unit = matrix / np.where(lengths > 0, lengths, 1)[:, None]
                bounds = dict(row["bounds"]) if bounded and row["bounds"] else {}
                out = []
                for q in range(len(q_ids)):
                    least = bounds.get(int(q_ids[q]))
                    for s, v in best_in_block(q_ids[q], queries[q], q_lengths[q], least, ids, lengths, matrix, unit, k):
                        out.append((int(q_ids[q]), v, s))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, embedding); queries are ids divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    usable = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = usable.mapInArrow(_lengths, "vec_id long, length double, vector binary")
    rows = scratch.save(rows, "rows")
    n = rows.count()
    parts = max(1, min(-(-n // block_rows), 2 * spark.sparkContext.defaultParallelism + n // (64 * block_rows)))
    order = [F.col("length").desc(), F.col("vec_id")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    candidates = scratch.save(dealt.mapInArrow(_packed(block_rows), PACKED), "candidates")
    queries = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-n // (every * QUERY_ROWS)))
    queries = queries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    queries = scratch.save(queries.mapInArrow(_packed(QUERY_ROWS), PACKED), "queries")
    head = candidates.orderBy(F.col("longest").desc(), "first_id").select("longest", "first_id").first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = (F.col("longest") == head["longest"]) & (F.col("first_id") == head["first_id"])

    q = queries.select(F.col("first_id").alias("q"), *[F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "lengths", "matrix")])
    c = candidates.select(first.alias("head"), *[F.col(c).alias(f"c_{c}") for c in ("n", "width", "ids", "lengths", "matrix")])
    found = "query_id long, vec_id long, score long"
    start = q.join(F.broadcast(c.where("head").drop("head")))  # one block of bounded rows
    start = scratch.save(start.drop("q").mapInArrow(_met(k, False), found), "start")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    bound = start.withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
    owner = queries.select(F.col("first_id").alias("q"), "n", "width", "ids").mapInArrow(_owned, "q long, query_id long")
    bounds = bound.join(owner, "query_id").groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("bounds"))
    number = F.row_number().over(Window.orderBy("q"))
    numbers = queries.select(F.col("first_id").alias("q")).withColumn("number", number)
    blocks = scratch.save(q.join(bounds, "q", "left").join(numbers, "q"), "bounded")
    # The block grid: each candidate block goes once to each query block.
    rest = c.where("not head").drop("head").withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(blocks.count()))))
    met = rest.join(blocks, "number").drop("q", "number").mapInArrow(_met(k, True), found)
    ranked = start.union(met).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int64()), pa.array(ids)], ["q", "query_id"])
