"""Benchmark decontamination: seeds of token pairs, then Smith-Waterman alignment.

Tokens are runs of letters, A-Z lower-cased, so punctuation and case are no edits.  A
document is contaminated if its local alignment with an item reaches ``LEAST_SHARE`` of
the score of the item aligned with itself.

Seeds lose no such document.  An alignment of share s of an item of n tokens has k matches
and at most 2k - 2sn edits, so of the k - 1 steps from one match to the next at most
k - sn have two edits or more, and at least sn - 1 have one or none.  Such a step joins
tokens one or two apart in the item to tokens one or two apart in the document.  All pairs
of tokens one or two apart are seeds, common or rare; an item is aligned with a document
around the places where enough pairs, of different places in both, lie near each other.

The test items go out in blocks of at most ``BLOCK_BYTES`` of text: each block is
broadcast and costs one pass, whatever the number of items.  Documents are never
shuffled.

Defined results: at least two tokens of an item must meet, or the only one it has; items without tokens match nothing, and neither do null or empty
documents; a null item_id or doc_id is carried as it is; repeated items are each found;
rows repeat as they do in the input; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .scratch import Scratch, ship
from .toxicity import GAPS

STEPS = (1, 2)
LEAST_SHARE = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20
CHUNK_HITS = 1 << 21


@dataclass(frozen=True)
class Index:
    """Sorted seed hashes, a bitmap over their top bits, and for each hash its items and the seed's places there."""

    seeds: np.ndarray
    bitmap: np.ndarray
    first: np.ndarray
    items: np.ndarray
    places: np.ndarray
    tokens: list[np.ndarray]
    sizes: np.ndarray
    ids: list

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the index, and their numbers there."""
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(self.seeds) or not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        number = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        hit = self.seeds[number] == hashes[at]
        return at[hit], number[hit]


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    starts, ends, owner = tk.word_spans(data, offsets, GAPS)
    return starts, ends, owner, tk.span_hashes(data, starts, ends)


def pair_hashes(tokens: np.ndarray, step: int) -> np.ndarray:
    """Hashes of each token and the one ``step`` after it."""
    return tk.mix64(tokens[:-step] * tk.SHINGLE_KEYS[0] + tokens[step:] * tk.SHINGLE_KEYS[1])


def item_tokens(texts: list) -> list[np.ndarray]:
    out = []
    for lo, hi, data, offsets in tk.slices(pa.array(texts, pa.string())):
        _, _, owner, hashes = tokens_of(data, offsets)
        out += np.split(hashes, np.searchsorted(owner, np.arange(1, hi - lo)))
    return out


def build_index(ids: list, tokens: list[np.ndarray]) -> Index:
    """All seeds of the items; an item of one token has that token."""
    hashes, items, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, t in enumerate(tokens):
        for h in [t] if len(t) == 1 else [pair_hashes(t, step) for step in STEPS]:
            hashes.append(h)
            items.append(np.full(len(h), i))
            places.append(np.arange(len(h)))
    hashes, items, places = np.concatenate(hashes), np.concatenate(items), np.concatenate(places)
    order = np.lexsort((places, items, hashes))
    hashes, items, places = hashes[order], items[order], places[order]
    unique, first = np.unique(hashes, return_index=True)
    bitmap = np.zeros(1 << FILTER_BITS, dtype=bool)
    bitmap[unique >> np.uint64(64 - FILTER_BITS)] = True
    return Index(unique, bitmap, np.append(first, len(hashes)), items, places, tokens, np.array([len(t) for t in tokens], np.int64), ids)


def seeds_needed(sizes: np.ndarray, least_share: float) -> np.ndarray:
    """How many seeds an alignment of ``least_share`` has at least, by the item's size."""
    return np.maximum(1, np.ceil(least_share * sizes - 1 - 1e-9)).astype(np.int64)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the window's token at which it ends, row by row; gaps along a row by a running maximum."""
    steps = np.arange(len(window) + 1) * -GAP
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for token in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(window == token, MATCH, MISMATCH)
        new = np.maximum(np.maximum(new, row + GAP), 0)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def seed_hits(index: Index, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens at which a seed begins, in order, and the seed's number."""
    found = [index.lookup(hashes)] if (index.sizes == 1).any() else []
    for step in STEPS:
        at, number = index.lookup(pair_hashes(hashes, step))
        inside = owner[at] == owner[at + step]
        found.append((at[inside], number[inside]))
    at, number = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], number[order]


def candidates(index: Index, owner: np.ndarray, at: np.ndarray, number: np.ndarray, least_share: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, tokens near which an alignment may begin) from the seeds found."""
    spread = index.first[number + 1] - index.first[number]
    entry = np.repeat(index.first[number] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
    at, item, place = np.repeat(at, spread), index.items[entry], index.places[entry]
    n, needed, longest = len(index.sizes), seeds_needed(index.sizes, least_share), int(index.sizes.max(initial=1))
    pair = owner[at] * n + item
    # Different places in the item, anywhere in the text.
    held, count = np.unique(np.unique(pair * longest + place) // longest, return_counts=True)
    held = held[count >= needed[held % n]]
    if not len(held):
        return
    inside = held[np.minimum(np.searchsorted(held, pair), len(held) - 1)] == pair
    # Different places in the text, no farther apart than an alignment is long.
    order = np.lexsort((at[inside], pair[inside]))
    pair, at = pair[inside][order], at[inside][order]
    new = np.ones(len(at), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])
    pair, at = pair[new], at[new]
    last = np.arange(len(at)) + needed[pair % n] - 1
    end = np.minimum(last, len(at) - 1)
    near = (last < len(at)) & (pair[end] == pair) & (at[end] - at <= reach_of(index.sizes[pair % n]))
    pair, at = pair[near], at[near]
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(pair)) + 1):
        if len(part):
            yield int(pair[part[0]] // n), int(pair[part[0]] % n), at[part]


def reach_of(size):
    """No alignment with a score above 0 is longer: k matches, k at most the item's size, pay for fewer than 2k edits."""
    return 3 * size


def matches(tokens: np.ndarray, hashes: np.ndarray, near: np.ndarray, least_share: float):
    """(share, first token, token after the last) of one item's alignments in the document's tokens around ``near``, the best first, then left and right of it."""
    reach, least = int(reach_of(len(tokens))), least_share * MATCH * len(tokens)
    for part in np.split(near, np.flatnonzero(np.diff(near) > 2 * reach) + 1):
        rest = [(max(0, int(part[0]) - reach), min(len(hashes), int(part[-1]) + reach))]
        while rest:
            a, b = rest.pop()
            if MATCH * (b - a) < least:
                continue
            score, end = align(tokens, hashes[a:b])
            if score < least or not score:
                continue
            _, back = align(tokens[::-1], hashes[a : a + end][::-1])
            yield score / (MATCH * len(tokens)), a + end - back, a + end
            rest += [(a, a + end - back), (a + end, b)]


def found_in(texts: pa.Array, index: Index, least_share: float) -> list[list[dict]]:
    """For each text the items found in it, with scores and byte spans."""
    out = []
    for lo, hi, data, offsets in tk.slices(texts):
        starts, ends, owner, hashes = tokens_of(data, offsets)
        first = np.searchsorted(owner, np.arange(hi - lo + 1))
        at, number = seed_hits(index, hashes, owner)
        found: list[list[dict]] = [[] for _ in range(hi - lo)]
        # Whole texts with a bounded number of hits at a time.
        upto = np.concatenate(([0], np.cumsum(index.first[number + 1] - index.first[number])))
        cuts = np.searchsorted(at, first)
        t = 0
        while t < hi - lo:
            u = max(t + 1, int(np.searchsorted(upto[cuts], upto[cuts[t]] + CHUNK_HITS, side="right")) - 1)
            part = slice(cuts[t], cuts[u])
            for text, item, near in candidates(index, owner, at[part], number[part], least_share):
                base = int(first[text])
                own = hashes[base : int(first[text + 1])]
                for share, a, b in matches(index.tokens[item], own, near - base, least_share):
                    span = {"start": int(starts[base + a] - offsets[text]), "stop": int(ends[base + b - 1] - offsets[text])}
                    found[text].append({"item_id": index.ids[item], "score": share} | span)
            t = u
        out += found
    return out


def _aligned(shared, least_share: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(found_in(batch.column(1), shared.value, least_share), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), out], ["doc_id", "row", "found"])

    return run


def blocks_of_items(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """(item_id, text) rows in blocks of bounded bytes; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def indexes(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator:
    """For each block of items its broadcast index of seeds."""
    ship(docs.sparkSession)
    for block in blocks_of_items(benchmark, block_bytes):
        yield docs.sparkSession.sparkContext.broadcast(build_index([i for i, _ in block], item_tokens([t for _, t in block])))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    at = docs.columns.index("text")

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not f for f in found_in(batch.column(at), shared.value, least_share)], pa.bool_()))

        return run

    out = docs
    for index in indexes(docs, benchmark, block_bytes):
        out = out.mapInArrow(clean(index), docs.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, found (item_id, score, start, stop in bytes) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, found array<struct<item_id:long,score:double,start:long,stop:long>>"
    texts = docs.select("doc_id", "text")
    out = None
    for index in indexes(docs, benchmark, block_bytes):
        part = texts.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_aligned(index, least_share), schema)
        if out is None:
            out = part
        else:
            # A further block of items: only documents with findings meet, by id and text.
            scratch = Scratch(spark, "decontaminate")
            more = scratch.save(part.where(F.size("found") > 0).dropDuplicates(["doc_id", "row"]), "more")
            more = more.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("found").alias("f"))
            out = out.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
            out = out.select("doc_id", "row", F.concat("found", F.coalesce("f", F.array())).alias("found"))
    if out is None:
        out = texts.select("doc_id", F.lit(0).cast("long").alias("row"), F.array().cast("array<struct<item_id:long,score:double,start:long,stop:long>>").alias("found"))
    return out.select("doc_id", "found")
