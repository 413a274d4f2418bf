"""Suffix-array dedup: every byte of a string of LENGTH bytes that also starts earlier goes.

Seeds.  In each window of LENGTH bytes the K-byte substring of the least hash (the
leftmost of equals) is the window's anchor, so equal windows have anchors at the same
offset.  An anchor owns the run of windows that chose it; its context is their bytes.
About one position in 35 is an anchor.  Anchors meet by their hash; anchors of equal
contexts are one class, combined before the shuffle, and all but the first lose what
they own.  Only the classes that differ within a hash go on, with their contexts' bytes.

Enhanced suffix array.  The contexts, from the anchor on, are sorted into a suffix array
with longest-common-prefix values; a stack scan of these gives the tree of common-prefix
intervals.  The contexts up to the anchor, read backwards, are sorted alike.  A repeat of
LENGTH bytes is an interval at some depth whose members agree in the rest to the left;
members are split by that left extension, which yields all groups of equal strings with
all members.  All but the first occurrence of a group are removed.  The suffix array
holds one context of each class, so what it leaves are the groups of equal strings of
LENGTH bytes among classes; maximal repeats as such are not an output, and strings whose
whole contexts are equal, as in copies of documents, are decided by the hashes of classes.

Contexts of one hash are sorted in one task while they are at most GROUP_ROWS; beyond
that their windows are hashed one by one and grouped by hash, with the least occurrence
combined before the shuffle, which has the same result.

Defined results: a null text is empty; a row with a null doc_id matches nothing and stays
whole; rows that repeat a doc_id start where they start, and no string is earlier than
one of the same doc_id and start; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .scratch import Scratch

LENGTH = 100
K = 32
GROUP_ROWS = 100_000
BATCH_ROWS = 4096
MIXERS = tk.keys64(4, 41) | np.uint64(1)
U = np.uint64
ROW_BITS = 19
SCHEMA = "h long, c long, doc long, loc long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """For every anchor: its hash, its position, its first and last window, its context's hash, its text."""
    n = len(data)
    if n < length:
        return [np.empty(0, np.int64)] * 6
    up, down = tk.powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tk.BYTE_KEY[data] * up[:n], out=sums[1:])
    seed = tk.mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])
    ranked = (seed & U(0xFFFFFFFF00000000)) | np.arange(len(seed), dtype=np.uint64)
    chosen = (sliding_least(ranked, length - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= offsets[1:][text]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return [np.empty(0, np.int64)] * 6
    at = chosen[windows]
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first, last = windows[edge], windows[np.append(edge[1:], len(windows)) - 1]
    at = at[edge]
    whole = (sums[last + length] - sums[first]) * down[first]
    whole = tk.mix64(whole + (at - first).astype(np.uint64) * MIXERS[0] + (last - first).astype(np.uint64) * MIXERS[1])
    return seed[at].view(np.int64), at, first, last, whole.view(np.int64), text[first]


def merged(doc: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Overlapping and touching spans of a document as one."""
    order = np.lexsort((start, row, doc))
    doc, row, start, stop = doc[order], row[order], start[order], stop[order]
    if not len(doc):
        return doc, row, start, stop
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
    group = np.cumsum(new) - 1
    # Ends run per document: shifting each document beyond the one before keeps one running maximum.
    shift = group.astype(np.int64) << 32
    reach = np.maximum.accumulate(stop + shift)
    begin = np.concatenate(([True], (start + shift)[1:] > reach[:-1])) | new
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], row[at], start[at], (reach - shift)[ends]


def _packed(at, first, last, row):
    return ((at.astype(np.uint64) << U(33)) | ((at - first).astype(np.uint64) << U(26)) | ((last - at + 68).astype(np.uint64) << U(19)) | row.astype(np.uint64)).view(np.int64)


def _unpacked(loc: np.ndarray):
    """Anchor, first and last window, row mark."""
    loc = loc.view(np.uint64)
    at = (loc >> U(33)).astype(np.int64)
    left = ((loc >> U(26)) & U(127)).astype(np.int64)
    right = ((loc >> U(19)) & U(127)).astype(np.int64) - 68
    return at, at - left, at + right, (loc & U((1 << ROW_BITS) - 1)).astype(np.int64)


def first_of_class(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """Sorted order by (h, c, doc, at), the class of each, and whether a strictly earlier one exists."""
    order = np.lexsort((at, doc, c, h))
    h, c, doc, at = h[order], c[order], doc[order], at[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    return order, group, (doc != doc[head]) | (at != at[head])


def _seeded(length: int, k: int):
    """Anchors of texts, one for each class of a batch; what the batch's other members own, as spans (c = 0, h spread by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.asarray(batch.column(0).cast(pa.int64()))
            rows = np.asarray(batch.column(2)).astype(np.int64) & ((1 << ROW_BITS) - 1)
            parts = []
            for lo, hi, data, offsets in tk.slices(batch.column(1)):
                h, at, first, last, c, text = anchors(data, offsets, length, k)
                base = offsets[text]
                parts.append((h, c, docs[lo + text], at - base, first - base, last - base, rows[lo + text]))
            if not parts:
                continue
            h, c, doc, at, first, last, row = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            if not len(h):
                continue
            order, _, later = first_of_class(h, c, doc, at)
            out, gone = order[~later], order[later]
            gd, gr, gs, ge = merged(doc[gone], row[gone], first[gone], last[gone] + length)
            yield _batch(h[out], c[out] | 1, doc[out], _packed(at[out], first[out], last[out], row[out]))
            yield _batch(tk.mix64(gd.view(np.uint64)).view(np.int64), np.zeros(len(gd), np.int64), gd, (gs << 32) | ge, gr)

    return run


def _batch(h, c, doc, loc, row=None):
    row = np.full(len(h), -1, np.int64) if row is None else row
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, doc, loc, row)], ["h", "c", "doc", "loc", "row"])


def _classified(length: int):
    """What later members of a class own, as spans (c = 0); one anchor of each class that is not alone under its hash (c = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(i)) for i in range(5)] for b in batches]
        if not parts:
            return
        h, c, doc, loc, row = (np.concatenate(x) for x in zip(*parts))
        del parts
        span = c == 0
        sd, sr, ss, se = doc[span], row[span], loc[span] >> 32, loc[span] & 0xFFFFFFFF
        h, c, doc, loc = h[~span], c[~span], doc[~span], loc[~span]
        at, first, last, mark = _unpacked(loc)
        order, group, later = first_of_class(h, c, doc, at)
        gone = order[later]
        spans = merged(
            np.concatenate((sd, doc[gone])), np.concatenate((sr, mark[gone])), np.concatenate((ss, first[gone])), np.concatenate((se, last[gone] + length))
        )
        yield _batch(np.zeros(len(spans[0]), np.int64), np.zeros(len(spans[0]), np.int64), spans[0], (spans[2] << 32) | spans[3], spans[1])
        # Members tied with the first (a repeated doc_id) stay with it; one stands for all that have the same row mark.
        keep = order[~later]
        hs = h[keep]
        classes = group[~later]
        new = np.concatenate(([True], classes[1:] != classes[:-1])) if len(keep) else np.empty(0, bool)
        run_of = np.concatenate(([True], hs[1:] != hs[:-1])) if len(keep) else np.empty(0, bool)
        runs = np.cumsum(run_of) - 1
        several = np.bincount(runs[new], minlength=runs[-1] + 1 if len(runs) else 0)[runs] > 1 if len(keep) else np.empty(0, bool)
        keep = keep[several]
        yield _batch(h[keep], np.ones(len(keep), np.int64), doc[keep], loc[keep], mark[keep])

    return run


def _contexts(length: int):
    """Bytes of the contexts of (h, loc) lists, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            hs, docs, locs, texts = [], [], [], []
            for i, (doc, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                h, loc = (np.asarray(x) for x in found.values.flatten())
                _, first, last, _ = _unpacked(loc)
                hs.append(h)
                locs.append(loc)
                docs.append(np.full(len(h), doc, np.int64))
                texts += [own[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
            if texts:
                h, doc, loc = (np.concatenate(x) for x in (hs, docs, locs))
                for lo in range(0, len(texts), 8192):
                    part = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[part]), pa.array(doc[part]), pa.array(loc[part]), pa.array(texts[part], pa.binary())], ["h", "doc", "loc", "context"]
                    )

    return run


def suffix_array(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each in order with the one before."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
    width = max(map(len, parts), default=0) + 1
    grid = np.zeros((len(parts), width), np.int16)
    for i, o in enumerate(order):
        s = np.frombuffer(parts[o], np.uint8)
        grid[i, : len(s)] = s
        grid[i, len(s) :] = -1
    lcp = np.zeros(len(parts), np.int64)
    if len(parts) > 1:
        differ = (grid[1:] != grid[:-1]) | (grid[1:] < 0)
        lcp[1:] = differ.argmax(axis=1)
    return order, lcp


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan of common-prefix values: (depth, depth of the parent, first, last) of every interval of two or more."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for i, depth in enumerate([*lcp[1:].tolist(), 0], start=1):
        first = i - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, max(stack[-1][0], depth), first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def interval_of(lcp: np.ndarray, depths: int) -> np.ndarray:
    """Number of the interval that holds each place of a suffix array at each depth 0..depths; places alone have numbers of their own."""
    n = len(lcp)
    out = np.repeat(np.arange(n, dtype=np.int64)[:, None], depths + 1, axis=1)
    out[:, 0] = 0
    for depth, parent, first, last in intervals(lcp):
        out[first : last + 1, parent + 1 : min(depth, depths) + 1] = first
    return out


def repeat_groups(contexts: list[bytes], left: np.ndarray, windows: np.ndarray, length: int, k: int):
    """All groups of equal strings of ``length`` bytes that begin 0..length-k bytes before the anchors.

    Yields (offset, members in groups, group of each member, right and left intervals).
    """
    rights = [c[a:] for c, a in zip(contexts, left.tolist())]
    lefts = [c[:a][::-1] for c, a in zip(contexts, left.tolist())]
    by_right = np.empty((len(contexts), length + 1), np.int64)
    order, lcp = suffix_array(rights)
    by_right[order] = interval_of(lcp, length)
    by_left = np.empty((len(contexts), length - k + 1), np.int64)
    order, lcp = suffix_array(lefts)
    by_left[order] = interval_of(lcp, length - k)
    for offset in range(length - k + 1):
        own = np.flatnonzero((left >= offset) & (left - offset < windows))
        if len(own) > 1:
            yield offset, own, by_left[own, offset] * len(contexts) + by_right[own, length - offset]


def later_windows(contexts, left, windows, doc, at, length: int, k: int) -> np.ndarray:
    """[context, offset]: whether the window that begins ``offset`` bytes before the anchor starts earlier elsewhere."""
    order = np.lexsort((at, doc))
    contexts, left, windows, doc, at = [contexts[i] for i in order], left[order], windows[order], doc[order], at[order]
    later = np.zeros((len(contexts), length - k + 1), dtype=bool)
    for offset, own, group in repeat_groups(contexts, left, windows, length, k):
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        head = own[first][which]
        later[own, offset] = (doc[own] != doc[head]) | (at[own] != at[head])
    out = np.empty_like(later)
    out[order] = later
    return out


def _resolved(length: int, k: int, batch_rows: int = BATCH_ROWS):
    """Spans of contexts, which come sorted by hash; whole hashes are gathered to batches."""

    def resolve(h, doc, loc, texts):
        at, first, last, row = _unpacked(loc)
        gone = later_windows(texts, at - first, last - first + 1, doc, at, length, k)
        who, offset = np.nonzero(gone)
        start = at[who] - offset
        return merged(doc[who], row[who], start, start + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)] + [batch.column(3).to_pylist()]
            if kept is not None:
                now = [np.concatenate((a, b)) for a, b in zip(kept[:3], now[:3])] + [kept[3] + now[3]]
            edges = np.flatnonzero(np.diff(now[0])) + 1
            lo = 0
            for edge in edges.tolist():
                if edge - lo >= batch_rows:
                    yield spans_batch(*resolve(*(x[lo:edge] for x in now)))
                    lo = edge
            kept = [x[lo:] for x in now]
        if kept is not None and len(kept[0]):
            yield spans_batch(*resolve(*kept))

    return run


def spans_batch(doc, row, start, stop):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, row, start, stop)], ["doc", "row", "start", "stop"])


def _windows(length: int):
    """Every window of a context, by two hashes: for anchors with too many contexts for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, loc = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            _, first, _, row = _unpacked(loc)
            data, offsets = tk.utf8(_as_text(batch.column(3)))
            counts = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[owner] + inside
            h1 = tk.span_hashes(data, start, start + length, None)
            digest = [hashlib.blake2b(data[s : s + length], digest_size=8).digest() for s in start.tolist()]
            h2 = np.frombuffer(b"".join(digest), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2), pa.array(doc[owner]), pa.array(first[owner] + inside), pa.array(row[owner])], ["h1", "h2", "doc", "start", "row"]
            )

    return run


def _as_text(column: pa.Array) -> pa.Array:
    """Binary as a string column over the same bytes, unchecked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    return pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(column), column.buffers(), column.null_count, column.offset)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.utf8(batch.column(1))
        out = []
        for i, spans in enumerate(batch.column(2)):
            own = memoryview(data[offsets[i] : offsets[i + 1]])
            digest, end, removed, runs = hashlib.sha256(), 0, 0, 0
            kept, places = [], []
            if spans.is_valid:
                start, stop = (np.asarray(x) for x in spans.values.flatten())
                zero = np.zeros(len(start), np.int64)
                _, _, start, stop = merged(zero, zero, start, stop)
                places = list(zip(start.tolist(), stop.tolist()))
            for a, b in places:
                digest.update(own[end:a])
                removed += b - a
                runs += 1
                end = b
            digest.update(own[end:])
            out.append((len(own), removed, runs, digest.hexdigest(), [{"start": a, "stop": b} for a, b in places]))
        n, removed, runs, digests, places = zip(*out) if out else ((),) * 5
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(places, kind)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) for every row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    row = F.xxhash64("text").bitwiseAND((1 << ROW_BITS) - 1)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row)
    seeds = texts.where(F.col("doc_id").isNotNull()).mapInArrow(_seeded(length, k), SCHEMA + ", row long")
    found = scratch.save(seeds.repartition("h").mapInArrow(_classified(length), SCHEMA + ", row long"), "found")

    wanted = found.where("c = 1").groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("h", "loc")).alias("list"))
    mine = (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r"))
    # One of rows that repeat both doc_id and text is enough.
    held = texts.join(wanted, mine).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "list")
    contexts = held.mapInArrow(_contexts(length), "h long, doc long, loc long, context binary")
    contexts = scratch.save(contexts, "contexts")
    crowded = scratch.save(contexts.groupBy("h").count().where(F.col("count") > group_rows).select("h"), "crowded")
    spans = "doc long, row long, start long, stop long"
    usual = contexts.join(crowded, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_resolved(length, k), spans)
    parts = [scratch.save(usual, "usual"), found.where("c = 0").select("doc", "row", F.shiftright("loc", 32).alias("start"), F.col("loc").bitwiseAND(0xFFFFFFFF).alias("stop"))]
    if not crowded.isEmpty():
        windows = scratch.save(contexts.join(crowded, "h", "left_semi").mapInArrow(_windows(length), "h1 long, h2 long, doc long, start long, row long"), "windows")
        least = scratch.save(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("least")), "least")
        late = windows.join(least, ["h1", "h2"]).where((F.col("doc") != F.col("least.doc")) | (F.col("start") != F.col("least.start")))
        parts.append(late.select("doc", "row", "start", (F.col("start") + length).alias("stop")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "stop")).alias("list"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>"
    return texts.join(spans, mine, "left").select("doc_id", "text", "list").mapInArrow(_cut, schema)
