"""MinHash near-dedup: fast similarity sketching, banding, exact verification, components.

A sketch has ``BINS`` coordinates.  In round i of the first BINS rounds every shingle is
hashed to a bin with the value i + u, in round BINS + j all shingles go to bin j; each bin
keeps its least value, so earlier rounds win and every bin is filled.  Texts agree in a
coordinate with a probability of their Jaccard similarity, with the concentration of
independent bins.  BANDS bands of ROWS coordinates: a pair at similarity 0.85 shares no
band with a probability of 5e-11.

Texts with the same set are one class, represented by its smallest doc_id; only
representatives meet in buckets.  A bucket is first linked to one member (its centre), so
a bucket of n near copies makes n - 1 pairs and not n * n.  After the components of those
links, only pairs of one bucket that lie in different components are left to compare.
Of these, pairs go whose overlap cannot reach the threshold: a document's overlap with
another component is at most the number of its shingles that occur outside its own, which
is counted exactly.  All pairs that remain are compared, once each.  No pair of a bucket
is skipped but those connected already or bounded so.  Every link is confirmed on the two
full sets.

Defined results: a text without words has no shingles and is linked with nothing; a row
with a null doc_id is linked with nothing and kept; rows that repeat a doc_id are one
document with that id, compared by the text of the least hash, and each gets its
component; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .components import connected_components, extended_components
from .scratch import Scratch

SHINGLE = 5
PERCENT = 85
BINS, BANDS, ROWS = 128, 32, 4
CENTRE_ROUNDS = 2
PRUNE_ROUNDS = 3
ROUND_KEYS = tk.keys64(2 * BINS, 21)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Coordinates of one set, given as distinct hashes.  Rounds go in groups: a later round never beats an earlier one."""
    out = np.full(BINS, TOP, dtype=np.uint64)
    group = max(1, 768 // len(shingles))
    for i in range(0, BINS, group):
        rounds = np.arange(i, min(i + group, BINS), dtype=np.uint64)
        h = tk.mix64(shingles[None, :] ^ ROUND_KEYS[i : i + len(rounds), None])
        np.minimum.at(out, (h & np.uint64(BINS - 1)).ravel().astype(np.int64), ((rounds[:, None] << np.uint64(56)) | (h >> np.uint64(8))).ravel())
        if out.max() != TOP:
            return out
    for j in np.flatnonzero(out == TOP):
        h = tk.mix64(shingles ^ ROUND_KEYS[BINS + j])
        out[j] = (np.uint64(BINS + j) << np.uint64(56)) | (h >> np.uint64(8)).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(BANDS, ROWS) * tk.SHINGLE_KEYS[:ROWS]
    return tk.mix64(parts.sum(axis=1, dtype=np.uint64) + ROUND_KEYS[:BANDS]).view(np.int64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for lo, hi, data, offsets in tk.slices(texts):
        starts, ends, owner = tk.word_spans(data, offsets)
        hashes, at = tk.shingle_hashes(tk.span_hashes(data, starts, ends), owner, hi - lo, SHINGLE)
        for i in range(hi - lo):
            yield np.unique(hashes[at[i] : at[i + 1]])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, bands, digests = [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(band_keys(sketch(s)) if len(s) else None)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n", "h1", "h2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        for lo in range(0, len(sets), 512):
            part = pa.array(sets[lo : lo + 512], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), part], ["id", "set"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _mixed(rows: DataFrame, least: int = 2) -> DataFrame:
    """Rows of the buckets whose members lie in several components."""
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"))
    return rows.join(mixed.where(F.expr("lo < hi") & (F.col("k") >= least)).select("key"), "key")


def _linkable(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Documents (id, n, c, keys) that may still have a link, with s, the shingles that some other component has too, and the keys of buckets in which one may be.

    An overlap is at most the smaller s of both sides, and must be percent / 100 of either size and
    percent / (100 + percent) of the summed sizes.  The first is judged by document, the second by bucket.
    """
    grams = docs.select("id", "c").join(sets, "id").select("id", "c", F.explode("set").alias("g"))
    common = grams.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    found = grams.join(common, "g").groupBy("id").agg(F.count("*").alias("s"))
    docs = docs.drop("s").join(found, "id").where(F.col("s") * 100 >= F.col("n") * percent)
    rows = docs.select("id", "n", "c", "s", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("n").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "least")
    rows = rows.join(least, "key").where(F.lit(100 + percent) * F.col("s") >= F.lit(percent) * (F.col("n") + F.col("least")))
    return rows.groupBy("id", "n", "c", "s").agg(F.collect_list("key").alias("keys"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, centre_rounds: int = CENTRE_ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    texts = docs.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    marks = scratch.save(texts.mapInArrow(_sketched, f"doc_id {id_type}, n long, h1 long, h2 long, bands array<long>"), "marks")

    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = marks.where(usable).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = scratch.save(classes.where("rep < last").drop("last"), "classes")
    members = marks.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    members = members.select("doc_id", "n", F.when(usable, F.coalesce("rep", "doc_id")).alias("rep"))
    copies = marks.where(usable).select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).where("doc_id <> rep").select("doc_id")

    banded = marks.where(usable).join(copies.distinct(), "doc_id", "left_anti")
    banded = banded.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    shared = scratch.save(shared.select("key", "size"), "shared")
    buckets = scratch.save(banded.join(shared, "key").dropDuplicates(["key", "id"]), "buckets")
    ids = scratch.save(buckets.groupBy("id").agg(F.sum("size").alias("crowd")), "ids")
    # Of several texts under one id the one of the least hash counts, whatever the order of rows.
    sets = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sets = scratch.save(sets.mapInArrow(_sets, f"id {id_type}, set array<long>"), "sets")

    similar_size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def verified(pairs: DataFrame, step: str) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return scratch.save(_verified(scratch.save(pairs, f"pairs_{step}"), sets, percent), f"links_{step}")

    def centred(rows: DataFrame, rank, step: str) -> DataFrame:
        """Links of every member of a bucket with the member of the highest rank."""
        x = rows.select("key", F.col("id").alias("x"), F.col("n").alias("na"), F.col("c").alias("ca"))
        top = F.max(F.struct(rank, F.col("id").alias("y"), F.col("n").alias("nb"), F.col("c").alias("cb"))).alias("s")
        y = scratch.save(rows.groupBy("key").agg(top).select("key", "s.y", "s.nb", "s.cb"), f"centres_{step}")
        return verified(x.join(y, "key").where((F.col("ca") != F.col("cb")) & similar_size), step)

    # A member that shares crowded buckets is close to many: the best first centre.
    links = centred(buckets.join(ids, "id").withColumn("c", F.col("id")), F.struct("crowd", F.xxhash64("id")), "0")
    comp = connected_components(links, scratch, "round0_")
    for r in range(1, centre_rounds + 1):
        known = comp.select(F.col("node").alias("id"), "component")
        left = buckets.join(known, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        left = scratch.save(_mixed(left, 3), f"left{r}")  # a bucket of two was settled by its only pair
        if left.isEmpty():
            break
        if r < centre_rounds:
            comp = extended_components(comp, centred(left, F.xxhash64("key", "id", F.lit(r)), str(r)), scratch, f"round{r}_")
            continue
        # From here on a row is a document with its buckets; n is the size of the set that is compared.
        left = left.groupBy("id", "c").agg(F.collect_list("key").alias("keys")).join(sets.select("id", F.size("set").cast("long").alias("n")), "id")
        left = scratch.save(left, "open")
        rows = left.agg(F.sum(F.size("keys"))).first()[0]
        for i in range(PRUNE_ROUNDS):
            left = scratch.save(_linkable(left, sets, percent), f"linkable{i}")
            before, rows = rows, left.agg(F.sum(F.size("keys"))).first()[0] or 0
            if rows in (0, before):  # nothing went, so nothing goes in a further round
                break
        if not rows:
            break
        left = _mixed(left.select("id", "n", "c", "s", "keys", F.explode("keys").alias("key")))
        x = left.select("key", F.col("id").alias("x"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("keys").alias("ka"))
        y = left.select("key", F.col("id").alias("y"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("s").alias("sb"), F.col("keys").alias("kb"))
        enough = F.lit(100 + percent) * F.least("sa", "sb") >= F.lit(percent) * (F.col("na") + F.col("nb"))
        once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")  # in the first bucket that both share
        rest = verified(x.join(y, "key").where((F.col("x") < F.col("y")) & (F.col("ca") != F.col("cb")) & enough & once), "rest")
        comp = extended_components(comp, rest, scratch, "last_")

    known = comp.select(F.col("node").alias("rep"), "component")
    out = members.join(known, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, but for near copies; the smallest doc_id of each group stays.

    Documents are judged by their whole texts first, at PERCENT, as ``whole`` (doc_id, text) has
    them if every line of a row of docs comes from there: what is left of a copy whose lines
    went looks like no copy any more.  Then what stays is judged by its own texts, at ``percent``.  Rows that
    repeat a doc_id and its text are one document and become one row; a null doc_id stays.
    """
    scratch = Scratch(docs.sparkSession, "copies")

    def lines(df: DataFrame, id: str, name: str) -> DataFrame:
        return df.select(F.col("doc_id").alias(id), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(x)).alias(name))

    same = lines(docs, "id", "mine").join(lines(whole, "of", "all"), (F.col("id") == F.col("of")) & (F.size(F.array_except("mine", "all")) == 0))
    same = scratch.save(same.groupBy("id").agg(F.count(F.lit(1)).alias("rows")), "same")
    first_pass = Scratch(docs.sparkSession, "copies")
    groups = near_duplicates(whole.select("doc_id", "text"), max(percent, PERCENT), scratch=first_pass).where("n_shingles > 0").select("doc_id", "component_id").distinct()
    groups = scratch.save(groups.join(same, F.col("doc_id") == F.col("id")).select("doc_id", "component_id"), "groups")
    first_pass.clear()
    first = groups.groupBy("component_id").agg(F.min("doc_id").alias("first"))
    gone = groups.join(first, "component_id").where("doc_id > first").select("doc_id").distinct()
    left = scratch.save(docs.join(gone, "doc_id", "left_anti").select(*docs.columns), "left")

    gone = near_duplicates(left, percent).where(~F.col("kept")).select("doc_id").distinct()
    left = left.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = scratch.save(left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
