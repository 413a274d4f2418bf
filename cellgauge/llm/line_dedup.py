"""Line dedup: explode normalised lines, hash, find hashes of several documents, reassemble by position.

DataFrame functions only.  Lines move as 128-bit hashes; texts are shuffled once,
for the reassembly.  Lines in ``least_docs`` distinct documents go.  For the usual two,
these are the lines whose smallest and largest doc_id differ, so the count needs two
values per hash, combined before the shuffle however common the line is.  The table of repeated lines is written, so the
join that follows is a plain sort-merge join whose hot keys AQE can split.

Defined results: a null or empty text is one empty line; a row with a null doc_id
shares lines with nobody and stays whole; rows that repeat a doc_id are judged each
by its own text; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

MIN_CHARS = 10
LEAST_DOCS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z only.  lower() has a fast path for pure ASCII, where both are the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _marked(docs: DataFrame, min_chars: int, least_docs: int) -> tuple[DataFrame, Column, Column]:
    """docs with all its columns in ``_row`` and the positions to drop in ``_drops``; the lines kept and all lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs["doc_id"].alias("_id"),
        F.coalesce(docs["text"], F.lit("")).alias("_text"),
        F.xxhash64(docs["text"]).alias("_hash"),
    )
    lines = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("th"))
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = scratch.save(lines, "lines")
    if least_docs <= 2:
        # Two documents are a smallest and a largest doc_id that differ.
        repeated = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
    else:
        # Distinct documents of each hash: pairs are combined before the shuffle, then counted, again combined before it.
        pairs = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        repeated = pairs.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("one").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    repeated = scratch.save(repeated, "repeated")
    drops = lines.join(repeated, ["h1", "h2"]).where("doc_id > keeper").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_drops"))
    marked = base.join(drops, (F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("th")), "left").drop("doc_id", "th")
    parts = F.split("_text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drops"))  # a hash set: linear in the lines
    # The lambda binds the lines, so that they are split once and not for every place.
    kept = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))[0]
    return marked, F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(kept), parts


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, new_text: one row for each row of docs(doc_id, text)."""
    marked, kept, parts = _marked(docs.select("doc_id", "text"), min_chars, least_docs)
    return marked.select(
        F.col("_id").alias("doc_id"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("new_text"),
    )


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with its columns as they are, but for text, and n_chars where there is one; a null text stays null.
    Rows that lost lines and have no word left go."""
    marked, kept, _ = _marked(docs, min_chars, least_docs)
    kept = F.when(F.col("_row")["text"].isNotNull(), kept)
    new = {"text": kept, "n_chars": F.when(F.col("_drops").isNull(), F.col("_row")["n_chars"]).otherwise(F.length(kept)) if "n_chars" in docs.columns else None}
    marked = marked.where(F.col("_drops").isNull() | (F.length(F.btrim(kept, F.lit(WHITE))) > 0))
    return marked.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("_row")[f.name]).alias(f.name) for f in docs.schema.fields])
