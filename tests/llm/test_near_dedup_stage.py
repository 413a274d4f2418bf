"""The pipeline's near-dedup stage against all pairs, and copies whose lines are gone before it."""

import random

import pytest

pytest.importorskip("cellgauge.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def shingles(t):
    return {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}


def test_pairs_from_the_threshold_on(spark, tmp_path):
    r = random.Random(80)
    rows = []
    for i in range(40):
        base = words(r, 200)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + words(r, 30 + i)))]
    sets = {d: shingles(t) for d, t in rows}
    share = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(0, 80, 2)}
    assert sum(0.8 <= s < 0.85 for s in share.values()) > 10 and sum(s < 0.8 for s in share.values()) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(sets) - {d + 1 for d, s in share.items() if s >= 0.8}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == want
    # A table of other texts under the same ids says nothing about these.
    other = spark.createDataFrame([(d, "the same text in all of these rows") for d, _ in rows], "doc_id long, text string")
    other.write.parquet(str(tmp_path / "other" / "documents.parquet"))
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path / "other")).collect()} == want


def test_copies_that_share_lines(spark, tmp_path):
    """Copies of documents of many lines, of which line dedup leaves little or nothing: none reaches the mix."""
    r = random.Random(81)
    rows, copies = [], set()
    for i in range(30):
        lines = [" ".join(words(r, 12)) for _ in range(20)]
        rows.append((10 * i, "\n".join(lines)))
        for k in range(1, 4):
            edited = list(lines)
            for j in r.sample(range(20), k - 1):
                edited[j] = edited[j].replace("a", "b", 1)
            rows.append((10 * i + k, "\n".join(edited)))
            if len(shingles(rows[-1][1]) & shingles(rows[-1 - k][1])) >= 0.8 * len(shingles(rows[-1][1]) | shingles(rows[-1 - k][1])):
                copies.add(10 * i + k)
    rows += [(1000 + i, " ".join(words(r, 30)) + "\n" + rows[0][1].split("\n")[i]) for i in range(10)]  # share one line each: no copies
    assert len(copies) > 60
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not left & copies
    assert {10 * i for i in range(30)} | set(range(1000, 1010)) <= left


def test_odd_tables(spark, tmp_path):
    """An empty table, nulls, a long text and repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string"
    r = random.Random(82)
    long = "\n".join(" ".join(words(r, 40)) for _ in range(5000))
    some = " ".join(words(r, 40))
    for name, rows, want in (
        ("empty", [], []),
        ("odd", [(1, long), (2, some), (2, some), (3, None), (4, ""), (5, "1 2 3"), (None, some), (6, some + " more")], ["1", "2", "None"]),
    ):
        sf = str(tmp_path / name)
        spark.createDataFrame([(d, t, "en", "a", 0, "x", "y") for d, t in rows], schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, "an item that is nowhere"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf)
        assert sorted(str(x["doc_id"]) for x in got.collect()) == want
        assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
