"""The last bounds of near-dedup: one row a document, exact, and no link lost."""

import random

import pytest

pytest.importorskip("cellgauge.llm")

from cellgauge.llm import minhash


def test_one_row_a_document(spark):
    keys = list(range(32))
    docs = [(1, 100, 1, keys), (2, 100, 2, keys), (3, 100, 3, keys), (4, 100, 1, [99]), (5, 100, 1, [99])]
    own = {1: range(100), 2: range(8, 108), 3: range(1000, 1100), 4: range(2000, 2100), 5: range(2000, 2100)}
    docs = spark.createDataFrame(docs, "id long, n long, c long, keys array<long>")
    sets = spark.createDataFrame([(d, list(s)) for d, s in own.items()], "id long, set array<long>")
    got = minhash._linkable(docs, sets, 85).collect()
    assert {x["id"]: (x["s"], sorted(x["keys"])) for x in got} == {1: (92, keys), 2: (92, keys)} and len(got) == 2


def test_chain_of_near_copies(spark):
    """Windows of one text: similar to their neighbours only, with shingles that all components share."""
    r = random.Random(91)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(900)]
    texts = {i: words[5 * i : 5 * i + 100] for i in range(80)} | {1000 + i: words[9 * i + 450 : 9 * i + 550] for i in range(30)}
    sets = {d: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for d, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    top = {d: d for d in texts}
    for _ in texts:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame).collect()} == top
