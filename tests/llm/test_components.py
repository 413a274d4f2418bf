"""Components of random graphs, whole and in parts, against a union of sets."""

import random

import pytest

pytest.importorskip("cellgauge.llm")

from cellgauge.llm.components import connected_components, extended_components
from cellgauge.llm.scratch import Scratch


def of_sets(edges):
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for e in edges for n in e if find(n) != n}


def test_components_in_parts(spark):
    r = random.Random(90)
    path = list(zip(range(30), range(1, 31)))
    r.shuffle(path)
    loose = [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(130)]
    hub = [(500, n) for n in range(450, 600)]
    for name, first, more in (
        ("path", path[:20], path[20:]),
        ("loose", loose[:100], loose[100:]),
        ("hub", hub, hub[:3] + [(460, 7)]),
        ("nothing_new", hub, [(460, 470)]),
        ("none_at_first", [], loose),
        ("none_later", loose, []),
    ):
        scratch = Scratch(spark, name)
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        known = connected_components(frame(first), scratch, "one_")
        assert {x["node"]: x["component"] for x in known.collect()} == of_sets(first), name
        both = extended_components(known, frame(more), scratch, "two_").collect()
        assert {x["node"]: x["component"] for x in both} == of_sets(first + more), name
        assert len(both) == len(of_sets(first + more)), name
