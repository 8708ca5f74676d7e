"""Components by rounds and in one task, against a plain union."""

import random

import pytest

from keepsake.llm import components as C
from keepsake.llm.common import Scratch


@pytest.mark.parametrize("most", [0, 10_000])
@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_components(spark, monkeypatch, most, kind):
    monkeypatch.setattr(C, "ONE_TASK_EDGES", most)
    r = random.Random(kind)
    name = [r.randrange(-(2**60), 2**60) for _ in range(120)]
    edges = {
        "random": [(r.choice(name), r.choice(name)) for _ in range(90)], "path": list(zip(name[:40], name[1:41])), "star": [(name[0], n) for n in name[1:50]] * 2,
        "loops": [(name[0], name[0]), (name[1], name[2]), (name[2], name[2])], "none": [],
    }[kind]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = C.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "c").collect()
    assert len(got) == len(parent) and {g.node: g.root for g in got} == {n: find(n) for n in parent}
