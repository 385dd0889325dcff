"""Connected groups against a plain search."""

import numpy as np
import pytest

from tillroll.llm import common as C


def searched(pairs):
    near = {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def graphs():
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(600)]
    star = [(10_000, 10_001 + i) for i in range(300)] + [(20_000 + i, 30_000) for i in range(300)]
    loose = [tuple(int(x) for x in p) for p in rng.integers(-40_500, -40_000, (260, 2))]
    return path + star + loose + loose[:50] + [(v, u) for u, v in loose[:20]] + [(7, 7), (-9, -9)]


@pytest.mark.parametrize("task_links", [0, 200, C.TASK_LINKS])
def test_components(spark, task_links):
    pairs = graphs()
    found = C.components(spark.createDataFrame(pairs, "u long, v long"), task_links=task_links)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == searched(pairs)


@pytest.mark.parametrize("pairs", [[], [(3, 3)]])
def test_no_links(spark, pairs):
    assert C.components(spark.createDataFrame(pairs, "u long, v long"), task_links=0).isEmpty()


def test_roots_of_a_long_path():
    order = np.random.default_rng(4).permutation(5_000)
    node, root = C.roots(order[:-1], order[1:])
    assert (node == np.arange(5_000)).all() and (root == 0).all()
