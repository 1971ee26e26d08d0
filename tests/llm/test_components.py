import random

import pytest

from twinlens.llm.common import connected_components


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def path(n):
    return [(i, i + 1) for i in range(n)]


def sparse(nodes, edges, seed=5):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


@pytest.mark.parametrize("edges", [path(20), path(60), [(a, b) for a, b in sparse(2000, 1400) if a != b]], ids=["path 20", "path 60", "sparse"])
def test_each_id_has_one_row(spark, edges):
    """Chains of hooks longer than a few doublings follow give no id twice."""
    found = connected_components(spark.createDataFrame(edges, "a long, b long").coalesce(2)).collect()
    assert sorted((r["id"], r["component_id"]) for r in found) == components(edges)
