import random

import pytest

from tessera.llm.common import Scratch, components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("kind", ["sparse", "dense", "path", "star", "strings"])
def test_as_union_find(spark, kind):
    r = random.Random(kind)
    if kind == "path":
        order = r.sample(range(300), 300)
        edges = list(zip(order, order[1:], strict=False))
    elif kind == "star":
        edges = [(500, i) for i in range(400)] + [(i + 1000, 1000) for i in range(300)]
    elif kind == "strings":
        edges = [(f"h{r.randint(0, 80)}.net/", f"h{r.randint(0, 80)}.net/") for _ in range(60)]
    else:
        edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(130 if kind == "sparse" else 700)]
    edges += [(None, edges[0][0]), (edges[0][0], None), (edges[0][0], edges[0][0]), edges[0], edges[0][::-1]]
    kind = "string" if kind == "strings" else "long"
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(5)
    assert sorted(map(tuple, components(df, Scratch(spark)).collect())) == brute(edges)
    assert components(df.limit(0), Scratch(spark)).count() == 0
