"""Connected components against a plain union-find: chains, stars, cliques, loops, null and repeated edges."""

import random

from textloom.llm.components import connected_components


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, 1000 + i) for i in range(1, 900)] + [(3000 + i, 3000 + j) for i in range(8) for j in range(i)]
    edges += [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(220)] + [(7, 7), (None, 3), (3, None)]
    edges += [(b, a) for a, b in edges[:50]]
    r.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(x) for x in connected_components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}
    assert connected_components(df.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "c"), ("a", "b")], "a string, b string")
    assert dict(map(tuple, connected_components(names).collect())) == {"a": "a", "b": "a", "c": "a"}
