import random

import pytest

from photonframe.llm import shared


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and random edges, broadcast as a whole, with few hubs, and with every node one."""
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 900 + i) for i in range(40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for nodes, share in ((10**6, 100_000), (0, 100), (0, 10**6)):
        monkeypatch.setattr(shared, "BROADCAST_NODES", nodes)
        monkeypatch.setattr(shared, "HUB_SHARE", share)
        got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="shared|share"):
        shared.shared_dir(Session())


def test_replaced_tables_are_removed(spark):
    first = shared.saved(spark.range(5), "one")
    place = shared._places[first]
    second = shared.saved(first.filter("id > 1"), "two", (first,))
    assert second.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(place).count()
