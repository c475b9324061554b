"""Jobs done on all of the data: no cap, sample or filter leaves a part out."""

import numpy as np

from webloom.llm import neardup


def test_large_regions_are_opened(spark):
    n, linked = 1200, 600  # 600 classes beside the main component make 720000 pairs
    key = lambda i: i.to_bytes(4, "big")
    bits = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, (n, 8))
    bits[700], bits[900] = bits[5], bits[901]
    crowds = spark.createDataFrame([(key(i), 0, 3, 77) for i in range(n)], "set_key binary, tree int, depth int, region long")
    roots = spark.createDataFrame([(key(i), key(0)) for i in range(linked)], "node binary, root binary")
    fine = spark.createDataFrame([(key(i), [int(x) for x in bits[i]]) for i in range(n)], "set_key binary, bits array<long>")
    found = neardup.crowd_pairs(crowds, roots, fine, neardup.Settings()).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in found} == {(key(5), key(700)), (key(900), key(901))}


def test_forest_regions():
    rng = np.random.default_rng(1)
    s = neardup.Settings(depth=2, region=3, deepest=5)
    keys = np.array(sorted(tuple(rng.integers(0, 3, 5)) for _ in range(120)), np.uint32)
    tree = np.repeat([0, 1], 60)
    shared = neardup.prefix_lengths(tree, keys)
    for i in range(1, 120):
        length = next((k for k in range(5) if keys[i, k] != keys[i - 1, k]), 5)
        assert shared[i] == (length if tree[i] == tree[i - 1] else 0)
    pairs = set(zip(*(x.tolist() for x in neardup.forest_pairs(shared, s))))
    assert all(a < b and shared[a + 1 : b + 1].min() >= s.depth for a, b in pairs)
    for depth in range(2, 6):
        first = [i for i in range(120) if shared[i] < depth]
        for a, b in zip(first, [*first[1:], 120]):
            outer = max(i for i in range(a + 1) if shared[i] < depth - 1) if depth > 2 else None
            size = next((j for j in range(a + 1, 120) if shared[j] < depth - 1), 120) - outer if depth > 2 else 4
            if size > s.region:  # only large regions are cut further
                assert all((a, j) in pairs for j in range(a + 1, b))
                if b - a <= s.region:
                    assert all((i, j) in pairs for i in range(a, b) for j in range(i + 1, b))


def test_regions_over_borders(spark):
    # Ten thousand classes in one order whose regions are larger than a task's part of it.
    rng = np.random.default_rng(2)
    s = neardup.Settings(trees=2, depth=3, deepest=6, floor=0.0)
    rows = [(i.to_bytes(4, "big"), i, np.concatenate([[7, 7, i % 5], rng.integers(0, 3, 3)]).astype(np.uint32).tobytes()) for i in range(3000)]
    classes = spark.createDataFrame(rows, "set_key binary, doc_id long, signature binary").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs, crowds = neardup.candidates(classes, s)
        found = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in pairs.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root = list(range(3000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert len({(find(i), i % 5) for i in range(3000)}) <= 5  # every region hangs together
    assert crowds.select("set_key").distinct().count() == 3000
