import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import clusters, modularity

SCHEMA = "a long, b long, weight double"


def score(edges, label, resolution=1.0):
    total, inside, degree = 0.0, 0.0, {}
    for a, b, w in edges:
        if w is None or w <= 0 or a is None or b is None:
            continue
        total += 2 * w
        inside += 2 * w if label[a] == label[b] else 0
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
    return inside / total - resolution * sum(d * d for d in degree.values()) / total ** 2


def planted(groups=6, size=12, seed=3):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a) if rng.random() < (0.6 if a // size == b // size else 0.02)], size


def labels_of(df):
    return {r.id: r.label for r in df.collect()}


def test_planted_groups_are_found_and_repeat(spark):
    edges, size = planted()
    df = spark.createDataFrame(edges, SCHEMA)
    got = labels_of(modularity.communities(df))
    assert len(got) == 72 and len(set(got.values())) == 6
    assert all(got[a] == got[b] for a in got for b in got if a // size == b // size)
    assert abs(modularity.modularity(modularity.both_ways(df), spark.createDataFrame(list(got.items()), "id long, label long")) - score(edges, got)) < 1e-9
    again = labels_of(modularity.communities(spark.createDataFrame([(b, a, w) for a, b, w in reversed(edges)], SCHEMA).repartition(7)))
    assert again == got


def test_no_worse_than_label_propagation_and_finer_with_resolution(spark):
    rng = random.Random(9)
    ring = [(i, (i + d) % 60, 1.0 + (i // 10 == ((i + d) % 60) // 10)) for i in range(60) for d in (1, 2, 3)]
    edges = ring + [(rng.randrange(60), rng.randrange(60), 0.2) for _ in range(40)] + [(0, 0, 1.0), (5, None, 1.0), (7, 8, -3.0), (9, 10, None)]
    df = spark.createDataFrame(edges, SCHEMA)
    middle, fine = labels_of(modularity.communities(df)), labels_of(modularity.communities(df, 3.0))
    spread = labels_of(clusters.communities(df.where("weight > 0 AND b IS NOT NULL"), 8))
    assert score(edges, middle) >= score(edges, spread) - 1e-9
    assert score(edges, fine, 3.0) >= score(edges, spread, 3.0) - 1e-9
    assert len(set(middle.values())) < len(set(fine.values()))
    assert all(v in middle for v in middle.values())


@pytest.mark.parametrize("rows", [[], [(1, 2, 0.0)]])
def test_nothing_to_join(spark, rows):
    assert modularity.communities(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_a_hub_and_two_parts(spark):
    star = [(0, i, 1.0) for i in range(1, 30)] + [(100, 101, 1.0), (101, 102, 1.0), (100, 102, 1.0)]
    got = labels_of(modularity.communities(spark.createDataFrame(star, SCHEMA).withColumn("weight", F.col("weight") * 2)))
    assert got[100] == got[101] == got[102] != got[0] and len({got[i] for i in range(30)}) == 1
