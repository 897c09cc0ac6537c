import math

import numpy as np
import pytest

from evidra.llm import topk


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q, a in dict(good).items():
        if q % 50 == 0:
            asked = [v for i, v in good if i == q]
            scores = sorted((-sum(x * y for x, y in zip(s, v)), i) for s in asked for i, v in good if i != q and len(v) == len(s))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, v int, b int, c int, dims int")
    return sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0, **options).collect())


@pytest.mark.parametrize("blocks", [dict(block_rows=8192, chunk_queries=256), dict(block_rows=70, chunk_queries=3)])
def test_like_brute_force_with_ties_and_bad_rows(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(0, 0.125, (400, 16)))]
    rows[7] = (7, rows[8][1])
    rows[60] = (60, [0.0] * 16)
    rows += [(500, None), (501, [None] + [0.1] * 15), (502, [float("nan")] * 16), (550, [float("inf")] * 16), (None, rows[3][1]),
             (503, [0.5] * 3), (504, []), (-50, rows[9][1]), (600, [-0.001] * 16)]
    full = [(*r, 1, 2, 3, 4, 5, 6) for r in rows]
    assert run(spark, full, k=5, **blocks) == brute(rows, 5)


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 4)]) for i in range(60)] + [(1000, [0.5] * 5)]
    rows += [(1050 + 50 * i, [0.25 * i] * 5) for i in range(4)] + [(2000, []), (2001, []), (2003, [])]
    got = run(spark, [(*r, 1, 2, 3, 4, 5, 6) for r in rows], k=5)
    assert got == brute(rows, 5) and len({r[0] for r in got if r[0] < 1000}) == 2 and [r[2:] for r in got if r[0] == 2000] == [(2001, 0), (2003, 0)]


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0], 1, 2, 3, 4, 5, 6)]) == []
    assert run(spark, [(0, [1.0, 2.0], *[1] * 6), (3, [1.0, 0.0], *[1] * 6)]) == [(0, 1, 3, 65536)]
    assert run(spark, [(1, [1.0, 2.0], *[1] * 6), (3, [1.0, 0.0], *[1] * 6)]) == []


def test_wide_values_and_negative_queries():
    rng = np.random.default_rng(2)
    values = rng.integers(-4000, 4000, (300, 9))
    ids = np.arange(300)
    q, row, score = topk.top_of_block(topk.SlicedBlock(values), values, ids, values[:20], ids[:20], 3)
    for i in range(20):
        exact = values @ values[i]
        exact[i] = exact.min() - 1
        best = np.sort(exact)[-3:]
        assert set(best) <= set(score[q == i]) and len(set(row[q == i])) == (q == i).sum()
