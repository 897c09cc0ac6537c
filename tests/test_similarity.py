import itertools
import math
import random

import numpy as np
import pytest

from evidra.functions.quantiles import exact_quantile
from evidra.operators import clusters as K
from evidra.operators import listings as L
from evidra.operators import neighbors as N
from evidra.operators import similarity as S


def make_sets(seed=1, n=40):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        s = {f"r{rng.randrange(60)}" for _ in range(rng.randrange(0, 5))}
        s |= {f"h{k}" for k in range(4) if rng.random() < 0.5}  # frequent terms
        if s:
            sets[i] = s
    sets[100] = sets[101] = sets[102] = {"h0", "h1"}  # copies, frequent terms only
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(i, t) for i, s in sets.items() for t in sorted(s)], "item long, term string")


def brute(sets):
    n = len(sets)
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    ic = {t: -math.log(c / n) for t, c in df.items()}
    tot = {i: sum(ic[t] for t in s) for i, s in sets.items()}
    sim = {}
    for a, b in itertools.permutations(sets, 2):
        sh = sum(ic[t] for t in sets[a] & sets[b])
        u = tot[a] + tot[b] - sh
        sim[a, b] = sh / u if u > 0 else 0.0
    return sim


@pytest.mark.parametrize("frequent", [1000, 8, 2])
def test_top_k_is_exact_whatever_counts_as_frequent(spark, frequent):
    sets = make_sets()
    sim = brute(sets)
    k = 5
    want = {}
    for a in sets:
        ranked = sorted(((-round(sim[a, b], 9), b) for b in sets if b != a and sim[a, b] > 1e-12))[:k]
        want[a] = [(b, -s) for s, b in ranked]
    got = {}
    for r in S.top_k(frame(spark, sets), k, frequent=frequent).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append((r["other"], r["sim"]))
    for a, rows in want.items():
        assert [round(s, 6) for _, s in got.get(a, [])] == [round(s, 6) for _, s in rows]
        # ids agree wherever scores are not tied to rounding
        assert {b for b, _ in got.get(a, [])} == {b for b, _ in rows} or len({round(s, 9) for _, s in rows}) < len(rows)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_similar_pairs_prefix_join_is_exact(spark, threshold):
    sets = make_sets(3)
    sim = brute(sets)
    groups = {}
    for i, s in sorted(sets.items()):
        groups.setdefault(frozenset(s), []).append(i)
    reps = {m[0]: len(m) for m in groups.values()}
    want = {(a, b, reps[a], reps[b]) for a in reps for b in reps if a < b and sim[a, b] >= threshold - 1e-12}
    got = {(r.a, r.b, r.copies_a, r.copies_b) for r in S.similar_pairs(frame(spark, sets), threshold).collect()}
    assert got == want


def test_score_pairs_and_rank(spark):
    sets = make_sets(5)
    sim = brute(sets)
    ids = sorted(sets)[:6]
    pairs = [(a, b) for a in ids for b in ids if a != b]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in S.score_pairs(df, frame(spark, sets)).collect():
        assert abs(r.sim - sim[r.a, r.b]) < 1e-9
    for r in S.rank_of_pair(df, frame(spark, sets)).collect():
        assert abs((1 + sum(sim[r.a, o] > sim[r.a, r.b] + 1e-12 for o in sets if o != r.a)) - r["rank"]) == 0


@pytest.mark.parametrize("n,p", [(1, 0.5), (2, 0.25), (7, 0.95), (301, 0.25), (5000, 0.99), (9001, 0.5)])
def test_exact_quantile_matches_numpy(spark, n, p):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 10), 2) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, v double")
    got = {r.g: r.quantile for r in exact_quantile(df, "v", p, ["g"]).collect()}
    assert abs(got["a"] - float(np.percentile(values, 100 * p))) < 1e-9
    assert got["b"] == 1.0
    one = exact_quantile(df.where("g = 'a'"), "v", p).first()[0]
    assert abs(one - float(np.percentile(values, 100 * p))) < 1e-9


@pytest.mark.parametrize("block_rows", [8, 50, 10000])
def test_knn_is_exact_with_many_blocks_and_a_hot_block(spark, block_rows):
    rng = np.random.default_rng(2)
    hot = rng.normal([5, 0, 0, 0], 0.05, size=(60, 4))
    rest = rng.normal(size=(60, 4))
    x = np.vstack([hot, rest])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in K.knn(df, 5, block_rows=block_rows, max_pivots=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((round(r.sim, 7)))
    for i in range(len(x)):
        want = sorted((s[i, j] for j in range(len(x)) if j != i), reverse=True)[:5]
        assert np.allclose(got[i], want, atol=1e-6)


def test_machinery_top_is_exact_with_frequent_terms(spark):
    sets = make_sets(7, 25)
    other = make_sets(8, 25)
    edges = spark.createDataFrame([(0, 1, 900), (2, 3, 800)], "a long, b long, score int")
    idx = {"complex": frame(spark, sets), "go": frame(spark, other)}
    whole = N.Machinery(idx, edges, frequent=10 ** 6).top(4).orderBy("item", "rank").collect()
    split = N.Machinery(idx, edges, frequent=3).top(4).orderBy("item", "rank").collect()
    assert [(r.item, r.other, round(r.mech, 6)) for r in whole] == [(r.item, r.other, round(r.mech, 6)) for r in split]
    sim1, sim2 = brute(sets), brute(other)
    row = next(r for r in whole if (r.item, r.other) == (0, 1) or (r.item, r.other) == (2, 3))
    base = 0.2 * sim1.get((row.item, row.other), 0) + 0.35 * sim2.get((row.item, row.other), 0)
    bonus = 0.6 * (0.9 if row.item == 0 else 0.8)
    assert abs(row.mech - (1 - (1 - base) * (1 - bonus))) < 1e-6


def test_machinery_reasons_match_brute_force(spark):
    rng = random.Random(5)
    go = {i: {f"{rng.randrange(12)}" for _ in range(4)} for i in range(14)}
    complexes = {i: {f"c{rng.randrange(5)}", "everywhere"} for i in range(14)}
    edges = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(20)) if a < b})
    partners = {i: {i} | {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in {x for e in edges for x in e}}
    up = {(str(t), str(t // 2)) for t in range(1, 12)} | {(str(t), str(t // 4)) for t in range(2, 12)} | {(str(t), str(t // 8)) for t in range(4, 12)}

    def rows(sets):
        return [(i, str(t)) for i, s in sets.items() for t in sorted(s, key=str)]
    indexes = {"complex": complexes, "go": go, "partners": partners}
    m = N.Machinery({n: spark.createDataFrame(rows(s), "item long, term string") for n, s in indexes.items()},
                    spark.createDataFrame([(a, b, 700 + 10 * a) for a, b in edges], "a long, b long, score int"),
                    {"complex": 0.4, "go": 0.3, "partners": 0.3}, frequent=3)
    asked = [(a, b) for a in range(14) for b in range(14)]
    got = {}
    closure = spark.createDataFrame([*up, ("3", "3")], "id string, ancestor string")
    for r in m.explain(spark.createDataFrame([*asked, (1, 2)], "a long, b long"), 4, {"go": closure}).orderBy("a", "b", "rank").collect():
        got.setdefault((r.a, r.b), []).append((r.kind, r.term, round(r.strength, 6)))
    want = {}
    for a, b in asked:
        if a == b:
            continue
        found = []
        for name, sets in indexes.items():
            shared = {str(t) for t in sets.get(a, ())} & {str(t) for t in sets.get(b, ())}
            if name == "go":
                shared -= {p for t in shared for c, p in up if c == t and c != p}
            for t in shared:
                n = sum(t in {str(x) for x in s} for s in sets.values())
                if n < len(sets) and not (name == "partners" and t in (str(a), str(b))):
                    found.append((-round(math.log(len(sets) / n), 9), "partner" if name == "partners" else name, t))
        direct = [("interaction", None, round(0.7 + 0.01 * min(a, b), 6))] if (min(a, b), max(a, b)) in edges else []
        best = (direct + [(k, t, round(-s, 6)) for s, k, t in sorted(found)])[:4]
        if best:
            want[a, b] = best
    assert got == want and {k for v in got.values() for k, _, _ in v} == {"interaction", "complex", "go", "partner"}


def test_combine_uses_a_lone_signal(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(
        N.combine(F.lit(0.4), F.lit(0.1), F.lit(0.8), F.lit(0.5), F.lit(True), F.lit(True)).alias("both"),
        N.combine(F.lit(0.4), F.lit(0.1), F.lit(0.8), F.lit(0.5), F.lit(True), F.lit(False)).alias("sym"),
        N.combine(F.lit(0.4), F.lit(0.1), F.lit(0.8), F.lit(0.5), F.lit(False), F.lit(True)).alias("mech")).first()
    assert abs(row.both - (0.5 * (0.5 + 0.2) / 2 + 0.5 * (0.5 * 0.2) ** 0.5)) < 1e-6
    assert abs(row.sym - 0.75 * 0.5) < 1e-9 and abs(row.mech - 0.75 * 0.2) < 1e-9


def test_shared_records_hot_record_matches_brute_force(spark):
    rng = random.Random(4)
    owners = [(i, i // 3, rng.random() < 0.5) for i in range(40)]
    assets = {(o, r) for o, _, _ in owners for r in range(4) if rng.random() < 0.2} | {(o, 99) for o, _, _ in owners}
    kind = {0: 0, 1: 2, 2: 0, 3: 2, 99: 2}
    near = [(i, (i + 5) % 40, 1) for i in range(40)]
    near_of = {(a, b): k for a, b, k in near}
    info = {o: (g, p) for o, g, p in owners}
    want = {}
    for o, g, _ in owners:
        best = {}
        for (o1, r) in assets:
            if o1 != o:
                continue
            for (o2, r2) in assets:
                if r2 == r and info[o2][0] != g:
                    k = near_of.get((o, o2))
                    key = (kind[r], k is None, k if k is not None else 999, not info[o2][1], r, o2)
                    best[o2] = min(best.get(o2, (9,)), key) if o2 in best else key
        want[o] = [(k[5], k[4]) for k in sorted(best.values())[:3]]
    a = spark.createDataFrame([(o, r, kind[r], str(kind[r])) for o, r in assets], "owner long, record long, type_rank int, type string")
    n = spark.createDataFrame(near, "owner long, partner long, near_rank int")
    w = spark.createDataFrame(owners, "owner long, gene long, has_people boolean")
    got = {}
    for r in L.shared_records(a, n, w).orderBy("owner", "pos").collect():
        got.setdefault(r.owner, []).append((r.partner, r.record))
    assert got == {k: v for k, v in want.items() if v}


def test_frontier_scores(spark):
    schema = "id string, n_requests int, n_terms int, n_groups int, n_studies int, prevalence string, strength string, n_causing int, recent boolean, campaign string"
    rows = [("asked", 3, 0, 0, 0, None, "strong", 0, False, None), ("done", 0, 9, 1, 1, "1-5 / 10 000", "definitive", 50, True, None),
            ("thin", 0, 2, 1, 1, None, "limited", 25, False, "spring")]
    got = {r.id: r for r in L.impact_frontier(spark.createDataFrame(rows, schema)).collect()}
    assert got["asked"].score == round(6 * 2 + 4 + 1.5 + 1 + 1, 2) and got["asked"].focus == "symptoms"
    assert got["done"].score == 3.0 + 1.0 - 3 and got["done"].focus == "review"
    assert got["thin"].score == 4 + 2.5 - 1 + 1 and "campaign spring" in got["thin"].reasons


def test_knn_splits_blocks_and_queries_by_their_own_limits(spark, monkeypatch):
    """Parts and loads do not follow ``block_rows``; copies tie by id, and vectors keep their type until they are compared."""
    monkeypatch.setattr(K, "PART_ROWS", 16)
    monkeypatch.setattr(K, "LOAD_ROWS", 8)
    rng = np.random.default_rng(5)
    x = np.vstack([np.repeat(rng.normal(size=(1, 6)), 40, axis=0), rng.normal(size=(50, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    got = {}
    for r in K.knn(df, 5, block_rows=20, max_pivots=4).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:5] for i in range(90)}


@pytest.mark.parametrize("dense_share", [0, 128, 10 ** 9])
def test_machinery_by_blocks(spark, monkeypatch, dense_share):
    """Many blocks, terms as columns or met one by one: the same scores, no more rows than k per id and block, and given pairs in any order."""
    rng = random.Random(4)
    held = [(i, t) for i in range(40) for t in range(12) if rng.random() < (0.5 if t < 3 else 0.2)]
    edges = spark.createDataFrame([(0, 1, 900), (2, 99, 800)], "a long, b long, score int")
    frames = {"complex": spark.createDataFrame(held, "item long, term long")}
    whole = N.Machinery(frames, edges)
    want = {(r.item, r.other): r.mech for r in whole.top(100).collect()}
    monkeypatch.setattr(N, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(N, "DENSE_SHARE", dense_share)
    split = N.Machinery(frames, edges, frequent=10 ** 6)
    assert whole.blocks == 1 and split.blocks >= 5
    assert {(r.item, r.other): r.mech for r in split.top(100).collect()} == want and want[(99, 2)] == want[(2, 99)] > 0
    assert split._compared(split.bonus, 2).count() <= 41 * 2 * split.blocks
    pairs = spark.createDataFrame([(1, 0), (0, 1), (99, 2), (7, 1000), (5, 6)], "a long, b long")
    got = {(r.a, r.b): r.mech for r in split.score(pairs).collect()}
    assert got == {(1, 0): want[(0, 1)], (0, 1): want[(0, 1)], (99, 2): want[(2, 99)], (7, 1000): 0.0, (5, 6): want.get((5, 6), 0.0)}


@pytest.mark.parametrize("few", [0, 10 ** 9])
def test_blocks_of_machinery_meet_where_they_are_stored(spark, monkeypatch, few):
    """Lists or rows, one block or many, pairs looked up or taken from whole blocks: the same scores and reasons, and no shuffle of what ids hold."""
    rng = random.Random(9)
    held = {i: {t for t in range(40) if rng.random() < 0.25} | {rng.randrange(40)} for i in range(60)}
    dag = spark.createDataFrame([(t, t // 2) for t in range(1, 40)], "child long, parent long")
    rows = spark.createDataFrame([(i, t) for i, s in held.items() for t in s], "item long, term long")
    lists = spark.createDataFrame([(i, sorted(s)) for i, s in held.items()], "item long, terms array<long>")
    edges = spark.createDataFrame([(0, 1, 900), (2, 77, 800), (5, 40, 750)], "a long, b long, score int")
    weights = {"go": 0.5, "partners": 0.5}
    whole = N.Machinery({"go": rows, "partners": N.partner_terms(edges)}, edges, weights)
    monkeypatch.setattr(N, "BLOCK_TERMS", 60)
    monkeypatch.setattr(N, "PARTS", 2)
    monkeypatch.setattr(N, "FEW", few)
    split = N.Machinery({"go": lists, "partners": N.partner_terms(edges, lists=True)}, edges, weights)
    assert whole.blocks == 1 and split.blocks > 8 and split.packed.count() <= split.blocks
    assert {tuple(r) for r in split.top(4).collect()} == {tuple(r) for r in whole.top(4).collect()}
    plan = split._compared(split.bonus, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    asked = spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in range(60)] + [(77, 2), (3, 1000), (None, 4)], "a long, b long")
    assert {(r.a, r.b, r.mech) for r in split.score(asked).collect()} == {(r.a, r.b, r.mech) for r in whole.score(asked).collect()}
    sim = {x: y for x, y in brute({i: {f"{t}" for t in s} for i, s in held.items()}).items()}
    got = {(r.a, r.b): r.weighted for r in split.score(asked).where("a <> b and a < 60 and b < 60").collect()}
    plain = {p for p in got if not {0, 1, 2, 5, 40} & set(p)}
    assert plain and all(abs(got[p] - 0.5 * sim.get(p, sim.get(p[::-1], 0))) < 1e-9 for p in plain)
    reasons = {tuple(r) for r in split.explain(asked, 3, {"go": dag}).collect()}
    assert reasons == {tuple(r) for r in whole.explain(asked, 3, {"go": dag}).collect()}
    over = {t: {t >> k for k in range(1, 7)} - {t} for t in range(40)}
    n = {t: sum(t in s for s in held.values()) for t in range(40)}
    for a, b in ((7, 8), (14, 30), (21, 3)):
        shared = {t for t in held[a] & held[b] if n[t] < 60}
        low = sorted((t for t in shared if not any(t in over[o] for o in shared)), key=lambda t: (-round(math.log(60 / n[t]), 9), str(t)))[:3]
        assert [r[3] for r in sorted((r for r in reasons if r[:2] == (a, b)), key=lambda r: r[5])] == [str(t) for t in low]
    assert {r.item for r in split.holders("go").collect()} == set(held)
