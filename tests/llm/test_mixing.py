import re
from collections import Counter, defaultdict

from evidra.llm import mixing

from . import frames

SIZE = re.compile(r"[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > most * sizes[s]}
        if not over:
            target.update({s: w[s] * level for s in left})
            break
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        left -= over
    return target


def check(rows, got):
    sizes, largest, taken, targets = Counter(), Counter(), Counter(), {}
    for r in rows:
        n = len(SIZE.findall(r[1] or ""))
        sizes[r[2]] += n
        largest[r[2]] = max(largest[r[2]], n)
    assert len(got) == len(rows)
    for r in got:
        source = r.row.source
        assert r.size == len(SIZE.findall(r.row.text or "")) and r.source_size == sizes[source]
        assert 0 <= r.copies <= 2
        taken[source] += r.copies * r.size
        targets[source] = r.target
    want = brute_targets(sizes)
    for source, target in targets.items():
        assert abs(target - want[source]) < 1e-6 * max(1, target)
        assert abs(taken[source] - target) <= largest[source]


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), ("a", "b", "c", "d", None)[min(i % 11, 4)]) for i in range(1500)]
    df = frames.docs(spark, rows)
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rs: sorted((r.row.doc_id, r.copies) for r in rs)
    assert key(got) == key(again)


def test_awkward_rows(spark):
    df = frames.docs(spark, frames.EDGE)
    check(frames.EDGE, mixing.mix(df).collect())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    counted = defaultdict(int)
    for r in mixing.mix(df).collect():
        counted[r.row.doc_id] += r.copies
    assert copies == Counter({k: v for k, v in counted.items() if v})


def test_no_rows_and_no_words(spark):
    assert mixing.mix(frames.docs(spark, [])).collect() == []
    got = mixing.mix(frames.docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in got] == [(0, 0, 0.0, 0)] * 2
