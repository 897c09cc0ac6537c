import random
import re
from collections import Counter, defaultdict

from evidra.llm import ngram_join

from . import frames

WORD = re.compile(r"\w+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [grams(r[1]) for r in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a == b) or (a and b and len(a & b) / len(a | b) >= threshold):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for group in members.values():
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], min(keys) if keys else None, links[i]) for i in group]
    return sorted(out, key=repr)


def near_copies(seed=3, groups=6, size=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 3))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def run(df, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(df, **options).collect()), key=repr)


def test_links_and_classes_like_brute_force(spark):
    rows = near_copies() + [(r[0] and r[0] + 1000, r[1]) for r in frames.EDGE]
    assert run(frames.docs(spark, rows)) == brute(rows)


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    rows = near_copies(seed=4, groups=2, size=40)
    assert run(frames.docs(spark, rows)) == brute(rows)


def test_one_of_each(spark):
    rows = near_copies() + [(900, "alone " * 3 + "in the world"), (901, "Alone alone, alone in the world!")]
    df = frames.docs(spark, rows)
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {c for _, c, _ in brute(rows)}
    assert ngram_join.one_of_each(frames.docs(spark, frames.EDGE)).count() > 0


def test_no_rows_and_nothing_near(spark):
    assert run(frames.docs(spark, [])) == []
    assert run(frames.docs(spark, [(1, "a b c d e f"), (2, "g h i j k l")])) == [(1, 1, 0), (2, 2, 0)]


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_many_rows_on_one_key_or_none(spark):
    rows = [(None if i % 3 else 7, t) for i, (_, t) in enumerate(near_copies(seed=8, groups=8, size=20))]
    rows += [(None, rows[1][1])] * 60 + [(i, t) for i, (_, t) in enumerate(near_copies(seed=8, groups=2, size=4))]
    assert run(frames.docs(spark, rows)) == brute(rows)


def test_words_of_all_scripts(spark):
    words = [f"mot{i}é" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "　".join(words[:-1])), (4, " – ".join(f"“{w}”" for w in words)), (5, "".join(words))]
    assert run(frames.docs(spark, rows)) == brute(rows)
    assert [r[2] for r in brute(rows)] == [3, 3, 3, 3, 0]
