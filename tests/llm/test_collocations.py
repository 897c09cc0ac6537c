import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evidra.llm import collocations

from . import frames

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most_words=5, top=2000):
    """rows: (lang, text)."""
    out = []
    by = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    by["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    for lang, f in by.items():
        kept = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        inside = set()
        for p, c in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * c >= 100 * f[p[i:i + k]]:
                        inside.add(p[i:i + k])
        found = []
        for p, a in kept.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(rng, n=300):
    vocabulary = [rng.choice("ka lo mi su te ra né ü".split()) * rng.randrange(1, 3) + rng.choice("nxyz") for _ in range(60)]
    fixed = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 8))] for _ in range(12)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words += rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(vocabulary), rng.choice(["a", "A"]) * rng.randrange(1, 4)]
            words[-1] += rng.choice(["", "", "", ".", ",", "\t", "\n", " ;", "\r\n", "\x0b"])
        rows.append((rng.choice(["en", "en", "en", "de", None]), " ".join(words)))
    return rows


def frame(spark, rows):
    df = frames.docs(spark, [(i, text) for i, (_, text) in enumerate(rows)], clashes=False)
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return df.drop("lang").join(langs, "doc_id").withColumns({c: F.lit(c) for c in ("grp", "words", "p1", "h", "f", "next", "phrase", "score")})


def test_like_brute_force(spark):
    rows = corpus(random.Random(5))
    for least, options in ((10, {}), (25, {"splits": 40}), (10, {"bits": 7, "top": 30}), (3, {"most_words": 3})):
        got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least_count=least, **options).collect())
        want = brute(rows, least, options.get("most_words", 5), options.get("top", 2000))
        assert got == want and len(got) > 20, (least, options)


def test_awkward_rows(spark):
    rows = [(None if i % 3 else "x", r[1]) for i, r in enumerate(frames.EDGE)] + [("", "nul\x00 nul\x00 one　two"), ("x", "A a a A"), ("x", None), ("und", "twice the same row of words")]
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least_count=2).collect())
    assert got == brute(rows, 2) and got
    assert collocations.collocations(frame(spark, rows).limit(0), least_count=2).collect() == []
    assert collocations.collocations(frame(spark, [("x", None)]), least_count=2).collect() == []


def test_stripes_of_many_tasks_and_small_steps(spark, monkeypatch):
    rows = corpus(random.Random(6), 120)
    monkeypatch.setattr(collocations, "STEP", 200)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(7), least_count=8).collect())
    assert got == brute(rows, 8)


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9_000_000_000_000, 31_000_000_000_000_007, 9_100_000_000_001, 30_000_000_000_000_003
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(F.expr(collocations.SCORE)).first()[0] == 1000 * a * n // (left * right)


def test_a_shared_hash_is_hashed_anew(spark, monkeypatch):
    rows = corpus(random.Random(7), 60)
    real, seeds = collocations.words_of, []

    def bent(groups, texts, seed):
        out = list(real(groups, texts, seed))
        if seed == 0:
            out[1] = out[5] ^ (out[1] & collocations.U(0xF))  # every hash is shared
        return tuple(out)

    def counted(rows, seed, real=collocations.word_counts):
        seeds.append(seed)
        return real(rows, seed)
    monkeypatch.setattr(collocations, "words_of", bent)
    monkeypatch.setattr(collocations, "word_counts", counted)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least_count=8).collect())
    assert got == brute(rows, 8) and seeds == [0, 1]
