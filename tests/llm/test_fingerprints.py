import hashlib
import random
import re

from pyspark.sql import functions as F

from evidra.llm import fingerprints

from . import frames


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, tolerance):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, following)))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    got = sorted(((g.doc_id, g.n_chars, g.edited_sha256, g.near_edited, g.near_next) for g in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:3] == w[:3]
        assert abs(g[3] - w[3]) < tolerance and abs(g[4] - w[4]) < tolerance, (g, w)


def texts(n, seed=5):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(1, 900))]
        if out and rng.random() < 0.4:
            words = out[-1].split()[:rng.randrange(1, 900)] + words[:rng.randrange(1, 200)]
        out.append(" ".join(words))
    return out


def test_edits_and_next_document(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 16)
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts(120))]
    check(rows, fingerprints.fingerprint_edits(frames.docs(spark, rows)).collect(), 0.15)


def test_awkward_rows(spark, monkeypatch):
    check([(r[0], r[1]) for r in frames.EDGE], fingerprints.fingerprint_edits(frames.docs(spark, frames.EDGE)).collect(), 0.15)
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 3)
    got = fingerprints.fingerprint_edits(frames.docs(spark, frames.EDGE)).collect()
    check([(r[0], r[1]) for r in frames.EDGE], got, 0.15)
    same = [g.fingerprint for g in got if g.doc_id in (7, 8)]
    assert len(same) == 3 and len(set(same)) == 1
    assert fingerprints.fingerprint_edits(frames.docs(spark, [])).collect() == []
    alone = fingerprints.fingerprint_edits(frames.docs(spark, [(4, "only this text here today")])).collect()
    assert alone[0].near_next == 1.0


def test_merging_and_estimates(spark):
    parts = texts(40, seed=6)
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(parts)] + [(2, "")], "part long, text string")
    sketches = fingerprints.with_sketch(df, "text", "sketch")
    merged = fingerprints.merge_sketches(sketches, ["part"])
    whole = [set().union(*(grams(t) for t in parts[p::2])) for p in (0, 1)] + [set()]
    for r in merged.withColumn("n", fingerprints.distinct_shingles("sketch")).collect():
        true = len(whole[r.part])
        assert abs(r.n - true) <= 0.25 * true
        assert len(r.sketch) == min(true, fingerprints.K)
    pair = spark.createDataFrame([(parts[0], parts[0] + " " + parts[1])], "a string, b string")
    pair = fingerprints.with_sketch(fingerprints.with_sketch(pair, "a", "sa"), "b", "sb")
    got = pair.select(fingerprints.containment("sa", "sb").alias("c"), fingerprints.resemblance("sa", "sb").alias("r")).first()
    assert got.c > 0.8 and abs(got.r - jaccard(parts[0], parts[0] + " " + parts[1])) < 0.12
    assert pair.select(F.size("sa")).first()[0] == min(len(grams(parts[0])), fingerprints.K)
