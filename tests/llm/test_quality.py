import random

from evidra.llm import quality

from . import frames


def corpus(n=600, seed=8):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice("the of and to in house river stone walk light small green".split()) + rng.choice(("", "er", "ly", "ing")) for _ in range(rng.randrange(30, 300))]
        bad = rng.random() < 0.25
        if bad:
            words = [w + "###" for w in words] if rng.random() < 0.5 else [w for w in words[:20] for _ in range(12)]
        else:
            words = [w + ("." if rng.random() < 0.1 else "") for w in words]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_labels_are_met(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in quality.classify(frames.docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    held = [(got[d], y) for d, y, _ in labels if got[d].held_out]
    assert len(held) > 30
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
    good, bad = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_held_out_labels_are_not_read(spark):
    import zlib
    rows, labels = corpus(200)
    docs = frames.docs(spark, rows)
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y, t) for d, y, t in labels]
    scores = [sorted((r.doc_id, r.held_out, round(r.score, 9)) for r in quality.classify(docs, spark.createDataFrame(x, LABELS)).collect())
              for x in (labels, turned)]
    assert scores[0] == scores[1]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h, _ in scores[0])


def test_awkward_rows(spark):
    rows, labels = corpus(150)
    rows = [(r[0] + 1000, r[1]) for r in rows] + frames.EDGE
    labels = [(d + 1000, y, t) for d, y, t in labels] + [(None, 1, 0), (1003, None, 0), (77777, 1, 0), *[(1000 + i, 1, 0) for i in range(3)]]
    df = frames.docs(spark, rows)
    got = quality.classify(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    kept = quality.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def test_nothing_to_learn_from(spark):
    rows, _ = corpus(20)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.classify(frames.docs(spark, rows), none).collect()} == {0.5}
    assert quality.classify(frames.docs(spark, []), none).collect() == []
    assert quality.classify(frames.docs(spark, []), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []
