import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from evidra.llm import language

from . import frames

WORDS = {"aa": "the of and thing these over water where".split(), "bb": "der und nicht schön über wasser weil".split(), "cc": "дом вода и она где кот".split()}


def brute_lengths(train, text, order):
    """Bits of ``text`` in each language, by a tree of dictionaries."""
    out = {}
    for lang, texts in train.items():
        tree = defaultdict(lambda: defaultdict(int))
        for t in texts:
            data = b"\xff" * order + t.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    tree[data[i - k:i]][data[i]] += 1
        bits, data = 0.0, b"\xff" * order + text.encode()
        for i in range(order, len(data)):
            for k in range(order, -1, -1):
                seen = tree.get(data[i - k:i])
                if not seen:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if data[i] in seen:
                    bits += math.log2((total + kinds) / seen[data[i]])
                    break
                bits += math.log2((total + kinds) / kinds)
            else:
                bits += 8
        out[lang] = bits
    return out


def trees_of(train, order):
    names = sorted(train)
    per = {lang: language.gram_counts(texts, order) for lang, texts in train.items()}
    counts = []
    for k in range(order + 1):
        keys = np.unique(np.concatenate([per[lang][k][0] for lang in names]))
        table = np.zeros((len(keys), len(names)))
        for i, lang in enumerate(names):
            table[np.searchsorted(keys, per[lang][k][0]), i] = per[lang][k][1]
        counts.append((keys, table))
    return language.Trees(names, np.full(len(names), 1 / len(names)), counts, order)


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_code_lengths_like_brute_force(monkeypatch):
    rng = random.Random(4)
    for order in (0, 2, 4):
        train = {lang: [text_of(rng, lang, 30) for _ in range(5)] for lang in WORDS}
        trees = trees_of(train, order)
        texts = ["", "a", "\x00\n", "zzz 漢字 ü", *(text_of(rng, lang, n) for lang in WORDS for n in (1, 9, 40)), text_of(rng, "aa", 5) + text_of(rng, "cc", 5)]
        for step in (1 << 20, 37):
            monkeypatch.setattr(language, "STEP", step)
            got = trees.lengths(texts) / language.UNIT
            for text, row in zip(texts, got):
                want = brute_lengths(train, text, order)
                assert np.allclose(row, [want[lang] for lang in trees.languages], atol=1e-4 * (len(text.encode()) + 1)), (order, step, text)


def labelled(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("de") for c in ("row", "lettered", "found", "score", "held_out", "lang_pred", "k", "n", "bytes")})


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(9)
    rows = [(i, text_of(rng, lang := rng.choice(list(WORDS)), rng.randrange(3, 60)), lang) for i in range(400)]
    odd = [(None, None, None), (None, "the water and these", "aa"), (1000, "", "bb"), (1001, " 12 .. ––\n", "cc"), (1002, None, "aa"), (1003, frames.LONG, None),
           (1004, "вода", None), (1004, "вода", None), (1005, "DER UND NICHT SCHÖN ÜBER", None), (1006, "漢", "bb")]
    got = language.identify(labelled(spark, rows + odd)).collect()
    assert len(got) == len(rows + odd)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(held) >= 0.98 * len(held)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[1000] == by[1001] == by[1002] == [("und", 0.0)] and ("und", 0.0) in by[None] and len(by[None]) == 2
    assert [p for p, _ in by[1004]] == ["cc", "cc"] and by[1004][0] == by[1004][1] and by[1005][0][0] == "bb"


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rng = random.Random(10)
    rows = [(i, text_of(rng, lang := rng.choice(list(WORDS)), 20), lang) for i in range(200)]
    bent = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows]
    a, b = (sorted(tuple(r) for r in language.identify(labelled(spark, x)).collect()) for x in (rows, bent))
    assert a == b and "zz" not in {r[2] for r in a}


def test_nothing_to_learn_from(spark):
    assert [(r.lang_pred, r.score) for r in language.identify(labelled(spark, [(1, "abc", None)])).collect()] == [("und", 0.0)]
    assert language.identify(labelled(spark, [])).collect() == []


def test_the_sample_is_bounded(spark):
    rng = random.Random(11)
    rows = [(i, text_of(rng, lang := rng.choice(list(WORDS)), 200), lang) for i in range(300)] + [(999, frames.LONG, "aa")]
    trees = language.train(labelled(spark, rows), most_bytes=3000)
    assert sum(len(k) for k in trees.keys) < 5 * 3 * 3000
