"""Each stage of the pipeline against brute force on its own input, with awkward rows among real ones."""

import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from evidra.llm import quality

from . import frames, test_linededup, test_mixing, test_ngram_join, test_packing

DATA = os.environ.get("EVIDRA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="input tables not present")
def test_stages_against_brute_force(spark, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [r for r in frames.EDGE if r[0] not in (7,)]  # rows that share a key are in the operators' own tests
    docs = real.unionByName(frames.docs(spark, [(r[0] and r[0] + 10_000, *r[1:]) for r in odd], clashes=False)).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")

    def written(df, name):
        assert df.columns == real.columns
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = written(stage["quality classifier"](spark, docs, DATA), "good")
    model = quality.train(docs, labels)
    rows = docs.collect()
    scores = model.score(quality.feature_rows([r.text for r in rows]))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "", r.source or "")
    assert sorted(map(key, good.collect())) == sorted(key(r) for r, s in zip(rows, scores) if s >= quality.THRESHOLD)

    lines = written(stage["line dedup"](spark, good, DATA), "lines")
    before = [(r.doc_id, r.text) for r in good.collect()]
    want = sorted(((d, kept) for d, _, dropped, kept in test_linededup.brute(before)), key=repr)
    assert sorted(((r.doc_id, r.text or "") for r in lines.collect()), key=repr) == want
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())

    single = written(stage["n-gram Jaccard join"](spark, lines, DATA), "single")
    before = [(r.doc_id, r.text) for r in lines.collect()]
    first = {c for _, c, _ in test_ngram_join.brute(before)}
    assert sorted((r.doc_id for r in single.collect()), key=repr) == sorted((d for d, _ in before if d in first), key=repr)

    mixed = written(stage["mixing sources"](spark, single, DATA), "mixed")
    kept = single.collect()
    targets = test_mixing.brute_targets({s: sum(len(test_mixing.SIZE.findall(r.text or "")) for r in kept if r.source == s) for s in {r.source for r in kept}})
    for source, target in targets.items():
        sizes = [len(test_mixing.SIZE.findall(r.text or "")) for r in kept if r.source == source]
        taken = sum(len(test_mixing.SIZE.findall(r.text or "")) for r in mixed.collect() if r.source == source)
        assert abs(taken - target) <= max(sizes, default=0)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stage["packing"](spark, mixed, DATA).collect()
    test_packing.check(tokenizer, [(r.doc_id, r.text) for r in mixed.collect()], pieces)
