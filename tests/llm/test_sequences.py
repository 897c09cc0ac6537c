import random
from collections import defaultdict

import numpy as np
import public_tokenizers

from evidra.llm import sequences, tokens

from . import frames

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_chunks_give_the_encoders_ids():
    import tiktoken
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = tokens.byte_encoder(RANKS, PATTERN)
    for text in ["", "a  b\t\nc ", "   x", "it's 12 34,5", "é  b　c   d", "<|endoftext|> x", " \n y"] + [r[1] or "" for r in frames.EDGE]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode_ordinary(text)


def round_trip(spark, rows, length, tmp_path):
    packed = sequences.pack_matrix(frames.docs(spark, rows).repartition(2), RANKS, PATTERN, length=length)
    path = str(tmp_path / f"packed{length}")
    sequences.write_packed(packed, path)
    back = spark.read.parquet(path)
    decode = tokens.byte_decoder(RANKS)
    parts, full = defaultdict(list), back.collect()
    for r in sequences.read_documents(back, length).collect():
        parts[r.doc_id].append((r.start, r.ids))
    for key in {r[0] for r in rows}:
        ids = [i for _, part in sorted(parts[key], key=lambda p: p[0]) for i in part]
        texts = [r[1] or "" for r in rows if r[0] == key]
        if len(texts) == 1:
            assert ids[-1] == sequences.END_ID and decode(ids[:-1]).decode() == texts[0]
        else:
            assert ids.count(sequences.END_ID) == len(texts)
    for r in full:
        assert len(r.input_ids) == 2 * length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert len(r.cu_seqlens) == len(r.doc_ids) + 1 == len(r.starts) + 1
        places = np.frombuffer(r.position_ids, "<u2").tolist()
        cuts = [*r.cu_seqlens, length]
        assert places == [i for a, b in zip(cuts, cuts[1:]) for i in range(b - a)]
    assert len({r.sequence_id for r in full}) == len(full)
    return full


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"tok{rng.randrange(300)}" for _ in range(int(rng.paretovariate(0.8) * 9) % 3000))) for i in range(200)]
    full = round_trip(spark, rows, 2048, tmp_path)
    assert sum(r.n_tokens for r in full) >= 0.97 * 2048 * (len(full) - 2)
    round_trip(spark, frames.EDGE, 64, tmp_path)
    assert sequences.pack_matrix(frames.docs(spark, []), RANKS, PATTERN).collect() == []


def test_ids_of_a_large_vocabulary(spark, tmp_path):
    ranks = tmp_path / "large.tiktoken"  # the same merges, ids from 256 on moved up by 50,000
    lines = [line.split() for line in open(RANKS, "rb")]
    ranks.write_bytes(b"".join(b"%s %d\n" % (a, int(b) if int(b) < 256 else int(b) + 50_000) for a, b in lines))
    rows = [(i, f"A sentence of ordinary words, number {i}, with supercalifragilistic ones.") for i in range(40)]
    packed = sequences.pack_matrix(frames.docs(spark, rows), str(ranks), PATTERN, length=128, end_id=0, pad_id=0).collect()
    assert all(len(r.input_ids) == 4 * 128 for r in packed)
    decode, parts, most = tokens.byte_decoder(str(ranks)), defaultdict(dict), 0
    back = sequences.read_documents(spark.createDataFrame(packed, sequences.SCHEMA), 128).collect()
    for r in back:
        parts[r.doc_id][r.start] = r.ids
        most = max(most, *r.ids)
    assert most > 1 << 16
    for key, text in rows:
        ids = [i for _, part in sorted(parts[key].items()) for i in part]
        assert ids[-1] == 0 and decode(ids[:-1]).decode() == text


def test_best_fit_takes_the_tightest_row():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 200) for _ in range(400)]
    pieces, n_rows = sequences.best_fit(lengths, 100)
    room = [100] * n_rows
    for doc, start, n, row, offset in pieces:
        if n < 100:
            fits = [r for r in range(n_rows) if room[r] >= n and room[r] < 100]
            assert room[row] == (min(room[r] for r in fits) if fits else 100)
        assert offset == 100 - room[row]
        room[row] -= n
    assert sum(p[2] for p in pieces) == sum(lengths)
