import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from evidra.llm import packing, tokens

from . import frames

PATH = public_tokenizers.path("word_bpe_49k.json")
NASTY = ["", " ", "a  b\t\nc", "it's they'll", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ ΟΔΟΣ.", "é ́ a b　c d", "x\x0by\x0cz\x1cq\x85r",
         "ﬁ İ ẞ", "1234567 12,3", "日本語 テスト", "straße. ΟΔΟΣ ὀδός, ŉ. ǅ İi. naïve! e\u0301. x² ⅷ. ªº. don't, l'été; A.B. ...", "ab\u0301c. 你好! ﬀ. ẞ.", "a" * 5000, "👩‍👩‍👧 🇩🇪", None]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_tokenizers_ids(tokenizer):
    encoder = tokens.word_encoder(PATH)
    for text in NASTY + [r[1] for r in frames.EDGE]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_memory_of_chunks_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 10)
    encoder = tokens.ChunkEncoder(tokens.word_encoder(PATH).split, tokens.word_encoder(PATH).memory.make)
    for i in range(30):
        text = " ".join(f"word{i} other{j}" for j in range(4))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.memory) < 20


def check(tokenizer, rows, got):
    want = sorted(((r[0] is not None, r[0] or 0, tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[(r.doc_id is not None, r.doc_id or 0, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    for known, key, ids in want:  # rows that share a key and a text give the same pieces twice or differ only in cuts
        mine = sorted(pieces[(known, key, len(ids))])
        same = sum(1 for w in want if w[:2] == (known, key) and len(w[2]) == len(ids))
        assert sum(n for _, n, _ in mine) == same * len(ids)
        for start, n, crc in mine:
            assert n > 0
            if same == 1:
                assert zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()) == crc
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_every_id_once_and_no_padding(spark, tokenizer):
    rng = random.Random(4)
    rows = [(i, " ".join(f"tok{rng.randrange(300)}" for _ in range(int(rng.paretovariate(0.8) * 20) % 9000))) for i in range(300)]
    check(tokenizer, rows, packing.pack(frames.docs(spark, rows).repartition(3), PATH).collect())


def test_awkward_rows(spark, tokenizer):
    rows = frames.EDGE + [(100 + i, t) for i, t in enumerate(NASTY)]
    check(tokenizer, rows, packing.pack(frames.docs(spark, rows), PATH, with_ids=True).collect())
    assert packing.pack(frames.docs(spark, []), PATH).collect() == []


def test_costs_are_balanced():
    rng = random.Random(9)
    lengths = [min(int(rng.lognormvariate(6, 1)) + 1, 2000) for _ in range(3000)]  # a longer one fills a sequence alone
    cost, size = defaultdict(float), defaultdict(int)
    placed = packing.balance(lengths)
    for _, _, n, s, _ in placed:
        cost[s] += packing.piece_cost(n)
        size[s] += n
    usual = [c for s, c in cost.items() if size[s] == 4096]
    assert sum(size.values()) == sum(lengths) and len(placed) < 1.3 * len(lengths)
    assert np.std(usual) < 0.25 * np.mean(usual)


def test_cut_only_where_nothing_has_room():
    rng = random.Random(17)
    for lengths in ([int(rng.lognormvariate(6, 1)) + 1 for _ in range(6000)], [int(rng.paretovariate(0.9) * 40) for _ in range(3000)], [1] * 50, [5000], []):
        room = packing.room_plan(sum(lengths), 4096)
        size, cost = list(room), [0.0] * len(room)
        for doc, start, n, s, _ in packing.balance(lengths):
            left = lengths[doc] - start
            fits = [i for i, r in enumerate(room) if r >= left]
            if fits:
                assert n == left and s == min(fits, key=lambda i: (cost[i], i))
            else:
                assert n == room[s] == max(room)
            room[s] -= n
            cost[s] += packing.piece_cost(n) / size[s]
        assert not any(room)
