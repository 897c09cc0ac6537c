"""Word shingles of many texts at once, as 64-bit hashes, with numpy. Runs inside Python workers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

U = np.uint64
ODD = re.compile(r"[^\w\x00-\x7f]")  # beyond ASCII, and in no word
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[c for c in range(128) if chr(c).isalnum() or c == 95]] = True
WORD_BYTE[128:] = True
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = 1 << 18  # bytes of text hashed together


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def plain(text: str) -> str:
    """The text with every character beyond ASCII that is in no word as a blank: bytes then tell words, and places stay."""
    return text if text.isascii() else ODD.sub(" ", text)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, stop byte) of every run of word bytes: a polynomial of its bytes, from two prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(BASE, max(len(raw), 1))[:len(raw)], out=sums[1:])
    down = powers(BASE_INVERSE, max(len(raw), 1))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts, ends


def runs_hashed(word: np.ndarray, first: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each run of words [first, stop): a polynomial of their hashes."""
    base = odd_numbers(seed, 1)[0]
    n = max(len(word), 1)
    sums = np.zeros(len(word) + 1, U)
    np.cumsum(word * powers(base, n)[:len(word)], out=sums[1:])
    down = powers(U(pow(int(base), -1, 1 << 64)), n)
    return mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(U))


def bitmap_of(hashes: DataFrame, column: str, bits: int):
    """A set of 64-bit hashes as one bit for each value of their top bits, which may hold more, never less. Spark puts the bits together in
    words of 64; the driver receives at most 2 ** (bits - 6) words and broadcasts them as plain arrays."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    got = (hashes.select(F.shiftright(place, 6).cast("int").alias("at"), bit.alias("bit"))
           .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    return hashes.sparkSession.sparkContext.broadcast((bits, got.column("at").to_numpy(), got.column("bits").to_numpy()))


def bitmap_table(value: tuple) -> np.ndarray:
    bits, at, words = value
    out = np.zeros(1 << (bits - 6), np.int64)
    out[at] = words
    return out.view(U)


def bitmap_holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U(64 - (len(table).bit_length() - 1 + 6))
    return (table[place >> U(6)] >> (place & U(63))) & U(1) == U(1)


def shingle_sets(texts: list, words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words.

    A word is a run of letters, digits and underscores, in any script; texts come lower-cased. A text of
    fewer words is one shingle of all it has; a text without words, or None, has none.
    """
    out: list[np.ndarray] = []
    turn = odd_numbers(11, words)
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < STEP):
            group.append(plain(texts[at] or "").encode())
            size += len(group[-1]) + 1
            at += 1
        word, start, _ = word_hashes(b"\n".join(group))
        begins = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
        first = np.searchsorted(start, begins)
        n = len(word) - words + 1
        full = np.zeros(max(n, 0), U)
        for k in range(words if n > 0 else 0):
            full += word[k:k + n] * turn[k]
        full = mix(full)
        for i in range(len(group)):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                out.append(np.unique(full[a:b - words + 1]))
            elif b > a:
                out.append(mix(np.sum(word[a:b] * turn[:b - a], dtype=U, keepdims=True) + U(b - a)))
            else:
                out.append(np.zeros(0, U))
    return out


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed numbers."""
    pair = (np.sum(mix(s + U(1)), dtype=U) + U(len(s)), np.sum(mix(s ^ U(0xD6E8FEB86659FD93)), dtype=U))
    return tuple(int(x.astype(np.int64)) for x in pair)


def minhash_bands(s: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of the MinHash signature of a set, as signed numbers."""
    least = np.full(len(factors), U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 256):
        np.minimum(least, (s[i:i + 256, None] * factors[None, :]).min(axis=0), out=least)
    rows = len(factors) // bands
    folded = (mix(least).reshape(bands, rows) * odd_numbers(23, rows)[None, :]).sum(axis=1, dtype=U)
    return mix(folded + odd_numbers(29, bands)).astype(np.int64)
