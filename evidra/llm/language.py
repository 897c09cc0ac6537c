"""Language ID by prediction by partial matching: the language whose context tree codes a text in the fewest bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import short_batches, slices
from .shingles import U, mix

ORDER = 4  # bytes of context at most
MOST_BYTES = 4 << 20  # of text that the trees are learnt from, in equal parts for the languages
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
UNIT = 1 << 16  # code lengths are whole numbers of 1 / UNIT bits, so that sums do not depend on their order
STEP = 1 << 20  # bytes scored together
BEGIN = 0xFF  # no byte of UTF-8: stands before a text, so that its first bytes have contexts too


def fold(key: Column) -> Column:
    return (F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS).cast("int")


def grams_at(data: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes up to each place as one number; places before the first full one hold what there is."""
    out = data.astype(U)
    for k in range(1, length):
        out[k:] |= data[:-k].astype(U) << U(8 * k)
    return out


def gram_counts(texts: list, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order 0..``order`` the runs of order + 1 bytes of the texts with their counts."""
    data = np.frombuffer(b"".join(bytes([BEGIN]) * order + (t or "").encode() for t in texts), np.uint8)
    own = data != BEGIN
    return [np.unique(grams_at(data, k + 1)[own], return_counts=True) for k in range(order + 1)]


class Lookup:
    """Places of 64-bit keys in a fixed list: buckets by the top bits of a mixed key, each searched step by step."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys + U(1))
        self.place = np.argsort(mixed).astype(np.int32)
        self.keys = mixed[self.place]
        self.bits = max(int(len(keys)).bit_length(), 1)
        self.starts = np.searchsorted(self.keys >> U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is none of the list."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        mixed = mix(keys + U(1))
        bucket = (mixed >> U(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        open_rows = np.flatnonzero(at < stop)
        at, stop, mixed = at[open_rows], stop[open_rows], mixed[open_rows]
        while len(open_rows):
            hit = self.keys[at] == mixed
            out[open_rows[hit]] = self.place[at[hit]]
            at = at + 1
            left = ~hit & (at < stop)
            open_rows, at, stop, mixed = open_rows[left], at[left], stop[left], mixed[left]
        return out


class Trees:
    """The context trees of all languages in one: for every run of k + 1 bytes that any language has seen, what its last byte costs in
    each language after the k bytes before it, escapes to shorter contexts included.

    A byte seen c times after a context that stands T times before D different bytes costs log2((T + D) / c) bits, an escape from it
    log2((T + D) / D); a context not seen costs nothing to leave, and without any context a byte costs 8 bits.
    """

    def __init__(self, languages: list[str], priors: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """counts: per order the keys and the matrix of counts, a row a key, a column a language."""
        self.languages, self.order = languages, order
        self.prior = np.log2(priors)
        self.keys, self.costs, self.escapes = [], [], []
        below = None
        for k, (keys, n) in enumerate(counts):
            context, group = np.unique(keys >> U(8), return_inverse=True)
            total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
            np.add.at(total, group, n)
            np.add.at(kinds, group, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                cost = np.log2((total + kinds)[group] / n)
            rest = np.full(n.shape, 8.0) if k == 0 else below[np.searchsorted(counts[k - 1][0], keys & U((1 << 8 * k) - 1))]
            below = np.where(n > 0, cost, escape[group] + rest)
            self.keys.append(keys)
            self.costs.append(np.rint(below * UNIT).astype(np.int32))
            self.escapes.append((context, np.rint(escape * UNIT).astype(np.int32)))
        self._lookups = None

    def lookups(self):
        if self._lookups is None:
            self._lookups = [(Lookup(k), Lookup(c[0])) for k, c in zip(self.keys, self.escapes)]
        return self._lookups

    def state(self) -> dict:
        """All that was learnt, in plain arrays, which any worker can read."""
        return {**self.__dict__, "_lookups": None}

    @classmethod
    def of(cls, state: dict) -> Trees:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def byte_costs(self, data: np.ndarray) -> np.ndarray:
        """What each byte costs in each language, after the bytes before it."""
        out = np.zeros((len(data), len(self.languages)), np.int32)
        grams = grams_at(data, self.order + 1)
        rows = np.arange(len(data))
        for k in range(self.order, -1, -1):
            own, contexts = self.lookups()[k]
            keys = grams[rows] & U((1 << 8 * (k + 1)) - 1)
            at = own.find(keys)
            hit = at >= 0
            out[rows[hit]] += self.costs[k][at[hit]]
            rows, keys = rows[~hit], keys[~hit]
            spot = contexts.find(keys >> U(8))
            out[rows[spot >= 0]] += self.escapes[k][1][spot[spot >= 0]]
        out[rows] += 8 * UNIT
        return out

    def lengths(self, texts: list) -> np.ndarray:
        """The code length of each text in each language, in 1 / UNIT bits; long texts are scored in steps."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        begin = bytes([BEGIN]) * self.order
        group, size = [], 0
        for i, text in enumerate([*texts, None]):
            body = (text or "").encode()
            if i < len(texts) and len(body) < STEP:
                group.append((i, body))
                size += len(body) + self.order
            if group and (size >= STEP or i == len(texts)):
                self._add(out, [j for j, _ in group], [begin + b for _, b in group])
                group, size = [], 0
            if i < len(texts) and len(body) >= STEP:
                whole = begin + body
                for at in range(0, len(body), STEP):
                    self._add(out, [i], [whole[at:at + STEP + self.order]])
        return out

    def _add(self, out: np.ndarray, rows: list, bodies: list) -> None:
        """Add the costs of bodies that each begin with ``order`` bytes of context."""
        data = np.frombuffer(b"".join(bodies), np.uint8)
        costs = self.byte_costs(data)
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
        costs[(starts[:-1, None] + np.arange(self.order)[None, :]).ravel()] = 0
        sums = np.zeros((len(data) + 1, costs.shape[1]), np.int64)
        np.cumsum(costs, axis=0, out=sums[1:])
        np.add.at(out, np.array(rows), sums[starts[1:]] - sums[starts[:-1]])

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language of the least code length, its prior included, and its share of the probability; ties to the first."""
        bits = -self.lengths(texts) / UNIT + self.prior[None, :]
        best = bits.argmax(axis=1)
        odds = np.exp2(np.clip(bits - bits.max(axis=1, keepdims=True), -1000, 0))
        return [self.languages[i] for i in best], 1 / odds.sum(axis=1)


def train(docs: DataFrame, order: int = ORDER, most_bytes: int = MOST_BYTES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees | None:
    """The trees of all languages, from rows outside the held-out fold that have a text and a language; None if there are none.

    Document and byte counts of each language are over all such rows. The trees see a sample by hash of text and key, about
    ``most_bytes`` / (number of languages) bytes of each, so what the driver and the tasks hold is bounded; whole texts enter, but of a
    text longer than a language's share only that many characters from a place chosen by hash.
    """
    rows = (docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("text"), F.col(lang).cast("string").alias("lang"))
            .filter(F.col("lang").isNotNull() & (F.char_length("text") > 0) & (F.col("k").isNull() | (fold(F.col("k")) != HELD_OUT))))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("lang").toArrow().to_pylist()
    if not sizes:
        return None
    share = max(most_bytes // len(sizes), 1)
    rate = F.create_map(*[F.lit(x) for s in sizes for x in (s["lang"], min(share / s["bytes"], 1.0))])
    drawn = F.pmod(F.xxhash64(F.lit(23), "k", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = F.pmod(F.xxhash64(F.lit(29), "text"), F.greatest(F.char_length("text") - share, F.lit(0)) + 1).cast("int") + 1
    sample = rows.filter(drawn < F.element_at(rate, F.col("lang"))).select("lang", F.substring("text", begin, F.lit(share)).alias("text"))

    def run(batches):
        for batch in batches:
            by = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for k, (keys, n) in enumerate(gram_counts(texts, order)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), k, np.int32)),
                                                      pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    got = (short_batches(sample).mapInArrow(run, "lang string, k int, gram long, n long")
           .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow())
    names = [s["lang"] for s in sizes]
    k, gram, n = (got.column(c).to_numpy() for c in ("k", "gram", "n"))
    column = np.array([names.index(x) for x in got.column("lang").dictionary_encode().combine_chunks().dictionary.to_pylist()], np.int64)[
        got.column("lang").dictionary_encode().combine_chunks().indices.to_numpy()] if got.num_rows else np.zeros(0, np.int64)
    counts = []
    for level in range(order + 1):
        mine = k == level
        keys, row = np.unique(gram[mine].astype(np.int64).view(U), return_inverse=True)
        table = np.zeros((len(keys), len(names)))
        table[row, column[mine]] = n[mine]
        counts.append((keys, table))
    documents = np.array([s["n"] for s in sizes], np.float64)
    return Trees(names, documents / documents.sum(), counts, order)


def predict(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` as a struct, the language whose tree codes its whole text, lower-cased, in the fewest
    bits, and that language's share of the probability. A text that is null or has no letter, and every text if nothing was learnt,
    is ``und`` at 0."""
    shared, here = docs.sparkSession.sparkContext.broadcast(trees and trees.state()), []

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        if not here:
            here.append(Trees.of(shared.value))
        for i in range(0, len(texts), 256):
            a, b = here[0].predict(texts.slice(i, 256).to_pylist())
            names.extend(a)
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang", "score"])

    body = F.col(text)
    lettered = body.isNotNull() & body.rlike(r"\p{L}")
    rows = short_batches(docs).select(F.struct("*").alias("row"), lettered.alias("lettered"))
    if trees is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.withColumn("found", run(F.when(F.col("lettered"), F.lower(F.col(f"row.`{text}`")))))
    return found.select("row", F.when(F.col("lettered"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("lettered"), F.col("found.score")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, order: int = ORDER, most_bytes: int = MOST_BYTES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learnt outside the held-out fold of the key; a null key is not held
    out. Neither the language nor another column than the text enters a prediction. Rows that repeat get the same answer. No rows:
    no rows."""
    trees = train(docs, order, most_bytes, key, text, lang)
    found = predict(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), trees)
    doc = F.col("row.doc_id")
    return found.select(doc.alias("doc_id"), F.coalesce(fold(doc) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
