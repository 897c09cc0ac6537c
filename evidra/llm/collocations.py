"""Phrase collocations from stripes: each prefix of words keys a counter of the words that follow it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidra.session import cut

from .common import short_batches, small
from .shingles import U, bitmap_holds, bitmap_of, bitmap_table, mix, odd_numbers, powers

MOST_WORDS, LEAST_COUNT, MOST_PER_GROUP = 5, 100, 2000
FILTER_BITS = 26  # size of the bitmap of frequent prefixes that every task gets: 8 MB at most
SPLITS = 1 << 14  # a prefix with a share s of its round's counts has its stripe in about s * SPLITS segments
STEP = 1 << 23  # bytes of text whose counts a task holds together
# exact: counts up to 17 digits, products in decimals of 38
SCORE = "(1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
BLANK, END = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = END
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, piece) of every word of a text in bytes: a run of bytes other than blanks and the marks that end a piece; pieces
    are numbered."""
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    piece = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kind == END, out=piece[1:])
    return edges[0::2], edges[1::2], piece[edges[0::2]]


def hashed(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each run of bytes: a polynomial of them, from two prefix sums."""
    base = odd_numbers(101 + seed, 1)[0]
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(base, max(len(raw), 1))[:len(raw)], out=sums[1:])
    down = powers(U(pow(int(base), -1, 1 << 64)), max(len(raw), 1))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))


def longer(p1: np.ndarray, p2: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for a phrase and the word after it, from those of the phrase."""
    a = odd_numbers(53, 4)
    return mix(p1 * a[0] + word * a[1]), mix(p2 * a[2] + mix(word * a[3]))


def runs_of(order_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each run of equal rows) of rows sorted by the keys, the first key foremost."""
    order = np.lexsort(order_keys[::-1])
    if not len(order):
        return order, order
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for key in order_keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(fresh)


def gathered(batches, step: int = STEP):
    """(group hashes, texts as bytes, byte length) for about ``step`` bytes of texts at a time. Columns: group hash, text."""
    groups, texts, size = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for g, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    groups.append(g)
                    texts.append(text.encode())
                    size += len(texts[-1]) + 1
                    if size >= step:
                        yield groups, texts
                        groups, texts, size = [], [], 0
    if texts:
        yield groups, texts


def words_of(groups: list, texts: list, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, word, start, stop, piece, group): all words of some texts, A-Z lower-cased; a word's hash holds that of its text's group."""
    raw = _FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
    start, stop, piece = piece_words(raw)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    group = np.array(groups, np.int64).astype(U)[np.searchsorted(begins, start, "right") - 1] if len(start) else np.zeros(0, U)
    return raw, mix(hashed(raw, start, stop, seed) ^ mix(group)), start, stop, piece, group


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(group_hash, h, word, f): all words of each group with their counts and 64-bit hashes. rows: group_hash, text. Within a task a
    second hash tells words apart that share the first."""
    def run(batches):
        for groups, texts in gathered(batches):
            raw, word, start, stop, _, group = words_of(groups, texts, seed)
            order, first = runs_of([word, hashed(raw, start, stop, seed + 1000) ^ group])
            at = order[first]
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at].view(np.int64)), pa.array(word[at].view(np.int64)),
                 pa.array([data[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())], pa.binary()),
                 pa.array(np.diff(np.append(first, len(order))))], ["group_hash", "h", "word", "n"])

    counts = (short_batches(rows).select("group_hash", "text").mapInArrow(run, "group_hash long, h long, word binary, n long")
              .groupBy("group_hash", "h", "word").agg(F.sum("n").alias("f")))
    return counts.select("group_hash", "h", F.decode("word", "UTF-8").alias("word"), "f")


def next_words(rows: DataFrame, prefixes: DataFrame, length: int, seed: int, splits: int = SPLITS, bits: int = FILTER_BITS) -> DataFrame:
    """(p1, p2, next, f): how often each word follows each prefix of ``length`` words, prefix and word within one piece.

    Every task sums its texts into stripes, a row per prefix with the words that follow and their counts, and leaves out phrases whose
    first or last ``length`` words cannot be frequent by the bitmap of frequent ``prefixes`` (p1, p2, f). Stripes of one prefix
    meet and are merged element by element; those of the commonest prefixes are cut into segments by the next word.
    """
    seen = bitmap_of(prefixes, "p1", bits)
    total = prefixes.agg(F.sum("f")).first()[0] or 0
    hot = (prefixes.filter(F.col("f") * splits > F.lit(total).cast("decimal(38,0)")).select("p1", F.ceil(F.col("f") / (total or 1) * splits).alias("s"))
           .toArrow())  # fewer than ``splits`` rows: their shares add up to 1
    commonest = hot.column("p1").to_numpy().astype(np.int64).view(U), hot.column("s").to_numpy().astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(x[np.argsort(commonest[0])] for x in commonest))

    def run(batches):
        hot, pieces = shared.value
        table = bitmap_table(seen.value)
        for groups, texts in gathered(batches):
            _, word, _, _, piece, _ = words_of(groups, texts, seed)
            n = len(word) - length
            if n <= 0:
                continue
            p1, p2 = word, mix(word)
            for k in range(1, length):
                p1, p2 = longer(p1[:-1], p2[:-1], word[k:])
            known = bitmap_holds(table, p1)
            at = np.flatnonzero((piece[:n] == piece[length:]) & known[:n] & known[1:n + 1])
            p1, p2, last = p1[at], p2[at], word[at + length]
            order, first = runs_of([p1, p2, last])
            count = np.diff(np.append(first, len(order)))
            p1, p2, last = p1[order[first]], p2[order[first]], last[order[first]]
            segment = np.zeros(len(p1), np.int64)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, p1), len(hot) - 1)
                segment = np.where(hot[spot] == p1, (mix(last) >> U(33)).astype(np.int64) % np.maximum(pieces[spot], 1), 0)
            order, first = runs_of([p1, p2, segment])
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (last.view(np.int64), count.astype(np.int64))]
            at = order[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p1[at].view(np.int64)), pa.array(p2[at].view(np.int64)), pa.array(segment[at].astype(np.int32)), *lists],
                ["p1", "p2", "segment", "words", "counts"])

    stripes = short_batches(rows).select("group_hash", "text").mapInArrow(
        run, "p1 long, p2 long, segment int, words array<long>, counts array<long>").repartition("p1", "p2", "segment")
    return (stripes.select("p1", "p2", "segment", F.inline(F.arrays_zip("words", "counts")).alias("next", "n"))
            .groupBy("p1", "p2", "segment", "next").agg(F.sum("n").alias("f")).select("p1", "p2", "next", "f"))


def _longer(*columns: str) -> Column:
    """``longer`` on columns, as a struct p1, p2."""
    @F.arrow_udf("struct<p1:long,p2:long>")
    def run(p1: pa.Array, p2: pa.Array, word: pa.Array) -> pa.Array:
        pair = longer(*(x.to_numpy(zero_copy_only=False).astype(np.int64).view(U) for x in (p1, p2, word)))
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in pair], ["p1", "p2"])
    return run(*columns)


def _mixed(column: str) -> Column:
    @F.arrow_udf("long")
    def run(word: pa.Array) -> pa.Array:
        return pa.array(mix(word.to_numpy(zero_copy_only=False).astype(np.int64).view(U)).view(np.int64))
    return run(column)


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, group: str = "lang", text: str = "text",
                     unknown: str = "und", splits: int = SPLITS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). phrases: grp, words (array), f for every phrase of 1 to ``most_words`` words found at least ``least_count``
    times in its group, overlaps included; totals: grp, n (all words).

    One scan a length. Words are told apart by 64 bits of hash; should a frequent word share its hash with any other, all is hashed anew
    with another seed. Prefixes are told apart by 128 bits.
    """
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("grp"), F.col(text).alias("text"))
    rows = rows.withColumn("group_hash", F.xxhash64("grp"))
    names = cut(rows.groupBy("group_hash").agg(F.max("grp").alias("grp")))
    for seed in range(8):
        words = cut(word_counts(rows, seed))
        clash = words.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f")).filter((F.col("n") > 1) & (F.col("f") >= least_count))
        if clash.isEmpty():
            break
    totals = cut(words.groupBy("group_hash").agg(F.sum("f").alias("n")).join(names, "group_hash").select("grp", "n"))
    known = cut(words.filter(F.col("f") >= least_count).join(names, "group_hash").select("grp", "h", "word", "f"))
    level = cut(known.select("grp", F.array("word").alias("words"), "f", F.col("h").alias("p1"), _mixed("h").alias("p2")))
    out = level
    for length in range(1, most_words):
        found = next_words(rows, level.select("p1", "p2", "f"), length, seed, splits, bits).filter(F.col("f") >= least_count)
        entry = cut(found.withColumn("p", _longer("p1", "p2", "next")))
        level = cut(entry.join(level.select("p1", "p2", "grp", "words"), ["p1", "p2"])
                    .join(known.select(F.col("h").alias("next"), "word"), "next")
                    .select("grp", F.concat("words", F.array("word")).alias("words"), "f", F.col("p.p1").alias("p1"), F.col("p.p2").alias("p2")))
        out = out.unionByName(level)
    return out.select("grp", "words", "f"), totals


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, top: int = MOST_PER_GROUP,
                 subsumed_percent: int = 100, group: str = "lang", text: str = "text", unknown: str = "und", splits: int = SPLITS,
                 bits: int = FILTER_BITS) -> DataFrame:
    """The phrases of 2 to ``most_words`` words whose parts meet far more often than by chance: grp, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. ``a`` counts the phrase in its group, ``n`` all
    words there. Cut after its first k words a phrase has l (count of the first part), r (of the rest) and floor(1000 a n / (l r));
    the cut of the least score counts, the first of such. A phrase inside a longer one that has at least ``subsumed_percent`` of
    its count is dropped; asking the phrases one word longer is enough, as counts never grow with length. The ``top`` of each group
    leave, by score, count and phrase (UTF-8 bytes).

    A null text has no words; a null group is ``unknown``. Rows that repeat count each time. No rows: no rows. Counting is exact over
    all texts. Every length is one scan whose tasks hold the counts of some megabytes of text; the bitmap that spares hopeless phrases the
    shuffle is bounded and only ever lets too many through.
    """
    phrases, totals = frequent_phrases(docs, most_words, least_count, group, text, unknown, splits, bits)
    phrases = cut(phrases)
    counted = phrases.select("grp", F.col("words").alias("part"), F.col("f").alias("part_f"))
    several = phrases.filter(F.size("words") > 1).withColumn("size", F.size("words"))
    inner = several.filter("size > 2").select("grp", "f", F.explode(F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))).alias("words"))
    most = inner.groupBy("grp", "words").agg(F.max("f").alias("most"))
    alone = (several.join(most, ["grp", "words"], "left")
             .filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * subsumed_percent)).select("grp", "words", "size", F.col("f").alias("a")))
    cuts = alone.select("grp", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = (cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))})
            .join(counted.withColumnsRenamed({"part": "left", "part_f": "l"}), ["grp", "left"])
            .join(counted.withColumnsRenamed({"part": "rest", "part_f": "r"}), ["grp", "rest"])
            .join(small(totals), "grp"))
    best = cuts.groupBy("grp", "words", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r", "n")).alias("b"))
    line = Window.partitionBy("grp").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    return (best.withColumn("phrase", F.array_join("words", " ")).withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
            .select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "b.n", "b.score"))
