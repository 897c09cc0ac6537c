"""Substring dedup by hashing units of text: every passage stays in the earliest document that holds it."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidra.session import cut

from .common import short_batches, slices
from .shingles import U, bitmap_holds, bitmap_of, bitmap_table, mix, plain, runs_hashed, word_hashes

LEAST_WORDS = 8  # of a unit, and of a line that is a unit of its own
LEAST_BITS, MOST_BITS = 20, 29  # size of the bitmap of repeated digests: 16 bits a digest, 64 MB at most
STEP = 1 << 22  # bytes of text cut together
FIRST_LOOK = 24  # words on either side of a run that the first round compares; each later round compares four times as many
WORD = re.compile(r"\w+")


def folded(text: str) -> str:
    """Lower case without moving a place: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def units_of(texts: list, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """(text, unit, start, stop, words, h1, h2) of the units of some texts: number of the text, number of the unit's first word in it,
    offsets in code points, number of words, 128 bits of digest of the lower-cased words alone.

    A line of ``least_words`` words or more is a piece; shorter lines that follow each other are a piece together. A piece is cut before
    words whose hash, taken with the next word, is the least of all within ``least_words`` - 1 words on either side, so that equal
    runs of words are cut alike wherever they stand; no part has fewer than ``least_words`` words. Shorter pieces are no units.
    """
    least, reach = least_words, least_words - 1
    bodies = [plain(folded(t or "")).encode() for t in texts]
    data = b"\n".join(bodies)
    raw = np.frombuffer(data, np.uint8)
    word, start, stop = word_hashes(data)
    n = len(word)
    if not n:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.int64, U, U))
    begins = np.concatenate(([0], np.cumsum([len(b) + 1 for b in bodies])))
    text = np.searchsorted(begins, start, "right") - 1
    line = np.cumsum(raw == 10)[start]
    solid = np.bincount(line)[line] >= least
    fresh = np.ones(n, bool)
    fresh[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1]) & (solid[1:] | solid[:-1])
    firsts = np.flatnonzero(fresh)
    piece = np.cumsum(fresh) - 1
    ends = np.append(firsts[1:], n)
    pair = word.copy()
    pair[:-1] += np.where(fresh[1:], U(0), mix(word[1:]))
    pair = mix(pair)
    place = np.arange(n)
    inner = np.flatnonzero((place - firsts[piece] >= least) & (ends[piece] - place >= least))
    for d in range(1, reach + 1):
        inner = inner[(pair[inner] < pair[inner - d]) & (pair[inner] < pair[inner + d])]
    fresh[inner] = True
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], n)
    full = b - a >= least
    a, b = a[full], b[full]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
    blank = np.flatnonzero((raw == 32) | (raw >= 9) & (raw <= 13))
    behind = np.append(blank, len(raw))[np.searchsorted(blank, stop[b - 1])]  # marks up to the next blank belong to the last word
    behind = np.minimum(behind, np.append(start, len(raw))[b])
    of = text[a]
    number = a - np.searchsorted(text, of)
    zero = points[begins[of]]
    return of, number, points[start[a]] - zero, points[behind] - zero, b - a, runs_hashed(word, a, b, 61), runs_hashed(word, a, b, 67)


def _groups(batches):
    """Rows of Arrow batches as lists of columns, about ``STEP`` characters of the last column at a time."""
    rows, size = [], 0
    for batch in (part for whole in batches for part in slices(whole, 64)):
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            rows.append(row)
            size += len(row[-1] or "") + 1
            if size >= STEP:
                yield list(zip(*rows))
                rows, size = [], 0
    if rows:
        yield list(zip(*rows))


def repeated_digests(texts: DataFrame, least_words: int) -> DataFrame:
    """(h1, h2) of the units that occur more than once. texts: text."""
    def run(batches):
        for (bodies,) in _groups(batches):
            h1, h2 = units_of(bodies, least_words)[5:]
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(len(h1), 1), bool), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)),
                                              pa.array(np.diff(np.append(first, len(h1))) > 1)], ["h1", "h2", "twice"])

    digests = texts.mapInArrow(run, "h1 long, h2 long, twice boolean").repartition("h1", "h2")  # one row a task at most for a common one
    return digests.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.bool_or("twice").alias("twice")).filter("n > 1 OR twice").select("h1", "h2")


def bits_for(hashes: DataFrame) -> int:
    """The size of a bitmap for the rows of a written table: about 16 bits each, within bounds."""
    return min(max(hashes.count().bit_length() + 4, LEAST_BITS), MOST_BITS)


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(k, t, unit, start, stop, words, h1, h2): the units that may occur more than once: all that do, and those that share the top bits
    of their digest with one that does. docs: k, t, text. The texts are cut twice, so that only digests travel for all units."""
    texts = short_batches(docs)
    twice = cut(repeated_digests(texts.select("text"), least_words))
    shared = bitmap_of(twice, "h1", bits_for(twice))
    names = ["k", "t", "unit", "start", "stop", "words", "h1", "h2"]

    def run(batches):
        table = bitmap_table(shared.value)
        for keys, hashes, bodies in _groups(batches):
            of, number, start, stop, words, h1, h2 = units_of(bodies, least_words)
            at = np.flatnonzero(bitmap_holds(table, h1))
            pick = of[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in pick], pa.int64()), pa.array([hashes[i] for i in pick], pa.int64()),
                 *(pa.array(x[at].astype(np.int32)) for x in (number, start, stop, words)),
                 *(pa.array(x[at].view(np.int64)) for x in (h1, h2))], names)

    return texts.select("k", "t", "text").mapInArrow(run, "k long, t long, unit int, start int, stop int, words int, h1 long, h2 long")


def windows(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """(k, t, at, n, w, base, part): the text around each place asked for: n words from ``at`` on, or -n words before it. ``w`` is the
    number of the word at the place, ``base`` where the part begins. docs: k, t, text. asks: k, t, at, n."""
    lists = asks.groupBy("k", "t").agg(F.collect_set(F.struct("at", "n")).alias("asks")).withColumnsRenamed({"k": "ak", "t": "at_text"})
    rows = docs.join(lists, docs["k"].eqNullSafe(lists["ak"]) & (docs["t"] == lists["at_text"]))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 64)):
            out = [[] for _ in range(7)]
            for k, t, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = [m.span() for m in WORD.finditer(text)]
                starts = [a for a, _ in spans]
                for place in places:
                    at, n = place["at"], place["n"]
                    w = bisect_left(starts, at)
                    mine = spans[w:w + n] if n > 0 else spans[max(0, w + n):w]
                    a, b = (mine[0][0], mine[-1][1]) if mine else (at, at)
                    for column, value in zip(out, (k, t, at, n, w, a, text[a:b])):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], ["k", "t", "at", "n", "w", "base", "part"])

    found = short_batches(rows).select("k", "t", "text", "asks").mapInArrow(run, "k long, t long, at int, n int, w int, base int, part string")
    return found.dropDuplicates(["k", "t", "at", "n"])


def compared(edges: DataFrame) -> DataFrame:
    """For each edge: ``same`` words that agree with the kept text, ``far`` (how far the run now reaches) and ``kept_far``, ``w``, and
    ``more`` where both texts agree to the end of what was looked at and the look was full."""
    names = ["w", "far", "kept_far", "same", "added", "more"]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            out = [[] for _ in names]
            for n, w, base, part, kept_base, kept_part, stop in zip(*(batch.column(name).to_pylist() for name in ("n", "w", "base", "part", "kept_base", "kept_part", "stop"))):
                mine, theirs = list(WORD.finditer(part)), list(WORD.finditer(kept_part))
                if n < 0:
                    mine.reverse()
                    theirs.reverse()
                same = 0
                for x, y in zip(mine, theirs):
                    if x.group().lower() != y.group().lower():
                        break
                    same += 1
                last, kept = (mine[same - 1], theirs[same - 1]) if same else (None, None)
                if n < 0:
                    values = (w - same, base + last.start() if same else None, kept_base + kept.start() if same else None, same, same)
                else:
                    added = sum(base + m.start() >= stop for m in mine[:same])
                    values = (w + same, base + last.end() if added else None, None, same, added)
                for column, value in zip(out, (*values, same == abs(n))):
                    column.append(value)
            fields = [f for f in batch.schema.names if f in KEEP]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), *(pa.array(c, pa.int32()) for c in out[:5]), pa.array(out[5], pa.bool_())], fields + names)

    KEEP = ("k", "t", "start", "stop", "words", "first", "at", "n", "kk", "kt", "kat")
    schema = ", ".join(f"{f} {edges.schema[f].dataType.simpleString()}" for f in KEEP)
    return edges.select(*KEEP, "w", "base", "part", "kept_base", "kept_part").withColumnRenamed("w", "w_at").select(
        *KEEP, F.col("w_at").alias("w"), "base", "part", "kept_base", "kept_part").mapInArrow(
        run, schema + ", w int, far int, kept_far int, same int, added int, more boolean")


def extended(docs: DataFrame, islands: DataFrame) -> DataFrame:
    """islands (k, t, start, stop, words, head, tail), each grown word by word on both sides as far as its words are those around the
    kept occurrence of its first and of its last unit. Rounds look ever further, until every edge has met a difference or an end. Only
    texts in which a run is or is kept are moved."""
    base = ["k", "t", "start", "stop", "words", F.col("head.first").alias("first")]
    edges = cut(islands.select(*base, F.col("start").alias("at"), F.lit(-FIRST_LOOK).alias("n"), F.col("head.first.k").alias("kk"),
                               F.col("head.first.t").alias("kt"), F.col("head.first.start").alias("kat"))
                .unionByName(islands.select(*base, F.col("tail.start").alias("at"), (F.col("tail.words") + FIRST_LOOK).alias("n"),
                                            F.col("tail.first.k").alias("kk"), F.col("tail.first.t").alias("kt"), F.col("tail.first.start").alias("kat"))))
    involved = cut(edges.select("t").unionByName(edges.select(F.col("kt").alias("t"))).distinct().select("t", F.xxhash64("t").alias("h")))
    shared, tables = bitmap_of(involved, "h", bits_for(involved)), []

    @F.arrow_udf("boolean")
    def is_involved(h: pa.Array) -> pa.Array:
        if not tables:
            tables.append(bitmap_table(shared.value))
        return pa.array(bitmap_holds(tables[0], h.to_numpy(zero_copy_only=False).astype(np.int64).view(U)))

    docs = short_batches(docs).filter(is_involved(F.xxhash64("t")))
    done = None
    while True:
        asks = edges.select("k", "t", "at", "n").unionByName(edges.select(F.col("kk").alias("k"), F.col("kt").alias("t"), F.col("kat").alias("at"), "n")).distinct()
        seen = cut(windows(docs, asks))
        kept = seen.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("at").alias("at2"), F.col("n").alias("n2"),
                           F.col("base").alias("kept_base"), F.col("part").alias("kept_part"))
        own = seen.withColumnsRenamed({"k": "k1", "t": "t1", "at": "at1", "n": "n1"})
        pairs = (edges.join(own, F.col("k").eqNullSafe(F.col("k1")) & (F.col("t") == F.col("t1")) & (F.col("at") == F.col("at1")) & (F.col("n") == F.col("n1")))
                 .join(kept, F.col("kk").eqNullSafe(F.col("k2")) & (F.col("kt") == F.col("t2")) & (F.col("kat") == F.col("at2")) & (F.col("n") == F.col("n2"))))
        out = cut(compared(pairs))
        done = out.filter("NOT more") if done is None else done.unionByName(out.filter("NOT more"))
        edges = out.filter("more").select("k", "t", "start", "stop", "words", "first", "at", (F.col("n") * 4).alias("n"), "kk", "kt", "kat")
        if edges.isEmpty():
            break
    grown = done.groupBy("k", "t", "start").agg(
        F.max("stop").alias("stop"), F.max("words").alias("words"), F.max("first").alias("first"), F.sum("added").cast("long").alias("added"),
        F.min(F.when(F.col("n") < 0, F.col("far"))).alias("back"), F.min(F.when(F.col("n") < 0, F.col("kept_far"))).alias("kept_back"),
        F.max(F.when(F.col("n") > 0, F.col("far"))).alias("ahead"), F.min(F.when(F.col("n") < 0, F.col("w"))).alias("w0"),
        F.max(F.when(F.col("n") > 0, F.col("w"))).alias("w1"))
    return grown.select("k", "t", F.coalesce("back", "start").alias("start"), F.greatest("stop", "ahead").alias("stop"),
                        (F.col("words") + F.col("added")).alias("words"), "w0", "w1", F.col("first.k").alias("kk"),
                        F.coalesce("kept_back", "first.start").alias("ks"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", by_text: bool = False,
                      run_words: int = 0) -> DataFrame:
    """The spans to remove: doc_id, start, length (code points of the original text), words, kept_doc_id, kept_start.

    Units are lines, long ones in parts (``units_of``). Their digests are grouped over all documents, and the occurrence that ranks first,
    by document key and then by offset, is kept; all others go. Repeats that follow each other without a word between are one run.
    Each run is extended word by word on both sides while its words are those of the kept text, and runs that then meet are one span.
    ``run_words`` asks for spans of that many words at least; by default every repeat is a span. ``kept_doc_id`` and ``kept_start`` tell
    where the beginning of the span is kept.

    A null or empty text has no units. Rows without a key rank first. Rows that share a key (or have none) and the text count as
    one document; different texts under one key are documents of their own, ordered by a hash of the text, whose spans
    ``by_text`` tells apart in a last column ``text_hash``. No rows: no rows. The first grouping shuffles bare digests; a frequent unit is
    one row per task and group of texts there, and adaptive execution splits it where the repeats meet the kept occurrences. For the
    extension, each text with a run meets the places asked for in it once a round.
    """
    docs = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("text IS NOT NULL")
    units = cut(repeated_units(docs, least_words))
    kept = (units.groupBy("h1", "h2").agg(F.min(F.struct("k", "t", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").select("h1", "h2", "first"))
    repeats = (units.join(kept, ["h1", "h2"])
               .filter(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("t") == F.col("first.t")) & (F.col("start") == F.col("first.start"))))
               .select("k", "t", "unit", "start", "stop", "words", "first"))
    order = Window.partitionBy("k", "t").orderBy("unit")
    once = repeats.withColumn("before", F.lag("unit").over(order)).filter("before IS NULL OR before <> unit")  # equal rows: one document
    so_far = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = cut(once.withColumn("island", F.col("unit") - so_far).groupBy("k", "t", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"),
        F.min(F.struct("start", "first")).alias("head"), F.max(F.struct("start", "words", "first")).alias("tail")))
    grown = extended(docs, islands)
    line = Window.partitionBy("k", "t").orderBy("start", "stop")
    reach = F.coalesce(F.max("w1").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = (grown.withColumn("reach", reach).withColumn("run", F.sum(F.when(F.col("w0") > F.col("reach"), 1).otherwise(0)).over(line))
             .withColumn("words", F.greatest(F.col("words") - F.greatest(F.col("reach") - F.col("w0"), F.lit(0)), F.lit(0)))
             .groupBy("k", "t", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"),
                                           F.min(F.struct("start", "kk", "ks")).alias("head")))
    return spans.filter(F.col("words") >= run_words).select(
        F.col("k").alias("doc_id"), F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("length"),
        F.col("words").cast("long").alias("words"), F.col("head.kk").alias("kept_doc_id"),
        F.col("head.ks").cast("long").alias("kept_start"), *([F.col("t").alias("text_hash")] if by_text else []))


def without_passages(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kept): each document as a struct, and its text without the spans found for it. Where different texts share a key, the
    spans must be those ``by_text``, so that each text loses its own."""
    by_text = "text_hash" in spans.columns
    lists = spans.groupBy(F.col("doc_id").alias("k"), (F.col("text_hash") if by_text else F.lit(0)).alias("t")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("body"))
    rows = rows.join(lists, rows["key"].cast("long").eqNullSafe(lists["k"]) & ((F.xxhash64(rows["body"]) if by_text else F.lit(0)) == lists["t"]), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["start"] + s["length"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("body").cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.substr(
        F.col("body"), (z["a"] + 1).cast("int"), F.greatest(z["b"] - z["a"], F.lit(0)).cast("int")))
    return rows.select("row", F.when(F.col("spans").isNull(), F.col("body")).otherwise(F.array_join(pieces, "")).alias("kept"))
