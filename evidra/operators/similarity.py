"""Rarity-weighted similarity between items described by sets of terms.

Input tables have columns ``item`` and ``term``. A term's information content is IC = -ln(share of items that
have it); the similarity of two items is the IC of their shared terms over the IC of all terms either one has.

Scale: the work is an inverted-index join. A term held by very many items would emit a quadratic number of
pairs, so no join here ever pairs up the holders of a frequent term:

* ``similar_pairs`` (all pairs above a threshold) compares only the rarest-first prefixes of the items' terms, two blocks of items in a task;
  equal term sets are collapsed to one representative first.
* ``top_k`` (best k per item) stores the items in blocks, compressed; any two blocks meet in one task, which keeps k of an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.operators.hierarchy import most_specific
from evidra.session import cut, stored


def term_ic(item_terms: DataFrame) -> DataFrame:
    """term, n_items, ic. The item count stays a one-row relation; nothing is collected."""
    n = item_terms.agg(F.countDistinct("item").alias("n_total"))
    counts = item_terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_items"))
    return (counts.join(F.broadcast(n))  # one row by construction
            .select("term", "n_items", (-F.log(F.col("n_items") / F.col("n_total"))).alias("ic")))


def weigh(item_terms: DataFrame, ic: DataFrame | None = None) -> DataFrame:
    """item, term, n_items, ic for every membership."""
    return item_terms.join(ic if ic is not None else term_ic(item_terms), "term")


def item_information(item_terms: DataFrame) -> DataFrame:
    """item, n_terms, total_ic."""
    return (weigh(item_terms).groupBy("item")
            .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("ic").alias("total_ic")))


def gic(shared, total_a, total_b):
    """Shared information over the union's information (0 when the union carries none)."""
    union = total_a + total_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def shrink(similarity, total_a, total_b, floor):
    """Damp the similarity when the poorer profile carries less information than ``floor``."""
    return similarity * F.least(F.lit(1.0), F.sqrt(F.least(total_a, total_b) / floor))


# A membership as one string, count first: it sorts rarest-first, carries its own weight, and array_intersect hashes
# strings (arrays of structs are compared pairwise).
_WIDTH = 14


def _key():
    return F.concat(F.lpad(F.col("n_items").cast("string"), _WIDTH, "0"), F.col("term").cast("string"))


def _weight_of(keys, n_total):
    return F.aggregate(keys, F.lit(0.0),
                       lambda acc, x: acc - F.log(F.substring(x, 1, _WIDTH).cast("double") / n_total))


def _with_total(weighted: DataFrame, item_terms: DataFrame) -> DataFrame:
    n = item_terms.agg(F.countDistinct("item").alias("n_total"))
    return weighted.join(F.broadcast(n))  # one row by construction


def _profiles(item_terms: DataFrame) -> DataFrame:
    """item, total, n_total, terms (rarest first). A profile is as large as one item's own term set."""
    weighted = _with_total(weigh(item_terms).where("ic > 0"), item_terms)
    return (weighted.groupBy("item")
            .agg(F.sum("ic").alias("total"), F.first("n_total").alias("n_total"),
                 F.array_sort(F.collect_list(_key())).alias("terms")))


_BITS = 35  # a coded membership: the term's count above its number, so smaller is rarer
TILE_TERMS = 4_000_000  # prefix terms of a block of ``similar_pairs``; two blocks meet in a task


def _coded(item_terms: DataFrame) -> DataFrame:
    """item, total, n_total, terms (coded, rarest first): as ``_profiles``, with eight bytes a term."""
    numbered = cut(term_ic(item_terms).where("ic > 0").withColumn("u", F.monotonically_increasing_id()))
    low = (1 << 33) - 1  # the row in its partition; the partition is above
    longest, most, last = numbered.agg(F.coalesce(F.max(F.col("u").bitwiseAND(low)), F.lit(0)), F.coalesce(F.max("n_items"), F.lit(0)),
                                       F.coalesce(F.max(F.shiftright("u", 33)), F.lit(0))).first()
    if most >> (63 - _BITS) or ((last + 1) * (longest + 1)) >> _BITS:
        raise ValueError("too many terms or items to code")
    code = F.shiftleft(F.col("n_items"), _BITS) + F.shiftright("u", 33) * (longest + 1) + F.col("u").bitwiseAND(low)
    weighted = _with_total(item_terms.join(numbered.select("term", "ic", code.alias("code")), "term"), item_terms)
    return (weighted.groupBy("item").agg(F.sum("ic").alias("total"), F.first("n_total").alias("n_total"), F.array_sort(F.collect_list("code")).alias("terms")))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """item, total, n_total, unique, rest, prefix: the terms from which on at least ``threshold`` of the weight is still to come, without those of one item
    only, which come first and weigh ``unique``; ``rest`` is the weight behind the prefix. Sums allow for rounding, so a prefix is rather too long."""
    out = T.StructType([*(sets.schema[c] for c in ("item", "total", "n_total")), T.StructField("unique", T.DoubleType()), T.StructField("rest", T.DoubleType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def cut_off(batches):
        for b in batches:
            terms, total, n = b["terms"], b["total"].to_numpy(), b["n_total"].to_numpy()
            size = np.diff(terms.offsets.to_numpy())
            codes, line = terms.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            ic = -np.log((codes >> _BITS) / n[line])
            so_far = np.cumsum(ic) - ic
            begin = np.cumsum(size) - size
            left = total[line] - (so_far - np.repeat(so_far[begin], size) if len(codes) else so_far)
            inside = left >= (threshold - 1e-9) * total[line] - 1e-6
            whole = np.bincount(line[inside], minlength=len(size)) == size
            rest = np.where(whole, 0.0, total - np.bincount(line[inside], ic[inside], len(size)))
            kept = inside & (codes >> _BITS > 1)
            unique = np.bincount(line[inside & ~kept], ic[inside & ~kept], len(size)).astype(float)  # of nothing it counts whole numbers
            offsets = np.concatenate([[0], np.cumsum(np.bincount(line[kept], minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["item"], b["total"], b["n_total"], pa.array(unique), pa.array(rest), pa.ListArray.from_arrays(offsets, pa.array(codes[kept]))], out.names)
    return sets.select("item", "total", "n_total", "terms").mapInArrow(cut_off, out)


def _tiles(prefixes: DataFrame, threshold: float) -> DataFrame:
    """i, j, own, other: the compressed rows of every block and of each block, itself included, whose totals can be near enough. Blocks meet where they are stored."""
    load = F.size("prefix")
    n = prefixes.agg(F.coalesce(F.sum(load), F.lit(0))).first()[0]
    ranges = max(1, -(-n // TILE_TERMS), min(4, n // 100_000))
    dealt = prefixes.repartitionByRange(ranges, "total", "item").withColumn("range", F.spark_partition_id())
    so_far = F.sum(load).over(Window.partitionBy("range").orderBy("total", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut(dealt.withColumn("block", F.col("range") * 1_000_000 + F.floor((so_far - load) / TILE_TERMS)).drop("range"))
    names = [c for c in placed.columns if c not in ("range", "block")]

    def packed(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.select(names).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.select(names).combine_chunks())
        total = rows["total"].to_numpy()
        return pa.table([rows["block"][:1], pa.array([total.min()]), pa.array([total.max()]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "lo", "hi", "data"])
    parts = min(max(12, ranges), 64)  # any two meet in one task
    blocks = cut(placed.repartition(parts, "block").groupBy("block").applyInArrow(packed, "block long, lo double, hi double, data binary"))
    left = blocks.select(F.col("block").alias("i"), F.col("hi").alias("top"), F.col("data").alias("own"))
    right = blocks.select(F.col("block").alias("j"), "lo", F.col("data").alias("other"))
    return (left.coalesce(parts).join(right.coalesce(parts).hint("shuffle_replicate_nl"), (F.col("i") <= F.col("j")) & (F.col("top") >= (threshold - 1e-9) * F.col("lo")))
            .select("i", "j", "own", "other"))


def _met(tiles: DataFrame, threshold: float, kind: T.DataType) -> DataFrame:
    """a, b (a < b) for the pairs that could reach the threshold. At the first common term both sides' remaining weight bounds what they share; afterwards
    the common prefix weight plus the weight behind the prefix that ends first does. Both bounds are safe."""
    out = T.StructType([T.StructField("x", kind), T.StructField("y", kind)])

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = pa.ipc.open_stream(b["own"][i].as_buffer()).read_all()
                other = own.slice(0, 0) if b["i"][i] == b["j"][i] else pa.ipc.open_stream(b["other"][i].as_buffer()).read_all()
                yield from meet(pa.concat_tables([own, other]).combine_chunks(), np.arange(len(own) + len(other)) < len(own)).to_batches(100_000)

    def meet(tile: pa.Table, own: np.ndarray) -> pa.Table:
        prefix = tile["prefix"].combine_chunks()
        total, unique, rest, n_total = (tile[c].to_numpy() for c in ("total", "unique", "rest", "n_total"))
        size = np.diff(prefix.offsets.to_numpy())
        codes, line = prefix.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        weight = -np.log((codes >> _BITS) / n_total[line])
        so_far = np.cumsum(weight) - weight
        start = np.cumsum(size) - size
        left = (total - unique)[line] - so_far + so_far[start[line]]
        last = np.zeros(len(size), np.int64)
        last[size > 0] = codes[(start + size - 1)[size > 0]]
        mine = np.flatnonzero(own)
        alone = bool(own.all())
        others = mine if alone else np.flatnonzero(~own)
        place = np.full(len(own), -1)
        place[others] = np.arange(len(others))
        at = np.flatnonzero(place[line] >= 0)
        at = at[np.argsort(codes[at], kind="stable")]
        posted, by, left_o = place[line[at]], codes[at], left[at]  # the other side's holders, term by term
        asked = np.flatnonzero(own[line])
        begin, end = np.searchsorted(by, codes[asked]), np.searchsorted(by, codes[asked], side="right")
        some = end - begin > (1 if alone else 0)  # alone, an item meets itself
        asked, begin, reps = asked[some], begin[some], (end - begin)[some]
        ic, left = weight[asked], left[asked]
        rank = np.full(len(own), -1)
        rank[mine] = np.arange(len(mine))
        row = rank[line[asked]]  # ascending, as the entries are in row order
        first, done = np.searchsorted(row, np.arange(len(mine) + 1)), np.concatenate([[0], np.cumsum(reps)])
        xs, ys, i = [], [], 0
        while i < len(mine):  # some items at a time: at most four million cells or meetings, or one item
            to = min(len(mine), i + max(1, 4_000_000 // max(1, len(others))))
            to = max(i + 1, min(to, int(np.searchsorted(done[first], done[first[i]] + 4_000_000, side="right")) - 1))
            part = slice(first[i], first[to])
            many = reps[part]
            if many.sum():
                where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[part], many)
                cell = np.repeat((row[part] - i) * len(others), many) + posted[where]
                common = np.bincount(cell, np.repeat(ic[part], many), (to - i) * len(others))
                hit = np.flatnonzero(common)
                q, c = np.divmod(hit, len(others))
                x, y = mine[i + q], others[c]
                needed = (threshold / (1 + threshold) - 1e-9) * (total[x] + total[y]) - 1e-6  # shared weight a qualifying pair must reach
                near = (np.minimum(total[x], total[y]) >= (threshold - 1e-9) * np.maximum(total[x], total[y])) & (
                    common[hit] + np.where(last[x] < last[y], rest[x], np.where(last[x] > last[y], rest[y], np.minimum(rest[x], rest[y]))) >= needed)
                if alone:
                    near &= x < y
                hit, x, y, needed = hit[near], x[near], y[near], needed[near]
                common[:] = -1.0  # from here on the weight left at the first common term, for the pairs that remain
                common[hit] = 0.0
                of = np.flatnonzero(common[cell] >= 0)
                np.maximum.at(common, cell[of], np.minimum(np.repeat(left[part], many)[of], left_o[where[of]]))
                near = common[hit] >= needed
                xs.append(x[near])
                ys.append(y[near])
            i = to
        items = tile["item"]
        x, y = (pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for v in (xs, ys))
        return pa.table([items.take(x), items.take(y)], ["x", "y"])
    pairs = tiles.mapInArrow(read, out)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(item_terms: DataFrame, threshold: float) -> DataFrame:
    """Exact pairs with similarity >= threshold: a, b, sim, copies_a, copies_b.

    Items with the same term set are one row (a/b is the smallest id, copies_* how many share the set), so a group
    of copies never emits its own square. Two sets can only reach the threshold t when they share a term inside both
    rarest-first prefixes: the terms from which on at least t times the set's total weight is still to come. What two prefixes have in common is
    added up inside the task of two blocks of sets; only pairs that the common weight and the weight behind the prefixes leave open are shuffled and verified.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    profiles = _coded(item_terms).withColumn("sig", F.sha2(F.array_join(F.col("terms").cast("array<string>"), " "), 256))
    sets = cut(profiles.groupBy("sig").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("copies"),
                                           F.first("total").alias("total"), F.first("n_total").alias("n_total"),
                                           F.first("terms").alias("terms")))
    candidates = cut(_met(_tiles(_prefixes(sets, threshold), threshold), threshold, sets.schema["item"].dataType))
    side = sets.select("item", "terms", "total", "copies")
    pairs = (candidates
             .join(side.toDF("a", "terms_a", "ta", "copies_a"), "a")
             .join(sets.select("item", "terms", "total", "copies", "n_total").toDF("b", "terms_b", "tb", "copies_b", "n_total"), "b"))
    shared = F.aggregate(F.array_intersect("terms_a", "terms_b"), F.lit(0.0), lambda acc, x: acc - F.log(F.shiftright(x, _BITS) / F.col("n_total")))
    return (pairs.withColumn("shared", shared).withColumn("sim", gic(F.col("shared"), F.col("ta"), F.col("tb")))
            .where(F.col("sim") >= threshold - 1e-12)
            .select("a", "b", "sim", "copies_a", "copies_b"))


BLOCK_MEETINGS = 3_000_000  # of items of a block with the holders of their terms in another, added up at a time
BLOCK_ITEMS = 16_384


def top_k(item_terms: DataFrame, k: int, frequent: int = 2000) -> DataFrame:
    """For each item its k most similar others: item, other, sim, rank (ties by id). Exact, whatever ``frequent`` says.

    Any two blocks of items meet in one task, which adds up what their items share term by term and keeps the k best of an item.
    """
    from evidra.operators.neighbors import Machinery  # which is built on this module
    return Machinery({"terms": item_terms}, None, {"terms": 1.0}, frequent, BLOCK_ITEMS, unknown=False).nearest(k, BLOCK_MEETINGS)


def score_pairs(pairs: DataFrame, item_terms: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Similarity of the given pairs only, as ``sim`` (0 when they share nothing or have no terms)."""
    base = _profiles(item_terms).select("item", "total", "terms", "n_total")
    out = (pairs.join(base.toDF(a, "_ta", "_sa", "_n"), a, "left").join(base.drop("n_total").toDF(b, "_tb", "_sb"), b, "left"))
    shared = _weight_of(F.array_intersect("_sa", "_sb"), F.col("_n"))
    return (out.withColumn("_s", shared).withColumn("sim", F.coalesce(gic(F.col("_s"), F.col("_ta"), F.col("_tb")), F.lit(0.0)))
            .drop("_ta", "_tb", "_sa", "_sb", "_n", "_s"))


def rank_of_pair(pairs: DataFrame, item_terms: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each given (a, b): sim, and 1 + the number of other items more similar to a than b is.

    Needs the whole neighbourhood of each seed, so it is meant for a short list of seeds.
    """
    weighted = weigh(item_terms).where("ic > 0")
    totals = weighted.groupBy("item").agg(F.sum("ic").alias("total"))
    seeds = pairs.select(F.col(a).alias("item")).distinct()
    known = stored(weighted.select("item", "term", "ic").join(totals, "item"))
    seed_terms = known.join(seeds, "item", "left_semi").select(F.col("item").alias("seed"), "term", F.col("total").alias("seed_total"))
    # what a seed meets is shuffled once, and added up, rounded and ranked where it is
    met = seed_terms.join(known, "term").where("seed <> item").select("seed", "seed_total", "item", "total", "ic").repartition("seed")
    sims = met.groupBy("seed", "item").agg(F.sum("ic").alias("shared"), F.first("seed_total").alias("seed_total"), F.first("total").alias("total"))
    lists = sims.groupBy("seed").agg(F.collect_list(F.struct("item", F.round(gic(F.col("shared"), F.col("seed_total"), F.col("total")), 9).alias("s"))).alias("near"))
    asked = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    asked = asked.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("copies")).join(lists.withColumnRenamed("seed", "_a").hint("merge"), "_a", "left")
    own = F.filter("near", lambda x: x["item"] == F.col("_b"))
    found = asked.withColumn("sim", F.coalesce(F.get(own, F.lit(0))["s"], F.lit(0.0)))
    found = found.withColumn("better", F.coalesce(F.size(F.filter("near", lambda x: x["s"] > F.col("sim"))), F.lit(0)))
    # a pair that is asked several times counts so many times, in every row of it
    found = found.select("_a", "_b", "sim", F.greatest("better", F.lit(0)).cast("long").alias("better"), F.explode(F.array_repeat("copies", F.col("copies").cast("int"))).alias("copies"))
    return found.select(F.col("_a").alias(a), F.col("_b").alias(b), "sim", (F.col("better") * F.col("copies") + 1).alias("rank"))


def set_overlap(pairs: DataFrame, item_terms: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per pair the sizes of the intersection and of the two differences."""
    sets = item_terms.groupBy("item").agg(F.collect_set("term").alias("terms"))
    return (pairs.join(sets.toDF(a, "_sa"), a).join(sets.toDF(b, "_sb"), b)
            .select(a, b, F.size(F.array_intersect("_sa", "_sb")).alias("n_shared"),
                    F.size(F.array_except("_sa", "_sb")).alias("n_only_a"),
                    F.size(F.array_except("_sb", "_sa")).alias("n_only_b")))


def shared_terms(pairs: DataFrame, item_terms: DataFrame, n: int, a: str = "a", b: str = "b",
                 edges: DataFrame | None = None) -> DataFrame:
    """Top n shared terms of each pair by information: a, b, term, ic, n_items, rank.

    With ``edges`` (child, parent) only the most specific shared terms remain.
    """
    weighted = weigh(item_terms)
    shared = (pairs.select(a, b)
              .join(weighted.select(F.col("item").alias(a), "term", "ic", "n_items"), a)
              .join(item_terms.select(F.col("item").alias(b), "term"), [b, "term"], "left_semi"))
    if edges is not None:
        shared = cut(shared)
        lowest = most_specific(shared.select(F.struct(a, b).alias("item"), "term"), edges).select(f"item.{a}", f"item.{b}", "term")
        shared = shared.join(lowest, [a, b, "term"], "left_semi")
    w = Window.partitionBy(a, b).orderBy(F.desc("ic"), "term")
    return (shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(a, b, "term", "ic", "n_items", "rank"))


def contrast_terms(pairs: DataFrame, item_terms: DataFrame, n: int, a: str = "a", b: str = "b") -> DataFrame:
    """The first n most informative terms of ``a`` that ``b`` lacks."""
    weighted = weigh(item_terms)
    own = pairs.select(a, b).join(weighted.select(F.col("item").alias(a), "term", "ic"), a)
    missing = own.join(item_terms.select(F.col("item").alias(b), "term"), [b, "term"], "left_anti")
    w = Window.partitionBy(a, b).orderBy(F.desc("ic"), "term")
    return (missing.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(a, b, "term", "ic", "rank"))
