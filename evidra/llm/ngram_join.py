"""Jaccard join on word n-grams: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidra.session import cut

from .common import short_batches, slices
from .shingles import minhash_bands, odd_numbers, set_hashes, shingle_sets

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20  # a task compares two blocks of at most about so many sets or shingles


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, noise_at: float = 0.4, noise: float = 0.1) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with which a pair at the threshold shares a band with probability ``recall`` and a pair of
    likeness ``noise_at`` with probability ``noise`` at most."""
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if 1 - (1 - noise_at ** rows) ** bands <= noise:
            return bands, rows
    raise ValueError("no such banding")


def signatures(docs: DataFrame, words: int, bands: int, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, n, h1, h2, bands): a hash of each document's text, the size of its n-gram set, 128 bits of the set, and its band hashes."""
    factors = odd_numbers(5, bands * rows)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            pairs = [set_hashes(s) for s in sets]
            found = [minhash_bands(s, factors, bands) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in pairs], pa.int64()),
                 pa.array([p[1] for p in pairs], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["k", "t", "n", "h1", "h2", "bands"])

    return short_batches(lowered(docs, key, text)).mapInArrow(run, "k long, t long, n long, h1 long, h2 long, bands array<long>")


def lowered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, text): key, hash of the text, and the text in lower case."""
    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"), F.lower(F.col(text)).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b).

    Every node takes the smallest label among its own and its neighbours', then the label of that label, until none changes.
    Each round is written to the checkpoint folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = cut(step.join(up, "root").select("node", "was", F.least("root", "up").alias("root")))
        labels = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return labels


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets at ``left`` are linked with which at ``right``: overlaps summed over the shared n-grams, those that lie in the same
    sets counted together."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, int)
    counts = np.diff(np.concatenate((starts, [len(gram)])))
    mark = odd_numbers(31, len(sets))
    pattern = np.add.reduceat(mark[owner], starts) if len(starts) else np.zeros(0, np.uint64)
    shared = np.flatnonzero(counts > 1)
    _, one, times = np.unique(pattern[shared], return_index=True, return_counts=True)
    chosen = shared[one]  # one n-gram for each distinct set of owners, and how many there are like it
    overlap = np.zeros((len(left), len(right)), np.float32)
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
    for i in range(0, len(chosen), 1024):
        part = chosen[i:i + 1024]
        n = counts[part]
        column = np.repeat(np.arange(len(part)), n)
        where = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        who = owner[where]
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        keep = row_of[who] >= 0
        a[row_of[who[keep]], column[keep]] = 1
        keep = col_of[who] >= 0
        b[col_of[who[keep]], column[keep]] = 1
        overlap += (a * times[i:i + 1024].astype(np.float32)) @ b.T
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    return overlap >= threshold * union - 1e-9


def _roots(linked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The smallest of ``own`` in each connected component of a symmetric relation."""
    root = own.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.array([root[row].min() if row.any() else top for row in linked]))
        if (new == root).all():
            return root
        root = new


def compare_blocks(words: int, threshold: float):
    """For one pair of blocks of a component: each set's linked documents in the other block, and edges that span its links."""
    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        h1, n, block = (table.column(c).to_numpy() for c in ("h1", "n", "block"))
        sets = shingle_sets(table.column("text").to_pylist(), words)
        seen, take = set(), []
        for i, s in enumerate(sets):  # rows that share a document key may bring another text: the set decides
            if len(s) == n[i] and int(h1[i]) not in seen and set_hashes(s)[0] == h1[i]:
                seen.add(int(h1[i]))
                take.append(i)
        take = np.array(take, int)
        sets, own, block, copies = [sets[i] for i in take], h1[take], block[take], table.column("copies").to_numpy()[take]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        linked = _linked(sets, left, right, threshold)
        if first == second:
            np.fill_diagonal(linked, False)
            links = linked @ copies[right]
            node, count, root = own[left], links, _roots(linked, own[left])
        else:
            both = np.zeros((len(own), len(own)), bool)
            both[np.ix_(left, right)] = linked
            both |= both.T
            node, count, root = own, both @ copies, _roots(both, own)
        some = count > 0
        return pa.table({"h1": pa.array(node[some], pa.int64()), "links": pa.array(count[some].astype(np.int64), pa.int64()),
                         "root": pa.array(root[some], pa.int64())})
    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    Two documents are linked if the Jaccard likeness of their sets of ``words``-word n-grams is at least ``threshold``;
    ``n_links`` counts the others that a document is linked with and ``class_id`` is the smallest key that links lead to.
    ``n_copies`` counts the documents with the same set, itself included.

    Equal sets collapse first and count by their number. The sets' MinHash bands are shuffled; in a band bucket every set points to
    the smallest one, which keeps it linear. Sets that buckets connect form a component, and all pairs of a component are
    compared on the full n-gram sets: at once if it is small, else in pairs of blocks, each pair in a task of its own. Pairs are counted where
    they are compared and never become rows; what leaves a task is one row per set with its count and one edge.

    Texts without words, empty and null ones are copies of each other and linked with nothing else. A null key is a document of
    its own without a number: it has null as class_id where its class has no key at all. Rows that share a key count as documents each.
    No rows: no rows. Sets are told apart by 128 bits; as nodes of the graph they go by 64 of these.
    """
    bands, rows = choose_bands(threshold, recall)
    sig = cut(signatures(docs, words, bands, rows, key, text))
    sets = sig.groupBy("h1", "h2", "n", "bands").agg(F.min("k").alias("first"), F.min(F.struct("k", "t")).alias("one"),
                                                       F.count(F.lit(1)).alias("copies"))
    placed = sets.select("h1", F.posexplode("bands").alias("band", "hash")).select("h1", F.xxhash64("band", "hash").alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.min("h1").alias("head"), F.max("h1").alias("tail")).filter("head < tail")
    edges = placed.join(heads, "bucket").filter("h1 <> head").select(F.col("h1").alias("a"), F.col("head").alias("b"))
    near = components(edges)
    members = near.join(sets.select("h1", "n", "one", "copies"), F.col("node") == F.col("h1"))
    weight = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)
    blocks = members.groupBy("root").agg(F.ceil(weight).cast("int").alias("blocks"))
    members = (members.join(blocks, "root")
               .select("root", "h1", "n", "copies", "blocks", F.pmod(F.xxhash64("h1"), "blocks").cast("int").alias("block"),
                       F.xxhash64("one.k", "one.t").alias("place"), F.col("one.t").alias("t")))
    texts = lowered(docs, key, text).select(F.xxhash64("k", "t").alias("place"), "t", "text")  # each text of a key once, so that a set meets its own only
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("place", "t").orderBy("t"))).filter("copy = 1").drop("copy")
    units = (members.join(texts, ["place", "t"])
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "h1", "n", "copies",
                     "block", "text"))
    found = cut(units.groupBy("root", "i", "j").applyInArrow(compare_blocks(words, threshold), "h1 long, links long, root long"))
    spanning = found.filter("h1 <> root").select(F.col("h1").alias("a"), F.col("root").alias("b")).distinct()
    groups = components(spanning)
    linked = (found.groupBy("h1").agg(F.sum("links").alias("links"))
              .join(groups.select(F.col("node").alias("h1"), F.col("root").alias("grp")), "h1", "left"))
    whole = sets.select("h1", "h2", "first", "copies").join(linked, "h1", "left").withColumn("grp", F.coalesce("grp", "h1"))
    classes = whole.groupBy("grp").agg(F.min("first").alias("class_id"))
    of_set = whole.join(classes, "grp").select(
        "h1", "h2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return sig.select("k", "h1", "h2").join(of_set, ["h1", "h2"]).select(F.col("k").alias("doc_id"), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest key. Rows that share a key stay or go together, equal
    ones once."""
    keep = (jaccard_join(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .select(F.col("doc_id").alias("kept")).distinct())
    rows = docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["kept"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])
