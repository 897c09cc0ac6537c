"""Exact top-k by inner product on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small

BLOCK_ROWS, CHUNK_QUERIES = 8192, 2048  # a group compares one block with one chunk
STEP_QUERIES = 256  # queries whose bitmaps are added together, so that they stay in the cache
ROW_BITS, QUERY_BITS = 6, 5  # bits of each component that the slices hold, of rows and of queries
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector is null or holds a null, an infinity or a NaN."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class SlicedBlock:
    """A block of integer vectors as bit slices: for each dimension its value above the least one, without the ``drop`` lowest bits, as
    one bitmap a bit."""

    def __init__(self, values: np.ndarray, bits: int = ROW_BITS):
        n, dims = values.shape
        self.n, self.words = n, -(-n // 64)
        self.least = values.min(axis=0)
        up = values - self.least
        self.drop = max(int(up.max()).bit_length() - bits, 0)
        kept = (up >> self.drop).astype(U)
        padded = np.zeros((self.words * 64, dims), U)
        padded[:n] = kept
        self.bits = max(int(kept.max()).bit_length(), 1)
        self.slices = np.empty((dims, self.bits, self.words), U)
        for b in range(self.bits):
            plane = np.ascontiguousarray((padded >> U(b) & U(1)).astype(np.uint8).T)
            self.slices[:, b] = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little")).view(U)
        self.present = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(U)
        middle = ((1 << self.drop) - 1) / 2
        self.rest = np.sqrt(((up - (kept.astype(np.int64) << self.drop) - middle) ** 2).sum(axis=1).max()) if n else 0.0
        self.norm = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1).max()) if n else 0.0


def _add_at(total: list, place: int, slices: list) -> None:
    """total += slices << place, by full adders on bitmaps; ``total`` holds one (queries, words) bitmap a bit."""
    carry = None
    i = 0
    while i < len(slices) or carry is not None:
        while len(total) <= place + i:
            total.append(np.zeros_like(slices[0]))
        a = total[place + i]
        if i < len(slices):
            b = slices[i]
            half = a ^ b
            both = a & b
            if carry is None:
                total[place + i], carry = half, both
            else:
                total[place + i] = half ^ carry
                half &= carry
                both |= half
                carry = both
        else:
            total[place + i] = a ^ carry
            carry = a & carry
            if not carry.any():
                carry = None
        i += 1


def sliced_scores(block: SlicedBlock, weights: np.ndarray) -> list:
    """Bit slices of sum_d |w_d| * (u_d or its complement where w_d is negative), for all queries (rows of ``weights``) at once."""
    total: list = []
    top = int(np.abs(weights).max()).bit_length()
    for d in range(weights.shape[1]):
        w = weights[:, d]
        flip = np.where(w < 0, ALL, U(0))[:, None]
        planes = [block.slices[d, b][None, :] ^ flip for b in range(block.bits)]
        for j in range(top):
            chosen = (np.abs(w) >> j & 1).astype(bool)
            if chosen.any():
                mask = np.where(chosen, ALL, U(0))[:, None]
                _add_at(total, j, [p & mask for p in planes])
    return total


def kth_value(total: list, candidates: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum of each query (the smallest, if fewer rows are candidates), found slice by slice from the top."""
    open_rows = candidates.copy()
    sure = np.zeros(len(candidates), np.int64)
    value = np.zeros(len(candidates), np.int64)
    for plane in reversed(total):
        ones = open_rows & plane
        n = sure + np.bitwise_count(ones).sum(axis=1)
        inside = n >= k  # the k-th has a 1 here
        sure = np.where(inside, sure, n)
        open_rows = np.where(inside[:, None], ones, open_rows & ~plane)
        value = value * 2 + inside
    return value


def rows_from(total: list, candidates: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is at least ``bound``."""
    over, same = np.zeros_like(candidates), candidates.copy()
    for i in range(len(total) - 1, -1, -1):
        one = (bound >> i & 1).astype(bool)[:, None]
        on = same & total[i]
        over = np.where(one, over, over | on)
        same = np.where(one, on, same & ~total[i])
    return over | same


def top_of_block(block: SlicedBlock, values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                 query_bits: int = QUERY_BITS) -> tuple:
    """(query index, row index, score) of at least the k best rows of the block for each query, without the query's own row.

    The slices hold quantised components, so a sum differs from the score by at most ``slack``: |q| times the longest
    remainder of a row plus the longest row times the remainder of q. Rows within twice the slack of the k-th sum are the boundary;
    their scores are computed exactly.
    """
    drop = max(int(np.abs(queries).max(initial=0)).bit_length() - query_bits, 0)
    coarse = np.sign(queries) * (np.abs(queries) + ((1 << drop) >> 1) >> drop)
    total = sliced_scores(block, coarse)
    if not total:
        total = [np.zeros((len(queries), block.words), U)]
    mine = np.tile(block.present, (len(queries), 1))
    where = {int(i): [] for i in query_ids}
    for row in np.flatnonzero(np.isin(ids, query_ids)):
        where[int(ids[row])].append(row)
    for q, i in enumerate(query_ids):
        for row in where[int(i)]:
            mine[q, row >> 6] &= ~(U(1) << U(row & 63))
    kth = kth_value(total, mine, k)
    few = np.bitwise_count(mine).sum(axis=1) <= k
    unit = float(1 << drop << block.drop)
    remainder = np.sqrt(((queries - (coarse << drop)).astype(np.float64) ** 2).sum(axis=1))
    slack = (np.sqrt(((coarse << drop).astype(np.float64) ** 2).sum(axis=1)) * block.rest + remainder * block.norm) / unit
    bound = np.where(few, 0, np.maximum(kth - np.ceil(2 * slack + 1).astype(np.int64), 0))
    bits = np.unpackbits(rows_from(total, mine, bound).view(np.uint8), axis=1, bitorder="little")
    q, row = np.nonzero(bits)
    score = np.empty(len(q), np.int64)
    for i in range(0, len(q), 65536):
        score[i:i + 65536] = np.einsum("ij,ij->i", queries[q[i:i + 65536]], values[row[i:i + 65536]])
    return q, row, score


def search_block(k: int):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not rows.num_rows or not queries.num_rows:
            return none
        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("v").combine_chunks().flatten().to_numpy()
            return flat.reshape(t.num_rows, -1) if len(flat) else np.zeros((t.num_rows, 1), np.int64)

        values, asked = matrix(rows), matrix(queries)
        ids, query_ids = rows.column("id").to_numpy(), queries.column("id").to_numpy()
        block, out = SlicedBlock(values), []
        for i in range(0, len(asked), STEP_QUERIES):
            some = query_ids[i:i + STEP_QUERIES]
            q, row, score = top_of_block(block, values, ids, asked[i:i + STEP_QUERIES], some, k)
            order = np.lexsort((ids[row], -score, q))
            q, row, score = q[order], row[order], score[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pa.table({"query_id": some[q[best]], "vec_id": ids[row[best]], "score": score[best]}))
        return pa.concat_tables(out)
    return run


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
          block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The k rows of highest integer inner product for each query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` selects the queries by a condition on the key; every row but the query's own key is a candidate, ties go to the
    smaller key. Rows are dealt to blocks by hash, queries to chunks, and each pair of a block and a chunk is one group: the block is
    held as bit slices, the weighted sum of all slices is formed with bitmap adders, the k-th sum is found from the top slice down,
    and rows near it are scored exactly. What leaves a group is k rows a query.

    Vectors null or with null or non-finite components take no part, nor do rows with a null key. Vectors of several lengths are indexes
    of their own: a query meets the rows of its length, an empty vector scores 0 with all empty ones.
    Rows that share a key are candidates each, and queries each: their best rows then merge. No rows, or no query: no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dims", F.size("v"))
    asked = F.coalesce(is_query(F.col("id")), F.lit(False))
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("n_asked")).filter("n_asked > 0").select(
        "dims", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("n_asked") / chunk_queries).cast("int").alias("chunks"))
    rows = rows.join(small(sizes), "dims")
    part = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = rows.select("id", "v", "dims", part("blocks", 1).alias("b"), every("chunks").alias("c"))
    right = rows.filter(asked).select("id", "v", "dims", part("chunks", 2).alias("c"), every("blocks").alias("b"))
    right = right.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own, though made from the same rows
    found = (left.groupBy("dims", "b", "c").cogroup(right.groupBy("dims", "b", "c"))
             .applyInArrow(search_block(k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
