"""Packed token matrices: best-fit-decreasing packing of documents into rows of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import short_batches, slices
from .tokens import byte_encoder, largest_id

LENGTH, END_ID, PAD_ID = 2048, 50256, 50256
GROUP_TOKENS = 1 << 22


class FreeRoom:
    """Rows by the room they have left, in a segment tree over 1..length: which is the tightest that takes n tokens?"""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def _change(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows.setdefault(room, []).append(row)
            self._change(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(row, room) with the least room >= n, taken out; None if there is none."""
        node = n + self.width
        while not self.count[node]:
            while node & 1:  # up while it is a right child
                node >>= 1
                if node <= 1:
                    return None
            node += 1  # the subtree to the right
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], length: int = LENGTH) -> tuple[list[tuple], int]:
    """((document, start, length, row, offset) ..., number of rows). Documents longer than a row give full rows first; the remainders
    and the other documents go, longest first, to the fullest row that takes them whole."""
    out, rest, n_rows = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            out.append((doc, start, length, n_rows, 0))
            n_rows += 1
        if n % length:
            rest.append((n % length, doc, n - n % length))
    rest.sort(key=lambda r: (-r[0], r[1]))
    free = FreeRoom(length)
    for n, doc, start in rest:
        found = free.take(n)
        if found is None:
            found = (n_rows, length)
            n_rows += 1
        row, room = found
        out.append((doc, start, n, row, length - room))
        free.put(row, room - n)
    return out, n_rows


SCHEMA = ("sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, "
          "position_ids binary")


def pack_matrix(docs: DataFrame, ranks: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, pad_id: int = PAD_ID,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence of ``length`` ids.

    ``input_ids`` is the matrix row, little-endian unsigned 16-bit if every id of the vocabulary, the end and the padding fit, else 32-bit, padded with ``pad_id`` behind
    ``n_tokens``; ``cu_seqlens`` are the cumulative segment lengths from 0; ``position_ids`` (16 or 32 bits as the length asks) start
    again at 0 with each segment and count on through the padding as a segment of its own. Segment i holds the ids of
    ``doc_ids[i]`` from ``starts[i]`` on. Every document ends with ``end_id``; a document longer than a row continues in others, no
    id is lost or doubled.

    Each task packs its part of the input in groups of about ``GROUP_TOKENS`` tokens; nothing is shuffled, and a lost task
    does the same again. A null text is empty and has the end id only; null keys stay null; rows that share a key are packed
    each. No rows: no rows.
    """
    kind = "<u2" if max(end_id, pad_id, largest_id(ranks)) < 1 << 16 else "<u4"
    place = "<u2" if length <= 1 << 16 else "<u4"
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def packed(group, first):
        ids = [np.frombuffer(b, "<u4") for _, b in group]
        pieces, n_rows = best_fit([len(x) for x in ids], length)
        matrix, places = np.full((n_rows, length), pad_id, kind), np.zeros((n_rows, length), place)
        used = np.zeros(n_rows, np.int64)
        keys, starts, cuts = [[] for _ in range(n_rows)], [[] for _ in range(n_rows)], [[0] for _ in range(n_rows)]
        count = np.arange(length).astype(place)
        for doc, start, n, row, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            matrix[row, offset:offset + n] = ids[doc][start:start + n]
            places[row, offset:offset + n] = count[:n]
            keys[row].append(group[doc][0])
            starts[row].append(start)
            cuts[row].append(offset + n)
            used[row] = offset + n
        for row in range(n_rows):
            places[row, used[row]:] = count[:length - used[row]]
        columns = [np.arange(first, first + n_rows), used, keys, starts, cuts, [r.tobytes() for r in matrix], [r.tobytes() for r in places]]
        step = 4096
        for i in range(0, n_rows, step):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + step], t) for c, t in zip(columns, kinds)], names)
        return n_rows

    def run(batches):
        encoder = byte_encoder(ranks, pattern)
        end = int(end_id).to_bytes(4, "little")
        first, group, size = TaskContext.get().partitionId() << 36, [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group.append((k, encoder.ids(body) + end))
                size += len(group[-1][1]) // 4
                if size >= GROUP_TOKENS:
                    first += yield from packed(group, first)
                    group, size = [], 0
        if group:
            yield from packed(group, first)

    return short_batches(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write_packed(sequences: DataFrame, path: str) -> None:
    """The matrices as Parquet, one file per task: fixed-length rows that a loader can lay over each other."""
    sequences.write.mode("errorifexists").parquet(path)


def read_documents(sequences: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, ids array<int>): the segments of packed rows, read back; a row's bytes tell the width of its ids."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = [(d, s, np.frombuffer(m, f"<u{len(m) // length}")[a:b].astype(np.int32))
                   for ds, ss, cs, m in zip(rows["doc_ids"], rows["starts"], rows["cu_seqlens"], rows["input_ids"])
                   for d, s, a, b in zip(ds, ss, cs, cs[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return sequences.select("doc_ids", "starts", "cu_seqlens", "input_ids").mapInArrow(run, "doc_id long, start long, ids array<int>")
