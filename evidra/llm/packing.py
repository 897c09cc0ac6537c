"""Cost-balanced packing of documents into sequences."""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import short_batches, slices
from .tokens import word_encoder

CAPACITY, END_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # a piece of n tokens costs LINEAR * n + QUADRATIC * n * n
GROUP_TOKENS = 1 << 22  # documents of a task that are packed together


def piece_cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def room_plan(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths that hold exactly ``total`` tokens: full ones, and powers of two for the rest, which need no padding."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Buckets:
    """Sequences by room: of those with at least n tokens of room, the cheapest (then the lowest number) in a logarithmic number of steps.

    A segment tree over the possible rooms, 0 to ``capacity``; a leaf heaps its sequences as (cost, number), a node holds the least of
    the leaves below it.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.best: list[tuple | None] = [None] * (2 * self.width)
        self.heaps: list[list | None] = [None] * self.width
        self.most = capacity

    def _refresh(self, room: int) -> None:
        node, heap, best = room + self.width, self.heaps[room], self.best
        best[node] = heap[0] if heap else None
        while node > 1:
            node >>= 1
            a, b = best[2 * node], best[2 * node + 1]
            least = a if b is None or a is not None and a < b else b
            if best[node] == least:
                return
            best[node] = least

    def put(self, room: int, cost: float, i: int) -> None:
        if self.heaps[room] is None:
            self.heaps[room] = []
        heapq.heappush(self.heaps[room], (cost, i))
        self._refresh(room)

    def take(self, room: int) -> tuple:
        out = heapq.heappop(self.heaps[room])
        self._refresh(room)
        return out

    def cheapest(self, n: int) -> tuple | None:
        """(cost, number) of the cheapest sequence with room for n; it stays in."""
        if n > self.most:
            return None
        least, lo, hi = None, n + self.width, 2 * self.width
        while lo < hi:
            if lo & 1:
                if self.best[lo] is not None and (least is None or self.best[lo] < least):
                    least = self.best[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if self.best[hi] is not None and (least is None or self.best[hi] < least):
                    least = self.best[hi]
            lo >>= 1
            hi >>= 1
        return least

    def roomiest(self) -> int:
        """The largest room of any sequence."""
        node = 1
        while node < self.width:
            node = 2 * node + 1 if self.best[2 * node + 1] is not None else 2 * node
        return node - self.width


def balance(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple]:
    """(document, start, length, sequence, offset) for documents of these lengths.

    The longest document left goes to the sequence of lowest cost, of all, that has room for it; if none has, the roomiest (of equal
    ones the cheapest) takes as much as it can hold and the rest waits as a shorter document. The sequences together hold exactly
    all tokens. Costs count per token of a sequence's length, so that short sequences fill alongside.
    """
    room = room_plan(sum(lengths), capacity)
    size = list(room)
    used = [0] * len(room)
    free = Buckets(capacity)
    for i, n in enumerate(room):
        free.put(n, 0.0, i)
    waiting = [(-n, d, 0) for d, n in enumerate(lengths) if n > 0]
    heapq.heapify(waiting)
    out = []
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        found = free.cheapest(n)
        cost, i = free.take(room[found[1]] if found else free.roomiest())
        took = min(n, room[i])
        out.append((doc, start, took, i, used[i]))
        used[i] += took
        room[i] -= took
        if room[i]:
            free.put(room[i], cost + piece_cost(took, linear, quadratic) / size[i], i)
        if took < n:
            heapq.heappush(waiting, (took - n, doc, start + took))
    return out


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, linear: float = LINEAR,
         quadratic: float = QUADRATIC, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where each run of a document's token ids lies in which sequence; ``ids`` (little-endian unsigned 32-bit)
    only if asked for.

    Each task tokenizes its part of the input and packs it in groups of about ``GROUP_TOKENS`` tokens, so nothing is shuffled and
    a group fits in memory whatever the size of the input. A lost task packs the same rows again in the same way. A null text
    is empty and has the end id only; a null key stays null; rows that share a key are packed each. No rows: no rows.
    """
    fields = SCHEMA if with_ids else SCHEMA.removesuffix(", ids binary")
    names = [f.split()[0] for f in fields.split(", ")]

    def packed(group, first_sequence):
        lengths = [len(ids) // 4 for _, ids in group]
        rows = sorted(balance(lengths, capacity, linear, quadratic), key=lambda r: (r[3], r[4]))
        columns = [[], [], [], [], [], [], [], []]
        for doc, start, n, sequence, offset in rows:
            k, ids = group[doc]
            part = ids[4 * start:4 * (start + n)]
            for column, value in zip(columns, (k, start, n, zlib.crc32(part), lengths[doc], first_sequence + sequence, offset, part)):
                column.append(value)
        kinds = [pa.int64()] * 7 + [pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)][:len(names)]
        return pa.RecordBatch.from_arrays(arrays, names), (rows[-1][3] + 1 if rows else 0)

    def run(batches):
        encoder = word_encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36
        group, size = [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(body) + end
                group.append((k, ids))
                size += len(ids) // 4
                if size >= GROUP_TOKENS:
                    out, n = packed(group, sequence)
                    yield out
                    sequence, group, size = sequence + n, [], 0
        if group:
            yield packed(group, sequence)[0]

    return short_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)
