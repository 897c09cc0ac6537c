"""Commitments over an ordered log: Merkle root, inclusion proofs, prefix check, recomputed hashes.

Leaves are sha256(00 || data), nodes sha256(01 || left || right), an odd node moves up unchanged. The log carries its own
dense sequence number, so a level needs no global sort: nodes are grouped FAN at a time by index div FAN and each group is
folded to one node inside its row. A log of n rows takes log_FAN(n) shuffles, each FAN times smaller than the last. The groups can be
stored as tiles, from which proofs of inclusion and of consistency are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import cut

FAN_BITS = 10
FAN = 1 << FAN_BITS


def leaf_hash(data) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(data, "UTF-8")), 256))


def node_hash(left, right) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def _next_level(nodes) -> Column:
    half = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: F.when(
        2 * i + 1 < F.size(nodes), node_hash(F.element_at(nodes, 2 * i + 1), F.element_at(nodes, 2 * i + 2)))
        .otherwise(F.element_at(nodes, 2 * i + 1)))


def _gathered(nodes: DataFrame) -> DataFrame:
    """group, nodes: up to FAN consecutive nodes in order."""
    return (nodes.groupBy(F.shiftrightunsigned("idx", FAN_BITS).alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("n")).select("idx", F.col("n.h").alias("nodes")))


def _fold(groups: DataFrame) -> DataFrame:
    df = groups
    for _ in range(FAN_BITS):  # one projection per level, so each level's array is computed once
        df = df.withColumn("nodes", _next_level(F.col("nodes")))
        df = df.select("idx", F.transform("nodes", lambda x: x).alias("nodes"))
    return df.select("idx", F.col("nodes")[0].alias("h"))


def leaves(log: DataFrame, seq: str = "seq", data: str = "data") -> DataFrame:
    """idx (dense from 0), h."""
    return log.select(F.col(seq).cast("long").alias("idx"), leaf_hash(F.col(data)).alias("h"))


def merkle_root(log: DataFrame, seq: str = "seq", data: str = "data") -> DataFrame:
    """One row: size, root (hex). ``seq`` numbers the log densely from 0."""
    nodes = leaves(log, seq, data)
    size = nodes.agg(F.count(F.lit(1)).alias("size"))
    n = size.first()[0]
    if n == 0:
        return size.select("size", F.sha2(F.lit(""), 256).alias("root"))
    while n > 1:
        nodes = cut(_fold(_gathered(nodes)))
        n = -(-n // FAN)
    return size.join(F.broadcast(nodes)).select("size", F.lower(F.hex("h")).alias("root"))  # one row each


def tiles(log: DataFrame, seq: str = "seq", data: str = "data") -> DataFrame:
    """The tree as rows: level, tile, nodes (binary array). A tile holds up to FAN consecutive nodes of its level; a node of a level is
    the root of a tile of the level below, so level 0 holds the leaves and the last level one tile. ``write_tiles`` keeps them as files."""
    nodes, out, level = leaves(log, seq, data), None, 0
    n = log.count()
    while n > 0:
        groups = cut(_gathered(nodes).select(F.lit(level).alias("level"), F.col("idx").alias("tile"), "nodes"))
        out = groups if out is None else out.unionByName(groups)
        if n <= FAN:
            break
        nodes, n, level = _fold(groups.select(F.col("tile").alias("idx"), "nodes")), -(-n // FAN), level + 1
    return out if out is not None else _gathered(nodes).select(F.lit(0).alias("level"), F.col("idx").alias("tile"), "nodes")


def write_tiles(log: DataFrame, path: str, seq: str = "seq", data: str = "data") -> None:
    """Tiles as Parquet, a folder per level and sorted by tile, so that a proof reads the few row groups that it needs."""
    tiles(log, seq, data).repartitionByRange("level", "tile").sortWithinPartitions("level", "tile").write.partitionBy("level").parquet(path)


def inclusion_proofs(log: DataFrame, wanted: DataFrame, seq: str = "seq", data: str = "data") -> DataFrame:
    """seq, proof: the sibling hashes (hex, leaf level first) that connect each wanted row to the root."""
    return proofs_from_tiles(tiles(log, seq, data), wanted)


def proofs_from_tiles(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """seq, proof for each wanted seq. The wanted places travel to their tile, and only there, after the tile has met the proof of its own
    root, are proofs spelled out: no proof is shuffled but those of tiles, FAN times fewer a level. A missing sibling (an odd node moving up)
    adds nothing."""
    levels = (stored.agg(F.max("level")).first()[0] or 0) + 1
    above = None
    asked = wanted.groupBy(F.col("seq").cast("long").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    for level in range(levels - 1, -1, -1):
        df = stored.where(F.col("level") == level).select("tile", F.col("nodes").alias("n0"))
        if level == 0:
            places = asked.groupBy(F.shiftright("seq", FAN_BITS).alias("tile")).agg(
                F.collect_list(F.struct(F.col("seq").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("p"), "n")).alias("places"))
            df = df.join(places, "tile")
        else:
            df = df.withColumn("places", F.transform("n0", lambda _, p: F.struct(p.alias("p"), F.lit(1).cast("long").alias("n"))))
        if above is not None:
            df = df.join(above.select(F.col("at").alias("tile"), "proof"), "tile")
        else:
            df = df.withColumn("proof", F.array().cast("array<string>"))
        df = df.select("tile", "places", "proof", "n0")
        for i in range(1, FAN_BITS):
            df = df.withColumn(f"n{i}", _next_level(F.col(f"n{i - 1}")))
            df = df.select("tile", "places", "proof", *(f"n{k}" for k in range(i)), F.transform(f"n{i}", lambda x: x).alias(f"n{i}"))
        sibling = lambda p: F.array_compact(F.array(*[F.lower(F.hex(F.get(f"n{i}", F.shiftright(p, i).bitwiseXOR(F.lit(1)).cast("int")))) for i in range(FAN_BITS)]))
        spelled = F.transform(F.filter("places", lambda w: w["p"] < F.size("n0")), lambda w: F.struct(w["p"].alias("p"), w["n"].alias("n"), sibling(w["p"]).alias("part")))
        parts = df.select("tile", "proof", F.explode(spelled).alias("w"))
        above = parts.select((F.col("tile") * FAN + F.col("w.p")).alias("at"), F.concat("w.part", "proof").alias("proof"), F.col("w.n").alias("n"))
    return above.select(F.col("at").alias("seq"), "proof", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("seq", "proof")


def prefix_ranges(old: int, new: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(proof, head): the runs of leaves whose roots prove that the first ``old`` of ``new`` leaves are a prefix, in proof order, and those
    whose roots make up the root of the first ``old``, left to right. Every run is a whole subtree of the ``new`` leaves."""
    proof, head = [], []
    start, end, known = 0, new, True  # known: the verifier has this subtree's root, as it is the old tree itself
    while old - start < end - start:
        half = 1 << (end - start - 1).bit_length() - 1
        if old <= start + half:
            proof.append((start + half, end))
            end = start + half
        else:
            proof.append((start, start + half))
            start, known = start + half, False
    if not known:
        proof.append((start, end))
    at = 0
    for bit in range(old.bit_length() - 1, -1, -1):
        if old >> bit & 1:
            head.append((at, at + (1 << bit)))
            at += 1 << bit
    return proof[::-1], head


def consistency_proofs(stored: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """old_size, proof (hex array), old_root (hex): for each size in ``heads`` (old_size, between 1 and ``size``) the O(log n) hashes that
    prove the tree of ``size`` leaves extends the tree of the first old_size, and that tree's root.

    Each hash is the root of a run of nodes inside one tile. Many heads ask for the same runs, so the different runs of a tile are listed
    first, at most two for each of its nodes; a tile is folded once for them, and the heads join the hashes alone.
    """
    fan, bits = FAN, FAN_BITS

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for old in batch.column(0).to_pylist():
                if old is None or not 0 < old <= size:
                    continue
                for kind, ranges in enumerate(prefix_ranges(old, size)):
                    for place, (a, b) in enumerate(ranges):
                        level = max((b - a - 1).bit_length() - 1, 0) // bits  # the run is some nodes of one tile there
                        cover = fan ** level
                        for column, value in zip(out, (old, kind, place, level, a // cover // fan, a // cover % fan, -(-(b - a) // cover))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["old_size", "kind", "place", "level", "tile", "first", "n"])

    asked = heads.select(F.col("old_size").cast("long").alias("old_size")).distinct().mapInArrow(
        run, "old_size long, kind long, place long, level long, tile long, first long, n long")
    runs = asked.groupBy("level", "tile").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    df = runs.join(stored.withColumn("level", F.col("level").cast("long")), ["level", "tile"]).select("level", "tile", "runs", F.col("nodes").alias("n0"))
    for i in range(1, FAN_BITS + 1):
        df = df.withColumn(f"n{i}", _next_level(F.col(f"n{i - 1}")))
        df = df.select("level", "tile", "runs", *(f"n{k}" for k in range(i)), F.transform(f"n{i}", lambda x: x).alias(f"n{i}"))
    # a run is a whole subtree, so its root is the node above its first one, as many levels up as halve its length to one
    root_of = lambda r: F.coalesce(*[F.when(r["n"] <= 1 << i, F.get(f"n{i}", F.shiftright(r["first"], i).cast("int"))) for i in range(FAN_BITS + 1)])
    roots = df.select("level", "tile", F.explode(F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n"), root_of(r).alias("h")))).alias("r"))
    df = asked.join(roots.select("level", "tile", "r.first", "r.n", "r.h"), ["level", "tile", "first", "n"])
    listed = df.groupBy("old_size").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "h"))).alias("l"))
    part = lambda kind: F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["h"])
    root = F.aggregate(F.reverse(part(1)), F.lit(None).cast("binary"), lambda r, h: F.when(r.isNull(), h).otherwise(node_hash(h, r)))
    return listed.select("old_size", F.transform(part(0), lambda h: F.lower(F.hex(h))).alias("proof"), F.lower(F.hex(root)).alias("old_root"))


def extends(old_size: int, new_size: int, proof: list[str], old_root: str, new_root: str) -> bool:
    """Whether a proof shows that the tree with ``new_root`` extends the one with ``old_root``: both roots are rebuilt from its hashes.
    The bits of the last old place tell on which side each hash stands; one on the left belongs to both trees, one on the right to the new."""
    if not 0 < old_size <= new_size:
        return False
    if old_size == new_size:
        return not proof and old_root == new_root
    def node(a, b):
        return hashlib.sha256(b"\x01" + a + b).digest()
    left = [bytes.fromhex(h) for h in proof]
    at, last = old_size - 1, new_size - 1
    whole = (~at & at + 1).bit_length() - 1  # the old tree's last subtree that is whole
    at, last = at >> whole, last >> whole
    if at:
        if not left:
            return False
        old = new = left.pop(0)
    else:
        old = new = bytes.fromhex(old_root)
    for h in left:
        while not at & 1 and at == last and at:  # no node to the right: moves up as it is
            at, last = at >> 1, last >> 1
        if not last:
            return False
        if at & 1:
            old, new = node(h, old), node(h, new)
        else:
            new = node(new, h)
        at, last = at >> 1, last >> 1
    return last == 0 and old.hex() == old_root and new.hex() == new_root


def verify_consistency(proofs: DataFrame, size: int, root: str) -> DataFrame:
    """proofs (old_size, proof, old_root) with ``consistent``: whether each proves that the tree of ``size`` leaves and ``root`` extends it."""
    @F.arrow_udf("boolean")
    def check(old_size: pa.Array, proof: pa.Array, old_root: pa.Array) -> pa.Array:
        return pa.array([extends(m, size, p, r, root) for m, p, r in zip(*(x.to_pylist() for x in (old_size, proof, old_root)))], pa.bool_())
    return proofs.withColumn("consistent", check("old_size", "proof", "old_root"))


def verify_inclusion(proofs: DataFrame, size: int) -> DataFrame:
    """seq, root (hex) each proof leads to. proofs: seq, leaf (binary), proof (hex array).

    At the last node of a level without a sibling the path moves up unchanged.
    """
    start = F.struct(F.col("seq").cast("long").alias("at"), F.lit(size - 1).cast("long").alias("last"), F.col("leaf").alias("h"), F.col("proof").alias("left"))

    def step(acc, _):
        lone = (acc["at"] == acc["last"]) & (acc["at"].bitwiseAND(F.lit(1)) == 0)
        other = F.unhex(F.get(acc["left"], F.lit(0)))
        joined = F.when(acc["at"].bitwiseAND(F.lit(1)) == 1, node_hash(other, acc["h"])).otherwise(node_hash(acc["h"], other))
        return F.struct(F.shiftrightunsigned(acc["at"], 1).alias("at"), F.shiftrightunsigned(acc["last"], 1).alias("last"),
                        F.when(lone, acc["h"]).otherwise(joined).alias("h"),
                        F.when(lone, acc["left"]).otherwise(F.slice(acc["left"], F.lit(2), F.greatest(F.size(acc["left"]), F.lit(1)))).alias("left"))
    levels = max(0, (size - 1).bit_length())
    if levels == 0:
        return proofs.select("seq", F.lower(F.hex("leaf")).alias("root"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step)
    return proofs.select("seq", F.lower(F.hex(end["h"])).alias("root"))


def prefix_consistent(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: old_size, new_size, missing, consistent. Every (seq, data) of the old log must be in the new one."""
    missing = old.select("seq", "data").join(new.select("seq", "data"), ["seq", "data"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    sizes = old.agg(F.count(F.lit(1)).alias("old_size")).join(F.broadcast(new.agg(F.count(F.lit(1)).alias("new_size"))))
    return sizes.join(F.broadcast(missing)).withColumn("consistent", (F.col("missing") == 0) & (F.col("old_size") <= F.col("new_size")))


def verify_log(log: DataFrame) -> DataFrame:
    """seq, problem: rows whose recomputed id or leaf differs from the recorded one; redacted rows keep only their leaf.

    log: seq, data, recorded_id, recorded_leaf (hex), redacted.
    """
    problem = F.when(~F.col("redacted") & (F.sha2("data", 256) != F.col("recorded_id")), "id differs").when(
        ~F.col("redacted") & (F.lower(F.hex(leaf_hash(F.col("data")))) != F.col("recorded_leaf")), "leaf differs")
    return log.withColumn("problem", problem).where("problem IS NOT NULL").select("seq", "problem")
