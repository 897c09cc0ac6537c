"""Merkle manifest of a dataset: every row is a leaf, every group of rows a tree, and the trees' roots are the leaves of one more tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidra.session import cut

FAN = 8  # nodes that one parent digests
BLOCK = FAN ** 3  # nodes of one window partition, a whole number of runs
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def encoded(columns: list[Column]) -> Column:
    """One string for the values of a row: ``-`` for a null, else the length in UTF-8 bytes, ``:`` and the value. No two rows share it."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
                      for c in columns])


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(encoded(columns), 256))


def hex_text(digests: Column) -> Column:
    """Digests in binary, one after the other, as lowercase hex text."""
    return F.lower(F.hex(digests))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within ``g``, in order) and ``m`` (rows of ``g``). The rows are cut into ranges of (g, order), ranges
    are counted, and each counts on from those before it, so that a group may hold any share of all rows."""
    dealt = cut(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("g").orderBy("part")
    starts = counts.select("g", "part", (F.sum("n").over(line) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("m"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    return dealt.join(starts, ["g", "part"]).withColumn("pos", F.col("before") + inside - 1).drop("part", "before")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, pos, m, h) with ``step``, the digests ``before`` and ``after`` the node in its run (none if it is alone in ``g``), and
    at the first node of each run ``parent``; a node that is alone goes up as it is. Lag and lead at fixed offsets look over a block of
    runs; the slot in the run and the length of the run say which of them count."""
    line = Window.partitionBy("g", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.pmod("pos", F.lit(FAN))
    run = F.least(F.lit(FAN), F.col("m") - F.col("pos") + slot)
    none = F.lit(b"")
    left = [F.when(slot >= j, F.lag("h", j).over(line)).otherwise(none) for j in range(FAN - 1, 0, -1)]
    right = [F.when(slot + j < run, F.lead("h", j).over(line)).otherwise(none) for j in range(1, FAN)]
    out = nodes.withColumns({"before": F.concat(*left), "after": F.concat(*right)})
    alone = F.col("m") == 1
    return out.withColumns({
        "parent": F.when(alone, F.col("h")).when(slot == 0, F.unhex(F.sha2(hex_text(F.concat("h", "after")), 256))),
        "step": F.when(alone, F.array().cast(PATH)).otherwise(F.array(F.struct("before", "after")))}).drop("before", "after")


def grown(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every level with their siblings, and (g, h): the last node of each group. The number of levels follows from the
    largest group; each is an eighth of the one below."""
    largest = max(leaves.agg(F.max("m")).first()[0] or 0, 2)
    nodes, tables = leaves, []
    while largest > 1:
        tables.append(cut(with_siblings(nodes)))
        nodes = (tables[-1].filter(F.col("parent").isNotNull())
                 .select("g", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("m") / FAN).alias("m"), F.col("parent").alias("h")))
        largest = -(-largest // FAN)
    return tables, nodes.select("g", "h")


def with_paths(tables: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of the lowest nodes, ``path`` (their siblings level by level to the last node of the group, then that node's
    own path) and the other columns of ``tops`` (g, path, ...). On the way down eight children at most meet one parent."""
    kept = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for level in range(len(tables) - 1, -1, -1):
        up = above.withColumnsRenamed({"g": "up_g", "pos": "up_pos"})
        found = tables[level].join(up, (F.col("g") == F.col("up_g")) & (F.floor(F.col("pos") / FAN) == F.col("up_pos")))
        above = found.select(*(["g", "pos"] if level else carry), F.concat("step", "path").alias("path"), *kept)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (binary) leads to along a path of siblings."""
    return F.aggregate(path, hex_text(leaf), lambda h, s: F.sha2(F.concat(hex_text(s["before"]), h, hex_text(s["after"])), 256))


def siblings_text(path: Column) -> Column:
    """All sibling digests of a path as hex text, left to right and upwards."""
    return F.array_join(F.transform(path, lambda s: hex_text(F.concat(s["before"], s["after"]))), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """The membership proof of every row.

    Returns ``row`` (the key and the columns of ``docs`` that are not digested, as a struct), and in binary ``leaf``, ``subroot`` (of
    its group) and ``root`` (of the dataset), and ``path``: for each level from the leaf to the root the digests ``before`` and
    ``after`` the node in its run. A leaf is the SHA-256 of the row's ``encoded`` columns. Within a group leaves stand by key, and every
    ``FAN`` consecutive nodes, or the fewer at the end, become the SHA-256 of their digests in hex, until one is left. The groups'
    last nodes, null first and then by UTF-8 bytes, go on likewise to the root.

    Nulls are encoded as such, empty texts as ``0:``; a null key stands first. Rows that share a key stand by leaf; equal rows are
    leaves each, with a path each. A group of one row has its leaf as subroot. Other columns of the input are not digested. No
    rows: no rows. Texts are read once and never shuffled; digests travel, and each level is an eighth of the one below.
    """
    aside = [c for c in docs.columns if c == key or c not in columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in aside]).alias("row"), F.col(key).alias("k"),
                       F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"),
                       leaf_digest([F.col(c) for c in columns]).alias("h"))
    tables, tops = grown(cut(numbered(cut(rows), ["k", "h"])))
    over_tables, over = grown(cut(numbered(tops.select(F.col("g").alias("group"), F.lit("").alias("g"), "h"), ["group"])))
    groups = with_paths(over_tables, over.select("g", F.array().cast(PATH).alias("path"), F.col("h").alias("root")), ["group", "h"])
    tops = cut(groups.select(F.col("group").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    return with_paths(tables, tops, ["row", F.col("h").alias("leaf")])
