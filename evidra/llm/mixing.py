"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import word_count

SLOTS = 64  # parts of each (source, size class), so that no source or group of equal sizes is ranked in one task


def _source_key(source: Column) -> Column:
    """Never null, and ordered as the sources are: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def size_class(size: Column) -> Column:
    """Sizes within about 6 % of each other share a class: the leading five bits and their place."""
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    return F.expr("0").cast("long") + shift.cast("long") * 16 + F.call_function("shiftright", size, shift)


def slot_of(key: Column) -> Column:
    digest = F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("long") % SLOTS


def random_offset(seed: int, key: Column) -> Column:
    """One draw from [0, 1) for each source, the same in every run."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), key), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def apportion(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (g, source_size), one row per source -> also ``target``.

    The weights repeat over the sources in the order of ``g`` and share ``share`` times the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight until none is above: sources sorted by
    cap / weight are filled from below, and the level that the rest share follows from two running sums, without iterating.
    The windows run over one row per source.
    """
    n = F.row_number().over(Window.orderBy("g")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "g")
    rows = (sources.withColumn("w", weight)
            .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
            .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
            .withColumn("cap_before", F.sum("cap").over(filled) - F.col("cap"))
            .withColumn("w_left", F.sum("w").over(everything) - F.sum("w").over(filled) + F.col("w"))
            .withColumn("full", F.col("cap") / F.col("w") <= (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
            .withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
            .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))))
    return rows.select("g", "source_size", F.when(F.col("full"), F.col("cap"))
                       .otherwise(F.col("w") * F.col("left") / F.col("w_open")).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
        key: str = "doc_id", source: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """How many copies of each document a mix of sources takes.

    Returns ``row`` (the columns ``carry`` of the input row, or all, as a struct, so no column name can clash), ``size`` (words), ``source_size``,
    ``target`` and ``copies``. Every document of a source has the same expected copies, target / source_size. Documents stand
    in a line by size class (largest first), slot and key; the prefix sum of expected copies plus one random offset per source
    crosses an integer once for each copy. Sizes in order make the sum of words taken follow the target closely.

    The prefix sum has two levels: counts of the few (source, class, slot) groups are summed per source, and a row only adds its
    rank in its own group. A null text has size 0, a null source is a source of its own, a null key ranks first; equal keys
    count separately. No rows: no rows. A source without words has target 0 and takes nothing.
    """
    slim = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(key).alias("k"), _source_key(F.col(source)).alias("g"),
                       word_count(F.col(text)).alias("size"))
    slim = slim.withColumn("cls", size_class(F.col("size"))).withColumn("slot", slot_of(F.col("k")))
    cells = slim.groupBy("g", "cls", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = apportion(cells.groupBy("g").agg(F.sum("words").alias("source_size")), weights, share, most)
    line = Window.partitionBy("g").orderBy(F.col("cls").desc(), "slot")
    before = (cells.withColumn("before", F.sum("n").over(line) - F.col("n")).drop("n", "words")
              .join(targets, "g")
              .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
              .withColumn("shift", random_offset(seed, F.col("g"))))
    rank = F.row_number().over(Window.partitionBy("g", "cls", "slot").orderBy("k", "size"))
    placed = slim.join(before, ["g", "cls", "slot"]).withColumn("rank", F.col("before") + rank)
    copies = (F.floor(F.col("rank") * F.col("rate") + F.col("shift"))
              - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("shift")))
    return placed.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row once for each copy taken, with the columns of ``docs``."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")
