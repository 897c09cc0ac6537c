"""Line dedup on levelled runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidra.session import cut

from .common import hash_pair, line_key, remove_folder, shared_folder, slot_text

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3


def lines_of(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, batches: int, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, k, t, h1, h2, pos, fresh): every long line of every document with the 128 bits of its key and its place; ``t`` is a hash of the
    text, ``fresh`` marks one of equal lines of a document."""
    keyed = F.transform(lines_of(F.col(text)), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    keyed = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)

    def hashed(x):
        h1, h2 = hash_pair(x["key"])
        return F.struct(h1.alias("h1"), h2.alias("h2"), x["pos"].alias("pos"))

    rows = docs.select(slot_text(F.col(key), batches).cast("int").alias("batch"), F.col(key).alias("k"), F.xxhash64(text).alias("t"),
                       F.array_sort(F.transform(keyed, hashed)).alias("found")).filter(F.size("found") > 0)
    before = lambda i: F.get(F.col("found"), i - 1)
    marked = F.transform("found", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
                                                        ((i == 0) | (x["h1"] != before(i)["h1"]) | (x["h2"] != before(i)["h2"])).alias("fresh")))
    return rows.select("batch", "k", "t", F.inline(marked))


class LineRuns:
    """Runs of (h1, h2, n_docs, last), each sorted by hash and dealt into the same buckets, in levels: ``fanout`` runs of a level merge
    into one of the next.

    Every hash lives in one run, that of the batch which brought it first: a batch meets the runs bucket by bucket in merge anti-joins,
    without moving them, and what they leave over is its own run. Hashes that a run knows already are noted as ``hits``, to be added to the
    run's counts. Every hash is rewritten once per level, so n batches cost n log(n) in writes and a batch meets at most
    ``fanout - 1`` runs a level. Runs are bucketed Parquet tables in the shared folder, so a lost executor loses none.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.folder = spark, fanout, shared_folder(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self.added: list[int] = []
        self.prefix, self.written = f"line_run_{uuid.uuid4().hex[:12]}", 0

    def _write(self, run: DataFrame, level: int) -> str:
        name, self.written = f"{self.prefix}_{self.written}", self.written + 1
        (run.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (h1, h2, k; one row a document and line), then compact the levels that are full."""
        batch = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("k").alias("last")))
        new = batch
        for name in self.runs():
            new = new.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        known = bool(self.runs())
        own = self.spark.table(self._write(new, 0))
        self.added.append(own.count())
        if known:
            path = f"{self.folder}/hits{len(self.hits)}"
            batch.join(own.select("h1", "h2"), ["h1", "h2"], "left_anti").write.parquet(path)
            self.hits.append(path)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            together = self.spark.table(old[0])
            for name in old[1:]:
                together = together.unionByName(self.spark.table(name))
            self._write(together, level + 1)
            for name in old:
                self._drop(name)
            level += 1

    def totals(self) -> DataFrame:
        """One row per line hash: documents that hold it, and the largest key among them."""
        rows = None
        for part in [*map(self.spark.table, self.runs()), *map(self.spark.read.parquet, self.hits)]:
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def remove(self) -> None:
        """Delete all runs and hits."""
        for name in self.runs():
            self._drop(name)
        remove_folder(self.spark, self.folder)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the lines that others repeat.

    Returns ``row`` (the input row as a struct), ``n_lines`` (before), ``n_dropped`` and ``kept`` (the other lines, joined). The
    key of a line is the line stripped of ASCII white space with A-Z lower-cased; keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents stay only in the largest document key that holds them, there in every place. The documents
    come in ``batches`` by a hash of their key; each meets the runs in merge anti-joins and adds its own. A line is judged when all are
    in, from the hashes written in the first pass: only then are its count and the last document that holds it known.

    A null or empty text is one empty line. A null document key ranks below all others; rows that share a key are documents of
    their own when counting, and each loses its own lines. No rows: no rows. Texts are read twice, for their hashes and to be
    rewritten; they move once, to meet the list of places to drop. A very common line is one row per task after partial
    aggregation; where lines meet the totals, adaptive execution splits it.
    """
    lines = cut(long_lines(docs, batches, key, text, min_chars))
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        runs.add(lines.filter((F.col("batch") == b) & F.col("fresh")).select("h1", "h2", "k"))
    stop = runs.totals().filter(F.col("n_docs") >= min_docs)
    earlier = F.coalesce(F.col("k") < F.col("last"), F.col("k").isNull() & F.col("last").isNotNull())
    drop = cut(lines.select("k", "t", "h1", "h2", "pos").join(stop, ["h1", "h2"]).filter(earlier)
               .groupBy("k", "t").agg(F.sort_array(F.collect_set("pos")).alias("drop")))
    runs.remove()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    rows = (rows.join(drop, rows["key"].eqNullSafe(drop["k"]) & (rows["hash"] == drop["t"]), "left")
            .select("row", "drop", F.coalesce(F.col("row")[text], F.lit("")).alias("body")))
    lines, first = lines_of(F.col("body")), F.array(F.lit(0))
    between = F.arrays_zip(F.concat(first, F.transform("drop", lambda p: p + 1)).alias("a"), F.concat("drop", F.array(F.size(lines))).alias("b"))
    left = F.flatten(F.transform(between, lambda z: F.slice(F.col("lines"), z["a"] + 1, z["b"] - z["a"])))
    rows = rows.withColumn("lines", F.when(F.col("drop").isNotNull(), lines)).withColumn("left", F.when(F.col("drop").isNotNull(), left))
    n_lines = F.char_length("body") - F.char_length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))) + 1
    return rows.select("row", n_lines.cast("long").alias("n_lines"),
                       F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
                       F.when(F.col("drop").isNull(), F.col("body")).otherwise(F.array_join("left", "\n")).alias("kept"))


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept text in ``text`` and its length in ``n_chars`` (where there is such a column); a document that
    loses nothing stays as it is."""
    out = dedup_lines(docs, **options)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`")
                        for c in docs.columns])
