"""Shared helpers: tables, native word and line expressions, and folders every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidra.session import ensure_checkpoint_dir

BLANK = " \t\n\x0b\x0c\r"  # the white space that the contracts name: [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hash_pair(value: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: together 128 bits, so that unequal values do not meet at any corpus size."""
    return [F.xxhash64(value), F.xxhash64(F.lit(7919), value)]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BATCH_BYTES = "4m"


def short_batches(df: DataFrame) -> DataFrame:
    """Have Spark hand texts to Python workers in batches of a few megabytes: a batch of 10,000 long texts would be held three times over, by
    the executor and by the worker. A value that the session has set itself stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)
    return df


def slices(batch, rows: int = 256):
    """An Arrow batch in short pieces, so that a worker holds few texts as Python strings at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


MOST_BROADCAST = 10_000  # rows


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most`` rows, else as it is; it is counted, so it should be cheap or written."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slot_text(key: Column, slots: int) -> Column:
    """A part number for each key from its text, the same for equal keys; null has one too."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots))
