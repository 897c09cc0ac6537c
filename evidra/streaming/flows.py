"""Streams made of built-in operators: intake, load, sessions, latest-wins folds, publication of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.vocab import model_family
from evidra.operators.activity import minute_load, sessions
from evidra.operators.review import review_status
from evidra.sources.publish import bundles, write_bundles


def intake(events: DataFrame, key: str, watermark: str = "1 day") -> DataFrame:
    """Each submission id once; a replay after a lost acknowledgement is dropped."""
    return events.withWatermark("at", watermark).dropDuplicatesWithinWatermark([key])


def load(events: DataFrame, width: str = "1 minute", watermark: str = "1 minute", slide: str | None = None) -> DataFrame:
    return minute_load(events.withWatermark("at", watermark), width, slide)


def activity_sessions(events: DataFrame, gap_seconds: int, watermark: str = "1 minute") -> DataFrame:
    return sessions(events.withWatermark("at", watermark), gap_seconds)


def latest_verdicts(reviews: DataFrame) -> DataFrame:
    """claim_id, family, reviewer_kind and the latest verdict; update mode. Combined map-side before each state update."""
    fam = model_family(F.col("model_family"))
    return (reviews.withColumn("model_family", F.when(fam == "", F.col("reviewer").cast("string")).otherwise(fam))
            .groupBy("claim_id", "model_family", "reviewer_kind").agg(F.max(F.struct("seq", "verdict", "reviewer")).alias("m"))
            .select("claim_id", "model_family", "reviewer_kind", "m.reviewer", "m.verdict", "m.seq"))


def latest_rechecks(rechecks: DataFrame) -> DataFrame:
    """claim_id, check and its latest result; update mode. A later recheck supersedes an earlier one."""
    return (rechecks.groupBy("claim_id", "check").agg(F.max(F.struct("seq", "result", "checked")).alias("m"))
            .select("claim_id", "check", "m.seq", "m.result", "m.checked"))


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder per batch, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """Review status from the folded verdicts: the log's latest row per claim and family gives the same answer as all reviews."""
    return review_status(spark.read.parquet(path))


def keep_feed_tail(path: str, n: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch leaves a folder with the newest n events up to and including it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.orderBy(F.desc("seq")).limit(n)
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{path}/upto={batch_id - 1}").select(*batch.columns)
            newest = newest.unionByName(before).orderBy(F.desc("seq")).limit(n)
        newest.write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
    return write


def publish_changes(state: Callable[[DataFrame], DataFrame], kind: str, key: str, columns: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: rebuild and overwrite only the shards that hold an entity touched by the batch.

    ``state(touched_shards)`` returns the current rows of every entity in the given shards (kind, shard).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        touched = bundles(batch.select(key).distinct(), kind, key, [key]).select("kind", "shard").distinct()
        write_bundles(bundles(state(touched), kind, key, columns), path, touched)
    return write
