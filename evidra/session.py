"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, app: str = "evidra", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own session."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("EVIDRA_DRIVER_MEMORY", "12g"))
               .config("spark.sql.shuffle.partitions", "8")
               # small test tables: keep every core busy instead of merging shuffle partitions up to 1 MB
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
               # the sample tables have one row group each, which one task would read: deal their texts out
               .config("spark.evidra.spreadTexts", "true"))
    if "EVIDRA_CHECKPOINT_DIR" in os.environ:  # tests, bench and tools name a folder of this machine; nothing else has a default
        builder = builder.config("spark.checkpoint.dir", os.environ["EVIDRA_CHECKPOINT_DIR"])
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``, which every executor must reach."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so an iterative plan stays short and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the reliable checkpoint folder and read again. Unlike a checkpoint, whose size Spark still guesses from the
    plan behind it, the table has the size of its files; in a loop of joins such guesses multiply until planning itself takes minutes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete what ``stored`` wrote, through the file system that holds it; for rounds of a loop that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = sc._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out over all cores where the session asks for it (``local_session`` does, a cluster's own session does not)."""
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get("spark.evidra.spreadTexts", "false") == "true" else df


TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, of: Sequence[DataFrame] = ()) -> DataFrame:
    """``df`` dealt by keys over as many tasks as give each about TASK_ROWS rows, so what a task sorts or groups does not grow with the input.

    of: what ``df`` is made of, counted in its place where counting ``df`` would do its work twice.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-sum(x.count() for x in of or (df,)) // TASK_ROWS)), *keys)
