"""Content-addressed archive, dataset fingerprints and canonical ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.pyudfs import nfc
from evidra.session import cut


def sha(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(columns: Sequence[str], texts: Sequence[str] = ()) -> Column:
    """One JSON text per row with the keys in sorted order and nulls kept; ``texts`` are the columns that may hold text beyond
    ASCII, which is composed first."""
    cells = [(nfc(F.col(c)) if c in texts else F.col(c)).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def content_id(prefix: str, columns: Sequence[str], texts: Sequence[str] = ()) -> Column:
    return F.concat(F.lit(f"{prefix}:"), sha(canonical_json(columns, texts)))


def archive(docs: DataFrame, canonical: Column) -> DataFrame:
    """source_id (hash of the canonical text), raw_hash and doc_id of the first copy, copies. Same content is kept once."""
    hashed = docs.select("doc_id", sha(F.col("text")).alias("raw_hash"), sha(canonical).alias("source_id"))
    return (hashed.groupBy("source_id").agg(F.min(F.struct("doc_id", "raw_hash")).alias("f"), F.count(F.lit(1)).alias("copies"))
            .select("source_id", "f.doc_id", "f.raw_hash", "copies"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, digest. The digest adds up 12 hash digits of every row, so it needs no order and no single task."""
    cells = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in cells])  # no two rows spell the same
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
    return df.select(part.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))


def write_archive(docs: DataFrame, canonical: Column, path: str) -> None:
    """Archive as parquet partitioned by the first hash byte, texts included. Content that is there already is not written again."""
    rows = docs.select("doc_id", F.col("text").alias("raw"), canonical.alias("text")).withColumn("source_id", sha(F.col("text")))
    first = rows.groupBy("source_id").agg(F.min_by(F.struct("doc_id", "raw", "text"), "doc_id").alias("f")).select("source_id", "f.*")
    first = first.withColumn("bucket", F.substring("source_id", 8, 2))
    try:
        there = docs.sparkSession.read.schema("source_id string, bucket string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        first = cut(first.join(there, ["bucket", "source_id"], "left_anti"))
    first.write.mode("append").partitionBy("bucket").parquet(path)
