"""Document fingerprints: bottom-k sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, WORDS = 256, 5
ROWS_PER_BUCKET, MOST_BUCKETS = 512, 4096


def with_sketch(rows: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Add ``out``: the ``k`` smallest distinct 64-bit hashes of the text's word shingles, ascending.

    A shingle is a run of ``words`` lower-cased words (letters, digits, underscores). A text of fewer words is one shingle of all
    it has; a text without words, or null, has none. Equal texts have equal sketches. Two columns are added and dropped again:
    ``out`` with ``_words`` and ``_starts`` behind it.
    """
    w, starts = f"{out}_words", f"{out}_starts"
    found = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)[^\w]+", -1), lambda x: x != "")
    n = F.size(w)
    runs = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(w), i, words)))
    return (rows.withColumn(w, found).withColumn(starts, runs)
            .withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(w, starts))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches: the share of the k smallest hashes of the union that both hold. Exact while
    the union has at most ``k`` shingles; two empty sketches are alike (1)."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) / (k-th hash as a share of the hash range)."""
    share = (F.element_at(F.col(a), -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds too (1 for an empty ``a``)."""
    j = resemblance(a, b, k)
    both = j / (j + 1.0) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_sketches(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: the k smallest distinct hashes of its parts' sketches. Spark limits each group to k rows
    before the shuffle."""
    rows = parts.select(*by, F.explode(sketch).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    kept = rows.withColumn("r", rank).filter(F.col("r") <= k)
    merged = kept.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    empty = parts.select(*by).distinct()
    none = F.array().cast("array<bigint>")
    same = [empty[c].eqNullSafe(merged[c]) for c in by]
    return empty.join(merged, same, "left").select(*[empty[c] for c in by], F.coalesce(merged[sketch], none).alias(sketch))


def as_text(sketch: str) -> Column:
    """16 hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, body, next_body): each document with the one after it by ascending key; the first one follows the last.

    Null keys come first, equal keys go by text, a null text is empty; a single document follows itself. The order is cut into at
    most ``MOST_BUCKETS`` key ranges of about equal size, so no task sorts everything; the last row of a range takes the first row
    of the next one, which comes from a table of one row per range. Each text is shuffled once.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    n = min(MOST_BUCKETS, rows.count() // ROWS_PER_BUCKET + 1)
    bounds = [int(b) for b in sorted(set(rows.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)))] if n > 1 else []
    bucket = F.size(F.filter(F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>"),
                             lambda b: b <= F.col("k")))
    rows = rows.withColumn("bucket", F.when(F.col("k").isNull(), F.lit(0)).otherwise(bucket))
    # one row per range: its smallest key, and whether that is a null
    first = rows.groupBy("bucket").agg(F.min("k").alias("lo"), F.bool_or(F.col("k").isNull()).alias("has_null"))
    first = first.withColumn("lo", F.when(~F.col("has_null"), F.col("lo")))
    chain = Window.orderBy("bucket")
    everything = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = first.select(
        F.col("bucket").alias("from_bucket"),
        F.coalesce(F.lead("bucket").over(chain), F.min("bucket").over(everything)).alias("to_bucket"),
        F.when(F.lead("bucket").over(chain).isNotNull(), F.lead("lo").over(chain)).otherwise(F.first("lo").over(everything)).alias("lo"))
    heads = (rows.join(F.broadcast(step), (rows["bucket"] == step["to_bucket"]) & rows["k"].eqNullSafe(step["lo"]))  # <= MOST_BUCKETS rows
             .groupBy("from_bucket").agg(F.min("body").alias("head")))
    following = F.lead("body").over(Window.partitionBy("bucket").orderBy("k", "body"))
    return (rows.withColumn("following", following).join(heads, F.col("bucket") == F.col("from_bucket"), "left")
            .select("k", "body", F.coalesce("following", "head").alias("next_body")))


def fingerprint_edits(docs: DataFrame, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half (rounded down) is the start of the next document."""
    rows = with_next(docs, key, text)
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("body", F.lit(1), n - half), F.substr("next_body", F.lit(1), half)))
    for column, out in (("body", "own"), ("edited", "other"), ("next_body", "following")):
        rows = with_sketch(rows, column, out, k)
    return rows.select(
        F.col("k").alias("doc_id"), F.char_length("body").cast("long").alias("n_chars"),
        F.sha2(F.encode(F.col("edited"), "UTF-8"), 256).alias("edited_sha256"), as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"), resemblance("own", "other", k).alias("near_edited"),
        resemblance("own", "following", k).alias("near_next"))
