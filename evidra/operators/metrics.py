"""Roll-ups: coverage, usage and spending, funnels, activity, researchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.quantiles import exact_quantile
from evidra.session import dealt


def coverage(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """metric, n: many conditional counts in one pass."""
    row = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in counts])).alias("m")).select("m.*")


def coverage_by(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """metric, n: one count for every value of a column that occurs."""
    return df.groupBy(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """task, model, calls, spent (actual where known, else reserved). calls: task, model, reserved, actual."""
    return calls.groupBy("task", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("actual", "reserved")).alias("spent"))


def spend_vs_cap(calls: DataFrame, unit: str, cap: float) -> DataFrame:
    """period, spent, over. calls: at, reserved, actual. unit: 'day' or 'month'."""
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]
    return (calls.groupBy(F.date_format("at", fmt).alias("period")).agg(F.sum(F.coalesce("actual", "reserved")).alias("spent"))
            .withColumn("over", F.col("spent") > cap))


def top_counts(df: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """by..., value, count, rank: most frequent values per group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*by).orderBy(F.desc("count"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def weighted_people(authors: DataFrame, n: int = 8) -> DataFrame:
    """topic, key, papers, weight, affiliation, latest, rank: researchers worth naming.

    First and last authors weigh 2, others 1; kept with two papers or weight 2. Key = surname and first initial.
    authors: topic, paper, pos, last_pos, surname, given, affiliation, year.
    """
    key = F.concat(F.lower("surname"), F.lit(" "), F.lower(F.substring("given", 1, 1)))
    weight = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("last_pos")), 2).otherwise(1)
    rows = dealt(authors.select("topic", key.alias("key"), "paper", "affiliation", "year", weight.alias("w")), "topic", "key")  # both groupings stay where they are
    base = (rows.groupBy("topic", "key").agg(F.countDistinct("paper").alias("papers"), F.sum("w").alias("weight"), F.max("year").alias("latest"))
            .where("papers >= 2 OR weight >= 2"))
    modal = (rows.where("affiliation <> ''").groupBy("topic", "key", "affiliation").agg(F.count(F.lit(1)).alias("n")).groupBy("topic", "key")
             .agg(F.min(F.struct((-F.col("n")).alias("neg"), "affiliation")).alias("m")).select("topic", "key", F.col("m.affiliation").alias("affiliation")))
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), F.desc("papers"), "key")
    return (base.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .join(modal, ["topic", "key"], "left").withColumn("affiliation", F.coalesce("affiliation", F.lit(""))))


def grants(projects: DataFrame) -> DataFrame:
    """core, n_records, years (sorted): one row per core project number. projects: number (type + core + suffix), core, year."""
    years = projects.select("core", "year").distinct().groupBy("core").agg(F.array_sort(F.collect_list("year")).alias("years"))  # calendar years
    return projects.groupBy("core").agg(F.count(F.lit(1)).alias("n_records")).join(years, "core")


def funnel(rows: DataFrame, by: str, steps: dict[str, Column]) -> DataFrame:
    return rows.groupBy(by).agg(*[F.count_if(c).alias(name) for name, c in steps.items()])


def progress_since(targets: DataFrame, findings: DataFrame, requests: DataFrame) -> DataFrame:
    """target, n_findings, n_requests since each target's own start. targets: target, started; findings, requests: target, at."""
    def counted(rows, name):
        return (rows.join(targets, "target").where("at >= started").groupBy("target").agg(F.count(F.lit(1)).alias(name)))
    return (targets.select("target").join(counted(findings, "n_findings"), "target", "left").join(counted(requests, "n_requests"), "target", "left")
            .na.fill(0, ["n_findings", "n_requests"]))


def counted_requests(requests: DataFrame, per_day: int = 10) -> DataFrame:
    """visitor, target, day: each target counts once per visitor, at most ``per_day`` a visitor and day. A request beyond that is refused
    and leaves no trace, so the same target counts on a later day on which it is asked for again.

    A visitor's requests are first reduced to one row per day and target; a small state machine then goes through the visitor's
    days. requests: visitor, target (string or long), at, seq.
    """
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    asked = requests.groupBy("visitor", day, "target").agg(F.min(F.struct("at", "seq")).alias("f")).select("visitor", "day", "target", "f.at", "f.seq")

    def admit(batches):
        import pyarrow as pa
        who, counted, today, left, first = None, set(), None, 0, True
        for batch in batches:
            keep = []
            for visitor, day, target in zip(*(batch.column(i).to_pylist() for i in (0, 2, 1))):
                if first or visitor != who:
                    who, counted, today, first = visitor, set(), None, False
                if day != today:
                    today, left = day, per_day
                new = left > 0 and target not in counted
                if new:
                    counted.add(target)
                    left -= 1
                keep.append(new)
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    ordered = asked.select("visitor", "target", "day", "at", "seq").repartition("visitor").sortWithinPartitions("visitor", "day", "at", "seq", "target")
    return ordered.mapInArrow(admit, asked.select("visitor", "target", "day").schema)


def distinct_requests(requests: DataFrame, per_day: int = 10) -> DataFrame:
    """target, n: distinct visitors whose request for the target counts (``counted_requests``)."""
    return counted_requests(requests, per_day).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, by: str) -> DataFrame:
    """by, n, errors, median, p95. rows: by, value, error."""
    base = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"))
    ok = rows.where(~F.col("error"))
    return (base.join(exact_quantile(ok, "value", 0.5, [by], name="median"), by, "left").join(exact_quantile(ok, "value", 0.95, [by], name="p95"), by, "left"))


def last_day(events: DataFrame) -> DataFrame:
    """actors, checks in the 24 hours up to the newest event. events: actor, at, is_check."""
    end = events.agg(F.max("at").alias("end"))
    recent = events.join(F.broadcast(end)).where(F.col("at") > F.col("end") - F.expr("INTERVAL 1 DAY"))
    return recent.agg(F.countDistinct(F.when(~F.col("is_check"), F.col("actor"))).alias("actors"), F.count_if("is_check").alias("checks"))
