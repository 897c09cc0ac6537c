"""Batch forms of the streaming behaviours, over one activity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENCE_SECONDS, REPEAT_SECONDS, HEARTBEAT_SECONDS, GRACE_SECONDS = 900, 10, 300, 600


def last_seen(events: DataFrame, now: Column, expire: int = PRESENCE_SECONDS) -> DataFrame:
    """actor, at, doing, topic, online: latest state per actor; the latest known topic is carried forward.

    events: actor, at (timestamp), seq, doing, topic (nullable).
    """
    out = events.groupBy("actor").agg(F.max(F.struct("at", "seq", "doing")).alias("m"), F.max(F.when(F.col("topic").isNotNull(), F.struct("at", "seq", "topic"))).alias("t"))
    return out.select("actor", "m.at", "m.doing", "t.topic", (F.unix_seconds(now) - F.unix_seconds("m.at") < expire).alias("online"))


def feed_tail(events: DataFrame, n: int) -> DataFrame:
    """The newest n events by their strictly increasing sequence number."""
    return events.orderBy(F.desc("seq")).limit(n)


def dedup_intake(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first delivery of every submission id."""
    rest = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_r"))).alias("f"), F.count(F.lit(1)).alias("deliveries"))
    return first.select(key, "f._r.*", "deliveries")


def minute_load(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """start, n, errors, actors per window."""
    win = F.window("at", width, slide) if slide else F.window("at", width)
    return (events.groupBy(win).agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.approx_count_distinct("actor").alias("actors"))
            .select(F.col("window.start").alias("start"), "n", "errors", "actors"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """actor, start, end, n: runs of activity without a gap of ``gap_seconds``. One aggregation, no per-actor window."""
    return (events.groupBy("actor", F.session_window("at", f"{gap_seconds} seconds")).agg(F.count(F.lit(1)).alias("n"))
            .select("actor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"))


def heartbeat(events: DataFrame, now: Column, alive: int = HEARTBEAT_SECONDS) -> DataFrame:
    return events.groupBy("actor").agg(F.max("at").alias("at")).withColumn("online", F.unix_seconds(now) - F.unix_seconds("at") < alive)


def suppress_repeats(events: DataFrame, within: int = REPEAT_SECONDS) -> DataFrame:
    """Drop an event whose actor, state and topic are those last shown less than ``within`` seconds ago. A dropped event does not restart
    the clock, so steady activity shows again every ``within`` seconds. A missing topic means the actor's latest known one.

    Hot actors are spread over days: what a day needs from the days before (last event, last topic, start of the running burst) comes
    from one row per actor and day. Events of one state with gaps under ``within`` form a burst, whose first event is always shown; only
    inside a burst is the rule applied in order, row by row over sorted partitions, so that no burst is held whole. events: actor, at, seq, doing, topic.
    """
    rows = events.withColumn("_d", F.floor(F.unix_seconds("at") / 86400))
    in_day = Window.partitionBy("actor", "_d").orderBy("at", "seq")
    before = Window.partitionBy("actor").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    last_topic = F.max(F.when(F.col("topic").isNotNull(), F.struct("at", "seq", "topic")))["topic"]
    days = (rows.groupBy("actor", "_d").agg(F.max(F.struct("at", "seq", "doing")).alias("_l"), last_topic.alias("_t"))
            .select("actor", "_d", F.last("_l").over(before).alias("_l"), F.last("_t", ignorenulls=True).over(before).alias("_t")))
    rows = rows.join(days, ["actor", "_d"]).withColumn("_topic", F.coalesce(F.last("topic", ignorenulls=True).over(in_day), "_t"))
    shown = F.struct("at", "doing", F.col("_topic").alias("topic"))
    rows = rows.withColumn("_p", F.coalesce(F.lag(shown).over(in_day), F.when(F.col("_l").isNotNull(), F.struct("_l.at", "_l.doing", F.col("_t").alias("topic")))))
    span = F.lit(within * 1_000_000)
    fresh = (F.col("_p").isNull() | ~F.col("_p.doing").eqNullSafe(F.col("doing")) | ~F.col("_p.topic").eqNullSafe(F.col("_topic"))
             | (F.unix_micros("at") - F.unix_micros("_p.at") >= span))
    rows = rows.withColumn("_f", F.when(fresh, F.struct("at", "seq")))
    starts = (rows.groupBy("actor", "_d").agg(F.max("_f").alias("_s")).select("actor", "_d", F.last("_s", ignorenulls=True).over(before).alias("_s")))
    rows = rows.join(starts, ["actor", "_d"]).withColumn("_burst", F.coalesce(F.last("_f", ignorenulls=True).over(in_day), "_s"))
    ordered = (rows.select(*events.columns, F.unix_micros("at").alias("_us"), F.unix_micros("_burst.at").alias("_b"), F.col("_burst.seq").alias("_q"))
               .repartition("actor", "_b", "_q").sortWithinPartitions("actor", "_b", "_q", "_us", "seq", *events.columns))
    width, limit = len(events.columns), within * 1_000_000

    def show(batches):
        import pyarrow as pa
        burst, told = None, None
        for batch in batches:
            keep = []
            actors = batch.column(batch.schema.get_field_index("actor")).to_pylist()
            for us, *key in zip(batch.column(width).to_pylist(), actors, *(batch.column(width + i).to_pylist() for i in (1, 2))):
                new = key != burst or us - told >= limit
                if new:
                    burst, told = key, us
                keep.append(new)
            yield batch.select(list(range(width))).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(show, events.schema)
