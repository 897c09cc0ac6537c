from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import activity as A

from .registry import query


def events(t):
    return t.events.select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("doing"),
                           F.when(F.col("value") > 60, F.floor("value").cast("string")).alias("topic"), (F.col("event_type") == "error").alias("error"))


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


NOW = "TIMESTAMP '2024-01-30 23:30:00'"


@query("last_seen", f"""SELECT user_id AS actor, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(event_type, row(ts, event_id)) AS doing,
  coalesce(arg_max(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), row(ts, event_id)) FILTER (value > 60), '') AS topic, floor(epoch({NOW})) - floor(epoch(max(ts))) < 7200 AS online FROM events GROUP BY 1""".replace("AS at,", 'AS "at",'))
def last_seen(t):
    out = A.last_seen(events(t), F.to_timestamp(F.lit("2024-01-30 23:30:00")), 7200)
    return out.select("actor", stamp("at").alias("at"), "doing", F.coalesce("topic", F.lit("")).alias("topic"), "online")


@query("feed_tail", """SELECT event_id AS seq, user_id AS actor, event_type AS doing FROM events ORDER BY event_id DESC LIMIT 400""")
def feed_tail(t):
    return A.feed_tail(events(t).select("seq", "actor", "doing"), 400)


@query("dedup_intake", """SELECT user_id, k, min(event_id) AS event_id, CAST(count(*) AS BIGINT) AS deliveries FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id, k""")
def dedup_intake(t):
    rows = t.events.select(F.struct("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("id"), "event_id")
    return A.dedup_intake(rows, "id", F.col("event_id")).select("id.user_id", "id.k", "event_id", "deliveries")


@query("minute_load", """SELECT strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1""")
def minute_load(t):
    return A.minute_load(events(t)).select(stamp("start").alias("start"), "n", "errors")


@query("activity_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS actor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S') AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def activity_sessions(t):
    return A.sessions(events(t), 3600).select("actor", stamp("start").alias("start"), stamp("end").alias("end"), "n")


@query("suppressed_feed", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN value > 60 THEN floor(value) END AS topic,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, n, event_id, ts AS told, event_type AS doing, topic, true AS shown FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN shown THEN now_at ELSE told END, CASE WHEN shown THEN now_doing ELSE doing END, CASE WHEN shown THEN now_topic ELSE topic END, shown FROM (
    SELECT e.user_id, e.n, e.event_id, s.told, s.doing, s.topic, e.ts AS now_at, e.event_type AS now_doing, coalesce(e.topic, s.topic) AS now_topic,
      NOT (s.doing = e.event_type AND coalesce(e.topic, s.topic) IS NOT DISTINCT FROM s.topic AND e.ts < s.told + INTERVAL 7200 SECOND) AS shown
    FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id AS seq FROM s WHERE shown""")
def suppressed_feed(t):
    return A.suppress_repeats(events(t), 7200).select("seq")
