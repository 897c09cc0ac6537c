from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import metrics as M
from evidra.session import dealt

from .registry import query
from .shared import r4


@query("coverage_report", """SELECT 'customers' AS metric, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'in_debt', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'nations', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT concat('segment ', c_mktsegment), count(*) FROM customer GROUP BY c_mktsegment""")
def coverage_report(t):
    counts = {"customers": F.count(F.lit(1)), "in_debt": F.count_if(F.col("c_acctbal") < 0), "nations": F.countDistinct("c_nationkey")}
    return M.coverage(t.customer, counts).unionByName(M.coverage_by(t.customer, "c_mktsegment", "segment "))


def calls(t):
    return t.events.selectExpr("event_type AS task", "CAST(user_id % 3 AS STRING) AS model", "value AS reserved", "CASE WHEN event_type = 'error' THEN NULL ELSE value * 0.8D END AS actual", "ts AS at")


CALLS_SQL = "calls AS (SELECT event_type AS task, CAST(user_id % 3 AS VARCHAR) AS model, value AS reserved, CASE WHEN event_type = 'error' THEN NULL ELSE value * 0.8::DOUBLE END AS actual, ts AS at_time FROM events)"


@query("usage_rollup", f"WITH {CALLS_SQL} SELECT task, model, CAST(count(*) AS BIGINT) AS calls, round(sum(coalesce(actual, reserved)), 2) AS spent FROM calls GROUP BY ALL")
def usage_rollup(t):
    return M.usage(calls(t)).withColumn("spent", F.round("spent", 2))


@query("spend_vs_cap", f"""WITH {CALLS_SQL} SELECT strftime(at_time, '%Y-%m-%d') AS period, round(sum(coalesce(actual, reserved)), 2) AS spent, sum(coalesce(actual, reserved)) > 14000 AS over FROM calls GROUP BY 1
UNION ALL SELECT strftime(at_time, '%Y-%m'), round(sum(coalesce(actual, reserved)), 2), sum(coalesce(actual, reserved)) > 400000 FROM calls GROUP BY 1""".replace("AS over FROM", 'AS "over" FROM'))
def spend_vs_cap(t):
    c = calls(t)
    return M.spend_vs_cap(c, "day", 14000).unionByName(M.spend_vs_cap(c, "month", 400000)).withColumn("spent", F.round("spent", 2))


@query("top_n_counts", """WITH c AS (SELECT l_suppkey, l_returnflag || l_linestatus AS combo, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, combo) AS rank FROM c)
SELECT l_suppkey, combo, CAST(n AS BIGINT) AS count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top_n_counts(t):
    return M.top_counts(t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("combo")), ["l_suppkey"], "combo", 3)


AUTHORS = """l_suppkey AS topic, l_orderkey AS paper, l_linenumber - 1 AS pos, 6 AS last_pos, concat('Fam', o_custkey % 400) AS surname, CASE WHEN l_quantity > 25 THEN 'Ada' ELSE 'Bo' END AS given,
  CASE WHEN l_tax > 0.04 THEN concat('Uni ', o_custkey % 7) ELSE '' END AS affiliation, year(o_orderdate) AS year"""


@query("weighted_people", f"""WITH a AS (SELECT {AUTHORS} FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT *, concat(lower(surname), ' ', lower(left(given, 1))) AS key, CASE WHEN pos IN (0, last_pos) THEN 2 ELSE 1 END AS w FROM a),
b AS (SELECT topic, key, count(DISTINCT paper) AS papers, sum(w) AS weight, max(year) AS latest FROM k GROUP BY ALL HAVING count(DISTINCT paper) >= 2 OR sum(w) >= 2),
m AS (SELECT topic, key, affiliation FROM (SELECT topic, key, affiliation, row_number() OVER (PARTITION BY topic, key ORDER BY count(*) DESC, affiliation) AS r FROM k WHERE affiliation <> '' GROUP BY ALL) WHERE r = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, papers DESC, key) AS rank FROM b)
SELECT topic, key, CAST(papers AS BIGINT) AS papers, CAST(weight AS BIGINT) AS weight, CAST(latest AS INTEGER) AS latest, CAST(rank AS INTEGER) AS rank, coalesce(affiliation, '') AS affiliation FROM r LEFT JOIN m USING (topic, key) WHERE rank <= 8""".replace("GROUP BY ALL) WHERE r = 1", "GROUP BY topic, key, affiliation) WHERE r = 1"))
def weighted_people(t):
    a = dealt(t.lineitem, "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*[x for x in (
        "l_suppkey AS topic", "l_orderkey AS paper", "l_linenumber - 1 AS pos", "6 AS last_pos", "concat('Fam', o_custkey % 400) AS surname", "CASE WHEN l_quantity > 25 THEN 'Ada' ELSE 'Bo' END AS given",
        "CASE WHEN l_tax > 0.04 THEN concat('Uni ', o_custkey % 7) ELSE '' END AS affiliation", "year(o_orderdate) AS year")])
    return M.weighted_people(a)


@query("grant_rollup", """SELECT concat('R01-', o_custkey) AS core, CAST(count(*) AS BIGINT) AS n_records, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS years FROM orders GROUP BY o_custkey""")
def grant_rollup(t):
    projects = t.orders.select(F.substring(F.concat(F.lit("5R01-"), F.col("o_custkey"), F.lit("-"), F.year("o_orderdate")), 2, 200).alias("n"), F.year("o_orderdate").alias("year"))
    core = F.regexp_replace("n", "-[0-9]+$", "")
    return M.grants(projects.select(core.alias("core"), "year")).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query("funnel", """SELECT user_id, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS relevant, CAST(count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS BIGINT) AS extracted,
  CAST(count(*) FILTER (event_type IN ('signup', 'purchase')) AS BIGINT) AS accepted, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS reviewed FROM events GROUP BY user_id""")
def funnel(t):
    kind = F.col("event_type")
    return M.funnel(t.events, "user_id", {"found": F.lit(True), "relevant": kind != "error", "extracted": kind.isin("click", "signup", "purchase"),
                                          "accepted": kind.isin("signup", "purchase"), "reviewed": kind == "purchase"})


@query("progress_since", """WITH s AS (SELECT c_custkey AS target, TIMESTAMP '1996-01-01' + to_days(CAST(c_nationkey * 60 AS INTEGER)) AS started FROM customer)
SELECT target, CAST((SELECT count(*) FROM orders WHERE o_custkey = target AND o_orderstatus = 'F' AND o_orderdate >= started) AS BIGINT) AS n_findings,
  CAST((SELECT count(*) FROM orders WHERE o_custkey = target AND o_orderstatus = 'O' AND o_orderdate >= started) AS BIGINT) AS n_requests FROM s""")
def progress_since(t):
    targets = t.customer.selectExpr("c_custkey AS target", "TIMESTAMP_NTZ '1996-01-01' + make_dt_interval(c_nationkey * 60) AS started")
    rows = t.orders.selectExpr("o_custkey AS target", "o_orderdate AS at", "o_orderstatus")
    return M.progress_since(targets, rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"))


@query("distinct_requests", """WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value) AS BIGINT) % 40 AS target, min(row(ts, event_id)) AS m FROM events GROUP BY ALL),
d AS (SELECT user_id, list(target ORDER BY m) AS targets, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM e GROUP BY user_id, day),
s AS (SELECT user_id, k, targets[1:3] AS counted FROM d WHERE k = 1
  UNION ALL SELECT d.user_id, d.k, list_concat(s.counted, list_filter(d.targets, lambda x: NOT list_contains(s.counted, x))[1:3]) FROM s JOIN d ON d.user_id = s.user_id AND d.k = s.k + 1)
SELECT target, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(arg_max(counted, k)) AS target FROM s GROUP BY user_id) GROUP BY target""")
def distinct_requests(t):
    return M.distinct_requests(t.events.selectExpr("user_id AS visitor", "CAST(floor(value) AS BIGINT) % 40 AS target", "ts AS at", "event_id AS seq"), 3)


@query("latency_stats", """SELECT strftime(ts, '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
  round(coalesce(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), -1), 4) AS median, round(coalesce(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), -1), 4) AS p95 FROM events GROUP BY 1""")
def latency_stats(t):
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "value", (F.col("event_type") == "error").alias("error"))
    out = M.latency(rows, "hour").na.fill(-1.0, ["median", "p95"])
    return out.withColumn("median", r4("median")).withColumn("p95", r4("p95"))


@query("last_day_activity", """WITH r AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
SELECT CAST(count(DISTINCT user_id) FILTER (event_type <> 'view') AS BIGINT) AS actors, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS checks FROM r""")
def last_day_activity(t):
    return M.last_day(t.events.select(F.col("user_id").alias("actor"), F.col("ts").alias("at"), (F.col("event_type") == "view").alias("is_check")))


@query("evidence_filter", """SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus <> 'O' AND l_quantity >= 35 GROUP BY 1""")
def evidence_filter(t):
    """The annotation-file rules as a pushed-down filter: aspect and evidence code lists, not negated, score floor."""
    return (t.lineitem.where("l_returnflag IN ('R', 'A') AND l_linestatus <> 'O' AND l_quantity >= 35").groupBy("l_suppkey")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts")))


@query("json_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.team[0].name'), concat('user ', user_id)) AS contact FROM events""")
def json_flatten(t):
    body = F.from_json("props", "k INT, team ARRAY<STRUCT<name: STRING>>")
    return t.events.select("event_id", body["k"].alias("k"), F.coalesce(F.get(body["team"], 0)["name"], F.concat(F.lit("user "), "user_id")).alias("contact"))
