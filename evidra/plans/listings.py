from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import listings as L
from evidra.operators import review as R

from .registry import query
from .review import CLAIMS, STATUS, claims, reviews

# A record = a part; owners = suppliers whose line was returned; its type by size.
ASSETS = """asset AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS record, CASE WHEN p_size > 25 THEN 'registry' ELSE 'trial' END AS type, CASE WHEN p_size > 25 THEN 0 ELSE 2 END AS type_rank
  FROM lineitem JOIN part ON p_partkey = l_partkey),
own AS (SELECT s_suppkey AS owner, s_suppkey // 2 AS gene, s_acctbal > 0 AS has_people FROM supplier),
near AS (SELECT s_suppkey AS owner, s_suppkey + k AS partner, k AS near_rank FROM supplier, (SELECT unnest([2, 5, 9]) AS k))"""


@query("shared_records", f"""WITH {ASSETS},
c AS (SELECT a.owner, b.owner AS partner, a.record, a.type_rank, near_rank, p.has_people FROM asset a JOIN asset b ON a.record = b.record AND a.type = b.type AND a.owner <> b.owner
  JOIN own o ON o.owner = a.owner JOIN own p ON p.owner = b.owner AND p.gene <> o.gene LEFT JOIN near ON near.owner = a.owner AND near.partner = b.owner),
f AS (SELECT *, row_number() OVER (PARTITION BY owner, partner ORDER BY type_rank, near_rank IS NULL, coalesce(near_rank, 999), NOT has_people, record) AS r FROM c),
g AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY type_rank, near_rank IS NULL, coalesce(near_rank, 999), NOT has_people, record, partner) AS pos FROM f WHERE r = 1)
SELECT owner, partner, record, CAST(pos AS INTEGER) AS pos FROM g WHERE pos <= 3""")
def shared_records(t):
    part = t.part.selectExpr("p_partkey AS l_partkey", "CASE WHEN p_size > 25 THEN 'registry' ELSE 'trial' END AS type", "CASE WHEN p_size > 25 THEN 0 ELSE 2 END AS type_rank")
    assets = t.lineitem.join(part, "l_partkey").selectExpr("l_suppkey AS owner", "l_partkey AS record", "type", "type_rank").distinct()
    owners = t.supplier.selectExpr("s_suppkey AS owner", "s_suppkey div 2 AS gene", "s_acctbal > 0 AS has_people")
    near = t.supplier.selectExpr("s_suppkey AS owner", "explode(array(2, 5, 9)) AS near_rank").selectExpr("owner", "owner + near_rank AS partner", "near_rank")
    return L.shared_records(assets, near, owners)


PEOPLE = "people AS (SELECT DISTINCT l_suppkey AS topic, o_custkey AS person, CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def people(t):
    return (t.lineitem.select("l_suppkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
            .join(t.customer.selectExpr("c_custkey AS o_custkey", "c_name"), "o_custkey")
            .selectExpr("l_suppkey AS topic", "CASE WHEN l_linenumber > 3 THEN upper(c_name) ELSE c_name END AS name", "CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS weight"))


@query("shared_people", f"""WITH {PEOPLE}, p AS (SELECT topic, person, max(weight) AS weight FROM people GROUP BY ALL),
m AS (SELECT DISTINCT l_suppkey AS topic, c_name AS name, CASE WHEN l_linenumber > 3 THEN upper(c_name) ELSE c_name END AS shown, o_custkey AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
nm AS (SELECT topic, person, min(shown) AS name FROM m GROUP BY ALL),
r AS (SELECT x.topic AS a, y.topic AS b, nm.name, row_number() OVER (PARTITION BY x.topic, y.topic ORDER BY x.weight DESC, nm.name) AS k FROM p x JOIN p y ON x.person = y.person AND y.topic = x.topic + 1 JOIN nm ON nm.topic = x.topic AND nm.person = x.person)
SELECT a, b, string_agg(name, ',' ORDER BY k) AS people FROM r WHERE k <= 4 GROUP BY ALL""")
def shared_people(t):
    pairs = t.supplier.selectExpr("s_suppkey AS a", "s_suppkey + 1 AS b")
    return L.shared_people(people(t), pairs).withColumn("people", F.array_join("people", ","))


@query("bridging_people", f"""WITH {PEOPLE}, m AS (SELECT s_suppkey AS topic, s_nationkey AS grp FROM supplier),
c AS (SELECT grp, person, count(DISTINCT topic) AS n FROM people JOIN m USING (topic) GROUP BY ALL HAVING count(DISTINCT topic) >= 2),
nm AS (SELECT s_nationkey AS grp, o_custkey AS person, min(CASE WHEN l_linenumber > 3 THEN upper(c_name) ELSE c_name END) AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY n DESC, name) AS k FROM c JOIN nm USING (grp, person))
SELECT grp, string_agg(name, ',' ORDER BY k) AS people FROM r WHERE k <= 8 GROUP BY grp""")
def bridging_people(t):
    return L.bridging_people(people(t), t.supplier.selectExpr("s_suppkey AS topic", "s_nationkey AS grp")).withColumn("people", F.array_join("people", ","))


FACTS_SQL = """fact AS (SELECT c_custkey AS id, coalesce(n_requests, 0) AS n_requests, coalesce(n_terms, 0) AS n_terms, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS n_groups, coalesce(n_studies, 0) AS n_studies,
  CASE c_mktsegment WHEN 'BUILDING' THEN '1-9 / 100 000' WHEN 'MACHINERY' THEN '<1 / 1 000 000' WHEN 'FURNITURE' THEN 'Unknown' END AS prevalence,
  CASE WHEN c_acctbal > 7000 THEN 'definitive' WHEN c_acctbal > 3000 THEN 'moderate' WHEN c_acctbal > 0 THEN 'limited' END AS strength, coalesce(n_lines, 0) AS n_causing,
  coalesce(last_order >= TIMESTAMP '2001-06-01', false) AS recent, CASE WHEN c_acctbal > 9800 THEN 'spring' END AS campaign
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_requests, count(*) FILTER (o_orderstatus = 'O') AS n_terms, count(*) FILTER (o_totalprice > 450000) AS n_studies, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey)"""
SCORE_SQL = """scored AS (SELECT *, round(CASE WHEN campaign IS NOT NULL THEN 4 ELSE 0 END + 6 * log2(1 + n_requests) + CASE WHEN n_terms = 0 THEN 4 WHEN n_terms < 5 THEN 2.5 ELSE 0 END + CASE WHEN n_groups = 0 THEN 1.5 ELSE 0 END
  + CASE WHEN n_studies = 0 THEN 1 ELSE 0 END + CASE prevalence WHEN '1-9 / 100 000' THEN 2.0 WHEN '<1 / 1 000 000' THEN 0.5 ELSE 0 END + CASE strength WHEN 'definitive' THEN 1.0 WHEN 'moderate' THEN 0.5 WHEN 'limited' THEN -1.0 ELSE 0 END
  + CASE WHEN n_causing >= 20 AND n_terms < 5 THEN 1 ELSE 0 END - CASE WHEN recent THEN 3 ELSE 0 END, 2) AS score FROM fact)"""


def facts(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_requests"), F.count_if(F.col("o_orderstatus") == "O").alias("n_terms"),
        F.count_if(F.col("o_totalprice") > 450000).alias("n_studies"), F.max("o_orderdate").alias("last_order"))
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    lines = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(per_order, "o_orderkey").groupBy("c_custkey").agg(F.sum("n").alias("n_causing"))
    return (t.customer.join(o, "c_custkey", "left").join(lines, "c_custkey", "left").na.fill(0, ["n_requests", "n_terms", "n_studies", "n_causing"])
            .selectExpr("c_custkey AS id", "n_requests", "n_terms", "CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS n_groups", "n_studies",
                        "CASE c_mktsegment WHEN 'BUILDING' THEN '1-9 / 100 000' WHEN 'MACHINERY' THEN '<1 / 1 000 000' WHEN 'FURNITURE' THEN 'Unknown' END AS prevalence",
                        "CASE WHEN c_acctbal > 7000 THEN 'definitive' WHEN c_acctbal > 3000 THEN 'moderate' WHEN c_acctbal > 0 THEN 'limited' END AS strength", "n_causing",
                        "coalesce(last_order >= TIMESTAMP_NTZ '2001-06-01', false) AS recent", "CASE WHEN c_acctbal > 9800 THEN 'spring' END AS campaign"))


@query("impact_frontier", f"""WITH {FACTS_SQL}, {SCORE_SQL}
SELECT id, CAST(score AS DOUBLE) AS score, concat_ws('; ', CASE WHEN campaign IS NOT NULL THEN concat('campaign ', campaign) END, CASE WHEN n_requests > 0 THEN concat(n_requests, CASE WHEN n_requests = 1 THEN ' person asked' ELSE ' people asked' END) END,
  CASE WHEN n_terms = 0 THEN 'no terms recorded' WHEN n_terms < 5 THEN concat('only ', n_terms, ' terms') END, CASE WHEN n_groups = 0 THEN 'no group found' END, CASE WHEN n_studies = 0 THEN 'no studies listed' END,
  CASE WHEN prevalence IS NOT NULL AND prevalence <> 'Unknown' THEN concat('affects ', prevalence) END, CASE WHEN n_causing >= 20 AND n_terms < 5 THEN 'many known variants, little description' END, CASE WHEN recent THEN 'expanded recently' END) AS reasons,
  CASE WHEN n_terms < 5 THEN 'symptoms' WHEN n_groups = 0 THEN 'community' WHEN n_studies = 0 THEN 'studies' ELSE 'review' END AS focus
FROM scored ORDER BY score DESC, id LIMIT 200""")
def impact_frontier(t):
    return L.impact_frontier(facts(t)).withColumn("reasons", F.array_join("reasons", "; "))


BATCH = """done AS (SELECT o_custkey AS target, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
pend AS (SELECT o_custkey AS target, o_orderkey AS item, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority FROM orders WHERE o_orderstatus <> 'F'),
batch AS (SELECT target, item, priority, coalesce(n_done, 0) AS n_done FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY priority, item) AS r FROM pend) LEFT JOIN done USING (target) WHERE r = 1 ORDER BY priority, n_done, target LIMIT 64)"""


def batch(t):
    pending = t.orders.where("o_orderstatus <> 'F'").selectExpr("o_custkey AS target", "o_orderkey AS item", "CAST(left(o_orderpriority, 1) AS INT) AS priority")
    done = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("target")).agg(F.count(F.lit(1)).alias("n_done"))
    return L.fair_batch(pending, done, 64)


@query("fair_batch", f"WITH {BATCH} SELECT target, item, priority, CAST(n_done AS BIGINT) AS n_done FROM batch")
def fair_batch(t):
    return batch(t).select("target", "item", "priority", "n_done")


@query("budget_prefix", f"""WITH {BATCH}, c AS (SELECT b.*, o_totalprice AS cost FROM batch b JOIN orders ON o_orderkey = item),
s AS (SELECT *, sum(cost) OVER (ORDER BY priority, n_done, target ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT target, item, round(spent, 2) AS spent FROM s WHERE spent <= 5000000""")
def budget_prefix(t):
    priced = batch(t).join(t.orders.selectExpr("o_orderkey AS item", "o_totalprice AS cost"), "item")
    return L.budget_prefix(priced, "cost", 5000000.0, [F.col("priority"), F.col("n_done"), F.col("target")]).select("target", "item", F.round("spent", 2).alias("spent"))


@query("task_list", f"""WITH {FACTS_SQL}, {SCORE_SQL}, {STATUS}, {CLAIMS},
rv AS (SELECT claim_id FROM claim WHERE kernel_ok AND status = 'unreviewed'),
tasks AS (SELECT 'review' AS task, claim_id AS id, 0 AS k, 0 AS f, 0 AS s, CAST(0 AS DOUBLE) AS score FROM rv
  UNION ALL SELECT 'expand', id, 1, CASE WHEN campaign IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN n_groups = 1 OR n_requests > 0 THEN 0 ELSE 1 END, CAST(score AS DOUBLE) FROM scored),
r AS (SELECT *, row_number() OVER (ORDER BY k, f, s, score DESC, id) AS pos FROM tasks)
SELECT CAST(pos AS INTEGER) AS pos, task, id, score FROM r WHERE pos <= 300""")
def task_list(t):
    f = facts(t)
    scored = L.impact_frontier(f, None).join(f.select("id", (F.col("n_groups") == 1).alias("single_gene"), (F.col("n_requests") > 0).alias("requested")), "id")
    waiting = R.with_status(claims(t).where("kernel_ok"), reviews(t)).where("status = 'unreviewed'").select(F.col("claim_id").alias("id"))
    return L.task_list(waiting, scored, f.where("campaign IS NOT NULL").select("id"), 300)


@query("listing_page", """WITH l AS (SELECT c_nationkey AS owner, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'patient_organization' WHEN 'FURNITURE' THEN 'research_program' WHEN 'MACHINERY' THEN 'professional_network' WHEN 'HOUSEHOLD' THEN 'information_service' ELSE 'company' END AS kind,
  CASE WHEN c_acctbal > 6000 THEN 'this_condition' WHEN c_acctbal > 2000 THEN 'this_gene' ELSE 'broader_group' END AS scope, c_acctbal < 1000 AS inherited FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE kind WHEN 'patient_organization' THEN 0 WHEN 'research_program' THEN 1 WHEN 'professional_network' THEN 2 WHEN 'information_service' THEN 3 ELSE 4 END,
  CASE scope WHEN 'this_condition' THEN 0 WHEN 'this_gene' THEN 1 ELSE 2 END, inherited, name) AS pos FROM l)
SELECT owner, name, kind, scope, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 10""")
def listing_page(t):
    rows = t.customer.selectExpr("c_nationkey AS owner", "c_name AS name", """CASE c_mktsegment WHEN 'BUILDING' THEN 'patient_organization' WHEN 'FURNITURE' THEN 'research_program' WHEN 'MACHINERY' THEN 'professional_network'
      WHEN 'HOUSEHOLD' THEN 'information_service' ELSE 'company' END AS kind""", "CASE WHEN c_acctbal > 6000 THEN 'this_condition' WHEN c_acctbal > 2000 THEN 'this_gene' ELSE 'broader_group' END AS scope",
                                 "CASE WHEN c_acctbal < 1000 THEN c_custkey END AS via")
    return L.ordered_page(rows, "owner", 10).select("owner", "name", "kind", "scope", "pos")
