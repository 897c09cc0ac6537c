"""The orders table as an append-only log: its dense key is the sequence number."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import integrity as I

from .registry import query

DATA = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"


def log(t):
    return t.orders.selectExpr("o_orderkey AS seq", f"{DATA} AS data", "o_orderstatus", "o_orderpriority")


LEVELS = """lv AS (SELECT 0 AS d, list(sha256(concat_blob) ORDER BY seq) AS hs FROM (SELECT o_orderkey AS seq, unhex('00') || CAST(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS BLOB) AS concat_blob FROM orders)
  UNION ALL SELECT d + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(hs) THEN sha256(unhex('01') || unhex(hs[2 * i + 1]) || unhex(hs[2 * i + 2])) ELSE hs[2 * i + 1] END)
  FROM lv WHERE len(hs) > 1)"""


@query("merkle_root", f"""WITH RECURSIVE {LEVELS}
SELECT CAST((SELECT len(hs) FROM lv WHERE d = 0) AS BIGINT) AS size, (SELECT hs[1] FROM lv WHERE len(hs) = 1) AS root""")
def merkle_root(t):
    return I.merkle_root(log(t))


@query("inclusion_proofs", f"""WITH RECURSIVE {LEVELS}
, node AS (SELECT d, unnest(range(0, len(hs))) AS i, unnest(hs) AS h FROM lv WHERE len(hs) > 1),
need AS (SELECT o_orderkey AS seq, d, xor(o_orderkey // CAST(pow(2, d) AS BIGINT), 1) AS sib FROM orders, (SELECT DISTINCT d FROM node))
SELECT seq, string_agg(h, ',' ORDER BY node.d) AS proof FROM need JOIN node ON node.d = need.d AND i = sib GROUP BY seq""")
def inclusion_proofs(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("seq"))
    return I.inclusion_proofs(log(t), wanted).withColumn("proof", F.array_join("proof", ","))


@query("consistency_proofs", f"""WITH RECURSIVE {LEVELS},
node AS (SELECT d, unnest(range(0, len(hs))) AS i, unnest(hs) AS h FROM lv),
size AS (SELECT count(*) AS n FROM orders), heads AS (SELECT DISTINCT 1 + s_suppkey * n // (SELECT count(*) FROM supplier) AS m FROM supplier, size),
sub AS (SELECT m AS head, 0 AS step, CAST(0 AS BIGINT) AS a, n AS b, true AS known, NULL::BIGINT AS x, NULL::BIGINT AS y FROM heads, size
  UNION ALL SELECT head, step + 1, CASE WHEN head <= a + k THEN a ELSE a + k END, CASE WHEN head <= a + k THEN a + k ELSE b END, known AND head <= a + k,
    CASE WHEN head <= a + k THEN a + k ELSE a END, CASE WHEN head <= a + k THEN b ELSE a + k END
  FROM (SELECT *, CAST(pow(2, ceil(log2(b - a)) - 1) AS BIGINT) AS k FROM sub WHERE head < b)),
run AS (SELECT head, step, x, y FROM sub WHERE x IS NOT NULL UNION ALL SELECT head, step + 1, a, b FROM sub WHERE head = b AND NOT known),
met AS (SELECT head, step, h FROM (SELECT *, CAST(ceil(log2(y - x)) AS BIGINT) AS d FROM run) r JOIN node ON node.d = r.d AND node.i = x >> r.d)
SELECT m AS old_size, coalesce(string_agg(h, ',' ORDER BY step DESC), '') AS proof, true AS consistent FROM heads LEFT JOIN met ON head = m GROUP BY m""")
def consistency_proofs(t):
    """Tree heads spread over the log, one for each supplier, and the proof that the whole log extends each of them."""
    size, stored = t.orders.count(), I.tiles(log(t))
    heads = t.supplier.selectExpr(f"CAST(1 + s_suppkey * {size} div {t.supplier.count()} AS BIGINT) AS old_size")
    root = I.merkle_root(log(t)).first()["root"]
    return I.verify_consistency(I.consistency_proofs(stored, heads, size), size, root).select(
        "old_size", F.array_join("proof", ",").alias("proof"), "consistent")


@query("prefix_consistent", """SELECT CAST(count(*) FILTER (o_orderkey < n // 2) AS BIGINT) AS old_size, CAST(count(*) AS BIGINT) AS new_size,
  CAST(count(*) FILTER (o_orderkey < n // 2 AND o_totalprice > 499000) AS BIGINT) AS missing, count(*) FILTER (o_orderkey < n // 2 AND o_totalprice > 499000) = 0 AS consistent
FROM orders, (SELECT count(*) AS n FROM orders) GROUP BY ALL""")
def prefix_consistent(t):
    n = t.orders.agg(F.count(F.lit(1)).alias("n"))
    old = (t.orders.join(F.broadcast(n)).where("o_orderkey < n div 2")
           .selectExpr("o_orderkey AS seq", f"CASE WHEN o_totalprice > 499000 THEN concat({DATA}, ' edited') ELSE {DATA} END AS data"))
    return I.prefix_consistent(old, log(t))


@query("verify_log", """SELECT o_orderkey AS seq, CASE WHEN o_totalprice > 495000 THEN 'id differs' ELSE 'leaf differs' END AS problem
FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice > 495000 OR o_totalprice < 5000)""")
def verify_log(t):
    rows = t.orders.selectExpr(
        "o_orderkey AS seq", f"{DATA} AS data", f"CASE WHEN o_totalprice > 495000 THEN sha2(concat({DATA}, 'x'), 256) ELSE sha2({DATA}, 256) END AS recorded_id",
        "o_orderstatus = 'P' AS redacted", "o_totalprice < 5000 AS bent")
    leaf = F.lower(F.hex(I.leaf_hash(F.when(F.col("bent"), F.concat("data", F.lit("y"))).otherwise(F.col("data")))))
    return I.verify_log(rows.withColumn("recorded_leaf", leaf))
