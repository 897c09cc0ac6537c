"""Orders as claims, their line items as reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import review as R

from .registry import query

VERDICT = """CASE WHEN l_returnflag = 'A' THEN 'does_not_support' WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'out_of_scope'
  WHEN l_returnflag = 'N' THEN 'supports_with_qualification' ELSE 'supports' END"""
PREDICATE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'tested_in' WHEN '2-HIGH' THEN 'causes' ELSE 'has_symptom' END"
ORIGIN = "CASE o_orderpriority WHEN '5-LOW' THEN 'reference' ELSE 'contributed' END"


def reviews(t):
    return t.lineitem.selectExpr(
        "l_orderkey AS claim_id", "l_suppkey AS reviewer", "CASE WHEN l_suppkey % 17 = 0 THEN 'human' ELSE 'agent' END AS reviewer_kind",
        "concat('fam', l_suppkey % 5) AS model_family", f"{VERDICT} AS verdict",
        "named_struct('a', l_linenumber, 'b', l_partkey, 'c', l_suppkey, 'd', l_quantity, 'e', l_extendedprice) AS seq")


def claims(t):
    return t.orders.selectExpr(
        "o_orderkey AS claim_id", "o_custkey * 10 + 1000000000 AS assertion_id", "o_custkey AS contributor", f"{ORIGIN} AS origin",
        "o_totalprice > 50000 AS kernel_ok", f"{PREDICATE} AS predicate", "o_orderkey AS seq", "o_orderstatus AS evidence_type",
        "date_format(o_orderdate, 'yyyy-MM') AS source_key", "o_orderdate AS created")


def with_evidence(t, rows):
    """One item of evidence per line of the order: papers with and without a number, datasets, experts, bare types."""
    kind = "CASE l_linenumber WHEN 1 THEN 'publication' WHEN 2 THEN 'publication' WHEN 3 THEN 'curated_database' WHEN 4 THEN 'expert_statement' ELSE 'note' END"
    lines = t.lineitem.selectExpr(
        "l_orderkey AS claim_id", f"""named_struct('type', {kind}, 'source_id', CASE WHEN l_linenumber <= 2 THEN concat('src:', l_suppkey % 20) END,
            'pmid', CASE WHEN l_linenumber = 1 THEN concat('PMID:', l_suppkey % 10) END, 'dataset', CASE WHEN l_linenumber = 3 THEN concat('set ', l_suppkey % 3) END) AS e""")
    return rows.join(lines.groupBy("claim_id").agg(F.collect_list("e").alias("evidence")), "claim_id")


def challenges(t):
    """Discounted lines object to their order, or to the whole assertion from the fourth line on."""
    return (t.lineitem.where("l_discount >= 0.1 AND l_returnflag = 'A'")
            .join(t.orders.selectExpr("o_orderkey AS l_orderkey", "o_custkey"), "l_orderkey")
            .selectExpr("CASE WHEN l_linenumber <= 3 THEN l_orderkey ELSE o_custkey * 10 + 1000000000 END AS target",
                        "l_suppkey AS challenger", "l_orderkey + 1 AS counter_claim", "l_orderkey AS event"))


REVIEWS = f"""rev AS (SELECT l_orderkey AS claim_id, l_suppkey AS reviewer, l_suppkey % 17 = 0 AS human, concat('fam', l_suppkey % 5) AS family, {VERDICT} AS verdict,
  row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem)"""


def STATUS_OF(source, name, key="claim_id"):
    return f"""{name}_f AS (SELECT {key}, family, arg_max(verdict, seq) AS v FROM {source} GROUP BY {key}, family),
{name}_h AS (SELECT {key}, arg_max(verdict, seq) AS hv FROM {source} WHERE human GROUP BY {key}),
{name} AS (SELECT {key}, any_value(hv) AS hv, count(*) AS n_families, CASE
  WHEN any_value(hv) IN ('supports', 'supports_with_qualification') THEN 'human_reviewed' WHEN any_value(hv) IS NOT NULL THEN 'rejected'
  WHEN count(*) FILTER (v IN ('supports', 'supports_with_qualification')) > 0 AND count(*) FILTER (v = 'does_not_support') > 0 THEN 'review_disagreement'
  WHEN count(*) FILTER (v = 'does_not_support') > 0 OR count(*) FILTER (v = 'out_of_scope') = count(*) THEN 'rejected'
  WHEN count(*) FILTER (v IN ('supports', 'supports_with_qualification')) >= 2 THEN 'independently_reviewed' ELSE 'reviewed' END AS status
  FROM {name}_f LEFT JOIN {name}_h USING ({key}) GROUP BY {key})"""


STATUS = f"{REVIEWS}, {STATUS_OF('rev', 'status')}"
CLAIMS = f"""claim AS (SELECT o_orderkey AS claim_id, o_custkey * 10 + 1000000000 AS assertion_id, o_custkey AS contributor, {ORIGIN} AS origin,
  o_totalprice > 50000 AS kernel_ok, {PREDICATE} AS predicate, o_orderkey AS seq, o_orderstatus AS evidence_type, strftime(o_orderdate, '%Y-%m') AS source_key,
  o_orderdate AS created, coalesce(status, 'unreviewed') AS status FROM orders LEFT JOIN status ON claim_id = o_orderkey)"""
CHALLENGES = """challenge AS (SELECT CASE WHEN l_linenumber <= 3 THEN l_orderkey ELSE o_custkey * 10 + 1000000000 END AS target, l_suppkey AS challenger,
  l_orderkey + 1 AS counter_claim, l_orderkey AS event FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.1 AND l_returnflag = 'A')"""


@query("review_status", f"""WITH {STATUS}, n AS (SELECT claim_id, count(*) AS n_reviews FROM rev GROUP BY 1)
SELECT claim_id, status, CAST(n_families AS BIGINT) AS n_families, CAST(n_reviews AS BIGINT) AS n_reviews FROM status JOIN n USING (claim_id)""")
def review_status(t):
    return R.review_status(reviews(t))


@query("visible_claims", f"""WITH {STATUS}, {CLAIMS}, {CHALLENGES}
SELECT claim_id, status, status <> 'rejected' AS research,
  status NOT IN ('rejected', 'review_disagreement') AND (origin = 'reference' OR CASE WHEN predicate = 'tested_in' THEN status = 'human_reviewed'
    WHEN predicate = 'causes' THEN status IN ('independently_reviewed', 'human_reviewed') ELSE status IN ('reviewed', 'independently_reviewed', 'human_reviewed') END) AS family,
  status NOT IN ('rejected', 'review_disagreement') AND (origin = 'reference' OR status = 'human_reviewed') AS strict,
  CASE WHEN assertion_id IN (SELECT target FROM challenge) THEN 'Contested: see both sides' WHEN origin = 'reference' THEN 'From a curated database'
    WHEN status = 'human_reviewed' THEN 'Reviewed by an expert' WHEN status = 'independently_reviewed' THEN 'Checked by two independent AI reviewers'
    WHEN status = 'reviewed' THEN 'Checked by an AI reviewer against its source' ELSE 'Not yet checked' END AS label FROM claim""")
def visible_claims(t):
    rows = R.with_status(claims(t), reviews(t))
    flags = challenges(t).select(F.col("target").alias("assertion_id"), F.lit(True).alias("c")).distinct()
    o, s, p = F.col("origin"), F.col("status"), F.col("predicate")
    return (rows.join(flags, "assertion_id", "left")
            .select("claim_id", "status", *[R.visible(x, o, s, p).alias(x) for x in ("research", "family", "strict")],
                    R.plain_label(o, s, F.coalesce("c", F.lit(False))).alias("label")))


@query("evidence_state", f"""WITH {STATUS}, {CLAIMS}, {CHALLENGES},
item AS (SELECT l_orderkey AS claim_id, CASE l_linenumber WHEN 1 THEN 'publication' WHEN 2 THEN 'publication' WHEN 3 THEN 'curated_database' WHEN 4 THEN 'expert_statement' ELSE 'note' END AS evidence_type,
  CASE l_linenumber WHEN 1 THEN concat('PMID:', l_suppkey % 10) WHEN 2 THEN concat('src:', l_suppkey % 20) WHEN 3 THEN concat('set ', l_suppkey % 3) WHEN 4 THEN concat('expert:', o_custkey) ELSE 'note' END AS key
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT claim_id, string_agg(DISTINCT key, '|' ORDER BY key) AS source_key FROM item GROUP BY claim_id),
c AS (SELECT claim.* EXCLUDE (source_key, evidence_type), k.source_key, origin = 'reference' OR status IN ('independently_reviewed', 'human_reviewed') AS counted FROM claim JOIN k USING (claim_id)),
ty AS (SELECT assertion_id, string_agg(concat(evidence_type, ':', n), ',' ORDER BY n DESC, evidence_type) AS types FROM (
  SELECT assertion_id, item.evidence_type, count(*) AS n FROM c JOIN item USING (claim_id) WHERE counted GROUP BY ALL) GROUP BY 1),
a AS (SELECT assertion_id, bool_or(origin = 'reference') AS curated, bool_or(status = 'human_reviewed') AS human_reviewed,
  count(DISTINCT source_key) FILTER (counted) AS k FROM c GROUP BY 1)
SELECT assertion_id, CASE WHEN assertion_id IN (SELECT target FROM challenge) THEN 'contested' WHEN curated THEN 'curated' WHEN k >= 2 THEN 'multiple_independent_sources'
  WHEN k = 1 THEN 'single_source' ELSE 'unsupported' END AS state, CAST(k AS BIGINT) AS independent_sources, human_reviewed, coalesce(types, '') AS types
FROM a LEFT JOIN ty USING (assertion_id)""")
def evidence_state(t):
    contested = challenges(t).select(F.col("target").alias("assertion_id"))
    return (R.evidence_state(with_evidence(t, R.with_status(claims(t), reviews(t))), contested).withColumn("types", F.array_join("types", ",")))


@query("track_records", f"""WITH {STATUS}, {CLAIMS}, {CHALLENGES},
r AS (SELECT contributor, count(*) AS submitted, count(*) FILTER (NOT kernel_ok) AS quote_failed,
  count(*) FILTER (kernel_ok AND status IN ('reviewed', 'independently_reviewed', 'human_reviewed')) AS accepted,
  count(*) FILTER (kernel_ok AND status = 'rejected') AS rejected, count(*) FILTER (kernel_ok AND status = 'review_disagreement') AS disputed,
  count(*) FILTER (kernel_ok AND status = 'unreviewed') AS pending,
  count(*) FILTER (claim_id IN (SELECT target FROM challenge) OR assertion_id IN (SELECT target FROM challenge)) AS challenged
  FROM claim WHERE origin = 'contributed' GROUP BY 1),
g AS (SELECT reviewer, count(*) AS reviews_given FROM rev GROUP BY 1), m AS (SELECT challenger, count(*) AS challenges_made FROM challenge GROUP BY 1),
w AS (SELECT contributor, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY seq DESC) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY seq DESC) AS k FROM claim WHERE origin = 'contributed') WHERE k <= 10 GROUP BY 1),
a AS (SELECT contributor FROM r UNION SELECT reviewer FROM g UNION SELECT challenger FROM m),
o AS (SELECT a.contributor, coalesce(submitted, 0) AS submitted, coalesce(quote_failed, 0) AS quote_failed, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected,
  coalesce(disputed, 0) AS disputed, coalesce(pending, 0) AS pending, coalesce(challenged, 0) AS challenged, coalesce(reviews_given, 0) AS reviews_given,
  coalesce(challenges_made, 0) AS challenges_made, coalesce(recent, '') AS recent
  FROM a LEFT JOIN r USING (contributor) LEFT JOIN g ON g.reviewer = a.contributor LEFT JOIN m ON m.challenger = a.contributor LEFT JOIN w ON w.contributor = a.contributor),
l AS (SELECT *, CASE WHEN accepted + rejected < 5 THEN 'new' WHEN accepted / (accepted + rejected) < 0.5 THEN 'unreliable'
  WHEN accepted / (accepted + rejected) < 0.8 THEN 'mixed' WHEN accepted + rejected >= 10 THEN 'reliable' ELSE 'new' END AS level FROM o)
SELECT *, CAST(CASE level WHEN 'reliable' THEN 40 WHEN 'unreliable' THEN 5 ELSE 20 END AS INTEGER) AS quota FROM l""")
def track_records(t):
    return R.track_records(claims(t), reviews(t), challenges(t)).withColumn("recent", F.array_join(F.col("recent").cast("array<string>"), ","))


@query("reviewer_agreement", f"""WITH {REVIEWS},
pairs AS (SELECT DISTINCT claim_id, reviewer FROM rev),
others AS (SELECT p.claim_id * 1000000 + p.reviewer AS k, o.human, o.family, o.verdict, o.seq FROM pairs p JOIN rev o ON o.claim_id = p.claim_id AND o.reviewer <> p.reviewer),
{STATUS_OF('others', 'st', 'k')},
j AS (SELECT r.reviewer, CASE WHEN status IN ('reviewed', 'independently_reviewed', 'human_reviewed') THEN verdict IN ('supports', 'supports_with_qualification')
  WHEN status = 'rejected' THEN verdict NOT IN ('supports', 'supports_with_qualification') END AS agrees FROM rev r LEFT JOIN st ON k = r.claim_id * 1000000 + r.reviewer)
SELECT reviewer, CAST(count(*) AS BIGINT) AS given, CAST(count(agrees) AS BIGINT) AS compared, CAST(count(*) FILTER (agrees) AS BIGINT) AS agreed,
  CASE WHEN count(agrees) >= 3 THEN round(count(*) FILTER (agrees) / count(agrees), 2) END AS agreement FROM j GROUP BY 1""")
def reviewer_agreement(t):
    return R.reviewer_agreement(reviews(t))


@query("recent_per_actor", """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10 GROUP BY 1""")
def recent_per_actor(t):
    out = R.recent_per_actor(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", [F.desc("o_orderdate"), F.col("o_orderkey")])
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("review_queue", f"""WITH {STATUS}, {CLAIMS}
SELECT claim_id, status FROM claim c WHERE kernel_ok AND contributor <> 5 AND status IN ('unreviewed', 'reviewed')
  AND NOT EXISTS (SELECT 1 FROM rev WHERE rev.claim_id = c.claim_id AND (human OR family = 'fam1'))""")
def review_queue(t):
    return R.review_queue(claims(t), reviews(t), "fam1", 5).select("claim_id", "status")


@query("expert_queue", f"""WITH {STATUS}, {CLAIMS}
SELECT claim_id, status FROM claim c WHERE kernel_ok AND NOT EXISTS (SELECT 1 FROM rev WHERE rev.claim_id = c.claim_id AND human) ORDER BY claim_id DESC LIMIT 60""")
def expert_queue(t):
    return R.expert_queue(claims(t), reviews(t)).select("claim_id", "status")


@query("cross_person_pairs", f"""WITH {REVIEWS}
SELECT claim_id, CAST(count(*) AS BIGINT) AS n_reviews, CAST(count(DISTINCT n_name) AS BIGINT) AS n_persons, CAST(count(*) FILTER (verdict IN ('supports', 'supports_with_qualification')) AS BIGINT) AS n_support
FROM rev JOIN supplier ON s_suppkey = reviewer JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = claim_id JOIN customer ON c_custkey = o_custkey
JOIN nation cn ON cn.n_nationkey = c_nationkey WHERE nation.n_name <> cn.n_name AND family <> concat('fam', c_custkey % 5) GROUP BY 1""".replace("count(DISTINCT n_name)", "count(DISTINCT nation.n_name)"))
def cross_person_pairs(t):
    person = t.nation.selectExpr("n_nationkey", "n_name AS person")
    agents = t.supplier.select(F.col("s_suppkey").alias("agent"), F.col("s_nationkey").alias("n_nationkey")).join(person, "n_nationkey").select("agent", "person")
    people = t.customer.select((F.col("c_custkey") * -1 - 1).alias("agent"), F.col("c_nationkey").alias("n_nationkey")).join(person, "n_nationkey").select("agent", "person")
    c = claims(t).selectExpr("claim_id", "contributor * -1 - 1 AS contributor", "concat('fam', contributor % 5) AS family")
    return (R.cross_person_eligible(reviews(t), c, agents.unionByName(people)).groupBy("claim_id")
            .agg(F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("person").alias("n_persons"), F.count_if(R.supports(F.col("verdict"))).alias("n_support")))
