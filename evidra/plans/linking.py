from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import strings, vocab
from evidra.operators import linking as L

from .hierarchy import LOT_TERMS
from .registry import query

CONFIDENCE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Definitive' WHEN '2-HIGH' THEN 'Moderate' WHEN '3-MEDIUM' THEN 'Limited'
  WHEN '4-NOT SPECIFIED' THEN 'Supportive' ELSE 'Refuted' END"""
STRENGTH = """CASE WHEN source IN ('MONDO', 'Orphanet') OR lower(confidence) IN ('definitive', 'strong') THEN 'strong'
  WHEN lower(confidence) = 'moderate' THEN 'moderate' WHEN lower(confidence) IN ('limited', 'supportive') THEN 'limited' ELSE 'none' END"""


@query("link_strength", f"""SELECT o_orderkey, {STRENGTH} AS strength FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'MONDO' ELSE 'GenCC' END AS source, {CONFIDENCE} AS confidence FROM orders)""")
def link_strength(t):
    rows = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'MONDO' ELSE 'GenCC' END AS source", f"{CONFIDENCE} AS confidence")
    return rows.select("o_orderkey", vocab.link_strength(F.col("source"), F.col("confidence")).alias("strength"))


@query("classify_text", """WITH raw AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Pathogenic/Likely pathogenic' WHEN '2-HIGH' THEN 'Likely pathogenic'
    WHEN '3-MEDIUM' THEN 'Uncertain significance' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'P' THEN 'Conflicting classifications of pathogenicity' ELSE 'Likely benign' END
    ELSE CASE WHEN o_orderstatus = 'O' THEN 'Benign/Likely benign' ELSE 'drug response' END END AS txt,
    CASE o_orderstatus WHEN 'F' THEN 'reviewed by expert panel' WHEN 'O' THEN 'criteria provided, single submitter' ELSE 'no assertion' END AS st FROM orders)
SELECT o_orderkey, CASE WHEN txt ILIKE '%conflicting%' THEN 'C' WHEN txt ILIKE 'pathogenic%' THEN 'P' WHEN txt ILIKE 'likely pathogenic%' THEN 'LP'
  WHEN txt ILIKE 'uncertain significance%' THEN 'VUS' WHEN txt ILIKE 'likely benign%' THEN 'LB' WHEN txt ILIKE 'benign%' THEN 'B' ELSE 'O' END AS klass,
  CASE st WHEN 'reviewed by expert panel' THEN 3 WHEN 'criteria provided, single submitter' THEN 1 ELSE 0 END AS stars FROM raw""")
def classify_text(t):
    raw = t.orders.selectExpr("o_orderkey", """CASE o_orderpriority WHEN '1-URGENT' THEN 'Pathogenic/Likely pathogenic' WHEN '2-HIGH' THEN 'Likely pathogenic'
      WHEN '3-MEDIUM' THEN 'Uncertain significance' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'P' THEN 'Conflicting classifications of pathogenicity' ELSE 'Likely benign' END
      ELSE CASE WHEN o_orderstatus = 'O' THEN 'Benign/Likely benign' ELSE 'drug response' END END AS txt""",
        "CASE o_orderstatus WHEN 'F' THEN 'reviewed by expert panel' WHEN 'O' THEN 'criteria provided, single submitter' ELSE 'no assertion' END AS st")
    return raw.select("o_orderkey", vocab.classification(F.col("txt")).alias("klass"), vocab.review_stars(F.col("st")).alias("stars"))


@query("resolve_ids", """WITH raw AS (SELECT DISTINCT l_partkey * 3 AS raw_id FROM lineitem),
xref AS (SELECT p_partkey * 3 AS xref, p_partkey AS id FROM part WHERE p_size <= 25),
alt AS (SELECT p_partkey AS alt, p_partkey // 2 AS id FROM part WHERE p_type = 'PROMO'),
r AS (SELECT raw_id, CASE WHEN p_partkey IS NOT NULL THEN raw_id ELSE x.id END AS resolved,
  CASE WHEN p_partkey IS NOT NULL THEN 'primary' WHEN x.id IS NOT NULL THEN 'xref' ELSE 'missing' END AS how
  FROM raw LEFT JOIN part ON p_partkey = raw_id LEFT JOIN xref x ON x.xref = raw_id)
SELECT raw_id, CAST(coalesce(alt.id, resolved, -1) AS BIGINT) AS resolved, how FROM r LEFT JOIN alt ON alt.alt = resolved""")
def resolve_ids(t):
    rows = t.lineitem.select((F.col("l_partkey") * 3).alias("raw_id")).distinct()
    xref = t.part.where("p_size <= 25").selectExpr("p_partkey * 3 AS xref", "p_partkey AS id")
    alt = t.part.where("p_type = 'PROMO'").selectExpr("p_partkey AS alt", "p_partkey div 2 AS id")
    out = L.resolve_ids(rows, "raw_id", t.part.select(F.col("p_partkey").alias("id")), xref, alt)
    return out.select("raw_id", F.coalesce("resolved", F.lit(-1)).cast("long").alias("resolved"), "how")


@query("symbol_index", """WITH s AS (
  SELECT lower(concat(p_name, '-', p_size)) AS symbol, p_partkey AS id, 0 AS priority, -p_retailprice AS pos FROM part
  UNION ALL SELECT lower(concat(split_part(p_name, ' ', 1), ' rod-', p_size)), p_partkey, 1, -p_retailprice FROM part)
SELECT symbol, id, CASE priority WHEN 0 THEN 'approved' ELSE 'alias' END AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority, pos, id) AS r FROM s) WHERE r = 1""")
def symbol_index(t):
    approved = t.part.selectExpr("concat(upper(p_name), '-', p_size) AS symbol", "p_partkey AS id", "-p_retailprice AS pos")
    alias = t.part.selectExpr("concat(split(p_name, ' ')[0], ' Rod-', p_size) AS symbol", "p_partkey AS id", "-p_retailprice AS pos")
    return L.symbol_index(approved, alias)


LINKS = f"""raw AS (
  SELECT l_orderkey AS disease, l_suppkey AS gene, 'MONDO' AS source, '' AS confidence, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_suppkey, 'G2P', {CONFIDENCE}, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, l_suppkey, 'GenCC', {CONFIDENCE}, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_returnflag = 'N' AND o_orderpriority <> '4-NOT SPECIFIED'),
links AS (SELECT *, {STRENGTH} AS strength FROM raw WHERE {STRENGTH} <> 'none'
  AND disease IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND gene IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))"""


def links_of(t):
    graded = t.lineitem.join(t.orders.selectExpr("o_orderkey AS l_orderkey", "o_orderpriority"), "l_orderkey")

    def slice_(df, flag, source, confidence, *submitter):
        return (df.where(F.col("l_returnflag") == flag)
                .select(F.col("l_orderkey").alias("disease"), F.col("l_suppkey").alias("gene"), F.lit(source).alias("source"),
                        vocab.link_strength(F.lit(source), confidence).alias("strength"), F.col("l_partkey").alias("ref"),
                        *(c.alias("submitter") for c in submitter)))
    sources = [slice_(t.lineitem, "R", "MONDO", F.lit("")),
               slice_(graded, "A", "G2P", F.expr(CONFIDENCE)),
               slice_(graded, "N", "GenCC", F.expr(CONFIDENCE), F.col("o_orderpriority"))]
    return L.integrate_links(sources, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("disease")),
                             t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("gene")), resubmitted=["4-NOT SPECIFIED"])


@query("integrate_links", f"""WITH {LINKS}
SELECT gene, source, strength, CAST(count(*) AS BIGINT) AS n_links, CAST(count(DISTINCT disease) AS BIGINT) AS n_diseases FROM links GROUP BY ALL""")
def integrate_links(t):
    return (links_of(t).groupBy("gene", "source", "strength")
            .agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("disease").alias("n_diseases")))


@query("evidence_rollup", f"""WITH {LINKS}
SELECT disease, gene, arg_max(strength, CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS strength,
  CAST(count(*) AS BIGINT) AS n_evidence, array_to_string(list_sort(list(DISTINCT ref))[1:5], ',') AS refs FROM links GROUP BY ALL""")
def evidence_rollup(t):
    return L.evidence_rollup(links_of(t)).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


@query("weighted_vote", """WITH votes AS (
  SELECT l_orderkey AS id, CASE l_linestatus WHEN 'F' THEN 'loss_of_function' ELSE 'gain_of_function' END AS value, 2 AS weight, l_linenumber AS position FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, CASE l_linestatus WHEN 'F' THEN 'loss_of_function' ELSE 'gain_of_function' END, 1, 100 + l_linenumber FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'loss_of_function', 1, 200 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1),
v AS (SELECT id, value, sum(weight) AS votes, min(position) AS position FROM votes GROUP BY ALL)
SELECT id, value, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, position, value) AS r FROM v) WHERE r = 1""")
def weighted_vote(t):
    effect = vocab.lookup(F.when(F.col("l_linestatus") == "F", "loss of function").otherwise("gain of function"), vocab.EFFECT_WORDS)
    curated = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), effect.alias("value"), F.lit(2).alias("weight"), F.col("l_linenumber").alias("position"))
    listed = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), effect.alias("value"), F.lit(1).alias("weight"), (F.col("l_linenumber") + 100).alias("position"))
    dosage = (t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi")).where("lo = hi")
              .select("id", F.lit("loss_of_function").alias("value"), F.lit(1).alias("weight"), F.lit(200).alias("position")))
    return L.weighted_vote(curated.unionByName(listed).unionByName(dosage))


@query("overlay_claims", f"""WITH {LOT_TERMS}, entity AS (SELECT p_partkey AS item, -1 - p_partkey // 4 AS node FROM part),
claims AS (SELECT CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE -1 - l_partkey // 4 END AS subject, l_suppkey AS term, concat('claim ', l_orderkey) AS source,
  CASE WHEN l_linenumber <= 4 THEN concat('PMID:', l_orderkey % 97) END AS ref, CASE WHEN l_discount > 0.05 THEN concat(l_linenumber, '/7') ELSE '' END AS frequency,
  l_orderkey * 10 + l_linenumber AS claim_id FROM lineitem),
rows_ AS (SELECT item, term, 'base' AS source, NULL AS ref, CASE WHEN item % 3 = 0 THEN '1/2' ELSE '' END AS frequency, NULL AS claim_id FROM lot_terms
  UNION ALL SELECT subject, term, source, ref, frequency, claim_id FROM claims WHERE subject IN (SELECT item FROM entity)
  UNION ALL SELECT e.item, term, source, ref, frequency, claim_id FROM claims JOIN entity e ON e.node = subject WHERE subject NOT IN (SELECT item FROM entity))
SELECT item, term, bool_or(claim_id IS NOT NULL) AS contributed, array_to_string(list_sort(list(DISTINCT source))[1:6], '; ') AS sources,
  coalesce(array_to_string(list_sort(list(DISTINCT ref) FILTER (ref IS NOT NULL))[1:5], '; '), '') AS refs, CAST(count(DISTINCT claim_id) AS BIGINT) AS n_claims,
  coalesce(arg_min(frequency, (coalesce(claim_id, -1), frequency)) FILTER (frequency <> ''), '') AS frequency FROM rows_ GROUP BY item, term""".replace("(coalesce(claim_id, -1), frequency)", "row(coalesce(claim_id, -1), frequency)"))
def overlay_claims(t):
    entity = t.part.selectExpr("p_partkey AS item", "-1 - p_partkey div 4 AS node")
    subject = "CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE -1 - l_partkey div 4 END AS subject"
    claims = t.lineitem.selectExpr(
        subject, "l_suppkey AS term", "concat('claim ', l_orderkey) AS source", "CASE WHEN l_linenumber <= 4 THEN concat('PMID:', l_orderkey % 97) END AS ref",
        "CASE WHEN l_discount > 0.05 THEN concat(l_linenumber, '/7') ELSE '' END AS frequency", "l_orderkey * 10 + l_linenumber AS claim_id")
    base = t.lineitem.selectExpr("l_partkey AS item", "l_suppkey AS term", "'base' AS source", "CAST(NULL AS STRING) AS ref", "CASE WHEN l_partkey % 3 = 0 THEN '1/2' ELSE '' END AS frequency")
    return (L.overlay_claims(base, claims, entity).withColumn("sources", F.array_join("sources", "; "))
            .withColumn("refs", F.coalesce(F.array_join("refs", "; "), F.lit(""))))


@query("id_overlap", """WITH v AS (SELECT DISTINCT l_orderkey AS variant, l_suppkey AS gene, unnest([p_brand, p_type, p_name]) AS id FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT s_suppkey AS gene, concat('C', s_nationkey) AS condition, concat('Brand#', s_nationkey + 1) AS id FROM supplier
  UNION ALL SELECT s_suppkey, concat('C', s_nationkey, 'b'), 'PROMO' FROM supplier
  UNION ALL SELECT s_suppkey, concat('C', s_nationkey), 'SMALL' FROM supplier)
SELECT condition, gene, CAST(count(DISTINCT variant) AS BIGINT) AS n_variants FROM v JOIN k USING (gene, id) WHERE id <> 'SMALL' GROUP BY ALL""")
def id_overlap(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.array("p_brand", "p_type", "p_name").alias("ids"))
    variants = t.lineitem.join(part, "l_partkey").select(F.struct("l_orderkey", "l_suppkey").alias("variant"), F.col("l_suppkey").alias("gene"), "ids")
    keys = t.supplier.select(F.col("s_suppkey").alias("gene"), F.explode(F.array(
        F.struct(F.concat(F.lit("C"), "s_nationkey").alias("condition"), F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("id")),
        F.struct(F.concat(F.lit("C"), "s_nationkey", F.lit("b")).alias("condition"), F.lit("PROMO").alias("id")),
        F.struct(F.concat(F.lit("C"), "s_nationkey").alias("condition"), F.lit("SMALL").alias("id")))).alias("k")).select("gene", "k.*")
    return (L.id_overlap(variants, keys, generic=("SMALL",))
            .groupBy("condition", F.col("variant.l_suppkey").alias("gene")).agg(F.count(F.lit(1)).alias("n_variants")))


@query("resolve_terms", """WITH m AS (SELECT p_partkey, CASE WHEN p_size > 30 THEN concat(upper(p_name), 's') WHEN p_size > 10 THEN replace(p_name, ' ', '--') ELSE concat(p_name, ' ', p_brand) END AS mention FROM part),
k AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, min(p_partkey) AS id FROM part GROUP BY 1),
n AS (SELECT DISTINCT mention, trim(regexp_replace(lower(mention), '[^a-z0-9]+', ' ', 'g')) AS key FROM m)
SELECT mention, CAST(coalesce(a.id, b.id, -1) AS BIGINT) AS id, CASE WHEN a.id IS NOT NULL THEN 1.0::DOUBLE WHEN b.id IS NOT NULL THEN 0.98::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM n LEFT JOIN k a ON a.key = n.key LEFT JOIN k b ON n.key LIKE '%s' AND b.key = left(n.key, -1)""")
def resolve_terms(t):
    mentions = t.part.selectExpr("CASE WHEN p_size > 30 THEN concat(upper(p_name), 's') WHEN p_size > 10 THEN replace(p_name, ' ', '--') ELSE concat(p_name, ' ', p_brand) END AS mention").distinct()
    out = L.resolve_terms(mentions, t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")))
    return out.withColumn("id", F.coalesce("id", F.lit(-1)).cast("long"))


@query("preferred_value", """SELECT o_custkey, o_orderkey, klass FROM (
  SELECT o_custkey, o_orderkey, o_orderpriority AS klass, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderstatus <> 'F', o_orderpriority <> '1-URGENT', -o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1""")
def preferred_value(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("klass"), "o_orderstatus", "o_totalprice")
    return (L.best_per_key(rows, ["o_custkey"], F.col("o_orderstatus") != "F", F.col("klass") != "1-URGENT", -F.col("o_totalprice"), F.col("o_orderkey"))
            .select("o_custkey", "o_orderkey", "klass"))


@query("keep_first", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def keep_first(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return L.best_per_key(rows, ["l_partkey", "l_suppkey"], F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity"))


@query("ordered_names", """WITH n AS (SELECT p_brand AS id, p_partkey AS pos, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name FROM part),
f AS (SELECT id, min(pos) AS pos, arg_min(name, pos) AS name FROM n GROUP BY id, lower(name)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, name) AS r FROM f)
SELECT id, max(CASE WHEN r = 1 THEN concat(upper(left(name, 1)), substring(name, 2)) END) AS title,
  coalesce(string_agg(name, '|' ORDER BY r) FILTER (r > 1), '') AS others FROM r WHERE r <= 16 GROUP BY id""")
def ordered_names(t):
    names = t.part.selectExpr("p_brand AS id", "p_partkey AS pos", "CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name")
    return L.ordered_names(names).withColumn("others", F.array_join("others", "|"))


@query("gather_refs", """WITH touched AS (SELECT l_orderkey * 2 AS id, l_orderkey AS seq, l_partkey AS ref FROM lineitem UNION ALL SELECT l_suppkey * 2 + 1, l_orderkey, l_partkey FROM lineitem),
f AS (SELECT id, ref, min(seq) AS seq FROM touched GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, ref) AS r FROM f)
SELECT id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY r) AS refs FROM r WHERE r <= 30 GROUP BY id""")
def gather_refs(t):
    claims = t.lineitem.selectExpr("l_orderkey * 2 AS subject", "l_suppkey * 2 + 1 AS object", "l_orderkey AS seq", "array(l_partkey) AS refs")
    return L.gather_refs(claims).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


@query("host_slug", """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' OR host = '' THEN '' ELSE left(concat('org:', trim(regexp_replace(host, '[^a-z0-9]+', '-', 'g'), '-')), 84) END AS org FROM h""")
def host_slug(t):
    return t.pages.select("page_id", F.coalesce(strings.organization_id(F.col("url"), ("example.net",)), F.lit("")).alias("org"))


AFFILIATION = """concat('Department of ', p_type, ', ', CASE WHEN p_size > 25 THEN 'University of ' ELSE CASE WHEN p_size > 12 THEN 'Institute for ' ELSE '' END END, p_name, ', ', p_brand,
  ' City, NATION_', p_size, CASE WHEN p_size > 20 THEN '. Electronic address: a.b@example.org' ELSE '' END)"""


@query("clean_affiliation", f"""WITH a AS (SELECT p_partkey, p_size, {AFFILIATION} AS txt FROM part)
SELECT p.p_partkey, CASE WHEN p.p_size > 25 THEN concat('University of ', p_name) WHEN p.p_size > 12 THEN concat('Institute for ', p_name)
  ELSE concat('Department of ', p_type) END || ', NATION_' || p.p_size AS affiliation FROM part p""")
def clean_affiliation(t):
    return t.part.select("p_partkey", strings.clean_affiliation(F.expr(AFFILIATION)).alias("affiliation"))


@query("id_kind", """WITH ids AS (
  SELECT concat('MONDO:', lpad(CAST(p_partkey AS VARCHAR), 7, '0'), CASE WHEN p_size > 25 THEN concat('-HGNC:', p_size) ELSE '' END) AS id FROM part
  UNION ALL SELECT concat('HGNC:', s_suppkey) FROM supplier UNION ALL SELECT concat('HP:', lpad(CAST(o_orderkey AS VARCHAR), 7, '0')) FROM orders
  UNION ALL SELECT concat('NCT', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) FROM customer UNION ALL SELECT concat('PMID:', doc_id) FROM documents
  UNION ALL SELECT concat('org:', replace(lower(n_name), '_', '-')) FROM nation UNION ALL SELECT concat('person:', lower(r_name)) FROM region
  UNION ALL SELECT url FROM pages UNION ALL SELECT concat('CPX-', vec_id) FROM embeddings UNION ALL SELECT concat('asset:', item_id, '-x') FROM benchmark)
SELECT coalesce(kind, '') AS kind, CAST(count(*) AS BIGINT) AS n, min(id) AS example FROM (SELECT id, CASE
  WHEN regexp_matches(id, '^MONDO:[0-9]{7}(-HGNC:[0-9]+)?$') THEN 'condition' WHEN regexp_matches(id, '^HGNC:[0-9]+$') THEN 'gene'
  WHEN regexp_matches(id, '^HP:[0-9]{7}$') THEN 'phenotype' WHEN regexp_matches(id, '^CPX-[0-9]+$') THEN 'complex' WHEN regexp_matches(id, '^NCT[0-9]{8}$') THEN 'trial'
  WHEN regexp_matches(id, '^PMID:[0-9]+$') THEN 'publication' WHEN regexp_matches(id, '^org:[a-z0-9][a-z0-9-]{1,80}$') THEN 'organization'
  WHEN regexp_matches(id, '^person:[a-z0-9][a-z0-9-]{1,80}$') THEN 'person' WHEN regexp_matches(id, '^asset:[a-z0-9][a-z0-9-]{1,120}$') THEN 'asset' END AS kind FROM ids) GROUP BY 1""")
def id_kind(t):
    def ids(df, expr):
        return df.selectExpr(f"{expr} AS id")
    rows = (ids(t.part, "concat('MONDO:', lpad(p_partkey, 7, '0'), CASE WHEN p_size > 25 THEN concat('-HGNC:', p_size) ELSE '' END)")
            .union(ids(t.supplier, "concat('HGNC:', s_suppkey)")).union(ids(t.orders, "concat('HP:', lpad(o_orderkey, 7, '0'))"))
            .union(ids(t.customer, "concat('NCT', lpad(c_custkey, 8, '0'))")).union(ids(t.documents, "concat('PMID:', doc_id)"))
            .union(ids(t.nation, "concat('org:', replace(lower(n_name), '_', '-'))")).union(ids(t.region, "concat('person:', lower(r_name))"))
            .union(ids(t.pages, "url")).union(ids(t.embeddings, "concat('CPX-', vec_id)")).union(ids(t.benchmark, "concat('asset:', item_id, '-x')")))
    return (rows.groupBy(F.coalesce(strings.id_kind(F.col("id")), F.lit("")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example")))


@query("keyword_classes", """WITH k AS (SELECT c_custkey, concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'Patient group' WHEN 'FURNITURE' THEN 'research registry' WHEN 'MACHINERY' THEN 'Professional society'
    WHEN 'HOUSEHOLD' THEN 'information site' ELSE 'biotech company' END) AS kind_text,
  CASE WHEN c_acctbal > 6000 THEN 'this condition' WHEN c_acctbal > 2000 THEN 'gene wide' ELSE 'many' END AS focus,
  CASE WHEN c_acctbal > 8000 THEN 'RECRUITING' WHEN c_acctbal > 6000 THEN 'NOT_YET_RECRUITING' WHEN c_acctbal > 3000 THEN 'COMPLETED' ELSE '' END AS status FROM customer)
SELECT c_custkey, CASE kind_text WHEN 'Patient group' THEN 'patient_organization' WHEN 'research registry' THEN 'research_program' WHEN 'Professional society' THEN 'professional_network'
    WHEN 'information site' THEN 'information_service' ELSE 'company' END AS kind,
  CASE focus WHEN 'this condition' THEN 'this_condition' WHEN 'gene wide' THEN 'this_gene' ELSE 'broader_group' END AS scope,
  CASE status WHEN 'RECRUITING' THEN 'recruiting' WHEN 'NOT_YET_RECRUITING' THEN 'soon' WHEN 'COMPLETED' THEN 'closed' ELSE 'unknown' END AS study_group FROM k""")
def keyword_classes(t):
    k = t.customer.selectExpr("c_custkey", """CASE c_mktsegment WHEN 'BUILDING' THEN 'Patient group' WHEN 'FURNITURE' THEN 'research registry' WHEN 'MACHINERY' THEN 'Professional society'
      WHEN 'HOUSEHOLD' THEN 'information site' ELSE 'biotech company' END AS kind_text""",
        "CASE WHEN c_acctbal > 6000 THEN 'this condition' WHEN c_acctbal > 2000 THEN 'gene wide' ELSE 'many' END AS focus",
        "CASE WHEN c_acctbal > 8000 THEN 'RECRUITING' WHEN c_acctbal > 6000 THEN 'NOT_YET_RECRUITING' WHEN c_acctbal > 3000 THEN 'COMPLETED' ELSE '' END AS status")
    return k.select("c_custkey", vocab.organization_kind(F.col("kind_text")).alias("kind"), vocab.listing_scope(F.col("focus")).alias("scope"),
                    vocab.study_group(F.col("status")).alias("study_group"))


@query("rarity_bucket", """SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders,
  CASE WHEN count(DISTINCT l_orderkey) <= 20 THEN 'very rare sign' WHEN count(DISTINCT l_orderkey) <= 35 THEN 'uncommon sign' ELSE 'common sign' END AS rarity
FROM lineitem GROUP BY l_partkey""")
def rarity_bucket(t):
    return (t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"))
            .withColumn("rarity", vocab.rarity(F.col("n_orders"), 20, 35)))


@query("status_drift", """WITH cur AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS current_status, max(l_shipdate) AS seen FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS recorded, coalesce(current_status, 'missing') AS current_status, coalesce(o_orderstatus <> current_status, false) AS drifted,
  seen IS NULL OR date_diff('day', seen, o_orderdate) >= 30 AS stale FROM orders LEFT JOIN cur ON l_orderkey = o_orderkey""")
def status_drift(t):
    from evidra.operators.claims import status_drift as drift
    current = (t.lineitem.groupBy(F.col("l_orderkey").alias("id"))
               .agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P").alias("current_status"),
                    F.max("l_shipdate").alias("seen")))
    recorded = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("recorded"), F.col("o_orderdate").alias("now"))
    return drift(recorded, current, 30).withColumnRenamed("id", "o_orderkey").drop("now", "seen")
