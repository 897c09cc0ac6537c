"""Variant records read off the line items: each row's numbers spell an HGVS name."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import variants as V

from .registry import query

FORM = """CASE CAST(l_quantity AS INTEGER) % 13 WHEN 0 THEN 'G>A (p.Arg#Gln)' WHEN 1 THEN 'C>T (p.Arg#Ter)' WHEN 2 THEN 'del (p.Lys#fs)' WHEN 3 THEN 'A>G (p.Leu#=)' WHEN 4 THEN '+1G>A' WHEN 5 THEN '-12C>T'
  WHEN 6 THEN '_@del (p.Glu#del)' WHEN 7 THEN '+15A>G' WHEN 8 THEN 'A>C (p.Met1Val)' WHEN 9 THEN '-2A>G' WHEN 10 THEN 'T>C (p.?)' WHEN 11 THEN 'C>A (p.Met1#Leu)' ELSE 'dup' END"""
START = "CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'm.' WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 'c.*' WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'c.-' ELSE 'c.' END"
NAME = f"CASE WHEN l_linenumber = 7 THEN concat('GRCh38 loss ', l_partkey) ELSE concat('NM_', l_suppkey, '(G', l_suppkey, '):', {START}, l_partkey, replace(replace({FORM}, '#', CAST(l_partkey AS {{s}})), '@', CAST(l_partkey + 3 AS {{s}}))) END"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
TYPE = "CASE WHEN l_tax = 0 THEN 'copy number loss' ELSE 'single nucleotide variant' END"

TYPED = f"""named AS (SELECT *, {NAME.format(s="VARCHAR")} AS name, {TYPE} AS vtype FROM lineitem),
parts AS (SELECT *, regexp_extract(name, '^([^\\s(:]+)(?:\\([^)]*\\))?:([cmgn]\\.\\S+)(?:\\s+\\((p\\.[^)]+)\\))?', 2) AS c, regexp_extract(name, '^([^\\s(:]+)(?:\\([^)]*\\))?:([cmgn]\\.\\S+)(?:\\s+\\((p\\.[^)]+)\\))?', 3) AS p FROM named),
typed AS (SELECT *, CASE WHEN vtype LIKE 'copy number%' OR c = '' THEN 'large' WHEN c LIKE 'm.%' THEN 'mitochondrial'
  WHEN p <> '' THEN CASE WHEN contains(p, 'fs') THEN 'frameshift' WHEN contains(p, '=') THEN 'synonymous' WHEN regexp_matches(p, '^p\\.Met1($|[^0-9])') THEN 'start'
    WHEN p LIKE '%Ter' OR p LIKE '%*' THEN 'nonsense' WHEN regexp_matches(p, 'del|ins|dup') THEN 'inframe' WHEN regexp_matches(p, '^p\\.[A-Z][a-z]{{2}}[0-9]+[A-Z][a-z]{{2}}$') THEN 'missense' ELSE 'other' END
  WHEN regexp_matches(c, '[0-9][+-][12]($|[^0-9])') THEN 'splice' WHEN regexp_matches(c, '[0-9][+-][0-9]') THEN 'intronic' WHEN c LIKE 'c.-%' OR c LIKE 'c.*%' THEN 'untranslated' ELSE 'other' END AS type FROM parts)"""


def typed(t):
    rows = t.lineitem.withColumn("name", F.expr(NAME.format(s="STRING"))).withColumn("vtype", F.expr(TYPE)).withColumn("h", V.split_name(F.col("name")))
    return rows.withColumn("type", V.variant_type(F.col("h.coding"), F.col("h.protein"), F.col("vtype")))


@query("variant_type", f"WITH {TYPED} SELECT {KEYS}, c AS coding, p AS protein, type FROM typed")
def variant_type(t):
    return typed(t).select(*KEYS.split(", "), F.col("h.coding").alias("coding"), F.col("h.protein").alias("protein"), "type")


@query("aligned_lists", """WITH f AS (SELECT p_partkey, concat('MONDO:MONDO:', lpad(CAST(p_size AS VARCHAR), 7, '0'), ', OMIM:', p_partkey, '|', CASE WHEN p_size > 25 THEN 'MedGen:1' ELSE concat('Orphanet:', p_size, ',OMIM:', p_partkey) END, '|') AS field FROM part)
SELECT p_partkey, concat('MONDO:', lpad(CAST(p_size AS VARCHAR), 7, '0'), ',OMIM:', p_partkey, '|', CASE WHEN p_size > 25 THEN '' ELSE concat('Orphanet:', p_size, ',OMIM:', p_partkey) END, '|') AS ids, 3 AS n_parts FROM part""")
def aligned_lists(t):
    field = F.expr("concat('MONDO:MONDO:', lpad(p_size, 7, '0'), ', OMIM:', p_partkey, '|', CASE WHEN p_size > 25 THEN 'MedGen:1' ELSE concat('Orphanet:', p_size, ',OMIM:', p_partkey) END, '|')")
    ids = V.aligned_ids(field)
    return t.part.select("p_partkey", F.array_join(F.transform(ids, lambda x: F.array_join(x, ",")), "|").alias("ids"), F.size(ids).alias("n_parts"))


CLASS = "CASE WHEN l_discount > 0.08 THEN 'C' WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'LP' END WHEN l_returnflag = 'A' THEN 'VUS' WHEN l_linestatus = 'F' THEN 'B' ELSE 'LB' END"
VID = "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey"


def gene_variants(t):
    conditions = F.array_compact(F.array(F.when(F.col("l_tax") > 0.03, F.concat(F.lit("A"), "l_suppkey")), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("B"), "l_suppkey"))))
    return typed(t).select(F.col("l_suppkey").alias("gene"), F.expr(VID).alias("variant"), F.expr(CLASS).alias("class"), F.col("l_linenumber").alias("stars"),
                           F.col("l_quantity").cast("int").alias("submitters"), "type", conditions.alias("conditions"))


SUMMARY = f"""{TYPED}, v AS (SELECT l_suppkey AS gene, {VID} AS variant, {CLASS} AS class, l_linenumber AS stars, CAST(l_quantity AS INTEGER) AS submitters, type, l_tax FROM typed),
e AS (SELECT *, concat('A', gene) AS condition FROM v WHERE l_tax > 0.03 UNION ALL SELECT *, concat('B', gene) FROM v WHERE l_tax > 0.06)"""


@query("conditional_summary", f"""WITH {SUMMARY},
c AS (SELECT gene, condition, count(*) FILTER (class IN ('P', 'LP')) AS plp, count(*) FILTER (class = 'VUS') AS vus, count(*) FILTER (class = 'C') AS conflicting, count(*) FILTER (class IN ('B', 'LB')) AS benign FROM e GROUP BY ALL),
t AS (SELECT gene, condition, string_agg(concat(type, ':', n), ',' ORDER BY n DESC, type) AS types FROM (SELECT gene, condition, type, count(*) AS n FROM e WHERE class IN ('P', 'LP') GROUP BY ALL) GROUP BY ALL),
k AS (SELECT gene, condition, string_agg(CAST(variant AS VARCHAR), ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY gene, condition ORDER BY class <> 'P', submitters DESC, stars DESC, variant) AS r FROM e WHERE class IN ('P', 'LP')) WHERE r <= 3 GROUP BY ALL),
u AS (SELECT gene, count(*) FILTER (class IN ('P', 'LP') AND l_tax <= 0.03) AS gene_unassigned FROM v GROUP BY gene)
SELECT c.gene, c.condition, CAST(plp AS BIGINT) AS plp, CAST(vus AS BIGINT) AS vus, CAST(conflicting AS BIGINT) AS conflicting, CAST(benign AS BIGINT) AS benign, coalesce(types, '') AS types, coalesce(top, '') AS top,
  CAST(gene_unassigned AS BIGINT) AS gene_unassigned FROM c LEFT JOIN t USING (gene, condition) LEFT JOIN k USING (gene, condition) LEFT JOIN u USING (gene)""")
def conditional_summary(t):
    out = V.condition_summary(gene_variants(t))
    return out.withColumn("types", F.coalesce(F.array_join("types", ","), F.lit(""))).withColumn("top", F.coalesce(F.array_join(F.col("top").cast("array<string>"), ","), F.lit("")))


@query("gene_rows", f"""WITH {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY CASE class WHEN 'P' THEN 0 WHEN 'LP' THEN 1 WHEN 'C' THEN 2 WHEN 'VUS' THEN 3 WHEN 'LB' THEN 4 ELSE 5 END, submitters DESC, stars DESC, variant) AS pos FROM v)
SELECT gene, variant, class, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 6000""")
def gene_rows(t):
    return V.gene_rows(gene_variants(t), 6000).select("gene", "variant", "class", "pos")


# A part and a line number are a condition; its curated effect goes by the part's size.
EFFECT = "CASE p_size % 4 WHEN 0 THEN 'loss_of_function' WHEN 1 THEN 'gain_of_function' WHEN 2 THEN 'dominant_negative' ELSE '' END"


@query("class_mix", f"""WITH {TYPED}, c AS (SELECT l_partkey AS part, l_linenumber AS line, count(*) AS n,
    count(*) FILTER (type IN ('nonsense', 'frameshift', 'splice', 'start', 'large')) AS t, count(*) FILTER (type = 'missense') AS m FROM typed GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n < 5 THEN 'too few' WHEN t / n >= 0.5 THEN 'mostly truncating' WHEN m / n >= 0.6 THEN 'mostly missense' ELSE 'mixed' END AS mix, {EFFECT} AS effect FROM c JOIN part ON p_partkey = part)
SELECT part, line, CAST(n AS BIGINT) AS n, CASE WHEN mix = 'mostly truncating' AND effect = 'loss_of_function' THEN 'fits loss of function'
  WHEN mix = 'mostly missense' AND effect IN ('gain_of_function', 'dominant_negative') THEN 'fits a changed protein' ELSE mix END AS reading FROM r""")
def class_mix(t):
    counts = typed(t).groupBy(F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line")).alias("id"), "type").agg(F.count(F.lit(1)).alias("n"))
    mix = V.class_mix(counts).select("id.part", "id.line", "n", "reading")
    effects = t.part.selectExpr("p_partkey AS part", f"{EFFECT} AS effect")
    return mix.join(effects, "part").select("part", "line", "n", V.read_with_effect(F.col("reading"), F.col("effect")).alias("reading"))


# What people type, derived from the records themselves: ids, rs numbers, coding forms, one-letter proteins, prefixes.
ASK = """CASE p_size % 5 WHEN 0 THEN CAST(p_partkey AS {s}) WHEN 1 THEN concat('RS', p_partkey) WHEN 2 THEN concat(' R', p_partkey, 'Q ') WHEN 3 THEN concat('c.', p_partkey, 'G>A') ELSE concat('p.(Arg', p_partkey, 'Gln)') END"""


@query("variant_lookup", f"""WITH q AS (SELECT DISTINCT p_partkey, p_size % 5 AS k, {ASK.format(s="VARCHAR")} AS query FROM part),
v AS (SELECT p_partkey AS variant, concat('NM_1:c.', p_partkey, CASE WHEN p_size > 25 THEN 'G>A' ELSE 'C>T' END) AS hgvs, CASE WHEN p_size > 25 THEN concat('p.Arg', p_partkey, 'Gln') ELSE concat('p.Arg', p_partkey, 'Ter') END AS protein FROM part)
SELECT query, variant FROM q JOIN v ON variant = p_partkey WHERE k IN (0, 1) OR (k IN (2, 4) AND protein = concat('p.Arg', p_partkey, 'Gln')) OR (k = 3 AND hgvs LIKE '%G>A')""")
def variant_lookup(t):
    variants = t.part.selectExpr("p_partkey AS variant", "concat('NM_1:c.', p_partkey, CASE WHEN p_size > 25 THEN 'G>A' ELSE 'C>T' END) AS hgvs",
                                 "CASE WHEN p_size > 25 THEN concat('p.Arg', p_partkey, 'Gln') ELSE concat('p.Arg', p_partkey, 'Ter') END AS protein", "concat('rs', p_partkey) AS rs")
    return V.lookup_variants(t.part.selectExpr(f"{ASK.format(s='STRING')} AS query"), variants)
