from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import search as Q

from .registry import query
from .shared import part_terms

ENTRIES = """SELECT p_name AS text, 'g' AS kind, CAST(p_partkey AS {s}) AS ref, p_name AS label, p_brand AS extra, 0.0 AS prominence, 0 AS pos FROM part
UNION ALL SELECT concat(p_brand, ' ', p_name), 'g', CAST(p_partkey AS {s}), p_name, p_brand, 0.0, 1 FROM part
UNION ALL SELECT upper(p_name), 'g', CAST(p_partkey AS {s}), p_name, p_brand, 0.0, 2 FROM part
UNION ALL SELECT concat(p_type, ' ', p_name), 'c', concat(p_type, '/', p_name), p_name, '', {prom}, 0 FROM part GROUP BY p_type, p_name
UNION ALL SELECT p_brand, 'grp', p_brand, p_brand, CAST(count(*) AS {s}), 0.0, 0 FROM part GROUP BY p_brand"""
PROM_SQL = "round(least(1.0, ln(1 + count(*)) / ln(151)) * 0.8 + CASE WHEN max(p_size) > 40 THEN 0.2 ELSE 0 END, 2)"
INDEX = f"""ix AS (SELECT text, kind, ref, CASE WHEN label <> text THEN label ELSE '' END AS label, extra, CAST(prominence AS DOUBLE) AS prominence FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(text), kind, ref ORDER BY pos, text) AS r FROM ({ENTRIES.format(s="VARCHAR", prom=PROM_SQL)})) WHERE r = 1)"""


def index(t):
    p = t.part
    gene = p.select(F.col("p_partkey").cast("string").alias("ref"), "p_name", "p_brand", F.posexplode(F.array("p_name", F.concat_ws(" ", "p_brand", "p_name"), F.upper("p_name"))).alias("pos", "text"))
    gene = gene.select("text", F.lit("g").alias("kind"), "ref", F.col("p_name").alias("label"), F.col("p_brand").alias("extra"), F.lit(0.0).alias("prominence"), "pos")
    cond = p.groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("big")).select(
        F.concat_ws(" ", "p_type", "p_name").alias("text"), F.lit("c").alias("kind"), F.concat_ws("/", "p_type", "p_name").alias("ref"), F.col("p_name").alias("label"),
        F.lit("").alias("extra"), Q.prominence(F.col("n"), F.col("big") > 40).alias("prominence"), F.lit(0).alias("pos"))
    grp = p.groupBy("p_brand").agg(F.count(F.lit(1)).cast("string").alias("extra")).select(
        F.col("p_brand").alias("text"), F.lit("grp").alias("kind"), F.col("p_brand").alias("ref"), F.col("p_brand").alias("label"), "extra", F.lit(0.0).alias("prominence"), F.lit(0).alias("pos"))
    return Q.search_index(gene.unionByName(cond).unionByName(grp))


@query("search_index", f"WITH {INDEX} SELECT * FROM ix")
def search_index(t):
    return index(t)


TYPED = """SELECT p_name AS query FROM part UNION SELECT concat(p_brand, ' ', left(p_name, 5)) FROM part UNION SELECT concat(lower(left(p_type, 4)), ' ', split_part(p_name, ' ', 2)) FROM part"""


def typed_queries(t):
    p = t.part
    return (p.select(F.col("p_name").alias("query")).union(p.selectExpr("concat(p_brand, ' ', left(p_name, 5))"))
            .union(p.selectExpr("concat(lower(left(p_type, 4)), ' ', split_part(p_name, ' ', 2))"))).distinct()


NORM = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query("name_search", f"""WITH {INDEX}, q AS (SELECT query, {NORM.format("query")} AS q FROM ({TYPED})),
n AS (SELECT *, {NORM.format("text")} AS norm FROM ix),
m AS (SELECT query, kind, ref, prominence, norm, q, CASE WHEN norm = q THEN 100.0 WHEN starts_with(norm, q || ' ') THEN 82 - least(20, (length(norm) - length(q)) / 3) WHEN starts_with(norm, q) THEN 75 - least(20, (length(norm) - length(q)) / 3)
  WHEN contains(' ' || norm || ' ', ' ' || q || ' ') THEN 70 - least(20, (length(norm) - length(q)) / 4)
  WHEN len(list_filter(string_split(q, ' '), lambda t: contains(' ' || norm, ' ' || t))) = len(string_split(q, ' ')) THEN 55 - least(25, (length(norm) - length(q)) / 4) END AS base FROM n, q),
s AS (SELECT query, kind, ref, base * CASE kind WHEN 'g' THEN 1.15 WHEN 'c' THEN 1.0 ELSE 0.62 END + CASE WHEN kind = 'c' THEN 20 * prominence ELSE 0 END + CASE WHEN kind = 'g' AND norm = q THEN 30 ELSE 0 END AS score FROM m WHERE base IS NOT NULL),
b AS (SELECT query, kind, ref, round(max(score) + 3 * least(3, count(*) - 1), 6) AS score FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kind, ref) AS rank FROM b)
SELECT query, kind, ref, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def name_search(t):
    return Q.name_search(typed_queries(t), index(t)).withColumn("score", F.round("score", 4))


NAMES = """SELECT concat('PT:', p_partkey) AS id, 0 AS pos, concat(p_name, ' ', lower(p_type)) AS name FROM part UNION ALL SELECT concat('PT:', p_partkey), 1, p_name FROM part
UNION ALL SELECT concat('PT:', p_partkey), 2, concat(lower(p_type), ' part size ', p_size) FROM part"""


@query("term_search", f"""WITH q AS (SELECT DISTINCT concat(p_name, ' ', lower(p_type)) AS query FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT concat('size ', p_size, ' ', lower(p_type)) FROM part
  UNION SELECT concat('pt:', p_size) FROM part UNION SELECT left(p_type, 1) FROM part UNION SELECT repeat(p_type, 30) FROM part),
ns AS ({NAMES}), w AS (SELECT id, pos, lower(name) AS n, list_distinct(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS nw FROM ns),
m AS (SELECT query, id, CASE WHEN n = lower(query) AND pos = 0 THEN 0.0 WHEN n = lower(query) THEN 1.0
  WHEN len(list_intersect(qw, nw)) = len(qw) THEN 2 + (len(nw) - len(qw)) * 0.1
  WHEN len(list_intersect(qw, nw)) >= greatest(1, len(qw) - 1) THEN 5 + (len(qw) - len(list_intersect(qw, nw))) + (len(nw) - len(list_intersect(qw, nw))) * 0.1 END AS score
  FROM w, (SELECT query, list_distinct(regexp_split_to_array(lower(query), '[^a-z0-9]+')) AS qw FROM q WHERE length(query) BETWEEN 2 AND 120 AND NOT starts_with(query, 'pt:'))),
b AS (SELECT query, id, round(min(score), 6) AS score FROM m WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY query ORDER BY score, length(concat(p_name, ' ', p_type)), id) AS rank FROM b JOIN part ON concat('PT:', p_partkey) = id)
SELECT query, id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, '' AS reason FROM r WHERE rank <= 10
UNION ALL SELECT query, id, 0.0::DOUBLE, 1, '' FROM q JOIN ns ON lower(id) = query AND pos = 0
UNION ALL SELECT query, '', -1.0::DOUBLE, -1, 'search with 2 to 120 characters' FROM q WHERE length(query) NOT BETWEEN 2 AND 120""")
def term_search(t):
    p = t.part
    q = (p.selectExpr("concat(p_name, ' ', lower(p_type)) AS query").union(p.select("p_name")).union(p.selectExpr("concat('size ', p_size, ' ', lower(p_type))"))
         .union(p.selectExpr("concat('pt:', p_size)")).union(p.selectExpr("left(p_type, 1)")).union(p.selectExpr("repeat(p_type, 30)"))).distinct()
    p = p.withColumn("id", F.concat(F.lit("PT:"), "p_partkey"))
    names = (p.selectExpr("id", "0 AS pos", "concat(p_name, ' ', lower(p_type)) AS name").union(p.selectExpr("id", "1", "p_name"))
             .union(p.selectExpr("id", "2", "concat(lower(p_type), ' part size ', p_size)")))
    return Q.term_search(q, names).na.fill("", ["id", "reason"]).na.fill(-1.0, ["score"]).na.fill(-1, ["rank"])


@query("substring_search", """WITH q AS (SELECT DISTINCT substring(p_name, 2, 5) AS query FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT left(p_name, 1) FROM part),
n AS (SELECT DISTINCT p_partkey AS id, name FROM (SELECT p_partkey, p_name AS name FROM part UNION ALL SELECT p_partkey, concat(p_name, ' / ', p_brand) FROM part UNION ALL SELECT p_partkey, left(p_type, 2) FROM part)),
h AS (SELECT query, id, bool_or(lower(name) = lower(trim(query))) AS exact FROM q JOIN n ON contains(lower(name), lower(trim(query))) WHERE length(trim(query)) >= 2 GROUP BY ALL),
r AS (SELECT query, id, exact, row_number() OVER (PARTITION BY query ORDER BY exact DESC, concat(p_type, p_name), id) AS rank FROM h JOIN part ON p_partkey = id)
SELECT query, id, exact, CAST(rank AS INTEGER) AS rank, '' AS reason FROM r WHERE rank <= 20
UNION ALL SELECT query, -1, false, -1, 'search with 2 to 200 characters' FROM q WHERE length(trim(query)) < 2""")
def substring_search(t):
    p = t.part
    q = p.selectExpr("substring(p_name, 2, 5) AS query").union(p.select("p_name")).union(p.selectExpr("left(p_name, 2)")).union(p.selectExpr("left(p_name, 1)")).distinct()
    title = "concat(p_type, p_name) AS title"
    names = (p.selectExpr("p_partkey AS id", "p_name AS name", title).union(p.selectExpr("p_partkey", "concat(p_name, ' / ', p_brand)", title))
             .union(p.selectExpr("p_partkey", "left(p_type, 2)", title)))
    return Q.substring_search(q, names).na.fill(-1, ["id", "rank"]).na.fill(False, ["exact"]).na.fill("", ["reason"])


@query("entity_pages", """WITH it AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS term FROM lineitem), j AS (SELECT term, item, s_acctbal > 5000 AS flagged FROM it JOIN supplier ON s_suppkey = item),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY flagged DESC, item) AS k FROM j)
SELECT term, CAST(count(*) AS BIGINT) AS n_items, CAST(count(*) FILTER (flagged) AS BIGINT) AS n_flagged, string_agg(CAST(item AS VARCHAR), ',' ORDER BY k) FILTER (k <= 10) AS items FROM r GROUP BY term""")
def entity_pages(t):
    flags = t.supplier.selectExpr("s_suppkey AS item", "s_acctbal > 5000 AS flagged")
    return Q.entity_pages(part_terms(t), flags, 10).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))
