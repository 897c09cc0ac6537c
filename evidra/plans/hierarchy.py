from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import hierarchy as H
from evidra.operators import similarity as S

from .registry import query
from .shared import PART_TERMS, part_terms


def edges(t):
    """A DAG over the parts with diamonds: every part points to its key div 4 and its key div 6."""
    p = t.part.where("p_partkey > 0")
    return (p.selectExpr("p_partkey AS child", "p_partkey div 4 AS parent")
            .unionByName(p.selectExpr("p_partkey AS child", "p_partkey div 6 AS parent")).distinct())


EDGES = """edges AS (SELECT p_partkey AS child, p_partkey // 4 AS parent FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey, p_partkey // 6 FROM part WHERE p_partkey > 0)"""
ABOVE = """above AS (SELECT child AS id, parent AS ancestor FROM edges
  UNION SELECT above.id, edges.parent FROM above JOIN edges ON edges.child = above.ancestor)"""
WITH_DAG = f"WITH RECURSIVE {EDGES}, {ABOVE}"


@query("ancestor_closure", f"""{WITH_DAG}
SELECT id, ancestor FROM above UNION ALL SELECT p_partkey, p_partkey FROM part""")
def ancestor_closure(t):
    return H.closure(edges(t))


@query("descendant_counts", f"""{WITH_DAG}
SELECT ancestor, CAST(count(*) AS BIGINT) AS n_below FROM above GROUP BY ancestor""")
def descendant_counts(t):
    return H.descendant_counts(H.strict_closure(edges(t)))


@query("under_root", f"""{WITH_DAG}
SELECT id FROM above WHERE ancestor = 2""")
def under_root(t):
    return H.under_root(edges(t), 2)


@query("most_specific", f"""{WITH_DAG}, {PART_TERMS}
SELECT item, term FROM item_terms i WHERE NOT EXISTS (
  SELECT 1 FROM item_terms o JOIN above ON above.id = o.term WHERE o.item = i.item AND above.ancestor = i.term)""")
def most_specific(t):
    return H.most_specific(part_terms(t), edges(t))


@query("expanded_terms", f"""{WITH_DAG}, {PART_TERMS}
SELECT item, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM (
  SELECT item, term FROM item_terms UNION ALL SELECT item, ancestor FROM item_terms JOIN above ON above.id = term) GROUP BY item""")
def expanded_terms(t):
    return H.expand_terms(part_terms(t), edges(t), lists=True).select("item", F.size("terms").cast("long").alias("n_terms"))


@query("umbrella_terms", f"""{WITH_DAG}
SELECT u.p_partkey AS umbrella, CAST(count(DISTINCT d.p_partkey) AS BIGINT) AS n_below
FROM part d JOIN above ON above.id = d.p_partkey JOIN part u ON u.p_partkey = above.ancestor AND u.p_brand = d.p_brand
GROUP BY 1""")
def umbrella_terms(t):
    candidates = t.part.select(F.col("p_partkey").alias("disease"), F.col("p_brand").alias("gene"))
    return (H.umbrella_pairs(candidates, edges(t))
            .groupBy("umbrella").agg(F.count(F.lit(1)).alias("n_below")))


@query("split_entities", """WITH links AS (
  SELECT l_orderkey AS disease, l_partkey AS gene, bool_or(l_returnflag = 'R') AS strong FROM lineitem
  WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY disease) AS n_genes FROM links),
terms AS (SELECT l_orderkey AS disease, count(DISTINCT l_suppkey) AS n_terms FROM lineitem GROUP BY 1),
single AS (SELECT disease, gene FROM sized WHERE n_genes = 1),
options AS (SELECT gene, disease, row_number() OVER (PARTITION BY gene ORDER BY n_genes, -coalesce(n_terms, 0), disease) AS r
  FROM sized LEFT JOIN terms USING (disease) WHERE n_genes > 1 AND strong AND gene NOT IN (SELECT gene FROM single))
SELECT CAST(disease AS VARCHAR) AS id, disease, gene, false AS synthetic FROM single
UNION ALL SELECT concat(disease, '-', gene), disease, gene, true FROM options WHERE r = 1""")
def split_entities(t):
    links = (t.lineitem.where("l_returnflag IN ('R', 'A')")
             .groupBy(F.col("l_orderkey").alias("disease"), F.col("l_partkey").alias("gene"))
             .agg(F.bool_or(F.col("l_returnflag") == "R").alias("strong")))
    terms = t.lineitem.groupBy(F.col("l_orderkey").alias("disease")).agg(F.countDistinct("l_suppkey").alias("n_terms"))
    return H.split_entities(links, terms)


# Parts are the nodes. A node's own terms: the suppliers that shipped it.
LOT_TERMS = """lot_terms AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS term FROM lineitem)"""


def lot_terms(t):
    return t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("term")).distinct()


# A customer is an entity below the part of its number.
@query("inherit_terms", f"""{WITH_DAG}, {LOT_TERMS},
under AS (SELECT -1 - c_custkey AS item, c_custkey AS node FROM customer),
reach AS (SELECT item, node AS ancestor FROM under UNION SELECT item, above.ancestor FROM under JOIN above ON above.id = node),
only_one AS (SELECT ancestor, min(item) AS item FROM reach GROUP BY ancestor HAVING count(*) = 1)
SELECT o.item, t.term, min(o.ancestor) AS via FROM only_one o JOIN lot_terms t ON t.item = o.ancestor GROUP BY 1, 2""")
def inherit_terms(t):
    under = t.customer.select((-1 - F.col("c_custkey")).alias("child"), F.col("c_custkey").alias("parent"))
    return H.inherit_terms(lot_terms(t), edges(t).unionByName(under), under.select(F.col("child").alias("item")))


# An order is an entity without terms of its own, a child of the first part in it.
FIRST_PART = "SELECT -1 - l_orderkey AS child, min(l_partkey) AS parent FROM lineitem GROUP BY l_orderkey"


@query("broader_profile", f"""WITH RECURSIVE {EDGES}, {ABOVE}, {LOT_TERMS}, first_part AS ({FIRST_PART}),
up AS (SELECT child AS item, parent AS source, 1 AS depth FROM first_part
  UNION SELECT up.item, edges.parent, depth + 1 FROM up JOIN edges ON edges.child = up.source WHERE depth < 4),
below AS (SELECT ancestor, count(*) AS n FROM above GROUP BY ancestor),
usable AS (SELECT item AS source FROM lot_terms LEFT JOIN below ON ancestor = item GROUP BY item, n HAVING count(*) >= 3 AND coalesce(n, 0) <= 60),
near AS (SELECT item, source, depth FROM (
  SELECT item, source, depth, row_number() OVER (PARTITION BY item ORDER BY depth, source) AS r
  FROM up JOIN usable USING (source)) WHERE r = 1),
ic AS (SELECT term, -ln(count(*) / (SELECT count(DISTINCT item) FROM lot_terms)) AS ic FROM lot_terms GROUP BY term)
SELECT item, source, depth, term, CAST(rank AS INTEGER) AS rank FROM (
  SELECT near.item, near.source, depth, t.term, row_number() OVER (PARTITION BY near.item ORDER BY ic DESC, t.term) AS rank
  FROM near JOIN lot_terms t ON t.item = near.source JOIN ic ON ic.term = t.term) WHERE rank <= 20""")
def broader_profile(t):
    terms = lot_terms(t)
    below = H.descendant_counts(H.strict_closure(edges(t)))
    orders = t.lineitem.groupBy((-1 - F.col("l_orderkey")).alias("child")).agg(F.min("l_partkey").alias("parent"))
    entities = orders.select(F.col("child").alias("item")).unionByName(t.part.select(F.col("p_partkey").alias("item")))
    return H.broader_profile(entities, edges(t).unionByName(orders), terms, below, S.term_ic(terms))


@query("ancestor_groups", f"""{WITH_DAG},
up AS (SELECT ancestor AS grp, id AS item FROM above JOIN part ON p_partkey = id
  UNION SELECT p_partkey, p_partkey FROM part WHERE p_type = 'PROMO')
SELECT grp, CAST(count(*) AS BIGINT) AS n_members, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS members
FROM up GROUP BY grp HAVING count(*) BETWEEN 2 AND 800""")
def ancestor_groups(t):
    entities = t.part.select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("node"),
                                        (F.col("p_type") == "PROMO").alias("synthetic"))
    return (H.ancestor_groups(entities, H.strict_closure(edges(t)))
            .withColumn("members", F.array_join(F.col("members").cast("array<string>"), ",")))


@query("term_members", """SELECT concat(p_brand, '/', p_name) AS term, CAST(count(*) AS BIGINT) AS n_items,
  string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS items
FROM part GROUP BY 1 HAVING count(*) BETWEEN 2 AND 300""")
def term_members(t):
    pairs = t.part.select(F.col("p_partkey").alias("item"), F.concat_ws("/", "p_brand", "p_name").alias("term"))
    return H.term_members(pairs).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


CATEGORIES = ((5, "heavy"), (3, "metal"), (11, "fine"), (1, "general"))  # first match wins


@query("first_category", f"""{WITH_DAG}, closed AS (SELECT * FROM above UNION ALL SELECT p_partkey, p_partkey FROM part),
cats(ancestor, name, position) AS (VALUES {", ".join(f"({a}, '{n}', {i})" for i, (a, n) in enumerate(CATEGORIES))})
SELECT p_partkey AS node, coalesce((SELECT arg_min(name, position) FROM closed JOIN cats USING (ancestor) WHERE closed.id = p_partkey), 'other') AS category
FROM part""")
def first_category(t):
    cats = t.spark.createDataFrame([(a, n, i) for i, (a, n) in enumerate(CATEGORIES)], "ancestor long, name string, position int")
    return H.first_category(t.part.select(F.col("p_partkey").alias("node")), H.descendants(edges(t), cats.select("ancestor")), cats)
