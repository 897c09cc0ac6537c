from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import clusters as K
from evidra.operators import modularity as M
from evidra.session import cut

from .registry import query
from .shared import DOC_WORDS, PART_TERMS, doc_words, part_terms, r4

KNN = 16
BLOCK = 256  # rows per block; small here so that several blocks exist even on test data


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


SIM = "round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9)"
KNN_SQL = f"""sim AS (SELECT x.vec_id AS id, y.vec_id AS other, {SIM} AS sim FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM sim) WHERE rank <= {KNN}),
edge AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(greatest(0.001, sim)) AS weight FROM nn GROUP BY 1, 2),
both_ways AS (SELECT a, b, weight FROM edge UNION ALL SELECT b, a, weight FROM edge)"""


@query("tfidf_profiles", f"""WITH {DOC_WORDS}, n AS (SELECT count(*) AS n FROM documents),
blocks AS (SELECT 'words' AS block, item, term FROM item_terms UNION ALL SELECT 'origin', doc_id, lang FROM documents UNION ALL SELECT 'origin', doc_id, source FROM documents),
df AS (SELECT block, term, count(*) AS df FROM blocks GROUP BY ALL HAVING count(*) >= 2),
raw AS (SELECT block, item, term, ln(n / df) AS w FROM blocks JOIN df USING (block, term), n),
len AS (SELECT block, item, sqrt(sum(w * w)) AS len FROM raw GROUP BY ALL),
r AS (SELECT block, item, term, round(w / len / sqrt(2), 9) AS weight, row_number() OVER (PARTITION BY block, item ORDER BY round(w / len / sqrt(2), 9) DESC, term) AS rank FROM raw JOIN len USING (block, item) WHERE len > 0)
SELECT block, item, term, round(weight, 4) AS weight, CAST(rank AS INTEGER) AS rank FROM r""")
def tfidf_profiles(t):
    from pyspark.sql import Window
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    origin = t.documents.select(F.col("doc_id").alias("item"), F.explode(F.array("lang", "source")).alias("term"))
    both = (K.tfidf(doc_words(t), n).withColumn("block", F.lit("words")).unionByName(K.tfidf(origin, n).withColumn("block", F.lit("origin")))
            .withColumn("weight", F.round("weight", 9)))
    w = Window.partitionBy("block", "item").orderBy(F.desc("weight"), "term")
    return (both.withColumn("rank", F.row_number().over(w)).select("block", "item", "term", r4("weight").alias("weight"), "rank"))


@query("knn_graph", f"WITH {KNN_SQL} SELECT a, b, round(weight, 4) AS weight FROM edge")
def knn_graph(t):
    return K.knn_edges(K.knn(vectors(t), KNN, block_rows=BLOCK)).withColumn("weight", r4("weight"))


@query("cosine_topk", """WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
r AS (SELECT c.label AS id, vec_id AS other, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS sim FROM c, embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM r)
SELECT CAST(id AS BIGINT) AS id, other, round(sim, 4) AS sim, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6""")
def cosine_topk(t):
    mean = (t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.col("label").cast("long").alias("id"), F.col("s.m").alias("v")))
    return K.knn(vectors(t), 6, queries=mean, block_rows=BLOCK).select("id", "other", r4("sim").alias("sim"), "rank")


def _round(i):
    return f"""l{i + 1} AS (SELECT a AS id, arg_min(label, (-w, label)) AS label FROM (
  SELECT e.a, l.label, round(sum(weight), 9) AS w FROM both_ways e JOIN l{i} l ON l.id = e.b GROUP BY 1, 2) GROUP BY a)"""


ROUNDS = 5
LABELS = "l0 AS (SELECT DISTINCT a AS id, a AS label FROM both_ways), " + ", ".join(_round(i) for i in range(ROUNDS))


@query("communities", f"""WITH {KNN_SQL}, {LABELS},
size AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS position FROM l{ROUNDS} GROUP BY label)
SELECT l{ROUNDS}.id, CAST(position AS INTEGER) AS community, CAST(size AS BIGINT) AS size, l{ROUNDS}.label <> p.label AS changing
FROM l{ROUNDS} JOIN size USING (label) JOIN l{ROUNDS - 1} p ON p.id = l{ROUNDS}.id""")
def communities(t):
    labels = K.communities(K.knn_edges(K.knn(vectors(t), KNN, block_rows=BLOCK)), ROUNDS)
    return labels.join(K.ordered_communities(labels), "label").select("id", F.col("position").alias("community"), "size", "changing")


@query("regions")
def regions(t):
    """Communities of the neighbour graph by modularity at two resolutions, numbered from the largest; SQL has no word for their search."""
    edges = cut(K.knn_edges(K.knn(vectors(t), KNN, block_rows=BLOCK)))

    def numbered(resolution, name):
        labels = M.communities(edges, resolution)
        return labels.join(K.ordered_communities(labels), "label").select("id", F.col("position").alias(name), F.col("size").alias(f"{name}_size"))
    return numbered(0.6, "region").join(numbered(3.0, "constellation"), "id")


@query("cluster_features", f"""WITH {PART_TERMS}, m AS (SELECT s_suppkey AS item, s_nationkey AS cluster FROM supplier),
s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1), df AS (SELECT term, count(*) AS df FROM item_terms GROUP BY 1),
c AS (SELECT cluster, term, count(*) AS cnt FROM m JOIN item_terms USING (item) GROUP BY ALL),
r AS (SELECT cluster, term, cnt, round(cnt / size * ln((SELECT count(*) FROM m) / df), 9) AS score FROM c JOIN s USING (cluster) JOIN df USING (term) WHERE cnt >= greatest(2, size * 0.15)),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term DESC) AS rank FROM r)
SELECT cluster, term, CAST(cnt AS BIGINT) AS count, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6""")
def cluster_features(t):
    members = t.supplier.selectExpr("s_suppkey AS item", "s_nationkey AS cluster")
    return K.cluster_features(members, part_terms(t)).withColumn("score", r4("score"))


@query("cluster_modes", """WITH c AS (SELECT c_nationkey AS cluster, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c_mktsegment) AS k FROM c)
SELECT cluster, string_agg(c_mktsegment, ',' ORDER BY k) AS values FROM r WHERE k <= 3 GROUP BY 1""".replace("AS values", 'AS "values"'))
def cluster_modes(t):
    return K.top_modes(t.customer.selectExpr("c_nationkey AS cluster", "c_mktsegment"), "c_mktsegment").withColumn("values", F.array_join("values", ","))


@query("cluster_centers", """SELECT label AS cluster, CAST(i - 1 AS INTEGER) AS axis, round(median(CAST(x AS DOUBLE)), 4) AS center FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
def cluster_centers(t):
    return K.cluster_centers(t.embeddings.select(F.col("label").alias("cluster"), F.col("embedding").alias("v"))).withColumn("center", r4("center"))


@query("central_members", f"""WITH {KNN_SQL}, d AS (SELECT a AS id, round(sum(weight), 9) AS degree FROM both_ways GROUP BY 1),
r AS (SELECT label, id, degree, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS rank FROM d JOIN embeddings ON vec_id = id)
SELECT label, id, round(degree, 4) AS degree, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def central_members(t):
    edges = K.knn_edges(K.knn(vectors(t), KNN, block_rows=BLOCK))
    return K.central_members(t.embeddings.select(F.col("vec_id").alias("id"), "label"), edges).select("label", "id", r4("degree").alias("degree"), "rank")


@query("reduce_vectors")
def reduce_vectors(t):
    """First 10 principal components per vector; the basis is an eigen-decomposition SQL cannot express."""
    return K.reduce_vectors(vectors(t), 10).select("id", F.transform("reduced", lambda x: F.round(x, 4)).alias("reduced"))
