"""Stand-ins shared by several queries: the driver's tables read as items, terms, claims and reviews.

Each stand-in exists once as a DataFrame and once as the equivalent SQL text for the twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.strings import words
from evidra.tables import Tables


def part_terms(t: Tables) -> DataFrame:
    """item = supplier, term = part it ships."""
    return t.lineitem.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("term")).distinct()


PART_TERMS = """item_terms AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS term FROM lineitem)"""

IC = """term_ic AS (
  SELECT term, count(*) AS n_items, -ln(count(*) / (SELECT count(DISTINCT item) FROM item_terms)) AS ic
  FROM item_terms GROUP BY term),
weighted AS (SELECT item, term, n_items, ic FROM item_terms JOIN term_ic USING (term)),
totals AS (SELECT item, sum(ic) AS total FROM weighted GROUP BY item)"""

PAIR_SIMS = """shared AS (
  SELECT x.item AS a, y.item AS b, sum(x.ic) AS s FROM weighted x JOIN weighted y ON x.term = y.term AND x.item <> y.item
  GROUP BY 1, 2),
sims AS (
  SELECT a, b, CASE WHEN p.total + q.total - s > 0 THEN s / (p.total + q.total - s) ELSE 0 END AS sim
  FROM shared JOIN totals p ON p.item = a JOIN totals q ON q.item = b)"""

def doc_words(t: Tables) -> DataFrame:
    """item = document, term = distinct lower-case word."""
    return t.documents.select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(words("text"))).alias("term"))


DOC_WORDS = """item_terms AS (
  SELECT * FROM (SELECT doc_id AS item, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS term
                 FROM documents) WHERE term <> '')"""


def short_words(t: Tables) -> DataFrame:
    """item = part name, described by its own words, brand and type (small closed vocabularies)."""
    return (t.part.select(F.col("p_partkey").alias("item"),
                          F.explode(F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))).alias("term")).distinct())


def r4(column) -> "F.Column":
    return F.round(column, 4)
