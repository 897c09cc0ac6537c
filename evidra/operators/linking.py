"""Bringing records of several sources onto one set of ids.

"First" and "best" choices are min_by / max_by aggregates (combined before the shuffle), not windows over whole groups;
lists are cut to their cap by rank before they are collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.strings import capitalised, plain
from evidra.functions.vocab import best_strength
from evidra.session import dealt


def capped_list(df: DataFrame, by: Sequence[str], value: str, n: int, order: Sequence[Column] | None = None,
                name: str = "items") -> DataFrame:
    """by..., name: at most n values per group in order (sorted distinct values by default). Ranked before collecting, so lists stay short."""
    rows = df.where(F.col(value).isNotNull())
    if not order:
        order, rows = [F.col(value)], rows.select(*by, value).distinct()
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return (ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("_v")))).alias("_l"))
            .select(*by, F.col("_l._v").alias(name)))


def best_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The row with the smallest ``order`` tuple per key, as one partially combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [o.alias(f"_{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranks, F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(*keys, "_b._row.*")


def resolve_ids(rows: DataFrame, column: str, primary: DataFrame, xref: DataFrame, alt: DataFrame | None = None) -> DataFrame:
    """Adds resolved and how: the id itself when known, else its exact cross-reference; old ids map to current ones.

    primary: id. xref: xref, id (several ids per xref: the smallest wins). alt: alt, id.
    """
    known = primary.select(F.col("id").alias(column)).distinct().withColumn("_known", F.lit(True))
    by_xref = xref.groupBy(F.col("xref").alias(column)).agg(F.min("id").alias("_xid"))
    out = (rows.join(known, column, "left").join(by_xref, column, "left")
           .withColumn("resolved", F.when(F.col("_known"), F.col(column)).otherwise(F.col("_xid")))
           .withColumn("how", F.when(F.col("_known"), "primary").when(F.col("_xid").isNotNull(), "xref").otherwise("missing"))
           .drop("_known", "_xid"))
    if alt is not None:
        current = alt.groupBy(F.col("alt").alias("resolved")).agg(F.min("id").alias("_current"))
        out = out.join(current, "resolved", "left").withColumn("resolved", F.coalesce("_current", "resolved")).drop("_current")
    return out


def symbol_index(approved: DataFrame, aliases: DataFrame) -> DataFrame:
    """symbol (lower case), id, kind: an approved symbol beats an alias; within a kind the row that stands first in its table wins.

    approved, aliases: symbol, id, pos (place in the table).
    """
    rows = (approved.select(F.lower("symbol").alias("symbol"), "id", "pos", F.lit(0).alias("priority"))
            .unionByName(aliases.select(F.lower("symbol").alias("symbol"), "id", "pos", F.lit(1).alias("priority"))))
    return (rows.groupBy("symbol").agg(F.min(F.struct("priority", "pos", "id")).alias("b"))
            .select("symbol", "b.id", F.when(F.col("b.priority") == 0, "approved").otherwise("alias").alias("kind")))


def integrate_links(sources: Sequence[DataFrame], diseases: DataFrame, genes: DataFrame, resubmitted: Sequence[str] = ()) -> DataFrame:
    """Union of source links (disease, gene, source, strength, ref) whose both ends are known and strength is graded.

    A source that gathers others' links names the ``submitter`` of each; those ``resubmitted`` are skipped, as the submitter's own
    source brings them. Where a source has no such column its links are its own.
    """
    links = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).where("strength <> 'none'")
    if "submitter" in links.columns:
        links = links.where(F.col("submitter").isNull() | ~F.col("submitter").isin(*resubmitted)).drop("submitter")
    return (links.join(diseases.select("disease").distinct(), "disease", "left_semi")
            .join(genes.select("gene").distinct(), "gene", "left_semi"))


def evidence_rollup(links: DataFrame, n_refs: int = 5) -> DataFrame:
    """disease, gene, strength (best), n_evidence, refs (sorted, capped)."""
    best = links.groupBy("disease", "gene").agg(best_strength(F.col("strength")).alias("strength"), F.count(F.lit(1)).alias("n_evidence"))
    refs = capped_list(links, ["disease", "gene"], "ref", n_refs, name="refs")
    return best.join(refs, ["disease", "gene"], "left")


def weighted_vote(votes: DataFrame) -> DataFrame:
    """id, value, votes: the value with most weight; ties go to the value inserted first.

    votes: id, value, weight, position (insertion order).
    """
    per_value = votes.groupBy("id", "value").agg(F.sum("weight").alias("votes"), F.min("position").alias("position"))
    return (per_value.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "position", "value")).alias("b"))
            .select("id", "b.value", (-F.col("b.v")).alias("votes")))


def overlay_claims(base: DataFrame, claims: DataFrame, entities: DataFrame, n_sources: int = 6, n_refs: int = 5) -> DataFrame:
    """Base profile plus accepted contributed claims; a claim names an entity or the node above several entities.

    base: item, term, source, ref, frequency. claims: subject, term, source, ref, frequency, claim_id. entities: item, node.
    Returns item, term, contributed (whether a claim adds to it), sources, refs (the first ``n_refs`` in order), frequency (the base's, else that
    of the first claim that gives one) and n_claims; the claims themselves are ``claim_targets``. ``base`` may repeat its rows.

    Rows of a term at an item meet in one task, once: every list and figure is read there, in the order of sources, of refs and of claims.
    """
    rows = (base.select("item", "term", "source", "ref", "frequency", F.lit(None).cast("long").alias("claim_id"))
            .unionByName(claim_targets(claims, entities)))
    at = Window.partitionBy("item", "term")
    by_claim = at.orderBy("claim_id")
    every = by_claim.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = {c: F.dense_rank().over(at.orderBy(F.col(c).asc_nulls_last())) for c in ("source", "ref")}
    given = F.coalesce(F.col("frequency"), F.lit("")) != ""
    # a list is cut to its cap by rank before it is collected, so lists stay short
    first = {c: F.collect_set(F.when(F.col(f"_{c}") <= n, F.col(c))).over(every) for c, n in (("source", n_sources), ("ref", n_refs))}
    read = (dealt(rows, "item", "term", of=(base, claims)).select("*", *(r.alias(f"_{c}") for c, r in place.items()))
            .select("item", "term", first["source"].alias("sources"), first["ref"].alias("refs"),
                    F.min(F.when(given, F.struct("claim_id", "frequency"))).over(every)["frequency"].alias("frequency"),
                    F.count(F.lit(1)).over(every).alias("_rows"), F.count("claim_id").over(every).alias("_claimed"),
                    F.row_number().over(by_claim).alias("_at"), F.dense_rank().over(by_claim).cast("long").alias("_ids")))
    last = read.where("_at = _rows")  # here _ids counts the different claim_ids, the null of the base as one
    return last.select("item", "term", (F.col("_claimed") > 0).alias("contributed"), (F.col("_ids") - (F.col("_claimed") < F.col("_rows")).cast("long")).alias("n_claims"),
                       F.coalesce("frequency", F.lit("")).alias("frequency"), F.array_sort("sources").alias("sources"),
                       F.when(F.size("refs") > 0, F.array_sort("refs")).alias("refs"))


def claim_targets(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """item, term, source, ref, frequency, claim_id: every claim at each entity that it reaches."""
    direct = entities.select(F.col("item").alias("subject"), "item").distinct()
    below = entities.select(F.col("node").alias("subject"), "item").distinct().join(direct.select("subject").hint("merge"), "subject", "left_anti")
    return claims.join(direct.unionByName(below).hint("merge"), "subject").select("item", "term", "source", "ref", "frequency", "claim_id")


def id_overlap(variants: DataFrame, keys: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """variant, condition: the variant's ids and the condition's ids meet, within one gene, generic ids ignored.

    variants: variant, gene, ids (array). keys: condition, gene, id.
    """
    ids = variants.select("variant", "gene", F.explode("ids").alias("id"))
    if generic:
        ids = ids.where(~F.col("id").isin(*generic))
    return ids.join(keys, ["gene", "id"]).select("variant", "condition").distinct()


def resolve_terms(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Exact normalised name first (confidence 1.0), then without a final s (0.98). mentions: mention; names: name, id."""
    index = names.select(plain("name").alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
    keyed = mentions.select("mention", plain("mention").alias("key"))
    singular = F.when(F.col("key").endswith("s"), F.expr("substring(key, 1, length(key) - 1)"))
    return (keyed.withColumn("key2", singular)
            .join(index.toDF("key", "id1"), "key", "left").join(index.toDF("key2", "id2"), "key2", "left")
            .select("mention", F.coalesce("id1", "id2").alias("id"),
                    F.when(F.col("id1").isNotNull(), 1.0).when(F.col("id2").isNotNull(), 0.98).otherwise(0.0).alias("confidence")))


def ordered_names(names: DataFrame, n: int = 15) -> DataFrame:
    """id, title, others: case-insensitive distinct names in order; the first is capitalised.

    names: id, pos, name.
    """
    firsts = (names.groupBy("id", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("f"))
              .select("id", F.col("f.pos").alias("pos"), F.col("f.name").alias("name")))
    listed = capped_list(firsts, ["id"], "name", n + 1, [F.col("pos"), F.col("name")], "names")
    return listed.select("id", capitalised(F.col("names")[0]).alias("title"), F.slice("names", 2, n).alias("others"))


def gather_refs(claims: DataFrame, n: int = 30) -> DataFrame:
    """id, refs: references of every claim that touches the id as subject or object, first seen first, capped.

    claims: subject, object, seq, refs (array).
    """
    touched = (claims.select(F.col("subject").alias("id"), "seq", "refs").unionByName(claims.select(F.col("object").alias("id"), "seq", "refs")))
    rows = touched.select("id", "seq", F.posexplode("refs").alias("pos", "ref"))
    firsts = rows.groupBy("id", "ref").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return capped_list(firsts, ["id"], "ref", n, [F.col("at"), F.col("ref")], "refs")
