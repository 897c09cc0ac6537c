"""Listings and work lists built on reviewed claims: best entry per key, shared records, people, work order, frontier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.vocab import lookup
from evidra.operators.linking import best_per_key, capped_list
from evidra.operators.review import ACCEPTED

# Fixed values
TRUST = {"reviewed": 1, "independently_reviewed": 2, "human_reviewed": 3}
KIND_ORDER = {"patient_organization": 0, "research_program": 1, "professional_network": 2, "information_service": 3, "company": 4}
SCOPE_ORDER = {"this_condition": 0, "this_gene": 1, "broader_group": 2}
PREVALENCE = {"<1 / 1 000 000": 0.5, "1-9 / 1 000 000": 1.0, "1-9 / 100 000": 2.0, "1-5 / 10 000": 3.0, "6-9 / 10 000": 3.5, ">1 / 1000": 4.0}
CERTAINTY = {"definitive": 1.0, "strong": 1.0, "moderate": 0.5, "limited": -1.0}


def best_listing(claims: DataFrame, keys: Sequence[str], *preferred: Column) -> DataFrame:
    """The display entry per key: most trusted review, then ``preferred``, then newest, then latest in the log.

    Rejected claims take part in the choice only through trust 0, and a key whose best entry is not accepted shows nothing.
    claims: status, created, seq.
    """
    trust = lookup(F.col("status"), TRUST, 0)
    rest = [c for c in claims.columns if c not in keys]
    best = claims.groupBy(*keys).agg(F.max(F.struct(trust.alias("_t"), *[p.alias(f"_p{i}") for i, p in enumerate(preferred)],
                                                    F.col("created").alias("_c"), F.col("seq").alias("_s"), F.struct(*rest).alias("_row"))).alias("b"))
    return best.select(*keys, "b._row.*").where(F.col("status").isin(*ACCEPTED))


def latest_wins(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest decision per key hides older ones, so a later rejection removes an earlier accepted entry."""
    return best_per_key(claims, list(keys), -F.col("seq")).where(F.col("status").isin(*ACCEPTED))


def ordered_page(listings: DataFrame, owner: str, n: int) -> DataFrame:
    """Listings of an owner in display order (kind, scope, own before inherited, name), first n with their position."""
    w = Window.partitionBy(owner).orderBy(lookup(F.col("kind"), KIND_ORDER, 9), lookup(F.col("scope"), SCOPE_ORDER, 9), F.col("via").isNotNull(), "name")
    return listings.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def shared_records(assets: DataFrame, near: DataFrame, owners: DataFrame, n: int = 3) -> DataFrame:
    """Routes between two owners that both list the same reviewed record of the same type, at most n partners per owner.

    assets: owner, record, type_rank, type. near: owner, partner, near_rank. owners: owner, gene, has_people.
    A partner of the same gene is no route. Order: type, near before far, near rank, with people first, record, partner.
    Near partners are found through the neighbour lists. For the others a record of a type makes up to one list for each has_people: its smallest ids, at
    most n of a gene and 2 n in all, which hold the n smallest of another gene whatever the owner's own is. An owner looks at its lists in order, up to the
    first that offers n partners: every list before it offers fewer than n, and none after it can win.
    """
    o = assets.join(owners, "owner").where("gene IS NOT NULL")
    me = o.select("owner", "record", "type", "type_rank", "gene")
    via_near = (me.join(near, "owner").join(o.select(F.col("owner").alias("partner"), "record", "type", F.col("gene").alias("p_gene"), F.col("has_people").alias("p_people")),
                                            ["partner", "record", "type"]).where("gene <> p_gene"))
    small = Window.partitionBy("record", "type", "has_people", "gene").orderBy("owner")
    first = Window.partitionBy("record", "type", "has_people").orderBy("owner")
    few = (o.select("record", "type", "has_people", "gene", "owner").distinct().withColumn("_r", F.row_number().over(small)).where(F.col("_r") <= n)
           .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 2 * n))
    lists = (few.groupBy("record", "type", "has_people").agg(F.array_sort(F.collect_list(F.struct("owner", "gene"))).alias("l"))
             .groupBy("record", "type").agg(F.collect_list(F.struct(F.col("has_people").alias("p_people"), "l")).alias("_lists")))
    offers = (me.distinct().join(lists, ["record", "type"]).select("owner", "gene", "record", "type_rank", F.explode("_lists").alias("x"))
              .withColumn("partners", F.filter("x.l", lambda p: p["gene"] != F.col("gene"))).where(F.size("partners") > 0)
              .select("owner", "record", "type_rank", "x.p_people", F.slice("partners.owner", 1, n).alias("partners"),
                      F.struct("type_rank", (~F.col("x.p_people")).alias("d"), "record").alias("_k")))
    stop = offers.where(F.size("partners") >= n).groupBy("owner").agg(F.min("_k").alias("_stop"))
    far = (offers.join(stop, "owner", "left").where(F.col("_stop").isNull() | (F.col("_k") <= F.col("_stop")))
           .select("owner", F.explode("partners").alias("partner"), "record", "type_rank", F.lit(None).cast(near.schema["near_rank"].dataType).alias("near_rank"), "p_people"))
    cols = ["owner", "partner", "record", "type_rank", "near_rank", "p_people"]
    rows = via_near.select(*cols).unionByName(far.select(*cols))  # a near partner's row among the far ones sorts behind its own
    rank = F.struct(F.col("type_rank").alias("a"), F.col("near_rank").isNull().alias("b"), F.coalesce("near_rank", F.lit(999)).alias("c"),
                    (~F.col("p_people")).alias("d"), F.col("record").alias("e"), F.col("partner").alias("f"))
    per_partner = rows.groupBy("owner", "partner").agg(F.min(F.struct(rank.alias("k"), "record")).alias("b"))
    w = Window.partitionBy("owner").orderBy("b.k")
    return (per_partner.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .select("owner", "partner", F.col("b.record").alias("record"), "pos"))


def shared_people(people: DataFrame, pairs: DataFrame, n: int = 4) -> DataFrame:
    """a, b, people: names (case-insensitive) working on both sides of each given pair, capped.

    people: topic, name, weight.
    """
    p = people.groupBy("topic", F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.max("weight").alias("weight"))
    both = (pairs.select("a", "b").join(p.select(F.col("topic").alias("a"), "key", "name", "weight"), "a")
            .join(p.select(F.col("topic").alias("b"), "key"), ["b", "key"], "left_semi"))
    return capped_list(both, ["a", "b"], "name", n, [F.desc("weight"), F.col("name")], "people")


def bridging_people(people: DataFrame, members: DataFrame, at_least: int = 2, n: int = 8) -> DataFrame:
    """grp, people: names that work on at least ``at_least`` topics of a group. members: grp, topic."""
    wide = (people.select("topic", F.lower("name").alias("key"), "name").join(members, "topic").groupBy("grp", "key")
            .agg(F.min("name").alias("name"), F.countDistinct("topic").alias("n_topics")).where(F.col("n_topics") >= at_least))
    return capped_list(wide, ["grp"], "name", n, [F.desc("n_topics"), F.col("name")], "people")


def impact_frontier(entities: DataFrame, n: int | None = 200) -> DataFrame:
    """Which entities to work on next: id, score, reasons, focus; the n highest by score, then id.

    entities: id, n_requests, n_terms, n_groups, n_studies, prevalence (class or null), strength, n_causing, recent, campaign.
    """
    c = F.col
    few = c("n_terms") < 5
    score = (F.when(c("campaign").isNotNull(), 4.0).otherwise(0.0) + 6 * F.log2(1 + c("n_requests").cast("double"))
             + F.when(c("n_terms") == 0, 4.0).when(few, 2.5).otherwise(0.0) + F.when(c("n_groups") == 0, 1.5).otherwise(0.0)
             + F.when(c("n_studies") == 0, 1.0).otherwise(0.0) + lookup(c("prevalence"), PREVALENCE, 0.0) + lookup(c("strength"), CERTAINTY, 0.0)
             + F.when((c("n_causing") >= 20) & few, 1.0).otherwise(0.0) - F.when(c("recent"), 3.0).otherwise(0.0))
    reasons = F.array_compact(F.array(
        F.when(c("campaign").isNotNull(), F.concat(F.lit("campaign "), c("campaign"))),
        F.when(c("n_requests") > 0, F.concat(c("n_requests").cast("string"), F.when(c("n_requests") == 1, " person asked").otherwise(" people asked"))),
        F.when(c("n_terms") == 0, "no terms recorded").when(few, F.concat(F.lit("only "), c("n_terms").cast("string"), F.lit(" terms"))),
        F.when(c("n_groups") == 0, "no group found"), F.when(c("n_studies") == 0, "no studies listed"),
        F.when(lookup(c("prevalence"), PREVALENCE).isNotNull(), F.concat(F.lit("affects "), c("prevalence"))),
        F.when((c("n_causing") >= 20) & few, "many known variants, little description"), F.when(c("recent"), "expanded recently")))
    focus = F.when(few, "symptoms").when(c("n_groups") == 0, "community").when(c("n_studies") == 0, "studies").otherwise("review")
    out = entities.select("id", F.round(score, 2).alias("score"), reasons.alias("reasons"), focus.alias("focus"))
    return out if n is None else out.orderBy(F.desc("score"), "id").limit(n)


def fair_batch(pending: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The next n work items, one per target: each target's best item, targets by priority, then fewest done, then id.

    pending: target, item, priority. done: target, n_done.
    """
    best = best_per_key(pending, ["target"], F.col("priority"), F.col("item"))
    return (best.join(done, "target", "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
            .orderBy("priority", "n_done", "target").limit(n))


def budget_prefix(batch: DataFrame, cost: str, cap: float, order: Sequence[Column]) -> DataFrame:
    """The leading items of an already limited batch whose running cost stays within the cap.

    The one-partition window is over the batch only; give it a limited batch such as fair_batch's.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batch.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= cap)


def task_list(reviews: DataFrame, scored: DataFrame, funded: DataFrame, n: int) -> DataFrame:
    """Review tasks first, then expansion tasks by funded campaign, impact score and id; the first n with their position.

    reviews: id (claims awaiting review), subject. scored: id, score, single_gene, requested. funded: id.
    """
    r = reviews.select(F.lit("review").alias("task"), F.col("id"), F.lit(0).alias("_k"), F.lit(0).alias("_f"), F.lit(0).alias("_s"), F.lit(0.0).alias("score"))
    e = (scored.join(funded.select("id").distinct().withColumn("_x", F.lit(0)), "id", "left")
         .select(F.lit("expand").alias("task"), "id", F.lit(1).alias("_k"), F.coalesce("_x", F.lit(1)).alias("_f"),
                 F.when(F.col("single_gene") | F.col("requested"), 0).otherwise(1).alias("_s"), "score"))
    top = r.unionByName(e).orderBy("_k", "_f", "_s", F.desc("score"), "id").limit(n)
    w = Window.orderBy("_k", "_f", "_s", F.desc("score"), "id")  # over the n rows of the list
    return top.withColumn("pos", F.row_number().over(w)).select("pos", "task", "id", "score")
