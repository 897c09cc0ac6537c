"""What reviews say about claims, assertions, contributors and reviewers.

Every "latest wins" step is an aggregate over (claim, family), so a claim with very many reviews is combined before the
shuffle. ``seq`` may be any orderable column, including a struct that breaks all ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.vocab import SUPPORTING, lookup, model_family
from evidra.operators.linking import capped_list

ACCEPTED = ("reviewed", "independently_reviewed", "human_reviewed")
STRONG = ("independently_reviewed", "human_reviewed")
# Risk tiers of predicates and the factor a level applies to the daily quota
MECHANISTIC = ("causes", "has_variant_effect", "interacts_with", "part_of_complex", "in_pathway", "involved_in")
THERAPEUTIC = ("tested_in",)
QUOTA_FACTOR = {"new": 1.0, "mixed": 1.0, "reliable": 2.0, "unreliable": 0.25}


def supports(verdict) -> Column:
    return verdict.isin(*SUPPORTING)


def _family(reviews: DataFrame) -> Column:
    fam = model_family(F.col("model_family"))
    return F.when(fam == "", F.col("reviewer").cast("string")).otherwise(fam)


def _decide(human, n_support, n_against, n_scope, n_families) -> Column:
    return (F.when(human.isNotNull(), F.when(supports(human), "human_reviewed").otherwise("rejected"))
            .when(n_families == 0, "unreviewed")
            .when((n_support > 0) & (n_against > 0), "review_disagreement")
            .when((n_against > 0) | (n_scope == n_families), "rejected")
            .when(n_support >= 2, "independently_reviewed").otherwise("reviewed"))


def review_status(reviews: DataFrame) -> DataFrame:
    """claim_id, status, n_families, n_reviews. Claims without reviews are absent: they are 'unreviewed'.

    reviews: claim_id, reviewer, reviewer_kind, model_family, verdict, seq. The latest human decides alone; otherwise the
    latest verdict of each model family counts once.
    """
    human = F.when(F.col("reviewer_kind") == "human", F.struct("seq", "verdict"))
    per_family = (reviews.withColumn("family", _family(reviews)).groupBy("claim_id", "family")
                  .agg(F.max(F.struct("seq", "verdict")).alias("last"), F.max(human).alias("human"), F.count(F.lit(1)).alias("n")))
    v = F.col("last.verdict")
    per_claim = per_family.groupBy("claim_id").agg(
        F.max("human").alias("human"), F.count_if(supports(v)).alias("n_support"),
        F.count_if(v == "does_not_support").alias("n_against"), F.count_if(v == "out_of_scope").alias("n_scope"),
        F.count(F.lit(1)).alias("n_families"), F.sum("n").alias("n_reviews"))
    return per_claim.select("claim_id", _decide(F.col("human.verdict"), F.col("n_support"), F.col("n_against"), F.col("n_scope"),
                                                F.col("n_families")).alias("status"), "n_families", "n_reviews")


def with_status(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    return (claims.join(review_status(reviews).select("claim_id", "status"), "claim_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("unreviewed"))))


def visible(policy: str, origin, status, predicate) -> Column:
    """Whether a view shows a claim: research hides only rejected ones; family asks more of riskier predicates."""
    if policy == "research":
        return status != "rejected"
    clean = ~status.isin("rejected", "review_disagreement")
    if policy == "strict":
        return clean & ((origin == "reference") | (status == "human_reviewed"))
    if policy == "family":
        enough = (F.when(predicate.isin(*THERAPEUTIC), status == "human_reviewed")
                  .when(predicate.isin(*MECHANISTIC), status.isin(*STRONG)).otherwise(status.isin(*ACCEPTED)))
        return clean & ((origin == "reference") | enough)
    raise ValueError(f"unknown policy {policy!r}")


# The labels that readers see
CONTESTED_LABEL, CURATED_LABEL, UNCHECKED_LABEL = "Contested: see both sides", "From a curated database", "Not yet checked"
STATUS_LABELS = {"human_reviewed": "Reviewed by an expert", "independently_reviewed": "Checked by two independent AI reviewers",
                 "reviewed": "Checked by an AI reviewer against its source"}


def plain_label(origin, status, contested) -> Column:
    """A contested claim says so first, a curated one names its kind of source, the others their review."""
    return F.when(contested, CONTESTED_LABEL).when(origin == "reference", CURATED_LABEL).otherwise(lookup(status, STATUS_LABELS, UNCHECKED_LABEL))


def source_key(evidence, contributor) -> Column:
    """What counts as one independent source: for each item of evidence the paper, else the archived source; without one the dataset of a
    curated database, the contributor as an expert, or the type; distinct, sorted and joined.

    evidence: array of struct type, source_id, pmid, dataset.
    """
    def one(e):
        return (F.when(e["source_id"].isNotNull(), F.coalesce(F.nullif(e["pmid"], F.lit("")), e["source_id"])).when(e["type"] == "curated_database", e["dataset"])
                .when(e["type"] == "expert_statement", F.concat(F.lit("expert:"), contributor)).otherwise(e["type"]))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(evidence, one))), "|")


def evidence_state(claims: DataFrame, contested: DataFrame) -> DataFrame:
    """assertion_id, state, independent_sources, human_reviewed, types ('type:count' over all items of evidence, most frequent first).

    claims: assertion_id, claim_id, origin, status, contributor, evidence (see ``source_key``). contested: assertion_id.
    """
    claims = claims.withColumn("source_key", source_key(F.col("evidence"), F.col("contributor").cast("string")))
    counted = (F.col("origin") == "reference") | ((F.col("origin") == "contributed") & F.col("status").isin(*STRONG))
    flagged = claims.withColumn("_counted", counted)
    base = flagged.groupBy("assertion_id").agg(
        F.bool_or(F.col("origin") == "reference").alias("curated"), F.bool_or(F.col("status") == "human_reviewed").alias("human_reviewed"),
        F.countDistinct(F.when(F.col("_counted"), F.col("source_key"))).alias("independent_sources"))
    items = flagged.where("_counted").select("assertion_id", F.explode(F.transform("evidence", lambda e: e["type"])).alias("evidence_type"))
    types = (items.groupBy("assertion_id", "evidence_type").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("assertion_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("evidence_type").alias("type")))).alias("t"))
             .select("assertion_id", F.transform("t", lambda x: F.concat(x["type"], F.lit(":"), (-x["neg"]).cast("string"))).alias("types")))
    flags = contested.select("assertion_id").distinct().withColumn("_contested", F.lit(True))
    return (base.join(types, "assertion_id", "left").join(flags, "assertion_id", "left")
            .select("assertion_id",
                    F.when(F.col("_contested"), "contested").when(F.col("curated"), "curated")
                    .when(F.col("independent_sources") >= 2, "multiple_independent_sources")
                    .when(F.col("independent_sources") == 1, "single_source").otherwise("unsupported").alias("state"),
                    "independent_sources", "human_reviewed", F.coalesce("types", F.array().cast("array<string>")).alias("types")))


def level(accepted, rejected) -> Column:
    judged = accepted + rejected
    rate = F.try_divide(accepted, judged)
    return (F.when(judged < 5, "new").when(rate < 0.5, "unreliable").when(rate < 0.8, "mixed")
            .when(judged >= 10, "reliable").otherwise("new"))


def earned_quota(base: int, lvl) -> Column:
    factor = F.coalesce(*[F.when(lvl == k, F.lit(v)) for k, v in QUOTA_FACTOR.items()])
    return F.greatest(F.lit(5), F.bround(F.lit(base) * factor).cast("int"))


def track_records(claims: DataFrame, reviews: DataFrame, challenges: DataFrame, base_quota: int = 20, n_recent: int = 10) -> DataFrame:
    """One row per actor: what became of the contributed claims, reviews given, challenges made, the latest claims (newest first), level and quota.

    claims: claim_id (long), assertion_id, contributor, origin, kernel_ok, seq. challenges: target (claim or assertion id), challenger.
    """
    mine = with_status(claims.where("origin = 'contributed'"), reviews)
    targets = challenges.select("target").distinct()
    by_claim = targets.select(F.col("target").alias("claim_id"), F.lit(True).alias("_c1"))
    by_assertion = targets.select(F.col("target").alias("assertion_id"), F.lit(True).alias("_c2"))
    mine = mine.join(by_claim, "claim_id", "left").join(by_assertion, "assertion_id", "left")
    ok = F.col("kernel_ok")
    status = F.col("status")
    out = mine.groupBy("contributor").agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(~ok).alias("quote_failed"),
        F.count_if(ok & status.isin(*ACCEPTED)).alias("accepted"), F.count_if(ok & (status == "rejected")).alias("rejected"),
        F.count_if(ok & (status == "review_disagreement")).alias("disputed"), F.count_if(ok & (status == "unreviewed")).alias("pending"),
        F.count_if(F.col("_c1").isNotNull() | F.col("_c2").isNotNull()).alias("challenged"))
    given = reviews.groupBy(F.col("reviewer").alias("contributor")).agg(F.count(F.lit(1)).alias("reviews_given"))
    made = challenges.groupBy(F.col("challenger").alias("contributor")).agg(F.count(F.lit(1)).alias("challenges_made"))
    recent = recent_per_actor(mine, "contributor", "claim_id", [F.desc("seq")], n_recent, "recent")
    out = (out.join(given, "contributor", "full").join(made, "contributor", "full")
           .na.fill(0).join(recent, "contributor", "left").withColumn("recent", F.coalesce("recent", F.array().cast("array<bigint>"))))
    lvl = level(F.col("accepted"), F.col("rejected"))
    return out.withColumn("level", lvl).withColumn("quota", earned_quota(base_quota, F.col("level")))


def recent_per_actor(claims: DataFrame, actor: str, item: str, order: list[Column], n: int = 10, name: str | None = None) -> DataFrame:
    """actor, items: the latest n items of each actor, newest first."""
    return capped_list(claims, [actor], item, n, order, name) if name else capped_list(claims, [actor], item, n, order)


def reviewer_agreement(reviews: DataFrame, at_least: int = 3) -> DataFrame:
    """reviewer, given, compared, agreed, agreement: each verdict against the status the *other* reviewers give the claim.

    Leaving one reviewer out only changes the families (and the human decision) where that reviewer is the latest, so the
    status without them is the claim's totals plus a correction: no self-join of the reviews.
    """
    rows = reviews.withColumn("family", _family(reviews))

    def latest_two(df: DataFrame, keys: list[str]) -> DataFrame:
        """keys..., r1, v1, v2: the latest verdict and its reviewer, and the latest of any other reviewer."""
        own = df.groupBy(*keys, "reviewer").agg(F.max(F.struct("seq", "verdict")).alias("last"))
        pos = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last.seq"), "reviewer"))
        return (own.withColumn("pos", pos).where(F.col("pos") <= 2).groupBy(*keys)
                .agg(F.max(F.when(F.col("pos") == 1, F.col("reviewer"))).alias("r1"),
                     F.max(F.when(F.col("pos") == 1, F.col("last.verdict"))).alias("v1"),
                     F.max(F.when(F.col("pos") == 2, F.col("last.verdict"))).alias("v2")))

    def tally(verdict, name):
        return [F.count_if(supports(verdict)).alias(f"{name}_s"), F.count_if(verdict == "does_not_support").alias(f"{name}_a"),
                F.count_if(verdict == "out_of_scope").alias(f"{name}_o"), F.count(verdict).alias(f"{name}_n")]

    families = latest_two(rows, ["claim_id", "family"])
    totals = families.groupBy("claim_id").agg(*tally(F.col("v1"), "t"))
    fix = families.groupBy("claim_id", F.col("r1").alias("reviewer")).agg(*tally(F.col("v1"), "m"), *tally(F.col("v2"), "p"))
    humans = latest_two(rows.where("reviewer_kind = 'human'"), ["claim_id"]).select(
        "claim_id", F.col("r1").alias("h_r"), F.col("v1").alias("h_1"), F.col("v2").alias("h_2"))
    given = rows.groupBy("claim_id", "reviewer", "verdict").agg(F.count(F.lit(1)).alias("n"))
    alone = rows.groupBy("claim_id").agg((F.min("reviewer") == F.max("reviewer")).alias("alone"))
    joined = (given.join(alone, "claim_id").join(totals, "claim_id").join(fix, ["claim_id", "reviewer"], "left").join(humans, "claim_id", "left"))

    def without(x):
        return F.col(f"t_{x}") - F.coalesce(f"m_{x}", F.lit(0)) + F.coalesce(f"p_{x}", F.lit(0))
    human = F.when(F.col("h_r") == F.col("reviewer"), F.col("h_2")).otherwise(F.col("h_1"))
    status = F.when(F.col("alone"), "unreviewed").otherwise(_decide(human, without("s"), without("a"), without("o"), without("n")))
    agrees = F.when(status.isin(*ACCEPTED), supports(F.col("verdict"))).when(status == "rejected", ~supports(F.col("verdict")))
    judged = joined.withColumn("agrees", agrees)
    out = judged.groupBy("reviewer").agg(
        F.sum("n").alias("given"), F.sum(F.when(F.col("agrees").isNotNull(), F.col("n")).otherwise(0)).alias("compared"),
        F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)).alias("agreed"))
    return out.withColumn("agreement", F.when(F.col("compared") >= at_least, F.round(F.col("agreed") / F.col("compared"), 2)))


def review_queue(claims: DataFrame, reviews: DataFrame, family: str, me, n: int | None = None) -> DataFrame:
    """Checked claims of others that neither my model family nor a person has reviewed, while their status is open.

    claims: claim_id, contributor, kernel_ok, seq.
    """
    taken = reviews.where((_family(reviews) == family) | (F.col("reviewer_kind") == "human")).select("claim_id")
    todo = (with_status(claims.where(F.col("kernel_ok") & (F.col("contributor") != F.lit(me))), reviews)
            .where(F.col("status").isin("unreviewed", "reviewed")).join(taken, "claim_id", "left_anti"))
    return todo if n is None else todo.orderBy("seq", "claim_id").limit(n)


def expert_queue(claims: DataFrame, reviews: DataFrame, n: int = 60) -> DataFrame:
    """The latest n checked claims that no person has reviewed, with their status."""
    human = reviews.where("reviewer_kind = 'human'").select("claim_id")
    latest = (claims.where("kernel_ok").join(human, "claim_id", "left_anti").orderBy(F.desc("seq"), F.desc("claim_id")).limit(n))
    # the queue is at most n rows: only its own reviews are rolled up
    return with_status(latest, reviews.join(latest.select("claim_id"), "claim_id", "left_semi"))


def cross_person_eligible(reviews: DataFrame, claims: DataFrame, persons: DataFrame) -> DataFrame:
    """Reviews that count as independent: another person and another model family than the claim's contributor.

    persons: agent, person (an agent without a row is its own person). claims: claim_id, contributor, family.
    """
    who = persons.select("agent", "person")
    r = (reviews.withColumn("_family", _family(reviews)).join(who.toDF("reviewer", "_rp"), "reviewer", "left")
         .withColumn("_rp", F.coalesce("_rp", F.col("reviewer").cast("string"))))
    c = (claims.select("claim_id", "contributor", F.col("family").alias("_cf")).join(who.toDF("contributor", "_cp"), "contributor", "left")
         .withColumn("_cp", F.coalesce("_cp", F.col("contributor").cast("string"))))
    return (r.join(c, "claim_id").where((F.col("_rp") != F.col("_cp")) & (F.col("_family") != F.col("_cf")))
            .select("claim_id", "reviewer", F.col("_rp").alias("person"), "verdict"))
