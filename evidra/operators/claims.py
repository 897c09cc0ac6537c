"""Claims and their log: validation with a reason, challenges, aliases, quotas, rechecks, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.strings import id_kind, one_space
from evidra.operators.linking import capped_list
from evidra.operators.review import STRONG, review_status
from evidra.session import cut

# Predicate -> (subject kinds, object kinds, qualifiers)
PREDICATES = {
    "causes": (["gene"], ["condition"], ["inheritance"]),
    "has_variant_effect": (["condition"], ["effect"], ["gene", "variant_class", "certainty"]),
    "has_symptom": (["condition"], ["phenotype"], ["frequency", "onset", "population", "evidence_level", "certainty"]),
    "has_name": (["condition"], ["text"], ["name_type", "naming_source"]),
    "part_of_complex": (["gene"], ["complex"], []),
    "in_pathway": (["gene"], ["pathway"], []),
    "involved_in": (["gene"], ["go_term"], []),
    "interacts_with": (["gene"], ["gene"], ["score", "species", "evidence_level", "certainty"]),
    "has_asset": (["condition"], ["trial", "asset"], ["asset_type", "status"]),
    "represented_by": (["condition"], ["organization"], ["org_type", "scope", "name", "homepage"]),
    "same_organization_as": (["organization"], ["organization"], []),
    "studied_by": (["condition"], ["person"], ["role"]),
    "tested_in": (["intervention"], ["condition"], ["species", "model_system", "evidence_level", "outcome", "certainty"]),
    "has_prevalence": (["condition"], ["text"], ["prevalence_kind", "geography"]),
}
# Qualifiers with a closed domain
QUALIFIER_DOMAINS = {
    "variant_class": ["missense", "truncating", "splice", "deletion", "duplication", "any"],
    "evidence_level": ["clinical", "case_report", "preclinical", "in_vitro", "computational", "curated"],
    "species": ["human", "mouse", "rat", "zebrafish", "fly", "worm", "yeast", "cell"],
    "outcome": ["improved", "no_effect", "worsened", "mixed", "unknown"],
    "certainty": ["asserted", "suggested", "speculative"],
    "name_type": ["preferred", "curated_name", "synonym", "obsolete_label"],
    "asset_type": ["registry", "natural_history_study", "model", "biomarker", "outcome_measure", "biorepository", "therapy_program", "trial", "guideline"],
    "org_type": ["patient_organization", "research_program", "information_service", "professional_network", "company"],
    "scope": ["this_condition", "this_gene", "broader_group"],
}
# Evidence type -> fields it must carry
EVIDENCE_FIELDS = {
    "publication_text": ["source_id", "quote", "start", "end"], "trial_record": ["source_id", "quote", "start", "end"],
    "organization_page": ["source_id", "quote", "start", "end"], "community_report": ["source_id", "quote", "start", "end"],
    "curated_database": ["dataset", "dataset_hash", "record"], "computed": ["recipe", "inputs"], "expert_statement": ["statement"],
}


def schema_check(claims: DataFrame) -> DataFrame:
    """Adds ``reason``: the first rule a claim breaks, or null.

    claims: subject, predicate, object, qualifiers (map), evidence (array of structs with ``type`` and a ``fields`` array of
    the field names present), contributor, agent, created.
    """
    spark = claims.sparkSession
    rules = spark.createDataFrame([(p, *r) for p, r in PREDICATES.items()],
                                  "predicate string, _subjects array<string>, _objects array<string>, _allowed array<string>")
    domains = F.create_map(*[x for k, v in QUALIFIER_DOMAINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    needs = F.create_map(*[x for k, v in EVIDENCE_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    joined = claims.join(F.broadcast(rules), "predicate", "left")  # a fixed table of 14 rows
    keys = F.map_keys("qualifiers")
    text_object = F.array_contains("_objects", "text")
    bad_value = F.exists(F.map_entries("qualifiers"), lambda e: F.coalesce(
        ~F.array_contains(F.try_element_at(domains, e["key"]), e["value"]), F.lit(False)))
    reason = F.coalesce(
        F.when(F.col("_subjects").isNull(), "unknown predicate"),
        F.when(~F.coalesce(F.array_contains("_subjects", id_kind(F.col("subject"))), F.lit(False)), "subject kind"),
        F.when(text_object & ((F.trim(F.coalesce("object", F.lit(""))) == "") | (F.length("object") > 500)), "text object"),
        F.when(~text_object & ~F.coalesce(F.array_contains("_objects", id_kind(F.col("object"))), F.lit(False)), "object kind"),
        F.when(F.size(F.array_except(keys, F.col("_allowed"))) > 0, "qualifier not allowed"),
        F.when(bad_value, "qualifier value"),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no evidence"),
        F.when(F.exists("evidence", lambda e: F.try_element_at(needs, e["type"]).isNull()), "evidence type"),
        F.when(F.exists("evidence", lambda e: F.size(F.array_except(F.try_element_at(needs, e["type"]), e["fields"])) > 0), "evidence fields"),
        *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"provenance {c}") for c in ("contributor", "agent", "created")])
    return joined.withColumn("reason", reason).drop("_subjects", "_objects", "_allowed")


def missing_ids(references: DataFrame, registries: dict[str, DataFrame], composites: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``exists``: true / false for kinds with a registry, null (cannot tell, so passes) for the others.

    A kind in ``composites`` joins two registered ids with the first hyphen: its first half must exist, and so must the second where
    there is one. references: kind, id. registries: kind -> DataFrame(id).
    """
    if composites:
        is_pair = F.col("kind").isin(*composites)
        left, right = F.substring_index("id", "-", 1), F.expr("CASE WHEN locate('-', id) > 0 THEN substring(id, locate('-', id) + 1) END")
        pairs = references.where(is_pair).select("kind", "id").distinct()
        parts = None
        for kind, (first, second) in composites.items():
            mine = pairs.where(F.col("kind") == kind)
            rows = (mine.select(F.col("kind").alias("of"), F.col("id").alias("whole"), F.lit(first).alias("kind"), left.alias("id"))
                    .unionByName(mine.where(right.isNotNull() & (right != "")).select(F.col("kind").alias("of"), F.col("id").alias("whole"), F.lit(second).alias("kind"), right.alias("id"))))
            parts = rows if parts is None else parts.unionByName(rows)
        whole = (missing_ids(parts, registries).groupBy(F.col("of").alias("kind"), F.col("whole").alias("id"))
                 .agg(F.bool_and("exists").alias("exists")))
        single = missing_ids(references.where(~is_pair), registries)
        return single.unionByName(references.where(is_pair).join(whole, ["kind", "id"], "left"), allowMissingColumns=True)
    known = None
    for kind, ids in registries.items():
        rows = ids.select(F.lit(kind).alias("kind"), "id").distinct()
        known = rows if known is None else known.unionByName(rows)
    return (references.join(known.withColumn("_hit", F.lit(True)), ["kind", "id"], "left")
            .withColumn("exists", F.when(F.col("kind").isin(*registries), F.coalesce("_hit", F.lit(False)))).drop("_hit"))


def import_summary(checked: DataFrame, n: int = 10) -> DataFrame:
    """part, key, n: accepted distinct ids, rejected rows, and the n most frequent rejection reasons.

    checked: claim_id, reason (null when accepted).
    """
    by_reason = checked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    accepted = checked.where("reason IS NULL").agg(F.countDistinct("claim_id").alias("n")).select(F.lit("accepted").alias("part"), F.lit("").alias("key"), "n")
    rejected = by_reason.where("reason IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("rejected").alias("part"), F.lit("").alias("key"), "n")
    top = by_reason.where("reason IS NOT NULL").orderBy(F.desc("n"), "reason").limit(n).select(F.lit("reason").alias("part"), F.col("reason").alias("key"), "n")
    return accepted.unionByName(rejected).unionByName(top)


def disputes(challenges: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """assertion_id, status, n_objections: contested once a checked counter-claim is strongly reviewed, else pending.

    challenges: target (a claim id or an assertion id), counter_claim. claims: claim_id, assertion_id, kernel_ok.
    """
    ok = claims.where("kernel_ok")
    by_claim = challenges.join(ok.select(F.col("claim_id").alias("target"), "assertion_id"), "target").select("assertion_id", "counter_claim")
    by_assertion = (challenges.join(ok.select(F.col("assertion_id").alias("target")).distinct(), "target", "left_semi")
                    .select(F.col("target").alias("assertion_id"), "counter_claim"))
    strong = (ok.select("claim_id").join(review_status(reviews).where(F.col("status").isin(*STRONG)), "claim_id", "left_semi")
              .select(F.col("claim_id").alias("counter_claim"), F.lit(True).alias("_strong")).distinct())
    return (by_claim.unionByName(by_assertion).join(strong, "counter_claim", "left").groupBy("assertion_id")
            .agg(F.when(F.bool_or(F.coalesce("_strong", F.lit(False))), "contested").otherwise("pending_review").alias("status"),
                 F.count(F.lit(1)).alias("n_objections")))


def accepted_links(assertions: DataFrame, accepted: Sequence[str] = ("reviewed", "independently_reviewed", "human_reviewed")) -> DataFrame:
    """alias, target of the identity claims that may be applied: of each (alias, target) the claim with the latest review decides, contested
    and unreviewed claims do not take part, and the deciding one must be accepted.

    assertions: alias, target, seq (of the last review, null if there is none), status, contested.
    """
    latest = (assertions.where(F.col("seq").isNotNull() & ~F.coalesce("contested", F.lit(False))).groupBy("alias", "target")
              .agg(F.max(F.struct("seq", "status")).alias("m")))
    return latest.where(F.col("m.status").isin(*accepted)).select("alias", "target")


def resolve_aliases(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """alias, target, hops: follow unique links to the end; ambiguous ends and cycles stay unresolved.

    links: alias, target. Pointer jumping: after round r every alias within 2**r hops of its end has arrived. As long as
    an unfinished chain that ends remains, each round finishes at least one alias; a round that finishes none leaves cycles.
    """
    links = links.where("alias <> target").distinct()
    degree = links.groupBy("alias").agg(F.count(F.lit(1)).alias("d"), F.min("target").alias("target"))
    jump = cut(degree.where("d = 1").select("alias", F.col("target").alias("cur"), F.lit(1).cast("long").alias("hops")))
    sources = cut(degree.select(F.col("alias").alias("cur"), (F.col("d") > 1).alias("ambiguous")))
    # an alias is finished when its current target has no outgoing unique link
    state = cut(jump.join(sources, "cur", "left").select("alias", "cur", "hops", F.coalesce(~F.col("ambiguous"), F.lit(False)).alias("moving")))
    moving = state.where("moving").count()
    for _ in range(max_rounds):
        if moving == 0:
            break
        nxt = state.select(F.col("alias").alias("cur"), F.col("cur").alias("n_cur"), F.col("hops").alias("n_hops"), F.col("moving").alias("n_moving"))
        state = cut(state.join(nxt, "cur", "left")
                    .select("alias", F.when(F.col("moving"), F.col("n_cur")).otherwise(F.col("cur")).alias("cur"),
                            F.when(F.col("moving"), F.col("hops") + F.col("n_hops")).otherwise(F.col("hops")).alias("hops"),
                            (F.col("moving") & F.coalesce("n_moving", F.lit(False))).alias("moving")))
        left = state.where("moving").count()
        if left == moving:
            break
        moving = left
    return (state.where("NOT moving").join(sources.select("cur"), "cur", "left_anti")
            .select("alias", F.col("cur").alias("target"), "hops"))


def scope_fanout(listings: DataFrame, entities: DataFrame) -> DataFrame:
    """A listing of scope 'this_gene' applies to every entity of the gene (``via`` says where it came from).

    listings: subject, listing, scope. entities: item, gene.
    """
    own = listings.select(F.col("subject").alias("item"), "listing", F.lit(None).cast("long").alias("via"))
    wide = (listings.where("scope = 'this_gene'").join(entities.select(F.col("item").alias("subject"), "gene"), "subject")
            .join(entities.select("item", "gene"), "gene").where("item <> subject").select("item", "listing", F.col("subject").alias("via")))
    return own.unionByName(wide)


def scope_counts(listings: DataFrame, entities: DataFrame) -> DataFrame:
    """item, n_listings, n_via of every entity that any listing reaches, as ``scope_fanout`` would list them, without writing them out:
    the listings of a gene are counted once and an entity's own are taken off."""
    own = listings.groupBy(F.col("subject").alias("item")).agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("scope") == "this_gene").alias("own_wide"))
    mine = entities.join(own, "item", "left")
    by_gene = mine.groupBy("gene").agg(F.coalesce(F.sum("own_wide"), F.lit(0)).alias("wide"))
    via = F.col("wide") - F.coalesce("own_wide", F.lit(0))
    counted = mine.join(by_gene, "gene").select("item", (F.coalesce("own", F.lit(0)) + via).alias("n_listings"), via.alias("n_via"))
    return counted.where("n_listings > 0")


def latest_checks(rechecks: DataFrame) -> DataFrame:
    """claim_id, check, result, checked: the latest of every kind of recheck. rechecks: claim_id, check, result, checked, seq."""
    return (rechecks.groupBy("claim_id", "check").agg(F.max(F.struct("seq", "result", "checked")).alias("m"))
            .select("claim_id", "check", "m.result", "m.checked"))


def not_superseded(claims: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Claims whose cited source has not been retracted."""
    gone = latest_checks(rechecks.where("check = 'retraction'")).where("result = 'retracted'")
    return claims.join(gone, "claim_id", "left_anti")


def recheck_due(claims: DataFrame, rechecks: DataFrame, today: Column, days: int = 30, n: int = 15) -> DataFrame:
    """The n claims whose page check is oldest (never checked first), at least ``days`` old: claim_id, age."""
    last = latest_checks(rechecks.where("check = 'page'")).select("claim_id", "checked")
    aged = (claims.join(last, "claim_id", "left")
            .withColumn("age", F.coalesce(F.datediff(today, "checked"), F.lit(10000))).where(F.col("age") >= days))
    return aged.orderBy(F.desc("age"), "claim_id").limit(n).select("claim_id", "age")


def status_drift(recorded: DataFrame, current: DataFrame, days: int) -> DataFrame:
    """Adds current_status, drifted, stale. recorded: id, recorded, now. current: id, current_status, seen."""
    return (recorded.join(current, "id", "left")
            .withColumn("drifted", F.coalesce(F.col("recorded") != F.col("current_status"), F.lit(False)))
            .withColumn("stale", F.col("seen").isNull() | (F.datediff("now", "seen") >= days))
            .withColumn("current_status", F.coalesce("current_status", F.lit("missing"))))


def reuse_duplicates(claims: DataFrame, content: Sequence[str], order: Sequence[Column], key: str = "claim_id") -> DataFrame:
    """content_hash, kept, copies: claims equal in ``content`` (timestamps left out) reuse the first one."""
    hashed = claims.withColumn("content_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    return (hashed.groupBy("content_hash").agg(F.min(F.struct(*order, F.col(key).alias("_k"))).alias("f"), F.count(F.lit(1)).alias("copies"))
            .select("content_hash", F.col("f._k").alias("kept"), "copies"))


def rolling_count(events: DataFrame, actor: str, at: str, span: int) -> DataFrame:
    """Adds ``recent``: how many events of the same actor fall in the ``span`` seconds before each event.

    An actor's events are cut into span-wide buckets and each bucket also sees the one before it, so a very active actor is
    spread over many window partitions. ``at`` is whole seconds.
    """
    slot = F.floor(F.col(at) / span)
    own = events.withColumn("_slot", slot).withColumn("_own", F.lit(True))
    before = events.withColumn("_slot", slot + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(actor, "_slot").orderBy(at).rangeBetween(-span, -1)
    return (own.unionByName(before).withColumn("recent", F.count(F.lit(1)).over(w)).where("_own").drop("_slot", "_own"))


def growth_history(support: DataFrame) -> DataFrame:
    """day, new_claims, total: accepted claims by the day of their first supporting review, with the running total.

    support: claim_id, at. The running total is over one row per day.
    """
    first = support.groupBy("claim_id").agg(F.min("at").alias("at"))
    daily = first.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("new_claims"))
    return daily.withColumn("total", F.sum("new_claims").over(Window.orderBy("day")))


def record_history(events: DataFrame, n_rechecks: int = 5) -> DataFrame:
    """id, submitted_at, checked_at, n_reviews, rechecks (the last n, oldest first).

    events: id, type (proposed / checked / review / recheck), ok, redacted, at, seq, label.
    """
    base = events.groupBy("id").agg(
        F.min(F.when(F.col("type") == "proposed", F.col("at"))).alias("submitted_at"),
        F.min(F.when((F.col("type") == "checked") & F.col("ok"), F.col("at"))).alias("checked_at"),
        F.count_if((F.col("type") == "review") & ~F.col("redacted")).alias("n_reviews"))
    last = capped_list(events.where("type = 'recheck' AND NOT redacted"), ["id"], "label", n_rechecks, [F.desc("seq")], "rechecks")
    return base.join(last.withColumn("rechecks", F.reverse("rechecks")), "id", "left")


def _spaced_words(text) -> Column:
    """The letters and digits of a text in lower case, a blank before, between and after its words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


# What may stand between the numbers of a list, a number in it, and the words before it
BETWEEN, NUMBER, HEADING = r"\s*(?:,|/|and|or)\s*", "[0-9]+[a-z]?", "[a-z]{2,}"


def _numbered_names(text) -> Column:
    """Every number of a list with its heading put before it: "ABC 1, 2 and 3A" holds abc1, abc2 and abc3a."""
    lists = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)(?<!\w){HEADING}\s*{NUMBER}(?:{BETWEEN}{NUMBER})*(?!\w)"), 0)
    def spelled_out(found):
        heading = F.regexp_extract(found, f"^{HEADING}", 0)
        return F.transform(F.regexp_extract_all(found, F.lit(NUMBER + r"\b"), 0), lambda number: F.concat(heading, number))
    return F.flatten(F.transform(lists, spelled_out))


def names_target(text: Column, names: Column) -> Column:
    """Whether the words of one of ``names`` stand in a row in the text, in any case and with any signs between them, or a name of capitals
    and a number, as in "ABC3A", is an entry of a numbered list ("ABC 1, 2 and 3A").

    The text is read once for all names; names without a letter or digit count for nothing.
    """
    said, listed = _spaced_words(text), _numbered_names(text)
    usable = F.filter(names, lambda name: F.coalesce(F.trim(_spaced_words(name)) != "", F.lit(False)))
    return F.exists(usable, lambda name: F.contains(said, _spaced_words(name))
                    | (F.rlike(name, F.lit("^[A-Z]{2,}[0-9]+[A-Z]?$")) & F.array_contains(listed, F.lower(name))))


def validate_decisions(decisions: DataFrame, broad: Sequence[str] = ()) -> DataFrame:
    """Adds ``reason``: the first rule a screening decision breaks, or null.

    decisions: relevance, asset_type, secondary_types, reason_text, quotes (array of struct role, text), text, target and, if there are
    any, aliases (array). Aliases listed in ``broad`` (lower case) do not name the target.
    """
    kinds = F.array(*[F.lit(k) for k in QUALIFIER_DOMAINS["asset_type"]])
    positive = F.col("relevance") != "not_relevant"
    roles = F.array_distinct(F.flatten(F.transform("quotes", lambda q: F.when(q["role"] == "both", F.array(F.lit("population"), F.lit("asset_type"))).otherwise(F.array(q["role"])))))
    text = one_space(F.col("text"))
    names = F.array("target")
    if "aliases" in decisions.columns:
        wide = F.array(*[F.lit(b) for b in broad]).cast("array<string>")
        names = F.concat(names, F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda n: ~F.array_contains(wide, F.lower(n))))
    reason = F.coalesce(
        F.when(~F.col("relevance").isin("relevant", "broader_group", "not_relevant"), "relevance"),
        F.when(F.trim(F.coalesce("reason_text", F.lit(""))) == "", "missing reason"),
        F.when(F.size(F.array_except("secondary_types", kinds)) > 0, "secondary types"),
        F.when(positive & ~F.coalesce(F.array_contains(kinds, F.col("asset_type")), F.lit(False)), "asset type"),
        F.when(~positive & (F.col("asset_type").isNotNull() | (F.size("secondary_types") > 0)), "negative with asset type"),
        F.when((F.size("quotes") > 2) | (positive & (F.size("quotes") == 0)), "number of quotes"),
        F.when(F.exists("quotes", lambda q: ~q["role"].isin("population", "asset_type", "both")), "quote role"),
        F.when(positive & (F.size(roles) != 2), "quotes must support both roles"),
        F.when(positive & ~F.exists("quotes", lambda q: q["role"].isin("population", "both") & names_target(q["text"], names)), "target not named"),
        F.when(F.exists("quotes", lambda q: ~F.contains(text, one_space(q["text"]))), "quote not found"))
    return decisions.withColumn("reason", reason)


def normalise_decision(decisions: DataFrame) -> DataFrame:
    """A negative decision may leave its asset fields out; give it the explicit empty shape."""
    negative = F.col("relevance") == "not_relevant"
    return (decisions.withColumn("secondary_types", F.when(negative, F.coalesce("secondary_types", F.array().cast("array<string>"))).otherwise(F.col("secondary_types")))
            .withColumn("quotes", F.when(negative & F.col("quotes").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.col("quotes"))))


def search_names(entities: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """id, field, query: the gene as a term query, then each name of 6+ letters once as a phrase query.

    entities: id, gene, names (array).
    """
    skip = F.array(*[F.lit(g) for g in generic]).cast("array<string>")
    tidy = F.transform("names", lambda n: one_space(F.coalesce(n, F.lit(""))))
    usable = F.filter(tidy, lambda n: (F.length(n) >= 6) & ~F.array_contains(skip, F.lower(n)) & (F.lower(n) != F.lower("gene")))
    rows = entities.select("id", F.posexplode(usable).alias("pos", "name"))
    names = (rows.groupBy("id", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("f"))
             .select("id", F.lit("query.cond").alias("field"), F.concat(F.lit('"'), F.regexp_replace("f.name", '"', ""), F.lit('"')).alias("query")))
    return entities.select("id", F.lit("query.term").alias("field"), F.col("gene").alias("query")).unionByName(names)


def numeric_faithfulness(text, facts, max_words: int = 60) -> Column:
    """A generated sentence is kept when non-empty, short, and every number in it occurs in the facts."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), 0))
    known = F.regexp_extract_all(facts, F.lit(r"\d+"), 0)
    return ((F.trim(text) != "") & (F.size(F.split(F.trim(text), r"\s+")) <= max_words) & (F.size(F.array_except(numbers, known)) == 0))


def gap_list(has_group, focused, n_studies, n_partial, solid, n_terms, has_neighbors, effect_known) -> Column:
    """Which kinds of information are missing, in display order."""
    return F.array_compact(F.array(
        F.when(~has_group, "no group found"), F.when(has_group & ~focused, "no group for this exact item"),
        F.when(n_studies == 0, "no studies found"),
        F.when(n_partial > 0, F.concat(F.lit("partly read: "), n_partial.cast("string"), F.lit(" of "), n_studies.cast("string"))),
        F.when((has_group | (n_studies > 0)) & ~solid, "nothing independently reviewed"),
        F.when(n_terms == 0, "no terms recorded"), F.when(~has_neighbors, "no connections"), F.when(~effect_known, "effect not curated")))


def calibration_sample(cases: DataFrame, n: int = 60, seed: str = "7") -> DataFrame:
    """Balanced known-answer cases in a seeded, repeatable order: n/2 rejects and n/2 supports.

    cases: case_id, answer. The order is by the hash of seed and id, so no shuffle can change it.
    """
    ranked = cases.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), F.col("case_id").cast("string")), 256))
    w = Window.partitionBy("answer").orderBy("h", "case_id")
    return ranked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n // 2)


RING, LOOKS = 4096, 8  # cases of one ring, partners that a case looks at in it


def swapped_negatives(positives: DataFrame, ring: int = RING) -> DataFrame:
    """Certain negatives: each positive's quote with another case's term that differs from its own and is not named in the quote.

    positives: case_id, quote, term. Returns one row per case: case_id, quote, term, answer; ``term`` and ``answer`` are null where no term
    of any case fits. Cases stand in hash order on rings of about ``ring``, so that no task sees all, and each looks at the next
    ``LOOKS`` partners. Those that find none look at the distinct terms in hash order, ever more of them until all were looked at. A case
    left after m terms names at least m - 1 of them, so the list grows only while some quote names all of it.
    """
    h = F.xxhash64("case_id")
    rings = max(positives.count() // ring, 1)
    w = Window.partitionBy("_r").orderBy(h, "case_id")
    dealt = positives.select("case_id", "quote", "term").withColumn("_r", F.pmod(F.xxhash64(F.lit(1), "case_id"), F.lit(rings)))
    numbered = dealt.withColumn("_i", F.row_number().over(w))
    heads = numbered.where(F.col("_i") <= LOOKS).groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_i", "term"))).alias("_h"))
    ahead = F.array(*[F.lead("term", k).over(w) for k in range(1, LOOKS + 1)])
    said = F.lower(F.coalesce("quote", F.lit("")))
    fits = lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("term")) & ~F.contains(said, F.lower(x))
    looked = (numbered.withColumn("_a", ahead).join(heads, "_r")
              .withColumn("other", F.get(F.filter(F.concat("_a", F.transform("_h", lambda s: s["term"])), fits), F.lit(0))))
    found = cut(looked.select("case_id", "quote", "term", "other"))
    terms = positives.select("term").where("term IS NOT NULL").distinct()
    done, left = found.where("other IS NOT NULL"), found.where("other IS NULL").select("case_id", "quote", "term")
    n, n_terms = 4 * LOOKS, None
    while not left.isEmpty():
        if n_terms is None:
            terms = cut(terms.withColumn("_h", F.xxhash64("term")))
            n_terms = terms.count()
        some = terms.orderBy("_h", "term").limit(n).agg(F.array_sort(F.collect_list(F.struct("_h", "term"))).alias("_t"))
        tried = cut(left.join(F.broadcast(some)).withColumn("other", F.get(F.filter(F.transform("_t", lambda s: s["term"]), fits), F.lit(0)))
                    .select("case_id", "quote", "term", "other"))
        last = n >= n_terms
        done = done.unionByName(tried if last else tried.where("other IS NOT NULL"))
        if last:
            break
        left, n = tried.where("other IS NULL").select("case_id", "quote", "term"), n * 4
    return done.select("case_id", "quote", F.col("other").alias("term"), F.when(F.col("other").isNotNull(), "reject").alias("answer"))


def calibration_scores(answers: DataFrame, key: DataFrame, passing: float = 0.8) -> DataFrame:
    """agent, answered, correct, score, passed. answers: agent, case_id, answer; key: case_id, expected."""
    return (answers.join(key, "case_id").groupBy("agent")
            .agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("answer") == F.col("expected")).alias("correct"))
            .withColumn("score", F.round(F.col("correct") / F.col("answered"), 4)).withColumn("passed", F.col("score") >= passing))
