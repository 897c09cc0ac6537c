"""Per-value rules: evidence strength, effects, classifications, buckets, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
STRENGTH_RANK = {"strong": 3, "moderate": 2, "limited": 1}
EFFECT_WORDS = {"loss of function": "loss_of_function", "gain of function": "gain_of_function",
                "dominant negative": "dominant_negative", "undetermined non-loss-of-function": "non_loss_of_function"}
REVIEW_STARS = {"practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2,
                "criteria provided, conflicting classifications": 1, "criteria provided, single submitter": 1}
CLASS_ORDER = {"P": 0, "LP": 1, "C": 2, "VUS": 3, "LB": 4, "B": 5, "O": 6}
SUPPORTING = ("supports", "supports_with_qualification")
OPEN_STATUS = {"RECRUITING": "recruiting", "NOT_YET_RECRUITING": "soon", "ENROLLING_BY_INVITATION": "soon",
               "ACTIVE_NOT_RECRUITING": "closed", "COMPLETED": "closed", "TERMINATED": "closed", "WITHDRAWN": "closed", "SUSPENDED": "closed"}


def lookup(column, table: dict, default=None) -> Column:
    """A small fixed table as a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def link_strength(source, confidence) -> Column:
    c = F.lower(confidence)
    return (F.when(source.isin("MONDO", "Orphanet") | c.isin("definitive", "strong"), "strong")
            .when(c == "moderate", "moderate").when(c.isin("limited", "supportive"), "limited").otherwise("none"))


def best_strength(strength) -> Column:
    """Aggregate: the strongest of a group."""
    return F.max_by(strength, lookup(strength, STRENGTH_RANK, 0))


def association_effect(text) -> Column:
    """Effect named in brackets at the end of an association type."""
    t = F.lower(text)
    return (F.when(t.contains("(loss of function)"), "loss_of_function")
            .when(t.contains("(gain of function)"), "gain_of_function"))


# How clinical significance begins, first match wins, and the word that beats them all
CONFLICTING = "conflicting"
SIGNIFICANCE = (("pathogenic", "P"), ("likely pathogenic", "LP"), ("uncertain significance", "VUS"), ("likely benign", "LB"), ("benign", "B"))


def classification(text) -> Column:
    """Clinical significance words to a class; conflicting wins over everything."""
    t = F.lower(text)
    out = F.when(t.contains(CONFLICTING), "C")
    for start, klass in SIGNIFICANCE:
        out = out.when(t.startswith(start), klass)
    return out.otherwise("O")


def review_stars(text) -> Column:
    return lookup(text, REVIEW_STARS, 0)


def model_family(name) -> Column:
    """Historical spellings of one model family count as one."""
    # The spellings
    v = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when((v == "openai") | v.startswith("openai-") | v.startswith("azure-openai") | v.startswith("gpt-"), "openai").otherwise(v)


# Words in the description of an organization and the kind they stand for, first match wins
ORGANIZATION_KINDS = (("patient", "patient_organization"), ("research", "research_program"), ("registry", "research_program"),
                      ("information", "information_service"), ("professional", "professional_network"), ("company", "company"))


def organization_kind(text) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(t.contains(word), kind) for word, kind in ORGANIZATION_KINDS], F.lit("patient_organization"))


def listing_scope(text) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("condition"), "this_condition").when(t.contains("gene"), "this_gene").otherwise("broader_group")


def study_group(status) -> Column:
    return lookup(status, OPEN_STATUS, "unknown")


# What a listing says about whom a study takes
SOME_PATIENTS, ASK_EXPERT, INCLUDED = "only some patients", "ask an expert", "includes your condition"


def study_fit(restriction, verdict) -> Column:
    return (F.when(F.coalesce(restriction, F.lit("")) != "", SOME_PATIENTS)
            .when(verdict == "supports_with_qualification", ASK_EXPERT).otherwise(INCLUDED))


def rarity(count, rare: int = 50, uncommon: int = 400) -> Column:
    """Plain words for how many items share a term."""
    return (F.when(count <= rare, "very rare sign").when(count <= uncommon, "uncommon sign").otherwise("common sign"))


def frequency_share(text) -> Column:
    """'a/b' as a number; other spellings give null."""
    a, b = F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", 2)
    return F.when((a != "") & (b != "") & (b.cast("double") > 0), F.try_divide(a.cast("double"), b.cast("double")))
