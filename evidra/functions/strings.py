"""String rules used when joining sources: normal forms, slugs, affiliations, ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# every kind of blank, as the inside of a character class; Java's own \\s knows only the ASCII ones
LINE_BLANK = " \t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = LINE_BLANK + "\n"

# Directories and platforms that are not an organization's own site
NOT_AN_ORGANIZATION = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "tiktok.com", "wikipedia.org",
    "nih.gov", "orpha.net", "omim.org", "medlineplus.gov", "clinicaltrials.gov", "rarediseases.org", "globalgenes.org",
    "eurordis.org", "geneticalliance.org", "rareconnect.org", "malacards.org", "genecards.org", "mayoclinic.org",
    "clevelandclinic.org", "healthline.com", "webmd.com")


def _base_letters() -> tuple[str, str]:
    """Letters with marks and the letters under them, by the Unicode decompositions of the European scripts."""
    pairs = []
    for code in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _base_letters()


def fold_marks(text) -> Column:
    """Text without accents: loose combining marks go, letters with marks become their base letters."""
    return F.translate(F.regexp_replace(text, "[\u0300-\u036f]+", ""), MARKED, UNMARKED)


def plain(text) -> Column:
    """Accents folded, lower case, everything but ASCII letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(fold_marks(text)), "[^a-z0-9]+", " "))


def words(text) -> Column:
    """Lower-case word tokens (letters and digits of any script)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def one_space(text) -> Column:
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def capitalised(text) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def organization_id(url, deny=NOT_AN_ORGANIZATION) -> Column:
    """org:<host slug> of a home page; null for directories, platforms and pages without a host."""
    full = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    denied = F.lit(False)
    for d in deny:
        denied = denied | (host == d) | host.endswith("." + d)
    slug = F.regexp_replace(F.regexp_replace(host, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when((slug != "") & ~denied, F.substring(F.concat(F.lit("org:"), slug), 1, 84))


# Words that mark the part of an affiliation that names the institution, sure ones and possible ones, and words that a unit
# inside an institution begins with
SURE_INSTITUTION = "universit|hospital|college|school|clinic"
ANY_INSTITUTION = "universit|hospital|institut|center|centre|college|school|clinic|foundation|laborator|academy|inserm|cnrs|nih"
INNER_UNIT = "^(department|division)"


def clean_affiliation(text, limit: int = 140) -> Column:
    """Institution and its place: e-mails removed, department dropped.

    Every comma-separated part gets a rank (0 surely an institution, 1 perhaps, 2 other); the first part of the best rank and the last part
    of all, the place, remain.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\S+@\S+", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s*Electronic address:?\s*", " ")), "[.;,: ]+$", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")

    def ranked(part, at):
        low = F.lower(part)
        rank = F.when(low.rlike(SURE_INSTITUTION) & ~low.rlike(INNER_UNIT), 0).when(low.rlike(ANY_INSTITUTION), 1).otherwise(2)
        return F.struct(rank.alias("rank"), at.alias("at"), part.alias("part"))

    best = F.array_min(F.transform(parts, ranked))
    place = F.element_at(parts, -1)
    named = F.when(best["at"] < F.size(parts) - 1, F.concat_ws(", ", best["part"], place)).otherwise(best["part"])
    return F.when(F.size(parts) == 0, "").otherwise(F.substring(named, 1, limit))


# Entity kinds by id shape, first match wins
ID_KINDS = (
    ("condition", r"^MONDO:[0-9]{7}(-HGNC:[0-9]+)?$"),
    ("gene", r"^HGNC:[0-9]+$"),
    ("phenotype", r"^HP:[0-9]{7}$"),
    ("go_term", r"^GO:[0-9]{7}$"),
    ("complex", r"^CPX-[0-9]+$"),
    ("pathway", r"^R-HSA-[0-9]+$"),
    ("effect", r"^effect:(loss_of_function|gain_of_function|dominant_negative|non_loss_of_function)$"),
    ("trial", r"^NCT[0-9]{8}$"),
    ("publication", r"^PMID:[0-9]+$"),
    ("organization", r"^org:[a-z0-9][a-z0-9-]{1,80}$"),
    ("person", r"^(orcid:[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]|person:[a-z0-9][a-z0-9-]{1,80})$"),
    ("asset", r"^asset:[a-z0-9][a-z0-9-]{1,120}$"),
    ("intervention", r"^intervention:[a-z0-9][a-z0-9-]{1,80}$"),
)


def id_kind(entity) -> Column:
    out = None
    for kind, shape in ID_KINDS:
        out = F.when(entity.rlike(shape), kind) if out is None else out.when(entity.rlike(shape), kind)
    return out
