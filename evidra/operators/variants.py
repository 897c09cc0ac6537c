"""Variant descriptions: splitting HGVS names, typing, aligned id lists, per-condition summaries, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.vocab import CLASS_ORDER, lookup

# Fixed value: how the public variant table writes a name: transcript, gene in brackets, coding change, protein change in brackets
NAME = r"^([^\s(:]+)(?:\([^)]*\))?:([cmgn]\.\S+)(?:\s+\((p\.[^)]+)\))?"
# One-letter to three-letter amino acids
AMINO = {"A": "ala", "R": "arg", "N": "asn", "D": "asp", "C": "cys", "Q": "gln", "E": "glu", "G": "gly", "H": "his", "I": "ile", "L": "leu",
         "K": "lys", "M": "met", "F": "phe", "P": "pro", "S": "ser", "T": "thr", "W": "trp", "Y": "tyr", "V": "val", "X": "ter", "*": "ter"}
TRUNCATING = ("nonsense", "frameshift", "splice", "start", "large")


def split_name(name) -> Column:
    """struct(transcript, coding, protein); empty strings where a part is missing."""
    return F.struct(F.regexp_extract(name, NAME, 1).alias("transcript"), F.regexp_extract(name, NAME, 2).alias("coding"),
                    F.coalesce(F.regexp_extract(name, NAME, 3), F.lit("")).alias("protein"))


def variant_type(coding, protein, record_type) -> Column:
    """The word a report would use for the change."""
    by_protein = (F.when(F.contains(protein, F.lit("fs")), "frameshift").when(F.contains(protein, F.lit("=")), "synonymous")
                  .when(protein.rlike(r"^p\.Met1(?!\d)"), "start").when(protein.endswith("Ter") | protein.endswith("*"), "nonsense")
                  .when(protein.rlike("del|ins|dup"), "inframe").when(protein.rlike(r"^p\.[A-Z][a-z]{2}\d+[A-Z][a-z]{2}$"), "missense").otherwise("other"))
    return (F.when(F.lower(record_type).startswith("copy number") | (F.coalesce(coding, F.lit("")) == ""), "large")
            .when(coding.startswith("m."), "mitochondrial").when(F.coalesce(protein, F.lit("")) != "", by_protein)
            .when(coding.rlike(r"\d[+-][12](?!\d)"), "splice").when(coding.rlike(r"\d[+-]\d"), "intronic")
            .when(coding.startswith("c.-") | coding.startswith("c.*"), "untranslated").otherwise("other"))


def aligned_ids(field) -> Column:
    """Array (one entry per '|' part, positions kept) of the recognised ids of that part."""
    def clean(raw):
        raw = F.trim(raw)
        return (F.when(raw.startswith("MONDO:MONDO:"), F.regexp_replace(raw, "^MONDO:", ""))
                .when(raw.startswith("OMIM:") | raw.startswith("Orphanet:"), raw))
    return F.transform(F.split(field, r"\|"), lambda part: F.array_distinct(F.array_compact(F.transform(F.split(part, ","), clean))))


def condition_summary(rows: DataFrame, n_top: int = 3) -> DataFrame:
    """Per (gene, condition): plp, vus, conflicting, benign, types ('type:count', most frequent first), top ids, and the
    gene's disease-causing variants that name none of its conditions.

    rows: gene, variant, class, stars, submitters, type, conditions (array).
    """
    causing = F.col("class").isin("P", "LP")
    each = rows.withColumn("condition", F.explode("conditions"))
    counts = each.groupBy("gene", "condition").agg(
        F.count_if(causing).alias("plp"), F.count_if(F.col("class") == "VUS").alias("vus"), F.count_if(F.col("class") == "C").alias("conflicting"),
        F.count_if(F.col("class").isin("B", "LB")).alias("benign"))
    types = (each.where(causing).groupBy("gene", "condition", "type").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("gene", "condition").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "type"))).alias("t"))
             .select("gene", "condition", F.transform("t", lambda x: F.concat(x["type"], F.lit(":"), (-x["neg"]).cast("string"))).alias("types")))
    w = Window.partitionBy("gene", "condition").orderBy(lookup(F.col("class"), CLASS_ORDER, 9), F.desc("submitters"), F.desc("stars"), "variant")
    top = (each.where(causing).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_top)
           .groupBy("gene", "condition").agg(F.array_sort(F.collect_list(F.struct("_r", "variant"))).alias("t")).select("gene", "condition", F.col("t.variant").alias("top")))
    loose = rows.groupBy("gene").agg(F.count_if(causing & (F.size("conditions") == 0)).alias("gene_unassigned"))
    return counts.join(types, ["gene", "condition"], "left").join(top, ["gene", "condition"], "left").join(loose, "gene", "left")


def gene_rows(rows: DataFrame, most: int = 6000) -> DataFrame:
    """The first ``most`` rows of each gene in display order."""
    w = Window.partitionBy("gene").orderBy(lookup(F.col("class"), CLASS_ORDER, 9), F.desc("submitters"), F.desc("stars"), "variant")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def class_mix(counts: DataFrame) -> DataFrame:
    """id, n, reading: mostly truncating (>= 0.5), mostly missense (>= 0.6) or mixed, from five classified variants on.

    counts: id, type, n.
    """
    per = counts.groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("type").isin(*TRUNCATING), F.col("n")).otherwise(0)).alias("t"),
                                   F.sum(F.when(F.col("type") == "missense", F.col("n")).otherwise(0)).alias("m"))
    return per.select("id", "n", F.when(F.col("n") < 5, "too few").when(F.col("t") / F.col("n") >= 0.5, "mostly truncating")
                      .when(F.col("m") / F.col("n") >= 0.6, "mostly missense").otherwise("mixed").alias("reading"))


def read_with_effect(reading, effect) -> Column:
    """The class mix crossed with the curated effect: whether what most variants do fits how the condition is thought to work."""
    return (F.when((reading == "mostly truncating") & (effect == "loss_of_function"), "fits loss of function")
            .when((reading == "mostly missense") & effect.isin("gain_of_function", "dominant_negative"), "fits a changed protein")
            .otherwise(reading))


def lookup_variants(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """query, variant: a number, an rs id, a coding or protein form (one- or three-letter), or a prefix of 6+ characters.

    queries: query. variants: variant (long), hgvs, protein, rs. Both sides are reduced to the same keys and joined on
    equality; for prefixes the forms are cut to the lengths that the queries have, so a key holds true matches only.
    """
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("query")), r"\s+", ""), r"^p\.\(?", "p."), r"\)$", "")
    asked = queries.select("query", q.alias("q")).where("q <> ''").distinct()
    bare = F.upper(F.regexp_replace("q", r"^p\.", ""))
    one = r"^([A-Z*])(\d+)([A-Z*]|FS.*)$"
    first, number, last = F.regexp_extract(bare, one, 1), F.regexp_extract(bare, one, 2), F.regexp_extract(bare, one, 3)
    tail = F.when(last.startswith("FS"), "fs").otherwise(lookup(last, AMINO))
    three = F.when(first != "", F.concat(F.lit("p."), lookup(first, AMINO), number, tail))
    number_only = F.col("q").rlike(r"^\d+$")
    rs_only = F.col("q").startswith("rs")
    asked = asked.withColumn("three", three).withColumn("plain", ~number_only & ~rs_only)
    v = variants.select("variant", F.lower("hgvs").alias("hgvs"), F.lower("protein").alias("protein"), F.lower("rs").alias("rs"))
    v = v.withColumn("local", F.regexp_replace("hgvs", "^[^:]*:", ""))
    keys = v.select("variant", F.explode(F.array_distinct(F.array(F.col("local"), F.col("hgvs"), F.col("protein")))).alias("key")).where("key <> ''")
    prefixes = asked.where(F.col("plain") & F.col("three").isNull() & (F.length("q") >= 6)).select("query", "q")
    lengths = prefixes.agg(F.collect_set(F.length("q")).alias("lengths"))
    forms = (v.select("variant", F.explode(F.array("local", "protein")).alias("form")).join(F.broadcast(lengths))  # one row
             .select("variant", "form", F.explode(F.filter("lengths", lambda n: n <= F.length("form"))).alias("n"))
             .select("variant", F.expr("substring(form, 1, n)").alias("q")))
    hits = [
        asked.where(number_only).join(v.select("variant", F.col("variant").cast("string").alias("q")), "q").select("query", "variant"),
        asked.where(rs_only).join(v.select("variant", F.col("rs").alias("q")), "q").select("query", "variant"),
        asked.where("plain").select("query", F.explode(F.array("q", F.concat(F.lit("p."), "q"))).alias("key")).join(keys, "key").select("query", "variant"),
        # a short protein form such as p.arg54 would be a prefix of longer positions, so the letters are part of the key
        asked.where("plain AND three IS NOT NULL").join(v.select("variant", "protein", F.regexp_extract("protein", r"^(p\.[a-z]+\d+)", 1).alias("stem")),
            F.regexp_extract("three", r"^(p\.[a-z]+\d+)", 1) == F.col("stem")).where(F.startswith("protein", F.col("three"))).select("query", "variant"),
        prefixes.join(forms, "q").select("query", "variant"),
    ]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()
