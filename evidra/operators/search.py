"""Name search over a flat index of names, aliases and ids.

A batch of queries is matched by equality joins on blocking keys that every match must share (a word prefix, one of the
rarest words, a trigram), then scored and checked; nothing compares every query with every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.strings import fold_marks, plain
from evidra.functions.vocab import lookup
from evidra.operators.linking import best_per_key, capped_list
from evidra.session import cut

# How much a hit of each kind counts (gene, condition, symptom, group, mechanism)
KIND_WEIGHT = {"g": 1.15, "c": 1.0, "s": 0.85, "grp": 0.62, "m": 0.6}


def prominence(n_terms, has_prevalence) -> Column:
    """Well-described entities first among similar matches."""
    return F.round(F.least(F.lit(1.0), F.log1p(n_terms.cast("double")) / F.log1p(F.lit(150.0))) * 0.8 + F.when(has_prevalence, 0.2).otherwise(0.0), 2)


def search_index(entries: DataFrame) -> DataFrame:
    """One row per (lower text, kind, ref), the first in order; label only when it differs from the text.

    entries: text, kind, ref, label, extra, prominence, pos.
    """
    keyed = entries.where("text <> ''").withColumn("key", F.lower("text"))
    firsts = best_per_key(keyed, ["key", "kind", "ref"], F.col("pos"), F.col("text"))
    return firsts.select("text", "kind", "ref", F.when(F.col("label") != F.col("text"), F.col("label")).otherwise("").alias("label"), "extra", "prominence")


def _prefixes(word) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, F.lit(1), i))


def _first_of(rows: DataFrame, keys: list[str], ref: str, n: int, name: str) -> DataFrame:
    """keys..., ``name``: per key the first n values of ``ref`` in order, as structs. Counted off before they are collected."""
    w = Window.partitionBy(*keys).orderBy(ref)
    first = rows.select(*keys, ref).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ref))).alias(name))


def name_search(queries: DataFrame, index: DataFrame, n: int = 12) -> DataFrame:
    """query, kind, ref, score, rank: the n best entities per query.

    Every kind of match needs each query word to begin some word of the name, so names are joined on the query's rarest
    word prefix. An entity scores by its best name plus up to 3 x 3 points for further matching names. Entities of a kind with the same
    names score alike, so they are matched once, and of them only the first n can be among a query's n best.
    """
    asked = queries.select("query", plain("query").alias("q")).where("q <> ''").distinct().withColumn("tokens", F.split("q", " "))
    forms = index.select("kind", "ref", plain("text").alias("norm"), "prominence").groupBy("kind", "ref").agg(
        F.array_sort(F.collect_list(F.struct("norm", "prominence"))).alias("forms"))
    alike = cut(_first_of(forms, ["kind", "forms"], "ref", n, "refs"))
    names = alike.select("kind", "refs", F.explode("forms").alias("f")).select("kind", "refs", "f.norm", "f.prominence").withColumn("words", F.split("norm", " "))
    blocked = names.select("norm", "words", "kind", "refs", "prominence", F.explode(F.array_distinct(F.flatten(F.transform("words", _prefixes)))).alias("block"))
    wanted = asked.select("query", F.explode(F.array_distinct("tokens")).alias("block"))
    spread = blocked.join(wanted.select("block").distinct(), "block", "left_semi").groupBy("block").agg(F.count(F.lit(1)).alias("df"))
    # a query word that begins no word of any name rules the query out
    rarest = (wanted.join(spread, "block", "left").groupBy("query").agg(F.min_by("block", F.struct("df", "block")).alias("block"), F.count_if(F.col("df").isNull()).alias("unknown"))
              .where("unknown = 0").select("query", "block"))
    hits = blocked.join(asked.join(rarest, "query"), "block")
    over = (F.length("norm") - F.length("q")).cast("double")
    spaced = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    all_begin = F.forall("tokens", lambda t: F.exists("words", lambda w: F.startswith(w, t)))
    base = (F.when(F.col("norm") == F.col("q"), 100.0)
            .when(F.startswith("norm", F.concat("q", F.lit(" "))), 82 - F.least(F.lit(20.0), over / 3))
            .when(F.startswith("norm", F.col("q")), 75 - F.least(F.lit(20.0), over / 3))
            .when(F.contains(spaced, F.concat(F.lit(" "), "q", F.lit(" "))), 70 - F.least(F.lit(20.0), over / 4))
            .when(all_begin, 55 - F.least(F.lit(25.0), over / 4)))
    score = (base * lookup(F.col("kind"), KIND_WEIGHT, 0.0) + F.when(F.col("kind") == "c", 20 * F.coalesce("prominence", F.lit(0.0))).otherwise(0.0)
             + F.when((F.col("kind") == "g") & (F.col("norm") == F.col("q")), 30.0).otherwise(0.0))
    scored = hits.withColumn("score", score).where("score IS NOT NULL").groupBy("query", "kind", "refs").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("hits"))
    total = F.round(F.col("s") + 3 * F.least(F.lit(3), F.col("hits") - 1), 6)
    groups = Window.partitionBy("query").orderBy(F.desc("score"), "kind", F.col("refs")[0])
    near = scored.select("query", "kind", "refs", total.alias("score")).withColumn("r", F.row_number().over(groups)).where(F.col("r") <= n)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "ref")
    return (near.select("query", "kind", F.explode("refs").alias("ref"), "score").select("query", "kind", "ref.ref", "score")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def term_search(queries: DataFrame, names: DataFrame, n: int = 10, shortest: int = 2, longest: int = 120) -> DataFrame:
    """query, id, score, rank, reason: exact main name 0, exact other name 1, all words 2+, all but one word 5+.

    A query that is a term id (letters, colon, digits) finds that term only, with score 0. A query outside ``shortest`` .. ``longest``
    characters gives one row with a reason and no id. A match shares all query words, or all but one, so it shares one of the query's two
    rarest words: names are joined on those only. Terms with the same names match alike and are matched once; of them only the first n
    can be among a query's n best. names: id (string), pos (0 = main name), name.
    """
    def word_set(text):
        return F.array_distinct(F.filter(F.split(F.lower(fold_marks(text)), "[^a-z0-9]+"), lambda w: w != ""))
    asked = queries.select("query", F.lower(F.trim("query")).alias("q")).distinct()
    fits = F.length("q").between(shortest, longest)
    refused = asked.where(~fits).select("query", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("score"),
                                        F.lit(None).cast("int").alias("rank"), F.lit(f"search with {shortest} to {longest} characters").alias("reason"))
    is_id = F.col("q").rlike("^[a-z]+:[0-9]+$")
    by_id = (asked.where(fits & is_id).join(names.where("pos = 0").select("id", F.lower("id").alias("q")), "q")
             .select("query", "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("reason")))
    asked = asked.where(fits & ~is_id).withColumn("qw", word_set("q")).where(F.size("qw") > 0)
    forms = names.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("forms")).where(F.exists("forms", lambda f: f["pos"] == 0))
    alike = cut(_first_of(forms, ["forms"], "id", n, "ids"))
    rows = alike.select("ids", F.transform(F.filter("forms", lambda f: f["pos"] == 0), lambda f: F.length(f["name"])).alias("lens"), F.explode("forms").alias("f"))
    rows = rows.select("ids", "lens", "f.pos", F.lower("f.name").alias("n"), word_set("f.name").alias("nw"))
    spread = rows.select(F.explode("nw").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    spelled = asked.select("query", "q", "qw", F.explode("qw").alias("word")).join(spread, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    two = Window.partitionBy("query", "q").orderBy("df", "word")
    keys = spelled.withColumn("r", F.row_number().over(two)).where("r <= 2").select("query", "q", "qw", "word")
    hits = rows.withColumn("word", F.explode("nw")).join(keys, "word").drop("word").distinct()
    both, extra, missing = F.size(F.array_intersect("qw", "nw")), F.size(F.array_except("nw", "qw")), F.size(F.array_except("qw", "nw"))
    score = (F.when((F.col("n") == F.col("q")) & (F.col("pos") == 0), 0.0).when(F.col("n") == F.col("q"), 1.0).when(missing == 0, 2 + extra * 0.1)
             .when(both >= F.greatest(F.lit(1), F.size("qw") - 1), 5 + missing + extra * 0.1))
    best = (hits.withColumn("score", score).where("score IS NOT NULL").groupBy("query", "ids", "lens").agg(F.round(F.min("score"), 6).alias("score"))
            .select("query", "ids", F.explode("lens").alias("len"), "score"))
    groups = Window.partitionBy("query").orderBy("score", "len", F.col("ids")[0])
    near = best.withColumn("r", F.row_number().over(groups)).where(F.col("r") <= n).select("query", F.explode("ids").alias("id"), "len", "score")
    w = Window.partitionBy("query").orderBy("score", "len", "id")
    found = (near.select("query", "id.id", "len", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("query", "id", "score", "rank", F.lit(None).cast("string").alias("reason")))
    return found.unionByName(by_id).unionByName(refused)


def substring_search(queries: DataFrame, names: DataFrame, n: int = 20, shortest: int = 2, longest: int = 200) -> DataFrame:
    """query, id, exact, rank, reason: entities with a name that contains the query, exact ones first, then by the entity's title.

    Joined on the query's rarest trigram, or on the query itself if it has two characters. A query outside ``shortest`` .. ``longest``
    characters gives one row with a reason and no id. names: id, name, title.
    """
    def grams_of(text):
        def runs(size):
            return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.coalesce(runs(2), none), F.coalesce(runs(3), none)))
    low = names.select("id", "title", F.lower("name").alias("name")).where(F.length("name") >= shortest).distinct()
    grams = low.select("id", "title", "name", F.explode(grams_of(F.col("name"))).alias("gram"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query", F.lower(F.trim("query")).alias("q")).distinct()
    fits = F.length("q").between(shortest, longest)
    refused = asked.where(~fits).select("query", F.lit(f"search with {shortest} to {longest} characters").alias("reason"))
    own = F.filter(grams_of(F.col("q")), lambda g: F.length(g) == F.least(F.lit(3), F.length("q")))
    keys = (asked.where(fits).select("query", "q", F.explode(own).alias("gram")).join(spread, "gram").groupBy("query", "q")
            .agg(F.min_by("gram", F.struct("df", "gram")).alias("gram")))
    hits = (grams.join(keys, "gram").where(F.contains("name", F.col("q"))).groupBy("query", "id", "title")
            .agg(F.bool_or(F.col("name") == F.col("q")).alias("exact")))
    w = Window.partitionBy("query").orderBy(F.desc("exact"), "title", "id")
    found = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query", "id", "exact", "rank")
    return found.unionByName(refused, allowMissingColumns=True)


def entity_pages(item_terms: DataFrame, flags: DataFrame, n: int = 120) -> DataFrame:
    """term, n_items, n_flagged, items: the page of a term, counting everything and listing the first n items.

    flags: item, flagged.
    """
    rows = item_terms.join(flags, "item", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("flagged").alias("n_flagged"))
    return counts.join(capped_list(rows, ["term"], "item", n, [F.desc("flagged"), F.col("item")], "items"), "term")
