"""Documents as evidence: canonical text, phrases, verbatim quotes, sentences, excerpts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evidra.functions import trie
from evidra.functions.pyudfs import nfc
from evidra.functions.strings import BLANK, LINE_BLANK, one_space
from evidra.session import cut

MAX_QUOTE = 2000
# Words that mark a sentence about an organization
ORGANIZATION_WORDS = "(?i)foundation|famil|mission|support|dedicated|cure|research|community|patients|children|advoca|connect"


def canonical_text(text) -> Column:
    """NFC, LF line ends, blanks collapsed and trimmed per line, at most one empty line, trimmed."""
    t = F.regexp_replace(nfc(text), "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t\u00a0\u2009\u202f]+", " ")
    t = F.regexp_replace(t, f"[{LINE_BLANK}]*\n[{LINE_BLANK}]*", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")


def canonical_quote(text) -> Column:
    return one_space(nfc(text))


def quote_pattern(quote) -> Column:
    """A literal pattern in which every blank of the quote matches any run of whitespace."""
    safe = F.replace(one_space(quote), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), F.replace(safe, F.lit(" "), F.lit(f"\\E[{BLANK}]+\\Q")), F.lit("\\E"))


def _tokens(text) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda x: x != "")


def locate_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, start, end (0-based, end exclusive) of each quote's first verbatim occurrence per document.

    Blocking: inside a quote every word but the first and last is a whole word of any text that contains it, so a quote is
    joined to documents on its rarest inner word only, and then checked. Quotes of one or two words have no inner word and
    are blocked through the vocabulary instead: distinct words that contain the start of their longest word.
    quotes: quote_id, quote. docs: doc_id, text.
    """
    doc_words = docs.select("doc_id", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("word"))
    spread = doc_words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    q = quotes.withColumn("ws", _tokens(F.col("quote"))).where(F.size("ws") > 0)
    inner = (q.where(F.size("ws") > 2)
             .select("quote_id", F.explode(F.array_distinct(F.slice("ws", F.lit(2), F.size("ws") - 2))).alias("word"))
             .join(spread, "word", "left").where("df IS NOT NULL")
             .groupBy("quote_id").agg(F.min_by("word", F.struct("df", "word")).alias("word")))
    candidates = doc_words.join(inner, "word").select("quote_id", "doc_id")
    longest = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = q.where(F.size("ws") <= 2).select("quote_id", longest.alias("piece")).withColumn("gram", F.substring("piece", 1, 4))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(
        F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n)))
        .otherwise(F.array().cast("array<string>"))))
    by_gram = (spread.select("word", F.explode(F.array_distinct(grams)).alias("gram")).join(short, "gram")
               .where(F.contains("word", F.col("piece"))).select("quote_id", "word").distinct())
    candidates = candidates.unionByName(doc_words.join(by_gram, "word").select("quote_id", "doc_id")).distinct()
    pattern = quote_pattern(F.col("quote"))
    return (candidates.join(quotes, "quote_id").join(docs.select("doc_id", "text"), "doc_id")
            .withColumn("start", F.regexp_instr("text", pattern) - 1).where("start >= 0")
            .withColumn("end", F.col("start") + F.length(F.regexp_substr("text", pattern)))
            .select("quote_id", "doc_id", "start", "end"))


def audit_quotes(evidence: DataFrame, sources: DataFrame, max_quote: int = MAX_QUOTE) -> DataFrame:
    """Adds ``reason``: the first check the evidence fails, or null.

    evidence: source_id, quote, start, end. sources: source_id, text, raw, text_hash, raw_hash (as recorded).
    """
    joined = evidence.join(sources, "source_id", "left")
    cut_out = F.expr("substring(text, start + 1, end - start)")
    reason = F.coalesce(
        F.when(F.col("text_hash").isNull(), "source is not archived"),
        F.when(F.col("text").isNull() | F.col("raw").isNull(), "archived files are missing"),
        F.when((F.sha2("text", 256) != F.col("text_hash")) | (F.sha2("raw", 256) != F.col("raw_hash")), "source does not match its hashes"),
        F.when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))), "offsets out of range"),
        F.when(F.length("quote") > max_quote, "quote too long"),
        F.when(canonical_quote(cut_out) != canonical_quote(F.col("quote")), "quote not at its offsets"))
    return joined.withColumn("reason", reason).drop("text", "raw", "text_hash", "raw_hash")


def match_version(recorded: DataFrame, versions: DataFrame) -> DataFrame:
    """id, version: the rendering whose hash equals the recorded one (smallest name on ties), else null.

    recorded: id, hash. versions: id, version, text.
    """
    hashed = versions.select("id", F.sha2("text", 256).alias("hash"), "version").groupBy("id", "hash").agg(F.min("version").alias("version"))
    return recorded.join(hashed, ["id", "hash"], "left").select("id", "version")


PART_PHRASES = 200_000  # phrases of one trie, which the driver builds and every task gets


def phrase_match(phrases: DataFrame, docs: DataFrame, part_phrases: int = PART_PHRASES) -> DataFrame:
    """doc_id, entity, priority: entities whose phrases occur as whole-word sequences, case and punctuation ignored.

    phrases: entity, phrase, kind ('symbol', 'name' or 'alias'), ambiguous. docs: doc_id, text and the fields title and
    population, which only decide the priority: 0 a main phrase in the title, 1 in the population field, 2 elsewhere in the
    text, 3 only an alias. An ambiguous symbol counts only when it occurs with its exact spelling or a name occurs as well.

    The phrases are cut by a hash of their words into parts of about ``part_phrases``; each part is a trie of words that walks every
    document once, so there are no candidate rows, whatever words a phrase is made of, and a longer list of phrases takes more passes
    instead of more memory. Only hits are shuffled.
    """
    spark = docs.sparkSession
    listed = cut(phrases.select("entity", "phrase", "kind", "ambiguous").where("phrase IS NOT NULL").distinct())
    parts = -(-listed.count() // part_phrases)
    rows = docs.select("doc_id", "text", "title", "population")
    schema = T.StructType([docs.schema["doc_id"], phrases.schema["entity"], T.StructField("firm", T.BooleanType()), T.StructField("level", T.IntegerType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    hits = None
    for part in range(parts):
        mine = listed.where(F.pmod(F.xxhash64(F.lower("phrase")), F.lit(parts)) == part).toArrow().to_pylist()
        shared = spark.sparkContext.broadcast((trie.build([m["phrase"] for m in mine]), [tuple(m.values()) for m in mine]))

        def run(batches, shared=shared):
            (nodes, ends), listed = shared.value
            spelled = trie.Spelled()
            for batch in batches:
                out = [[], [], [], []]
                for doc, text, title, population in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    heads = None
                    for number in trie.found(nodes, ends, trie.tokens(text)):
                        entity, phrase, kind, ambiguous = listed[number]
                        if heads is None:
                            heads = [trie.found(nodes, ends, trie.tokens(field)) for field in (title, population)]
                        level = 3 if kind == "alias" else 0 if number in heads[0] else 1 if number in heads[1] else 2
                        firm = kind != "symbol" or not ambiguous or spelled(phrase, text)
                        for column, value in zip(out, (doc, entity, firm, level)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], schema.names)

        found = rows.mapInArrow(run, schema)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], schema)
    return (hits.groupBy("doc_id", "entity").agg(F.bool_or("firm").alias("firm"), F.min("level").alias("priority"))
            .where("firm").select("doc_id", "entity", "priority"))


def best_sentence(docs: DataFrame, target: str, organization_words: str = ORGANIZATION_WORDS) -> DataFrame:
    """doc_id, start, end, sentence, score: the passage naming ``target`` that says most about an organization.

    Lines of 25+ characters that name the target; long lines are narrowed to the sentence around the first hit, or to
    -150/+200 characters. Score = 10 per organization word - |length - 160| / 40; the first best line wins.
    """
    pattern = rf"(?<![A-Za-z0-9]){target}(?![A-Za-z0-9])"
    lines = F.split(F.col("text"), "\n")
    before_line = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = (docs.where(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(lines).alias("pos", "line"))
            .withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before_line), F.lit(0)).cast("int"))
            .withColumn("hit", F.regexp_instr("line", F.lit(pattern)) - 1)
            .where((F.col("hit") >= 0) & (F.length(F.trim("line")) >= 25)))
    n = F.length("line")
    hit_end = F.col("hit") + F.length(F.regexp_substr("line", F.lit(pattern)))
    before = F.expr("substring(line, 1, hit)")
    s1 = F.when(F.contains(before, F.lit(". ")), F.length(before) - F.length(F.substring_index(before, ". ", -1))).otherwise(0)
    rows = rows.withColumn("n", n).withColumn("hit_end", hit_end).withColumn("s1", s1)
    nxt = F.expr("locate('. ', line, hit_end + 1)")
    rows = rows.withColumn("e1", F.when(nxt > 0, nxt).otherwise(F.col("n")))
    wide = F.col("n") > 400
    still = F.col("e1") - F.col("s1") > 400
    rows = (rows.withColumn("s", F.when(wide & still, F.greatest(F.lit(0), F.col("hit") - 150)).when(wide, F.col("s1")).otherwise(0))
            .withColumn("e", F.when(wide & still, F.least(F.col("n"), F.col("hit_end") + 200)).when(wide, F.col("e1")).otherwise(F.col("n")))
            .withColumn("piece", F.expr("substring(line, s + 1, e - s)"))
            .withColumn("lead", F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", "")))
            .withColumn("sentence", F.regexp_replace("piece", r"^\s+|\s+$", ""))
            .withColumn("start", F.col("at") + F.col("s") + F.col("lead"))
            .withColumn("score", F.regexp_count("sentence", F.lit(organization_words)) * 10 - F.abs(F.length("sentence") - 160) / 40))
    best = rows.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos", "start", "sentence", "score")).alias("b"))
    return best.select("doc_id", "b.start", (F.col("b.start") + F.length("b.sentence")).alias("end"), "b.sentence", "b.score")


def excerpt(text, pattern, limit: int, before: int = 100, after: int = 180, most: int = 2) -> Column:
    """The first ``limit`` characters plus at most ``most`` later windows around matches of ``pattern`` (a column).

    Windows never overlap each other or the kept start. Returns an array: the start, then the windows.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    spans = F.aggregate(
        F.arrays_zip(gaps.alias("g"), found.alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))).alias("at"),
            F.when(z["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(z["g"])).alias("s"), (acc["at"] + F.length(z["g"]) + F.length(z["m"])).alias("e"))))).alias("out")),
        lambda acc: acc["out"])
    late = F.filter(spans, lambda x: x["e"] > limit)
    picked = F.aggregate(
        late, F.struct(F.lit(limit).alias("end"), F.array().cast("array<struct<l:int,r:int>>").alias("out")),
        lambda acc, x: F.when((x["s"] >= acc["end"]) & (F.size(acc["out"]) < most), F.struct(
            F.least(F.length(text), x["e"] + after).alias("end"),
            F.concat(acc["out"], F.array(F.struct(F.greatest(F.lit(limit), x["s"] - before).alias("l"), F.least(F.length(text), x["e"] + after).alias("r")))).alias("out")))
        .otherwise(acc), lambda acc: acc["out"])
    return F.concat(F.array(F.substring(text, 1, limit)), F.transform(picked, lambda w: F.substring(text, w["l"] + 1, w["r"] - w["l"])))


def context_window(text, start, end, whole: int = 30000, around: int = 3000) -> Column:
    """The whole text when short, else the text around the span."""
    left = F.greatest(F.lit(0), start - around)
    return F.when(F.length(text) <= whole, text).otherwise(F.substring(text, left + 1, F.least(F.length(text), end + around) - left))


def render_record(fields: list[tuple[str, Column]]) -> Column:
    """'Label: value' lines of a structured record as canonical text."""
    return canonical_text(F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(""))) for label, value in fields]))
