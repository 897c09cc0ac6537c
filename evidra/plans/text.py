from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import strings
from evidra.functions.strings import BLANK, LINE_BLANK
from evidra.functions.pyudfs import html_text
from evidra.operators import text as X
from evidra.sources import archive as A

from .registry import query

# Documents as they might arrive: CRLF line ends, tabs and wide blanks between words and lines, accents decomposed, blank lines around.
DIRTY = "concat('\n\u3000\n ', replace(replace(replace(text, '\n', '\u2003 \r\n\r\n\u2028\r\n '), ' ', ' \t\u00a0'), 'é', 'e\u0301'), ' \n\u3000')"
CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({}), '\r\n?', '\n', 'g'), '[ \t\u00a0\u2009\u202f]+', ' ', 'g'),
  '[@L]*\n[@L]*', '\n', 'g'), '\n{{3,}}', '\n\n', 'g'), '^[@B]+|[@B]+$', '', 'g')""".replace("@L", LINE_BLANK).replace("@B", BLANK)


def dirty():
    return F.expr(DIRTY.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))


@query("canonical_text", f"""SELECT doc_id, sha256({CLEAN.format(DIRTY)}) AS text_hash, CAST(length({CLEAN.format(DIRTY)}) AS INTEGER) AS n_chars FROM documents""")
def canonical_text(t):
    clean = t.documents.select("doc_id", X.canonical_text(dirty()).alias("c"))
    return clean.select("doc_id", F.sha2("c", 256).alias("text_hash"), F.length("c").alias("n_chars"))


@query("normalize_text", """SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS norm_hash FROM documents""")
def normalize_text(t):
    return t.documents.select("doc_id", F.sha2(strings.plain("text"), 256).alias("norm_hash"))


@query("content_id", """SELECT c_custkey, concat('claim:sha256:', sha256(concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_name":"', c_name, '","note":',
  CASE WHEN c_acctbal < 0 THEN 'null' ELSE concat('"caf\u00e9 ', c_nationkey, '"') END, '}'))) AS claim_id FROM customer""")
def content_id(t):
    """Claims with a field that is null for some and holds a decomposed accent for the others."""
    note = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("cafe\u0301 "), F.col("c_nationkey")))
    rows = t.customer.withColumn("note", note)
    return rows.select("c_custkey", A.content_id("claim", ["c_name", "c_custkey", "c_mktsegment", "note"], ["note"]).alias("claim_id"))


@query("content_archive", f"""WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, {DIRTY} FROM documents),
h AS (SELECT doc_id, concat('sha256:', sha256(text)) AS raw_hash, concat('sha256:', sha256({CLEAN.format("text")})) AS source_id FROM a)
SELECT source_id, min(doc_id) AS doc_id, arg_min(raw_hash, doc_id) AS raw_hash, CAST(count(*) AS BIGINT) AS copies FROM h GROUP BY source_id""")
def content_archive(t):
    """Every document and a copy of it with other line ends, blanks and accents: one source for both."""
    docs = t.documents.select("doc_id", "text")
    both = docs.unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), dirty().alias("text")))
    return A.archive(both, X.canonical_text(F.col("text")))


# every column of every table; numbers with a point and times are spelled the same by any engine
PLAIN, NUMBER, TIME, LIST = "{c}", "CAST(round({c} * 1e6) AS BIGINT)", "time", "list"
FINGERPRINTED = {
    "region": {"r_regionkey": PLAIN, "r_name": PLAIN}, "nation": {"n_nationkey": PLAIN, "n_name": PLAIN, "n_regionkey": PLAIN},
    "customer": {"c_custkey": PLAIN, "c_name": PLAIN, "c_nationkey": PLAIN, "c_acctbal": NUMBER, "c_mktsegment": PLAIN},
    "supplier": {"s_suppkey": PLAIN, "s_name": PLAIN, "s_nationkey": PLAIN, "s_acctbal": NUMBER},
    "part": {"p_partkey": PLAIN, "p_name": PLAIN, "p_brand": PLAIN, "p_type": PLAIN, "p_size": PLAIN, "p_retailprice": NUMBER},
    "orders": {"o_orderkey": PLAIN, "o_custkey": PLAIN, "o_orderstatus": PLAIN, "o_totalprice": NUMBER, "o_orderdate": TIME, "o_orderpriority": PLAIN},
    "lineitem": {"l_orderkey": PLAIN, "l_partkey": PLAIN, "l_suppkey": PLAIN, "l_linenumber": PLAIN, "l_quantity": NUMBER, "l_extendedprice": NUMBER,
                 "l_discount": NUMBER, "l_tax": NUMBER, "l_returnflag": PLAIN, "l_linestatus": PLAIN, "l_shipdate": TIME},
    "events": {"event_id": PLAIN, "ts": TIME, "user_id": PLAIN, "event_type": PLAIN, "value": NUMBER, "props": PLAIN},
    "documents": {"doc_id": PLAIN, "text": PLAIN, "lang": PLAIN, "source": PLAIN, "n_chars": PLAIN},
    "embeddings": {"vec_id": PLAIN, "embedding": LIST, "label": PLAIN}, "pages": {"page_id": PLAIN, "url": PLAIN, "html": PLAIN},
    "benchmark": {"item_id": PLAIN, "text": PLAIN}, "labels": {"doc_id": PLAIN, "quality": PLAIN, "toxic": PLAIN},
    "conversations": {"conv_id": PLAIN, "turn": PLAIN, "role": PLAIN, "text": PLAIN}}


def _digest_sql(name, cols):
    spelled = {PLAIN: "CAST({c} AS VARCHAR)", NUMBER: f"CAST({NUMBER} AS VARCHAR)", TIME: "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
               LIST: "array_to_string(list_transform({c}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')"}
    cells = [spelled[kind].format(c=c) for c, kind in cols.items()]
    row = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in cells)
    return f"""SELECT '{name}' AS dataset, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(concat('0x', left(sha256({row}), 12)) AS BIGINT)) AS VARCHAR) AS digest FROM {name}"""


@query("dataset_fingerprint", " UNION ALL ".join(_digest_sql(n, c) for n, c in FINGERPRINTED.items()))
def dataset_fingerprint(t):
    out = None
    spelled = {TIME: "date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
               LIST: "array_join(transform({c}, x -> CAST(round(CAST(x AS DOUBLE) * 1e6D) AS BIGINT)), ',')", NUMBER: "CAST(round({c} * 1e6D) AS BIGINT)"}
    for name, cols in FINGERPRINTED.items():
        rows = getattr(t, name).select(*[F.expr(spelled.get(kind, kind).format(c=c)).alias(c) for c, kind in cols.items()])
        row = A.fingerprint(rows, list(cols)).select(F.lit(name).alias("dataset"), "n_rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


LOCATED = """loc AS (SELECT item_id AS quote_id, doc_id, strpos(d.text, m) - 1 AS start, strpos(d.text, m) - 1 + length(m) AS "end", b.text AS quote, d.text AS text FROM (
  SELECT item_id, doc_id, regexp_extract(d.text, regexp_replace(regexp_escape(regexp_replace(trim(b.text), '[@B]+', ' ', 'g')), '\\\\? ', '[@B]+', 'g')) AS m
  FROM benchmark b, documents d) JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE m <> '')""".replace("@B", BLANK)


def located(t):
    return X.locate_quotes(t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t.documents)


@query("locate_quotes", f"""WITH {LOCATED} SELECT quote_id, doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM loc""")
def locate_quotes(t):
    return located(t)


@query("excerpt_windows", f"""WITH {LOCATED}
SELECT quote_id, doc_id, CASE WHEN "end" > 400 AND start >= 400 THEN concat(left(text, 400), ' ... ', substring(text, greatest(400, start - 100)::INTEGER + 1, (least(length(text), "end" + 180) - greatest(400, start - 100))::INTEGER)) ELSE left(text, 400) END AS excerpt,
  CAST(length(CASE WHEN length(text) <= 3000 THEN text ELSE substring(text, greatest(0, start - 300)::INTEGER + 1, (least(length(text), "end" + 300) - greatest(0, start - 300))::INTEGER) END) AS INTEGER) AS context_chars
FROM loc""")
def excerpt_windows(t):
    hits = located(t).join(t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), "quote_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return hits.select("quote_id", "doc_id", F.array_join(X.excerpt(F.col("text"), X.quote_pattern(F.col("quote")), 400), " ... ").alias("excerpt"),
                       F.length(X.context_window(F.col("text"), F.col("start"), F.col("end"), 3000, 300)).alias("context_chars"))


# Evidence that cites every document somewhere in its text, with the kinds of mistakes a contributor makes: unknown sources, quotes that are
# made up, negative offsets, offsets past the end of short texts, and quotes that are too long.
CITED_AT = """CASE WHEN lang = 'fr' AND length(text) > 4000 THEN (d.doc_id * 7919) % (length(text) - 2600)
  WHEN length(text) > 80 THEN (d.doc_id * 7919) % (length(text) - 70) ELSE 0 END"""
CITED_CHARS = "CASE WHEN lang = 'fr' AND length(text) > 4000 THEN 2500 ELSE 60 END"
AUDITED = """doc_id, CASE WHEN lang = 'es' AND length(text) < 400 THEN concat('missing-', doc_id) ELSE CAST(doc_id AS STRING) END AS source_id,
  CASE WHEN toxic = 1 THEN 'not in the text' ELSE replace(substring(text, CAST(s + 1 AS INT), n), ' ', '  ') END AS quote,
  CASE WHEN quality = 0 THEN -1 ELSE s END AS start, s + n AS `end`"""


@query("audit_quotes", f"""WITH c AS (SELECT d.doc_id, text, lang, quality, toxic, {CITED_AT} AS s, {CITED_CHARS} AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
ev AS (SELECT {AUDITED.replace("STRING", "VARCHAR").replace("`end`", '"end"')} FROM c),
src AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, text, sha256(text) AS h, sha256(CASE WHEN lang = 'de' THEN concat(text, '.') ELSE text END) AS recorded FROM documents)
SELECT doc_id, coalesce(CASE WHEN recorded IS NULL THEN 'source is not archived' WHEN h <> recorded THEN 'source does not match its hashes'
  WHEN NOT (start >= 0 AND start < "end" AND "end" <= length(text)) THEN 'offsets out of range' WHEN length(quote) > 2000 THEN 'quote too long'
  WHEN trim(regexp_replace(substring(text, CAST(start + 1 AS INTEGER), CAST("end" - start AS INTEGER)), '\\s+', ' ', 'g')) <> trim(regexp_replace(quote, '\\s+', ' ', 'g')) THEN 'quote not at its offsets' END, 'ok') AS reason
FROM ev LEFT JOIN src USING (source_id)""")
def audit_quotes(t):
    cited = (t.documents.alias("d").join(t.labels.alias("l"), F.col("l.doc_id") == F.col("d.doc_id"), "left")
             .selectExpr("d.doc_id AS doc_id", "text", "lang", "quality", "toxic", f"CAST({CITED_AT} AS INT) AS s", f"{CITED_CHARS} AS n"))
    ev = cited.select("doc_id", *[F.expr(x) for x in (
        "CASE WHEN lang = 'es' AND length(text) < 400 THEN concat('missing-', doc_id) ELSE CAST(doc_id AS STRING) END AS source_id",
        "CASE WHEN toxic = 1 THEN 'not in the text' ELSE replace(substring(text, s + 1, n), ' ', '  ') END AS quote",
        "CASE WHEN quality = 0 THEN -1 ELSE s END AS start", "s + n AS end")])
    src = t.documents.select(F.col("doc_id").cast("string").alias("source_id"), "text", F.col("text").alias("raw"),
                             F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("text_hash"), F.sha2("text", 256).alias("raw_hash"))
    return X.audit_quotes(ev, src).select("doc_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("match_version", """SELECT doc_id AS id, CASE lang WHEN 'fr' THEN 'lower' WHEN 'es' THEN CASE WHEN lower(text) = text THEN 'lower' ELSE 'raw' END ELSE 'none' END AS version FROM documents""")
def match_version(t):
    d = t.documents
    versions = d.select(F.col("doc_id").alias("id"), F.lit("raw").alias("version"), "text").unionByName(d.select(F.col("doc_id").alias("id"), F.lit("lower").alias("version"), F.lower("text").alias("text")))
    recorded = d.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", F.sha2(F.lower("text"), 256)).when(F.col("lang") == "es", F.sha2("text", 256))
                        .otherwise(F.sha2(F.concat(F.lit("x"), "text"), 256)).alias("hash"))
    return X.match_version(recorded, versions).withColumn("version", F.coalesce("version", F.lit("none")))


COMMON = ("that", "the", "on", "re", "is", "and", "of", "in")  # symbols that are ordinary words here


def phrases(t):
    w = t.benchmark.select(F.col("item_id").alias("entity"), strings.words("text").alias("w"))
    symbol = w.select("entity", F.upper(F.col("w")[0]).alias("phrase"), F.lit("symbol").alias("kind"), F.col("w")[0].isin(*COMMON).alias("ambiguous"))
    name = w.select("entity", F.array_join(F.slice("w", 2, 3), " ").alias("phrase"), F.lit("name").alias("kind"), F.lit(False).alias("ambiguous"))
    alias = w.select("entity", F.array_join(F.slice("w", 6, 2), "-").alias("phrase"), F.lit("alias").alias("kind"), F.lit(False).alias("ambiguous"))
    return symbol.unionByName(name).unionByName(alias)


TOKENS = "concat(' ', array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' '), ' ')"


@query("phrase_match", f"""WITH w AS (SELECT item_id AS entity, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT entity, upper(w[1]) AS phrase, 'symbol' AS kind, w[1] IN {COMMON} AS ambiguous, concat(' ', w[1], ' ') AS want FROM w
  UNION ALL SELECT entity, '', 'name', false, concat(' ', array_to_string(w[2:4], ' '), ' ') FROM w
  UNION ALL SELECT entity, '', 'alias', false, concat(' ', array_to_string(w[6:7], ' '), ' ') FROM w),
d AS (SELECT doc_id, text, {TOKENS.format("text")} AS toks, {TOKENS.format("split_part(text, chr(10), 1)")} AS title, {TOKENS.format("split_part(text, chr(10), 2)")} AS population FROM documents),
h AS (SELECT doc_id, entity, kind <> 'symbol' OR NOT ambiguous OR regexp_matches(text, concat('(^|[^\\p{{L}}\\p{{N}}_])', phrase, '($|[^\\p{{L}}\\p{{N}}_])')) AS firm,
  CASE WHEN kind = 'alias' THEN 3 WHEN contains(title, want) THEN 0 WHEN contains(population, want) THEN 1 ELSE 2 END AS level
  FROM d JOIN p ON contains(toks, want))
SELECT doc_id, entity, CAST(min(level) AS INTEGER) AS priority FROM h GROUP BY ALL HAVING bool_or(firm)""")
def phrase_match(t):
    docs = t.documents.select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("population"))
    return X.phrase_match(phrases(t), docs)


ORG = "tion|and|with"


@query("best_sentence", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
a AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at FROM l),
h AS (SELECT *, length(regexp_extract(line, '^(.*?)\\bthe\\b', 1)) AS hit, length(line) AS n FROM a WHERE regexp_matches(line, '\\bthe\\b') AND length(trim(line)) >= 25),
c AS (SELECT *, CASE WHEN contains(left(line, hit), '. ') THEN hit - strpos(reverse(left(line, hit)), ' .') + 1 ELSE 0 END AS s1,
  CASE WHEN strpos(substring(line, hit + 4), '. ') > 0 THEN hit + 3 + strpos(substring(line, hit + 4), '. ') ELSE n END AS e1 FROM h),
p AS (SELECT *, CASE WHEN n > 400 AND e1 - s1 > 400 THEN greatest(0, hit - 150) WHEN n > 400 THEN s1 ELSE 0 END AS s,
  CASE WHEN n > 400 AND e1 - s1 > 400 THEN least(n, hit + 203) WHEN n > 400 THEN e1 ELSE n END AS e FROM c),
q AS (SELECT *, regexp_replace(substring(line, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS sentence,
  length(substring(line, s + 1, e - s)) - length(regexp_replace(substring(line, s + 1, e - s), '^\\s+', '')) AS lead FROM p),
r AS (SELECT *, len(regexp_extract_all(sentence, '{ORG}')) * 10 - abs(length(sentence) - 160) / 40 AS score FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM r)
SELECT doc_id, CAST(line_at + s + lead AS INTEGER) AS start, CAST(line_at + s + lead + length(sentence) AS INTEGER) AS "end", sentence, round(score, 4) AS score FROM b WHERE k = 1""")
def best_sentence(t):
    return X.best_sentence(t.documents, "the", ORG).withColumn("score", F.round("score", 4))


def _page_sql():
    """The given pages are well formed, so patterns give what the parser gives; tests hold it against pages that are not."""
    x = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "nav", "footer", "header"):
        x = f"regexp_replace({x}, '(?is)<{tag}[ \t\r\n>].*?</{tag} *>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|li|h1|h2|h3|h4|tr) *>|<br */?>', chr(10), 'g')"
    def plain(text):
        return f"replace(replace({text}, '&quot;', '\"'), '&amp;', '&')"
    text = plain(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    title = plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return f"""WITH p AS (SELECT page_id, trim({title}) AS title, {text} AS x FROM pages), c AS (SELECT page_id, title, {CLEAN.format("x")} AS t FROM p)
SELECT page_id, title, sha256(t) AS text_hash, CAST(length(t) AS INTEGER) AS n_chars FROM c"""


@query("page_text", _page_sql())
def page_text(t):
    """Visible text of every page."""
    parsed = t.pages.select("page_id", html_text("html").alias("h"))
    return parsed.select("page_id", "h.title", F.sha2(X.canonical_text(F.col("h.text")), 256).alias("text_hash"), F.length(X.canonical_text(F.col("h.text"))).alias("n_chars"))


LINK = '<a href="([^"]+)">([^<]*)</a>'


def links(t):
    return (t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), 0)).alias("tag"))
            .select("page_id", F.regexp_extract("tag", LINK, 1).alias("href"), F.regexp_extract("tag", LINK, 2).alias("label")).distinct())


LINKS = f"""link AS (SELECT DISTINCT page_id, regexp_extract(tag, '{LINK}', 1) AS href, regexp_extract(tag, '{LINK}', 2) AS label FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '{LINK}')) AS tag FROM pages))"""


@query("page_links", f"WITH {LINKS} SELECT page_id, href, label FROM link")
def page_links(t):
    return links(t)


@query("regex_members", f"""WITH {LINKS}, m AS (SELECT DISTINCT lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS grp, href AS member FROM link JOIN pages USING (page_id))
SELECT grp, CAST(count(*) AS BIGINT) AS n_members, min(member) AS first_member FROM m GROUP BY grp""")
def regex_members(t):
    host = t.pages.select("page_id", F.lower(F.regexp_extract("url", "^[^:]+://([^/?#:]+)", 1)).alias("grp"))
    return (links(t).join(host, "page_id").select("grp", F.col("href").alias("member")).distinct()
            .groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"), F.min("member").alias("first_member")))
