"""The registered queries of this package and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, collocations, fingerprints, language, linededup, manifest, mixing, ngram_join, packing, passages, quality, sequences, topk
from .common import LOWER, UPPER, sha256, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query("""
WITH d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
           CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
c AS (
    SELECT *, greatest(length(bin(size)) - 5, 0) AS sh,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS BIGINT) % 64 AS slot
    FROM d),
r AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY sh * 16 + (size >> sh) DESC, slot, doc_id NULLS FIRST, size) AS pos
    FROM c),
s AS (
    SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY g) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap
    FROM (SELECT g, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY g)),
f AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(cap) OVER (ORDER BY cap / w, g) - cap AS cap_before,
           sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, g) + w AS w_left
    FROM s),
t AS (
    SELECT *, cap / w <= (budget - cap_before) / w_left AS is_full FROM f),
u AS (
    SELECT g, source_size,
           CASE WHEN is_full THEN cap ELSE w * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0))
                                          / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target,
           CAST('0x' || substr(md5('0:' || g), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift
    FROM t),
v AS (
    SELECT r.doc_id, r.size, u.source_size, u.target, r.pos, u.shift,
           CASE WHEN u.source_size > 0 THEN u.target / u.source_size ELSE 0.0 END AS rate
    FROM r JOIN u ON r.g = u.g)
SELECT doc_id, size, source_size, target,
       CAST((floor(pos * rate + shift) - floor((pos - 1) * rate + shift)) * size AS BIGINT) AS taken
FROM v""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 over the sources, 150 % of all words, at most twice a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


@query("""
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest inner product for each fiftieth vector, against all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 50 == 0)


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all documents and of their edited texts, with the likeness to the edit and to the next document."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""
WITH lines AS (
    SELECT doc_id, i, ls[i] AS line,
           translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
stop AS (
    SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, k FROM lines WHERE length(k) >= 40)
    GROUP BY k HAVING count(*) >= 5),
judged AS (
    SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND l.doc_id < s.last AS gone FROM lines l LEFT JOIN stop s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the long lines that five or more of them share."""
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents, learnt outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query()
def op6_pack_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of balanced cost."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents that repeat an earlier passage."""
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op8_pack_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id matrices with segment lengths and position resets."""
    return sequences.pack_matrix(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
           length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g')) AS chars,
           length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) AS role_chars
    FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN before IS NULL THEN 7 + role_chars WHEN before = role THEN 6 ELSE 15 + role_chars END) + 8 AS BIGINT)
           AS formatted_chars
FROM p GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own marks, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(odd)))


@query()
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of all documents, at a likeness of 0.8 of their five-word n-grams."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by the code length of their whole texts, learnt outside the held-out fold."""
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query(r"""
WITH pieces AS (
    SELECT lang, d, i, ps[i] AS piece
    FROM (SELECT lang, d, ps, unnest(range(1, len(ps) + 1)) AS i
          FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
                       regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
                FROM documents WHERE text IS NOT NULL))),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM said GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM said, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
held AS (
    SELECT DISTINCT s.lang, s.phrase
    FROM f s JOIN (SELECT lang, f, array_to_string(ws[i:i + j - 1], ' ') AS part
                   FROM (SELECT lang, f, ws, k, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest([2, 3, 4]) AS j) WHERE j < k)) b
      ON s.lang = b.lang AND s.phrase = b.part AND 100 * b.f >= 100 * s.f),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
scored AS (
    SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n,
           CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, c.c
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored) WHERE o = 1),
ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase WHERE h.phrase IS NULL)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""")
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text")).withColumnRenamed("grp", "lang")


@query(r"""
WITH RECURSIVE bit AS (
    SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], flatten([[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                                                         FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
said AS (
    SELECT d.doc_id, lang AS g, text,
           coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
           coalesce(xor(crc, 4294967295) % 3 = 0, false) AS bent
    FROM documents d LEFT JOIN bit ON d.doc_id = bit.doc_id),
leaf AS (
    SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
           sha256(head || coalesce(strlen(text) || ':' || CASE WHEN bent
               THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS told
    FROM said),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf),
lv AS (
    SELECT g, 0 AS d, list(h ORDER BY pos) AS hs FROM placed GROUP BY g
    UNION ALL
    SELECT g, d + 1, [sha256(array_to_string(hs[8 * i + 1:8 * i + 8], '')) FOR i IN range(0, (len(hs) + 7) // 8)] FROM lv WHERE len(hs) > 1),
sub AS (SELECT g, d AS height, hs[1] AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM lv WHERE len(hs) = 1),
up AS (
    SELECT 0 AS d, list(subroot ORDER BY place) AS hs FROM sub HAVING count(*) > 0
    UNION ALL
    SELECT d + 1, [sha256(array_to_string(hs[8 * i + 1:8 * i + 8], '')) FOR i IN range(0, (len(hs) + 7) // 8)] FROM up WHERE len(hs) > 1),
stepped AS (
    SELECT p.g, p.pos, lv.d, lv.hs AS hs, p.pos // CAST(pow(8, lv.d) AS BIGINT) AS i
    FROM placed p JOIN lv ON p.g IS NOT DISTINCT FROM lv.g AND len(lv.hs) > 1
    UNION ALL
    SELECT p.g, p.pos, sub.height + up.d, up.hs, sub.place // CAST(pow(8, up.d) AS BIGINT)
    FROM placed p JOIN sub ON p.g IS NOT DISTINCT FROM sub.g JOIN up ON len(up.hs) > 1),
steps AS (
    SELECT g, pos, d, array_to_string(hs[i - i % 8 + 1:i], '') AS before, array_to_string(hs[i + 2:i - i % 8 + 8], '') AS after FROM stepped),
proof AS (SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY d)) AS proof_sha256, count(*) AS n FROM steps GROUP BY g, pos),
fold AS (
    SELECT g, pos, 0 AS d, told AS h FROM placed
    UNION ALL
    SELECT f.g, f.pos, f.d + 1, sha256(s.before || f.h || s.after)
    FROM fold f JOIN steps s ON f.g IS NOT DISTINCT FROM s.g AND f.pos = s.pos AND f.d = s.d),
ended AS (SELECT g, pos, arg_max(h, d) AS folded_root FROM fold GROUP BY g, pos)
SELECT p.doc_id, p.h AS leaf, sub.subroot, r.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = r.root AS verified
FROM placed p JOIN sub ON p.g IS NOT DISTINCT FROM sub.g CROSS JOIN (SELECT hs[1] AS root FROM up WHERE len(hs) = 1) r
JOIN ended e ON p.g IS NOT DISTINCT FROM e.g AND p.pos = e.pos
LEFT JOIN proof ON p.g IS NOT DISTINCT FROM proof.g AND p.pos = proof.pos""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of all documents, and whether a copy, lower-cased in a third of the documents, still leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    bent = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    lowered = F.when(bent, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    told = manifest.leaf_digest([lowered if c == "text" else F.col(c) for c in manifest.COLUMNS])
    rows = manifest.manifest(docs.withColumn("told", F.when(bent, told)))
    root = manifest.folded(F.coalesce("row.told", "leaf"), F.col("path"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), *[manifest.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                       F.sha2(manifest.siblings_text(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"),
                       (root == manifest.hex_text(F.col("root"))).alias("verified"))
