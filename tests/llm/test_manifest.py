import hashlib
import random
import zlib

from pyspark.sql import functions as F

from evidra.llm import manifest

from . import frames


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes):
    """(top, for each leaf its list of (before, after))."""
    trails, spots, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, at in enumerate(spots):
            a, b = at - at % 8, at - at % 8 + 8
            trails[i].append(("".join(level[a:at]), "".join(level[at + 1:b])))
        level = [sha(*level[i:i + 8]) for i in range(0, len(level), 8)]
        spots = [at // 8 for at in spots]
    return level[0], trails


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r: sha(*map(said, (r[0], r[3], r[2], r[4], r[1])))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    root, over = tree([tops[g][0] for g in order]) if order else (None, [])
    out = []
    for g, up in zip(order, over):
        for r, trail in zip(groups[g], tops[g][1]):
            out.append((r[0], leaf(r), tops[g][0], root, sha(*(a + b for a, b in trail + up)), trail + up))
    return out


def got(df):
    hexed = lambda c: manifest.hex_text(F.col(c)).alias(c)
    rows = manifest.manifest(df).select(
        "row.doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(manifest.siblings_text(F.col("path")), 256).alias("proof"),
        F.transform("path", lambda p: F.struct(manifest.hex_text(p["before"]).alias("a"), manifest.hex_text(p["after"]).alias("b"))).alias("path"),
        manifest.folded(F.col("leaf"), F.col("path")).alias("back"), "row").collect()
    assert all(r.back == r.root for r in rows)
    return [(*r[:5], [tuple(p) for p in r.path]) for r in rows], rows


def table(spark, rows, clashes=True):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], frames.DOCS)
    return df.withColumns({c: F.lit(f"<{c}>") for c in (*frames.CLASHES, "pos", "m", "h", "leaf", "path", "up_g", "part")}) if clashes else df


def test_trees_of_all_sizes(spark):
    rows = [(i * 7 % 1000, f"text {i}", f"l{n}", None if i % 5 == 0 else "s", i) for n in (1, 2, 7, 8, 9, 64, 65, 130) for i in range(n)]
    random.Random(3).shuffle(rows)
    assert sorted(got(table(spark, rows, False))[0]) == sorted(brute(rows))


def test_blocks_meet(spark):
    n = manifest.BLOCK * 2 + 10
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
    assert sorted(got(table(spark, rows, False))[0]) == sorted(brute(rows))


def test_awkward_rows(spark):
    rows = [(r[0], r[1], "en" if i % 3 else None, r[2] if len(r) > 2 else "x", None if i % 4 == 0 else i) for i, r in enumerate(frames.EDGE)]
    rows += [(None, None, None, None, None)] * 3 + [(4, "same", "é", "ü–", 1), (4, "same", "é", "ü–", 1), (4, "other", "é", "", 0)]
    mine, whole = got(table(spark, rows))
    assert sorted(mine, key=repr) == sorted(brute(rows), key=repr)
    assert {r.row.path for r in whole} == {"<path>"} and whole[0].row["m"] == "<m>"
    assert got(table(spark, [], False))[0] == []
    lone = got(table(spark, [(1, "a", "en", "s", 1)], False))[0][0]
    assert lone[1] == lone[2] == lone[3] and lone[5] == [] and lone[4] == sha("")


def test_tampering_shows(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else "fr", "s", i) for i in range(300)]
    df = table(spark, rows, False)
    bent = df.withColumn("told", manifest.leaf_digest([F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in manifest.COLUMNS]))
    out = manifest.manifest(bent).select("row.doc_id", manifest.folded(F.col("row.told"), F.col("path")).alias("back"), manifest.hex_text(F.col("root")).alias("root")).collect()
    assert len(out) == 300 and all(r.back != r.root for r in out)


def test_query_flags_what_it_bent(spark, tmp_path):
    from evidra.llm.queries import QUERIES
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", "en", "s", i) for i in range(120)]
    table(spark, rows, False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2 == 1))
