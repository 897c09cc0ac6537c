import hashlib

import pytest
from pyspark.sql import functions as F

from evidra.operators import claims as C
from evidra.operators import integrity as I
from evidra.operators import linking as L
from evidra.operators import review as R
from evidra.functions.hashing import fnv1a32
from evidra.sources import publish as P

REV = "claim_id string, reviewer string, reviewer_kind string, model_family string, verdict string, seq int"


def status(spark, rows):
    df = spark.createDataFrame([("c", *r) for r in rows], REV)
    return R.review_status(df).first().status


def test_review_status_rules(spark):
    ok, bad, scope = "supports", "does_not_support", "out_of_scope"
    assert status(spark, [("a", "agent", "f1", ok, 1)]) == "reviewed"
    assert status(spark, [("a", "agent", "gpt-5", ok, 1), ("b", "agent", "OpenAI", ok, 2)]) == "reviewed"
    assert status(spark, [("a", "agent", "f1", ok, 1), ("b", "agent", "f2", "supports_with_qualification", 2)]) == "independently_reviewed"
    assert status(spark, [("a", "agent", "f1", ok, 1), ("b", "agent", "f2", bad, 2)]) == "review_disagreement"
    assert status(spark, [("a", "agent", "f1", ok, 1), ("a", "agent", "f1", bad, 2)]) == "rejected"
    assert status(spark, [("a", "agent", "f1", scope, 1)]) == "rejected"
    assert status(spark, [("a", "agent", "f1", ok, 1), ("b", "agent", "f2", scope, 2)]) == "reviewed"
    assert status(spark, [("a", "agent", "f1", bad, 3), ("h", "human", None, bad, 1), ("h", "human", None, ok, 2)]) == "human_reviewed"
    assert status(spark, [("a", "agent", "", ok, 1), ("b", "agent", None, ok, 2)]) == "independently_reviewed"


def test_levels_and_quota(spark):
    cases = [(0, 0, "new", 20), (4, 0, "new", 20), (2, 3, "unreliable", 5), (4, 2, "mixed", 20), (8, 1, "new", 20), (9, 1, "reliable", 40)]
    df = spark.createDataFrame([(a, r) for a, r, _, _ in cases], "a int, r int").withColumn("l", R.level(F.col("a"), F.col("r")))
    got = df.withColumn("q", R.earned_quota(20, F.col("l"))).collect()
    assert [(g.a, g.r, g.l, g.q) for g in got] == cases


def test_reviewer_agreement_leaves_self_out(spark):
    rows = [("c1", "a", "agent", "f1", "supports", 1), ("c1", "b", "agent", "f1", "does_not_support", 2), ("c1", "c", "agent", "f2", "supports", 3), ("c1", "a", "agent", "f1", "supports", 4),
            ("c2", "a", "agent", "f1", "supports", 5), ("c3", "h", "human", "", "supports", 6), ("c3", "a", "agent", "f1", "does_not_support", 7), ("c3", "g", "human", "", "does_not_support", 8)]
    df = spark.createDataFrame(rows, REV)
    want = {}
    for cid in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == cid), key=lambda r: r[5])
        for r in mine:
            others = [("c", *x[1:]) for x in mine if x[1] != r[1]]
            w = want.setdefault(r[1], [0, 0, 0])
            w[0] += 1
            if others:
                st = R.review_status(spark.createDataFrame(others, REV)).first().status
                ok = r[4].startswith("supports")
                agree = ok if st in R.ACCEPTED else (not ok if st == "rejected" else None)
                if agree is not None:
                    w[1] += 1
                    w[2] += agree
    got = {r.reviewer: [r.given, r.compared, r.agreed] for r in R.reviewer_agreement(df).collect()}
    assert got == want


def test_visibility(spark):
    df = spark.createDataFrame([("contributed", s, p) for s in ("unreviewed", "reviewed", "independently_reviewed", "human_reviewed", "review_disagreement", "rejected") for p in ("has_symptom", "causes", "tested_in")],
                               "origin string, status string, predicate string")
    seen = {(r.status, r.predicate): (r.research, r.family, r.strict) for r in df.select("*", *[R.visible(p, F.col("origin"), F.col("status"), F.col("predicate")).alias(p) for p in ("research", "family", "strict")]).collect()}
    assert seen["review_disagreement", "causes"] == (True, False, False) and seen["rejected", "causes"] == (False, False, False)
    assert seen["reviewed", "has_symptom"] == (True, True, False) and seen["reviewed", "causes"] == (True, False, False)
    assert seen["independently_reviewed", "tested_in"] == (True, False, False) and seen["human_reviewed", "tested_in"] == (True, True, True)


def test_alias_chains_cycles_and_ambiguity(spark):
    links = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "g"), ("f", "h"), ("i", "f"), ("k", "k")]
    got = {(r.alias, r.target, r.hops) for r in C.resolve_aliases(spark.createDataFrame(links, "alias string, target string")).collect()}
    assert got == {("a", "c", 2), ("b", "c", 1)}
    chain = [(i, i + 1) for i in range(37)] + [(100, 101), (101, 102), (102, 100), (99, 100)]
    got = {(r.alias, r.target, r.hops) for r in C.resolve_aliases(spark.createDataFrame(chain, "alias long, target long")).collect()}
    assert got == {(i, 37, 37 - i) for i in range(37)}


def test_disputes_pending_then_contested(spark):
    claims = spark.createDataFrame([("c1", "A1", True), ("c2", "A2", True), ("c3", "A3", False), ("k", "B", True)], "claim_id string, assertion_id string, kernel_ok boolean")
    ch = spark.createDataFrame([("c1", None), ("A2", "k"), ("c3", None), ("A1", None)], "target string, counter_claim string")
    one = spark.createDataFrame([("k", "a", "agent", "f1", "supports", 1)], REV)
    two = spark.createDataFrame([("k", "a", "agent", "f1", "supports", 1), ("k", "b", "agent", "f2", "supports", 2)], REV)
    assert {(r.assertion_id, r.status, r.n_objections) for r in C.disputes(ch, claims, one).collect()} == {("A1", "pending_review", 2), ("A2", "pending_review", 1)}
    assert {(r.assertion_id, r.status) for r in C.disputes(ch, claims, two).collect()} == {("A1", "pending_review"), ("A2", "contested")}


def test_rolling_count_across_buckets(spark):
    times = [0, 5, 99, 100, 101, 150, 199, 200, 305]
    df = spark.createDataFrame([("u", t) for t in times] + [("w", 100)], "actor string, at long")
    got = {(r.actor, r.at): r.recent for r in C.rolling_count(df, "actor", "at", 100).collect()}
    assert got == {**{("u", t): sum(t - 100 <= s <= t - 1 for s in times) for t in times}, ("w", 100): 0}


def merkle(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + merkle(leaves[:k]) + merkle(leaves[k:])).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 33])
def test_merkle_root_proofs_and_verification(spark, n):
    leaves = [hashlib.sha256(b"\x00" + f"event-{i}".encode()).digest() for i in range(n)]
    log = spark.createDataFrame([(i, f"event-{i}") for i in range(n)], "seq long, data string")
    row = I.merkle_root(log).first()
    assert (row["size"], row["root"]) == (n, merkle(leaves).hex())
    proofs = I.inclusion_proofs(log, log.select("seq"))
    checked = I.verify_inclusion(proofs.join(log.select("seq", I.leaf_hash(F.col("data")).alias("leaf")), "seq"), n)
    assert {r["root"] for r in checked.collect()} == {merkle(leaves).hex()} and checked.count() == n


def test_merkle_root_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(I, "FAN_BITS", 2)
    monkeypatch.setattr(I, "FAN", 4)
    for n in (5, 16, 23, 65):
        leaves = [hashlib.sha256(b"\x00" + f"event-{i}".encode()).digest() for i in range(n)]
        log = spark.createDataFrame([(i, f"event-{i}") for i in range(n)], "seq long, data string")
        assert I.merkle_root(log).first()["root"] == merkle(leaves).hex()


def test_consistency_of_every_prefix(spark, monkeypatch):
    hashed = [hashlib.sha256(b"\x00" + f"event-{i}".encode()).digest() for i in range(90)]

    def subproof(m, leaves, known):
        if m == len(leaves):
            return [] if known else [merkle(leaves)]
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return subproof(m, leaves[:k], known) + [merkle(leaves[k:])] if m <= k else subproof(m - k, leaves[k:], False) + [merkle(leaves[:k])]

    for n in range(1, 34):  # every pair by the rule alone
        root = merkle(hashed[:n]).hex()
        for m in range(1, n + 1):
            runs, head = I.prefix_ranges(m, n)
            proof = [merkle(hashed[a:b]).hex() for a, b in runs]
            assert proof == [h.hex() for h in subproof(m, hashed[:n], True)]
            old = merkle(hashed[:m]).hex()
            assert I.extends(m, n, proof, old, root) and head[-1][1] == m
            assert not I.extends(m, n, proof, "00" * 32, root) and not I.extends(m, n, proof, old, "00" * 32)
            assert not I.extends(m, n, [*proof, old], old, root)
            for i in range(len(proof)):
                assert not I.extends(m, n, [*proof[:i], "11" * 32, *proof[i + 1:]], old, root)
                assert not I.extends(m, n, proof[:i] + proof[i + 1:], old, root)
        assert not I.extends(n + 1, n, [], root, root) and not I.extends(0, n, [], root, root)
    for bits in (2, 10):
        monkeypatch.setattr(I, "FAN_BITS", bits)
        monkeypatch.setattr(I, "FAN", 1 << bits)
        for n in (1, 4, 23, 64, 90):
            log = spark.createDataFrame([(i, f"event-{i}") for i in range(n)], "seq long, data string")
            stored, heads = I.tiles(log), spark.range(-1, n + 3).withColumnRenamed("id", "old_size")
            got = I.verify_consistency(I.consistency_proofs(stored, heads, n), n, merkle(hashed[:n]).hex()).collect()
            assert len(got) == n and all(r.consistent for r in got)
            for r in got:
                assert r.old_root == merkle(hashed[:r.old_size]).hex() and list(r.proof) == [h.hex() for h in subproof(r.old_size, hashed[:n], True)]


def test_proofs_from_stored_tiles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "FAN_BITS", 2)
    monkeypatch.setattr(I, "FAN", 4)
    for n in (1, 5, 16, 70):
        leaves = [hashlib.sha256(b"\x00" + f"event-{i}".encode()).digest() for i in range(n)]
        log = spark.createDataFrame([(i, f"event-{i}") for i in range(n)], "seq long, data string")
        I.write_tiles(log, f"{tmp_path}/{n}")
        proofs = I.proofs_from_tiles(spark.read.parquet(f"{tmp_path}/{n}"), log.select("seq"))
        checked = I.verify_inclusion(proofs.join(log.select("seq", I.leaf_hash(F.col("data")).alias("leaf")), "seq"), n).collect()
        assert len(checked) == n and {r["root"] for r in checked} == {merkle(leaves).hex()}


def test_fnv_known_values(spark):
    def py(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h
    words = ["", "a", "MONDO:0012345", "naïve ☃"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fnv1a32(F.col("w"))).collect()]
    assert got == [py(w) for w in words]


def test_changed_shards_and_dynamic_overwrite(spark, tmp_path):
    old = spark.createDataFrame([(i, "x") for i in range(500)], "id long, v string")
    new = spark.createDataFrame([(i, "y" if i == 7 else "x") for i in range(500)], "id long, v string")
    a, b = P.bundles(old, "c", "id", ["id", "v"]), P.bundles(new, "c", "id", ["id", "v"])
    changed = P.changed_shards(P.shard_digests(a), P.shard_digests(b))
    assert [r.change for r in changed.collect()] == ["changed"]
    P.write_bundles(a, str(tmp_path / "out"))
    P.write_bundles(b, str(tmp_path / "out"), changed)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 500 and back.where("body LIKE '%\"y\"%'").count() == 1


def test_entity_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}" if i else None, [f"alias {i}", " ", None, f"n{i}"] if i != 3 else None) for i in range(40)],
                                 "id long, name string, aka array<string>")
    links = spark.createDataFrame([(i, j, (i * j) % 7) for i in range(40) for j in range(i)], "id long, other long, place int")
    few = P.nested(links, "id", ["place", "other"], ["other"], "near", least=2, most=10)
    assert {r.id: [x.other for x in r.near] for r in few.collect()} == {i: sorted(range(i), key=lambda j: ((i * j) % 7, j)) for i in range(2, 11)}
    lines = P.entity_lines("thing", rows.join(few, "id", "left"), "id", ["id", "name", "near"]).unionByName(P.search_lines("thing", rows, "id", "name", ["name", "aka"]))
    path = str(tmp_path / "export")
    P.write_entities(lines, path)
    things = {r.id: r for r in spark.read.schema("id long, name string, near array<struct<other: long>>").json(f"{path}/kind=thing").collect()}
    assert len(things) == 40 and things[0].name is None and things[0].near is None and len(things[10].near) == 10 and things[11].near is None
    found = [(r.id, r.text) for r in spark.read.json(f"{path}/kind=search").collect()]
    assert sorted(found) == sorted([(str(i), f"n{i}") for i in range(40) if i != 0] + [("0", "n0")] + [(str(i), f"alias {i}") for i in range(40) if i != 3])
    assert {r.kind: (r.n, r.entities) for r in P.export_report(lines).collect()} == {"thing": (40, 40), "search": (79, 40)}
    changed = rows.withColumn("name", F.when(F.col("id") == 7, "x").otherwise(F.col("name"))).withColumn("part", F.col("id") % 5)
    same = P.same_exports(rows.withColumn("part", F.col("id") % 5).unionByName(changed.where("id = 1")), changed, ["part"])
    assert {r.part: r.same for r in same.collect()} == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_resolve_and_names(spark):
    names = spark.createDataFrame([(1, 0, "alpha Syndrome"), (1, 1, "ALPHA syndrome"), (1, 2, "Beta"), (2, 5, "x")], "id long, pos int, name string")
    got = {r.id: (r.title, list(r.others)) for r in L.ordered_names(names).collect()}
    assert got == {1: ("Alpha Syndrome", ["Beta"]), 2: ("X", [])}
    out = L.resolve_terms(spark.createDataFrame([("Seizures",), ("febrile  seizure",), ("none",)], "mention string"), spark.createDataFrame([("Seizure", 1), ("Febrile seizure", 2)], "name string, id long"))
    assert {r.mention: (r.id, r.confidence) for r in out.collect()} == {"Seizures": (1, 0.98), "febrile  seizure": (2, 1.0), "none": (None, 0.0)}


def test_schema_check_reasons(spark):
    good = ("MONDO:0000001", "has_symptom", "HP:0000001", {"certainty": "asserted"}, [("trial_record", ["source_id", "quote", "start", "end"])], "c", "a", "2024")
    cases = {None: good, "unknown predicate": ("x", "nope", *good[2:]), "subject kind": ("HGNC:5", *good[1:]), "object kind": (*good[:2], "HGNC:1", *good[3:]),
             "qualifier not allowed": (*good[:3], {"mood": "x"}, *good[4:]), "qualifier value": (*good[:3], {"certainty": "sure"}, *good[4:]), "no evidence": (*good[:4], [], *good[5:]),
             "evidence type": (*good[:4], [("rumour", [])], *good[5:]), "evidence fields": (*good[:4], [("computed", ["recipe"])], *good[5:]), "provenance agent": (*good[:6], "", good[7]),
             "text object": ("MONDO:0000001", "has_name", " ", {}, *good[4:])}
    schema = "want string, subject string, predicate string, object string, qualifiers map<string,string>, evidence array<struct<type:string,fields:array<string>>>, contributor string, agent string, created string"
    df = spark.createDataFrame([(w, *c) for w, c in cases.items()], schema)
    for r in C.schema_check(df).collect():
        assert r.reason == r.want


def test_a_toxic_row_never_names_its_target(spark, tmp_path):
    """One-letter words at the start of the quote, or left by its cut, are no name of the stand-in's target."""
    from evidra.plans import QUERIES
    texts = ["A, the rest of a text", "Thst onat enwhha. To the on esble. And the to", "a b c zz", "One b one"]
    spark.createDataFrame([(i, t, "en", "s", n) for i, t in enumerate(texts) for n in (400 - 200 * (i == 2),)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 3)) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.reason for r in QUERIES["validate_decisions"](spark, str(tmp_path)).collect()}
    assert got == {0: "target not named", 1: "target not named", 2: "target not named", 3: "ok"}
