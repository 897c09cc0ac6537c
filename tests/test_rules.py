"""Rules that the named queries do not reach, on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from evidra.functions.pyudfs import html_text
from evidra.functions.strings import plain
from evidra.operators import activity, claims, clusters, hierarchy, linking, neighbors, review, search, text, variants
from evidra.sources import publish


def test_history_keeps_every_review(spark):
    own = spark.createDataFrame([(1,), (2,)], "claim_id long")
    reviews = spark.createDataFrame([(1, i, f"r{i % 7}", "supports") for i in range(100)] + [(9, 1, "r", "supports")], "claim_id long, seq long, reviewer string, verdict string")
    events = spark.createDataFrame([(1, 500, "challenge", "x"), (2, 1, "proposed", "y")], "claim_id long, seq long, type string, actor string")
    rows = publish.dossier_history(own, events, reviews).collect()
    assert len(rows) == 102 and {r.seq for r in rows if r.claim_id == 1 and r.type == "review"} == set(range(100))


def test_accents_and_blanks(spark):
    one = spark.range(1)
    assert one.select(plain(F.lit("Crème Brûlée — Ångström")), plain(F.lit("été"))).first()[:] == ("creme brulee angstrom", "ete")
    index = spark.createDataFrame([("Brûlée syndrome", "c", "C1", "", "", 0.0)], "text string, kind string, ref string, label string, extra string, prominence double")
    hits = search.name_search(spark.createDataFrame([("brulee",), ("BRÛLÉE",)], "query string"), index)
    assert {(r.query, r.ref) for r in hits.collect()} == {("brulee", "C1"), ("BRÛLÉE", "C1")}
    quotes = spark.createDataFrame([(1, "seen in three families")], "quote_id long, quote string")
    docs = spark.createDataFrame([(1, "It was seen in　three families."), (2, "seen in two families")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end) for r in text.locate_quotes(quotes, docs).collect()] == [(1, 7, 29)]
    assert one.select(text.canonical_text(F.lit("　a  b \r\n \r\nc　"))).first()[0] == "a b\n\nc"


def test_skipped_elements_end_with_their_parent(spark):
    pages = ["<p>a</p><div><nav>menu<p>b</p></div><p>rest of page</p>", "<header><div>x</header>y", "</nav><p>z</p>", "<script>if (a < b) { c }</script>w<br>v"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(html_text("h")["text"]).collect()]
    assert [g.split() for g in got] == [["a", "rest", "of", "page"], ["y"], ["z"], ["w", "v"]]


def test_references_end_with_a_semicolon(spark):
    pages = [("<title>a &amp b &amp</title><p>&amp;amp &quot;x&quot; &#233;&#xe9; R&D &am</p>",), ("&copy;&copy &nosuch; &notit; &lt;p&gt;&",)]
    got = [tuple(r) for r in spark.createDataFrame(pages, "h string").select(html_text("h")["title"], html_text("h")["text"]).collect()]
    assert got == [("a &amp b &amp", 'a &amp b &amp&amp "x" éé R&D &am\n'), ("", "©&copy &nosuch; &notit; <p>&")]


def test_short_and_refused_searches(spark):
    names = spark.createDataFrame([(1, "AR", "b title"), (2, "ARX", "a title"), (3, "xar", "c title"), (4, "tp", "d")], "id long, name string, title string")
    asked = spark.createDataFrame([("ar",), ("a",), ("x" * 300,), ("arx",)], "query string")
    rows = search.substring_search(asked, names).collect()
    assert [(r.id, r.exact) for r in sorted((r for r in rows if r.query == "ar"), key=lambda r: r["rank"])] == [(1, True), (2, False), (3, False)]
    assert {r.query for r in rows if r.reason} == {"a", "x" * 300} and [r.id for r in rows if r.query == "arx"] == [2]
    terms = spark.createDataFrame([("HP:1", 0, "Épilepsie focale"), ("HP:2", 0, "fever")], "id string, pos int, name string")
    rows = search.term_search(spark.createDataFrame([("hp:2",), ("epilepsie",), ("f",)], "query string"), terms).collect()
    assert {(r.query, r.id, r.reason is None) for r in rows} == {("hp:2", "HP:2", True), ("epilepsie", "HP:1", True), ("f", None, False)}


def test_targets_are_named_by_whole_words(spark):
    cases = [("the category", ["cat"], False), ("The Cat, sat", ["cat"], True), ("black-cat fever", ["Black Cat Fever"], True), ("SCA 1, 2 and 3", ["SCA3"], True),
             ("SCA 1, 2 and 33", ["SCA3"], False), ("SCA3", ["SCA3"], True), ("anything", [""], False), ("Été indien", ["été"], True),
             ("ABC 1, 2 and 3A", ["zzz", "ABC1"], True), ("ABC 1, 2 and 3A", ["ABC3A"], True), ("ABC 1, 2 and 3A", ["ABC3"], False), ("abc 1/2/3", ["ABC2"], True),
             ("abc 1. 2", ["ABC2"], False), ("ABC-3 disease", ["ABC 3"], True), ("XABC 3", ["ABC3"], False), ("x", [None], False), ("x", [], False), (None, ["a"], None)]
    rows = spark.createDataFrame(cases, "t string, names array<string>, want boolean").select("want", claims.names_target(F.col("t"), F.col("names")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_composite_ids_need_both_halves(spark):
    refs = spark.createDataFrame([("condition", "M:1"), ("condition", "M:1-H:5"), ("condition", "M:1-H:6"), ("condition", "M:2-H:5"), ("gene", "H:5"), ("trial", "N1")], "kind string, id string")
    known = {"disease": spark.createDataFrame([("M:1",)], "id string"), "gene": spark.createDataFrame([("H:5",)], "id string")}
    got = {r.id: r["exists"] for r in claims.missing_ids(refs, known, {"condition": ("disease", "gene")}).collect()}
    assert got == {"M:1": True, "M:1-H:5": True, "M:1-H:6": False, "M:2-H:5": False, "H:5": True, "N1": None}


def test_alias_claims_by_latest_review(spark):
    rows = [("a", "c", 1, "reviewed", False), ("a", "c", 2, "rejected", False), ("b", "c", 1, "rejected", False), ("b", "c", 3, "human_reviewed", False),
            ("d", "c", 1, "reviewed", True), ("e", "c", None, "unreviewed", False)]
    df = spark.createDataFrame(rows, "alias string, target string, seq long, status string, contested boolean")
    assert [tuple(r) for r in claims.accepted_links(df).collect()] == [("b", "c")]


def test_source_keys_and_types_from_the_evidence(spark):
    item = "struct<type:string,source_id:string,pmid:string,dataset:string>"
    rows = [(1, 1, "contributed", "independently_reviewed", "x", [("paper", "s1", "P1", None), ("paper", "s2", None, None), ("paper", "s3", "P1", None)]),
            (1, 2, "contributed", "human_reviewed", "y", [("expert_statement", None, None, None), ("curated_database", None, None, "D")]),
            (2, 3, "contributed", "reviewed", "y", [("paper", "s9", "P9", None)])]
    df = spark.createDataFrame(rows, f"assertion_id long, claim_id long, origin string, status string, contributor string, evidence array<{item}>")
    keys = {r.claim_id: r.k for r in df.select("claim_id", review.source_key(F.col("evidence"), F.col("contributor")).alias("k")).collect()}
    assert keys == {1: "P1|s2", 2: "D|expert:y", 3: "P9"}
    got = {r.assertion_id: (r.state, r.independent_sources, list(r.types)) for r in review.evidence_state(df, spark.createDataFrame([], "assertion_id long")).collect()}
    assert got == {1: ("multiple_independent_sources", 2, ["paper:3", "curated_database:1", "expert_statement:1"]), 2: ("unsupported", 0, [])}


def test_closure_and_descent(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(40, 3), (40, 5), (41, 40), (5, 5)], "child long, parent long")
    up = {i: set() for i in range(42)}
    for child, parent in [(r.child, r.parent) for r in edges.collect() if r.child != r.parent]:
        up[child].add(parent)

    def above(i):
        return set().union(*({p} | above(p) for p in up[i])) if up[i] else set()
    got = {(r.id, r.ancestor) for r in hierarchy.strict_closure(edges).collect()}
    assert got == {(i, a) for i in up for a in above(i)}
    below = {(r.id, r.ancestor) for r in hierarchy.descendants(edges, spark.createDataFrame([(5,), (40,)], "ancestor long")).collect()}
    assert below == {(i, r) for r in (5, 40) for i in up if r in above(i) or i == r}


def test_a_term_that_almost_all_hold(spark):
    rows = [(i, "common") for i in range(1, 60)] + [(i, f"t{i // 2}") for i in range(60)]
    terms = spark.createDataFrame(rows, "item long, term string")
    edges = spark.createDataFrame([(0, 59, 900)], "a long, b long, score int")
    whole = neighbors.Machinery({"x": terms}, edges, {"x": 1.0}, frequent=10 ** 6)
    split = neighbors.Machinery({"x": terms}, edges, {"x": 1.0}, frequent=20)
    assert split.shared.count() == 30  # the common term makes no pairs
    a, b = ({(r.item, r.other, r.mech, r["rank"]) for r in m.top(5).collect()} for m in (whole, split))
    assert a == b


def test_parts_without_a_query(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:10:00"))
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 6)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1, 0, 4))], "actor long, at timestamp")
    assert {(r.actor, r.online) for r in activity.heartbeat(events, now).collect()} == {(1, True), (2, False)}
    near = spark.createDataFrame([(1, 2, 0.51239, 1), (2, 1, 0.51239, 3), (1, 3, 0.2, 4)], "item long, other long, score double, rank int")
    assert [tuple(r) for r in clusters.map_edges(near).collect()] == [(1, 2, 0.512)]
    one = spark.range(1)
    assert one.select(text.render_record([("Title", F.lit(" a  b ")), ("Status", F.lit(None))])).first()[0] == "Title: a b\nStatus:"
    cases = spark.createDataFrame([(i, f"quote about term{i % 3}", f"term{i % 3}") for i in range(30)], "case_id long, quote string, term string")
    swapped = claims.swapped_negatives(cases, 2).collect()
    assert len(swapped) == 30 and all(r.term not in r.quote and r.answer == "reject" for r in swapped)
    every = " ".join(f"sign{i}" for i in range(300))
    rows = [(i, f"it shows sign{i}", f"sign{i}") for i in range(300)] + [(400 + i, every, f"sign{i}") for i in range(195)] + [
        (600, every + " rare", "sign1"), (601, every, "rare"), (602, "", "sign2"), (603, None, None), (604, "Rare RARE", "sign3")]
    got = {r.case_id: r for r in claims.swapped_negatives(spark.createDataFrame(rows, "case_id long, quote string, term string")).collect()}
    assert len(got) == 500
    for i, quote, term in rows:
        fits = {t for _, _, t in rows if t and t != term and t not in (quote or "").lower()}
        assert (got[i].term in fits and got[i].answer == "reject") if fits else (got[i].term is None and got[i].answer is None), i
    base = spark.createDataFrame([(1, "t", "base", None, "")], "item long, term string, source string, ref string, frequency string")
    said = spark.createDataFrame([(1, "t", "c1", f"P{i}", "1/3" if i else "", i) for i in range(8)], "subject long, term string, source string, ref string, frequency string, claim_id long")
    r = linking.overlay_claims(base, said, spark.createDataFrame([(1, 100)], "item long, node long")).first()
    assert (r.contributed, r.n_claims, r.frequency, list(r.refs)) == (True, 8, "1/3", [f"P{i}" for i in range(5)])


def test_bursts_and_visitors_are_streamed(spark):
    import contextlib
    import io
    from datetime import datetime, timedelta

    from evidra.operators import activity, metrics
    start = datetime(2024, 1, 1, 23)
    rows = [(a, start + timedelta(seconds=3 * i), i, "reads", "x" if i == 0 else None) for a in (1, 2) for i in range(3000)]  # one burst each, over midnight
    events = spark.createDataFrame(rows, "actor long, at timestamp, seq long, doing string, topic string")
    shown = activity.suppress_repeats(events, 10)
    assert sorted((r.actor, r.seq) for r in shown.collect()) == [(a, i) for a in (1, 2) for i in range(0, 3000, 4)]
    requests = spark.createDataFrame([(a, i, at, i) for a, at, i, *_ in rows], "visitor long, target long, at timestamp, seq long")
    counted = metrics.counted_requests(requests, 5)
    assert sorted((r.visitor, r.target) for r in counted.collect()) == [(a, i) for a in (1, 2) for i in [*range(5), *range(1200, 1205)]]
    for frame in (shown, counted):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            frame.explain()
        assert "collect_list" not in plan.getvalue() and "FlatMapGroupsInPandas" not in plan.getvalue()
