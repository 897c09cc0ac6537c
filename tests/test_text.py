import random
import re
import unicodedata

from pyspark.sql import functions as F

from evidra.functions import strings, vocab
from evidra.functions.pyudfs import html_text, strip_marks
from evidra.operators import text as X
from evidra.operators import variants as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_canonical_text(spark):
    raw = "  Áb \t c\r\n\r\n\r\n\r\nd  e  \r f \n"
    got = one(spark, t=X.canonical_text(F.lit(raw))).t
    assert got == unicodedata.normalize("NFC", "Áb c\n\nd e\nf")


def test_locate_quotes_whitespace_tolerant_and_short(spark):
    docs = spark.createDataFrame([(1, "Alpha beta\n gamma delta. Omega"), (2, "alpha beta gamma"), (3, "xxAlpha betayy")], "doc_id long, text string")
    quotes = spark.createDataFrame([(10, "Alpha beta  gamma"), (11, "ha bet"), (12, "Omega"), (13, "not here at all"), (14, "mega"), (15, "a.b*c (d")], "quote_id long, quote string")
    got = {(r.quote_id, r.doc_id): (r.start, r.end) for r in X.locate_quotes(quotes, docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {}
    for q in quotes.collect():
        pat = r"\s+".join(re.escape(p) for p in q.quote.split())
        for d, text in texts.items():
            m = re.search(pat, text)
            if m:
                want[q.quote_id, d] = (m.start(), m.end())
    assert got == want and (11, 3) in got


def test_phrase_match_rules(spark):
    rows = [("c1", "WAS", "symbol", True), ("c1", "Wiskott-Aldrich syndrome", "name", False), ("c2", "SCN1A", "symbol", False), ("c2", "Dravet disease", "alias", False)]
    phrases = spark.createDataFrame(rows, "entity string, phrase string, kind string, ambiguous boolean")
    docs = spark.createDataFrame([(1, "It was seen in SCN1A patients", "t", "p"), (2, "WAS gene study", "WAS gene study", ""), (3, "wiskott aldrich SYNDROME cohort", "x", "wiskott aldrich syndrome"),
                                  (4, "a dravet, disease registry", "", "")], "doc_id long, text string, title string, population string")
    got = {(r.doc_id, r.entity): r.priority for r in X.phrase_match(phrases, docs).collect()}
    assert got == {(1, "c2"): 2, (2, "c1"): 0, (3, "c1"): 1, (4, "c2"): 3}


def test_phrase_match_like_brute_force_with_many_phrases(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(30)]
    rare = [f"Zé{i}" for i in range(3000)]
    rows = [(i % 4000, rng.choice([" ", "-", "_, "]).join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(1, 6))),
             rng.choice(["symbol", "name", "alias"]), rng.random() < 0.3) for i in range(10_000)]
    rows += [(9000, "w1 w2", "symbol", True), (9001, "-- ", "name", False), (9002, None, "name", False), (9003, " ".join(["w3"] * 1500), "name", False)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(60)) for _ in range(40)] + ["W1 W2", "w1, w2", "", None, " ".join(["w3"] * 1600)]
    docs = [(i, t, (t or "")[:30], None if i % 3 else (t or "")[30:90]) for i, t in enumerate(texts)]
    split = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    said = lambda s: " " + " ".join(split(s)) + " "
    want = {}
    for d, text, title, population in docs:
        for entity, phrase, kind, ambiguous in rows:
            p = said(phrase)
            if p.strip() and p in said(text):
                level = 3 if kind == "alias" else 0 if p in said(title) else 1 if p in said(population) else 2
                firm = kind != "symbol" or not ambiguous or re.search(r"(?<!\w)" + re.escape(phrase) + r"(?!\w)", text) is not None
                old = want.get((d, entity), (False, 9))
                want[d, entity] = (old[0] or firm, min(old[1], level))
    phrases = spark.createDataFrame(rows, "entity long, phrase string, kind string, ambiguous boolean")
    df = spark.createDataFrame(docs, "doc_id long, text string, title string, population string").repartition(3)
    for part in (200_000, 4000):
        got = {(r.doc_id, r.entity): r.priority for r in X.phrase_match(phrases, df, part).collect()}
        assert got == {k: level for k, (firm, level) in want.items() if firm} and len(got) > 1000
    assert X.phrase_match(phrases.limit(0), df).collect() == []


def test_excerpt_windows_do_not_overlap(spark):
    text = "x" * 50 + "HIT" + "y" * 300 + "HIT" + "z" * 20 + "HIT" + "w" * 500 + "HIT" + "v" * 400 + "HIT" + "u" * 10
    got = one(spark, e=X.excerpt(F.lit(text), F.lit("HIT"), 100)).e
    spans = [(m.start(), m.end()) for m in re.finditer("HIT", text)]
    want, end, added = [text[:100]], 100, 0
    for s, e in spans:
        if e <= 100 or s < end or added == 2:
            continue
        l, r = max(100, s - 100), min(len(text), e + 180)
        want.append(text[l:r])
        end, added = r, added + 1
    assert got == want and len(got) == 3


def test_best_sentence_narrows_long_lines(spark):
    long = "First sentence here. " + "pad " * 60 + ". We support families with GENE1 in our community. " + "tail " * 80
    docs = spark.createDataFrame([(1, "short GENE1\n" + long + "\nGENE1 is a gene, nothing more to say here"), (2, "none")], "doc_id long, text string")
    got = X.best_sentence(docs, "GENE1").collect()
    assert len(got) == 1 and got[0].sentence.startswith("We support families") and got[0].sentence.endswith("community.")
    text = docs.where("doc_id = 1").first().text
    assert text[got[0].start:got[0].end] == got[0].sentence


def test_audit_reasons(spark):
    import hashlib
    text = "The quick  brown\nfox jumps"
    h = hashlib.sha256(text.encode()).hexdigest()
    src = spark.createDataFrame([("s", text, text, h, h), ("bad", text, text, "0", h)], "source_id string, text string, raw string, text_hash string, raw_hash string")
    ev = spark.createDataFrame([("s", "quick brown fox", 4, 20), ("s", "quick red fox", 4, 20), ("s", "x", 5, 500), ("none", "x", 0, 1), ("bad", "quick", 4, 9), ("s", "q" * 2001, 4, 9)],
                               "source_id string, quote string, start int, end int")
    got = [r.reason for r in X.audit_quotes(ev, src).orderBy("source_id", "quote").collect()]
    assert sorted(map(str, got)) == sorted(["None", "quote not at its offsets", "offsets out of range", "source is not archived", "source does not match its hashes", "quote too long"])


def test_html_to_text(spark):
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav><p>menu</p></nav><h1>Head</h1><p>One <b>two</b></p><script>x('</p>')</script><p>Three<br>four</p><footer>end</footer></body></html>"
    r = spark.createDataFrame([(page,), (None,)], "html string").select(html_text("html").alias("h")).select("h.*").collect()
    assert r[0].title == "T & U" and [x for x in r[0].text.split("\n") if x.strip()] == ["T & UHead", "One two", "Three", "four"]
    assert r[1].text == ""


def test_string_rules(spark):
    r = one(spark, a=strings.organization_id(F.lit("https://www.Foo-Bar.org:80/x")), b=strings.organization_id(F.lit("en.wikipedia.org/wiki/X")), c=strings.organization_id(F.lit("foo.org")),
            d=strings.clean_affiliation(F.lit("Department of X, University of Y, Faculty, Berlin, Germany. Electronic address: a@b.de")), e=strings.clean_affiliation(F.lit("")),
            f=strings.id_kind(F.lit("MONDO:0000001-HGNC:5")), g=strings.id_kind(F.lit("nope")), h=strip_marks(F.lit("Crème Brûlée")), i=strings.capitalised(F.lit("abc d")))
    assert (r.a, r.b, r.c) == ("org:foo-bar-org", None, "org:foo-org")
    assert r.d == "University of Y, Germany" and r.e == "" and r.f == "condition" and r.g is None and r.h == "Creme Brulee" and r.i == "Abc d"


def test_vocabulary(spark):
    r = one(spark, a=vocab.classification(F.lit("Conflicting; pathogenic")), b=vocab.classification(F.lit("Likely benign")), c=vocab.review_stars(F.lit("practice guideline")), d=vocab.model_family(F.lit("Azure-OpenAI-x")),
            e=vocab.frequency_share(F.lit(" 3/12 ")), f=vocab.frequency_share(F.lit("often")), g=vocab.association_effect(F.lit("Disease-causing germline mutation(s) (loss of function) in")), h=vocab.study_fit(F.lit(None).cast("string"), F.lit("supports")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("C", "LB", 4, "openai", 0.25, None, "loss_of_function", "includes your condition")


def test_variant_names_and_types(spark):
    cases = [("NM_1(G):c.1631G>A (p.Arg544Gln)", "single nucleotide variant", "missense"), ("NM_1(G):c.10C>T (p.Arg4Ter)", "snv", "nonsense"), ("NM_1:c.5del (p.Lys2fs)", "Deletion", "frameshift"),
             ("NM_1:c.3A>G (p.Leu1=)", "snv", "synonymous"), ("NM_1:c.2T>C (p.Met1Thr)", "snv", "start"), ("NM_1:c.30_32del (p.Glu10del)", "Deletion", "inframe"), ("NM_1:c.100+1G>A", "snv", "splice"),
             ("NM_1:c.100+15G>A", "snv", "intronic"), ("NM_1:c.-20A>G", "snv", "untranslated"), ("NC_012920.1:m.3243A>G", "snv", "mitochondrial"), ("GRCh38 1q21 loss", "copy number loss", "large"),
             ("NM_1:c.2T>C (p.Met11Thr)", "snv", "missense"), ("NM_1:c.100-12G>A", "snv", "intronic")]
    df = spark.createDataFrame([(n, t, w) for n, t, w in cases], "name string, vtype string, want string").withColumn("h", V.split_name(F.col("name")))
    for r in df.withColumn("got", V.variant_type(F.col("h.coding"), F.col("h.protein"), F.col("vtype"))).collect():
        assert r.got == r.want, r.name


def test_variant_lookup_forms(spark):
    v = spark.createDataFrame([(7, "NM_1:c.1631G>A", "p.Arg544Gln", "rs12"), (8, "NM_1:c.163G>A", "p.Arg54Gln", "rs13"), (9, "NC:m.3243A>G", "", "")], "variant long, hgvs string, protein string, rs string")
    asked = {"7": {7}, "RS13": {8}, "c.1631G>A": {7}, "R544Q": {7}, "p.(Arg54Gln)": {8}, "Arg54Gln": {8}, "m.3243A>G": {9}, "c.1631": {7}, "c.16": set(), "R54X": set()}
    got = {}
    for r in V.lookup_variants(spark.createDataFrame([(q,) for q in asked], "query string"), v).collect():
        got.setdefault(r.query, set()).add(r.variant)
    assert got == {q: s for q, s in asked.items() if s}


def test_aligned_ids(spark):
    r = one(spark, a=V.aligned_ids(F.lit("MONDO:MONDO:0001, OMIM:5|MedGen:C1|Orphanet:9")))
    assert r.a == [["MONDO:0001", "OMIM:5"], [], ["Orphanet:9"]]
