import gzip
import hashlib
import json

from evidra.sources import archive as A
from evidra.sources import readers as S


def put(tmp_path, name, text):
    p = tmp_path / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text, encoding="utf-8")
    return str(p)


def test_graph_json(spark, tmp_path):
    base = "http://purl.obolibrary.org/obo/HP_"
    nodes = [{"id": base + "0000001", "lbl": "All", "type": "CLASS"},
             {"id": base + "0000118", "lbl": "Abnormality", "type": "CLASS", "meta": {"definition": {"val": "d"}, "synonyms": [
                 {"pred": "hasExactSynonym", "val": "Odd", "synonymType": "http://x#layperson"}, {"pred": "hasExactSynonym", "val": "Abn"}],
                 "basicPropertyValues": [{"pred": "http://x#hasAlternativeId", "val": "HP:0000999"}]}},
             {"id": base + "0000002", "lbl": "Old", "type": "CLASS", "meta": {"deprecated": True}}, {"id": base + "0000003", "lbl": "p", "type": "PROPERTY"}]
    edges = [{"sub": base + "0000118", "pred": "is_a", "obj": base + "0000001"}, {"sub": base + "0000002", "pred": "is_a", "obj": base + "0000001"}, {"sub": base + "0000118", "pred": "other", "obj": base + "0000001"}]
    got = S.read_graph_json(spark, put(tmp_path, "hp.json", json.dumps({"graphs": [{"nodes": nodes, "edges": edges}]}, indent=1)))
    terms = {r.id: r for r in got["terms"].collect()}
    assert set(terms) == {"HP:0000001", "HP:0000118"} and list(terms["HP:0000118"].layperson) == ["Odd"] and list(terms["HP:0000118"].synonyms) == ["Abn"]
    assert [tuple(r) for r in got["edges"].collect()] == [("HP:0000118", "HP:0000001")]
    assert [tuple(r) for r in got["alt_ids"].collect()] == [("HP:0000999", "HP:0000118")]


def test_obo(spark, tmp_path):
    text = """format-version: 1.2

[Term]
id: MONDO:0000001
name: disease
namespace: mondo
def: "A \\"bad\\" thing." [X:1]
alt_id: MONDO:0000009
synonym: "illness" EXACT [X]
synonym: "ailment" RELATED []
xref: OMIM:5 {source="MONDO:equivalentTo", source="X"}
subset: rare
is_a: MONDO:0000000 {source="x"} ! root
relationship: part_of GO:1 ! part
relationship: has_material_basis_in_germline_mutation_in http://identifiers.org/hgnc/11 ! G

[Term]
id: MONDO:0000002
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""
    rows = S.read_obo(spark, put(tmp_path, "m.obo", text)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.name, r.namespace) == ("MONDO:0000001", "disease", "mondo") and r.alt_ids == ["MONDO:0000009"] and r.parents == ["MONDO:0000000"] and r.part_of == ["GO:1"]
    assert [(x.text, x.scope) for x in r.synonyms] == [("illness", "EXACT"), ("ailment", "RELATED")] and r.subsets == ["rare"] and r.genes == ["HGNC:11"]
    assert [(x.id, list(x.sources)) for x in r.xrefs] == [("OMIM:5", ["MONDO:equivalentTo", "X"])]


def test_annotations(spark, tmp_path):
    rows = ["#description: x", "database_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration",
            "OMIM:1\tD\t\tHP:0000999\tPMID:2;PMID:1\tPCS\t\t3/4\t\t\tP\tx", "OMIM:1\tD\t\tHP:0000118\tPMID:3\tPCS\t\t\t\t\tP\tx", "OMIM:1\tD\tNOT\tHP:0000005\tPMID:3\tPCS\t\t\t\t\tP\tx", "OMIM:1\tD\t\tHP:0000006\tPMID:3\tPCS\t\t\t\t\tI\tx"]
    alt = spark.createDataFrame([("HP:0000999", "HP:0000118")], "alt string, id string")
    got = {(r.database_id, r.aspect, r.term): (r.frequency, list(r.refs)) for r in S.read_annotations(spark, put(tmp_path, "a.hpoa", "\n".join(rows) + "\n"), alt).collect()}
    assert got == {("OMIM:1", "P", "HP:0000118"): ("3/4", ["PMID:1", "PMID:2", "PMID:3"]), ("OMIM:1", "I", "HP:0000006"): ("", ["PMID:3"])}


def test_tables(spark, tmp_path):
    genes = "hgnc_id\tsymbol\tname\tstatus\talias_symbol\tprev_symbol\tgene_group\tuniprot_ids\tentrez_id\nHGNC:1\tAAA\ta gene\tApproved\tB|C\t\tG one|G two\tP1\t9\nHGNC:2\tOLD\tx\tEntry Withdrawn\t\t\t\t\t\n"
    r = S.read_genes(spark, put(tmp_path, "g.tsv", genes)).collect()
    assert len(r) == 1 and r[0].aliases == ["B", "C"] and r[0].previous == [] and r[0].groups == ["G one", "G two"]
    validity = 'CLINGEN GENE VALIDITY,,,,,,,,,\n"+++","+++","+++","+++","+++","+++","+++","+++","+++","+++"\nGENE SYMBOL,GENE ID (HGNC),L,D,M,S,C,U,DATE,GCEP\n"A","HGNC:1","d","MONDO:0000001","AD","S","Definitive","u","2020","g"\n'
    r = S.read_validity(spark, put(tmp_path, "v.csv", validity)).collect()
    assert [(x.hgnc_id, x.classification) for x in r] == [("HGNC:1", "Definitive")]
    dosage = "#c\n#Gene Symbol\tGene ID\tcyto\tloc\tHI\n" + "\t".join(["A", "1", "c", "l", "3"] + [""] * 7 + ["0"]) + "\n"
    assert [(x.symbol, x.haploinsufficiency_score, x.triplosensitivity_score) for x in S.read_dosage(spark, put(tmp_path, "d.tsv", dosage)).collect()] == [("A", "3", "0")]
    subs = "gene_curie\tdisease_curie\tsubmitter_title\tclassification_title\tsubmitted_as_pmids\tsubmitted_as_date\nHGNC:1\tMONDO:1\tLab\tStrong\tPMID: 12; 13,14\t2020-01-02 03:04\nX:1\tMONDO:1\tLab\tStrong\t\t\n"
    r = S.read_submissions(spark, put(tmp_path, "s.tsv", subs)).collect()
    assert [(x.gene, x.pmids, x.date) for x in r] == [("HGNC:1", ["PMID:12", "PMID:13", "PMID:14"], "2020-01-02")]


def test_xml(spark, tmp_path):
    disorders = """<JDBOR><DisorderList><Disorder id="1"><OrphaCode>58</OrphaCode><DisorderGeneAssociationList><DisorderGeneAssociation>
      <SourceOfValidation>22513320[PMID]_9[PMID]</SourceOfValidation><Gene><Symbol>G</Symbol><ExternalReferenceList><ExternalReference><Source>OMIM</Source><Reference>5</Reference></ExternalReference><ExternalReference><Source>HGNC</Source><Reference>77</Reference></ExternalReference></ExternalReferenceList></Gene>
      <DisorderGeneAssociationType><Name lang="en">Disease-causing germline mutation(s) (gain of function) in</Name></DisorderGeneAssociationType><DisorderGeneAssociationStatus><Name lang="en">Assessed</Name></DisorderGeneAssociationStatus></DisorderGeneAssociation></DisorderGeneAssociationList></Disorder></DisorderList></JDBOR>"""
    r = S.read_disorders(spark, put(tmp_path, "o.xml", disorders)).collect()
    assert [(x.code, x.gene, x.status, x.effect, x.pmids) for x in r] == [("ORPHA:58", "HGNC:77", "Assessed", "gain_of_function", ["PMID:22513320", "PMID:9"])]
    prev = """<JDBOR><Disorder><OrphaCode>58</OrphaCode><PrevalenceList><Prevalence><Source>ORPHANET</Source><PrevalenceType><Name lang="en">Point prevalence</Name></PrevalenceType><PrevalenceClass><Name lang="en">1-9 / 1 000 000</Name></PrevalenceClass>
      <ValMoy>0.5</ValMoy><PrevalenceGeographic><Name lang="en">Worldwide</Name></PrevalenceGeographic><PrevalenceValidationStatus><Name lang="en">Validated</Name></PrevalenceValidationStatus></Prevalence></PrevalenceList></Disorder></JDBOR>"""
    r = S.read_prevalence(spark, put(tmp_path, "p.xml", prev)).first()
    assert (r.code, r.klass, r.value, r.geography, r.validated) == ("ORPHA:58", "1-9 / 1 000 000", 0.5, "Worldwide", True)
    arts = """<Set><PubmedArticle><MedlineCitation><PMID Version="1">123</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">One</AbstractText><AbstractText Label="END">Two</AbstractText></Abstract>
      <Journal><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Lee</LastName><ForeName>A</ForeName><AffiliationInfo><Affiliation>Uni</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></Set>"""
    r = S.read_articles(spark, put(tmp_path, "a.xml", arts)).first()
    assert (r.pmid, r.title, r.abstract, r.year) == ("PMID:123", "T", "AIM: One\n\nEND: Two", "2019") and [(x.last, x.affiliation) for x in r.authors] == [("Lee", "Uni")]


def test_line_formats(spark, tmp_path):
    def gaf(sym, qual, term, code, aspect):
        return "\t".join(["UniProtKB", "P1", sym, qual, term, "PMID:1", code, "", aspect, "n"])
    text = "!gaf\n" + "\n".join([gaf("A", "involved_in", "GO:1", "IDA", "P"), gaf("A", "NOT|involved_in", "GO:2", "IDA", "P"), gaf("A", "enables", "GO:3", "IDA", "F"), gaf("A", "involved_in", "GO:4", "IEA", "P"), gaf("A", "involved_in", "GO:1", "IMP", "P")]) + "\n"
    assert [tuple(r) for r in S.read_gaf(spark, put(tmp_path, "g.gaf.gz", text)).collect()] == [("A", "GO:1", "P", "IDA")]
    more = text + "\n".join([gaf("a", "part_of", "GO:9", "IBA", "C"), gaf("Z", "part_of", "GO:1", "ISS", "C"), gaf("A", "part_of", "GO:77", "TAS", "C")]) + "\n"
    symbols, terms = spark.createDataFrame([("A", "HGNC:1")], "key string, gene string"), spark.createDataFrame([("GO:1",), ("GO:8",)], "id string")
    alt = spark.createDataFrame([("GO:9", "GO:8")], "alt string, id string")
    got = S.read_gaf(spark, put(tmp_path, "m.gaf.gz", more), symbols=symbols, terms=terms, alt_ids=alt).collect()
    assert sorted(tuple(r) for r in got) == [("HGNC:1", "GO:1", "P", "IDA"), ("HGNC:1", "GO:8", "C", "IBA")]
    assert len(S.EVIDENCE_CODES) == 24 and "IEA" not in S.EVIDENCE_CODES
    links = put(tmp_path, "l.txt.gz", "protein1 protein2 combined_score\n9.a 9.b 800\n9.b 9.a 900\n9.a 9.c 100\n")
    info = put(tmp_path, "i.txt.gz", "#string_protein_id\tpreferred_name\tx\n9.a\tA\t1\n9.b\tB\t1\n9.c\tC\t1\n")
    assert [tuple(r) for r in S.read_interactions(spark, links, info).collect()] == [("A", "B", 900)]
    cpx = put(tmp_path, "c.tsv", "#Complex ac\tRecommended name\tIdentifiers (and stoichiometry) of molecules in complex\tEvidence Code\tExpanded participant list\nCPX-1\tC\tP12345(1)|Q9ABC1-2(2)|Q8AAA1-PRO_0000001(0)|CHEBI:29105(1)\tECO:1\tX99999(1)\n")
    members = S.read_complexes(spark, cpx)
    assert sorted(r.accession for r in members.collect()) == ["29105", "P12345", "Q8AAA1", "Q9ABC1"]  # an id that is no accession finds no gene
    mapped = S.crosswalk(members, spark.createDataFrame([("P12345", "HGNC:1"), ("Q9ABC1", "HGNC:1")], "accession string, gene string"))
    assert [(r["complex"], r.gene) for r in mapped.collect()] == [("CPX-1", "HGNC:1")]


def test_gene_phenotype(spark, tmp_path):
    head = ("g2p id,gene symbol,gene mim,hgnc id,disease name,disease mim,disease MONDO,allelic requirement,confidence,variant consequence,molecular mechanism,"
            "molecular mechanism support,phenotypes,publications,additional mined publications,panel,date of last review")
    rows = ['G2P1,AAA,1,5,"a, disease",600001,MONDO:0000001,biallelic,strong,absent,loss of function,evidence,HP:1; HP:2,11;12,,DD; Eye,2020-01-02 10:00',
            "G2P2,BBB,1,6,other,,,monoallelic,limited,,,,,,13,,"]
    a, b = S.read_gene_phenotype(spark, put(tmp_path, "g2p.csv", "\n".join([head, *rows]) + "\n")).orderBy("record").collect()
    assert (a.gene, a.disease, a.mondo_id, a.omim_id, a.phenotypes, a.pmids, a.panels, a.reviewed) == (
        "HGNC:5", "a, disease", "MONDO:0000001", "OMIM:600001", ["HP:1", "HP:2"], ["11", "12"], ["DD", "Eye"], "2020-01-02")
    assert (b.mondo_id, b.omim_id, b.mechanism, b.mined_pmids, b.reviewed) == (None, None, "", ["13"], "")


def test_study_team_and_projects(spark):
    section = {"identificationModule": {"nctId": "NCT1"}, "statusModule": {"overallStatus": "RECRUITING", "lastUpdatePostDateStruct": {"date": "2024-01"}},
               "sponsorCollaboratorsModule": {"leadSponsor": {"name": "S"}, "collaborators": [{"name": n} for n in "ABCDEF"],
                                              "responsibleParty": {"investigatorFullName": "R", "investigatorAffiliation": "U"}},
               "contactsLocationsModule": {"centralContacts": [{"role": "CONTACT", "email": "x@y"}, {"role": "CONTACT"}],
                                           "locations": [{"country": c} for c in ("France", "Chile", "France")]}}
    named = {**section, "identificationModule": {"nctId": "NCT2"}, "contactsLocationsModule": {"overallOfficials": [
        {"name": n, "affiliation": "V", "role": "PRINCIPAL_INVESTIGATOR"} for n in "abcde"]}}
    raw = spark.createDataFrame([(json.dumps({"protocolSection": s}),) for s in (section, named, {"identificationModule": {"nctId": "NCT3"}})], "body string")
    one, two, none = S.study_team(raw).orderBy("id").collect()
    assert [tuple(o) for o in one.officials] == [("R", "U", "responsible investigator")] and [tuple(c) for c in one.contacts] == [(None, "contact", "x@y")]
    assert (one.collaborators, one.sites, one.countries, one.updated) == (list("ABCDE"), 3, ["Chile", "France"], "2024-01")
    assert [(o.name, o.role) for o in two.officials] == [(n, "principal investigator") for n in "abcd"]
    assert (none.officials, none.contacts, none.sites, none.sponsor) == ([], [], 0, None)
    page = {"results": [{"project_num": "5R01", "project_title": "T", "fiscal_year": 2024, "principal_investigators": [{"full_name": "P Q"}],
                         "organization": {"org_name": "O"}, "award_amount": 10.5, "appl_id": 7}, {"project_num": "X"}]}
    a, b = S.flatten_projects(spark.createDataFrame([(json.dumps(page),)], "body string")).orderBy("number").collect()
    assert (a.number, a.year, a.investigators, a.organization, a.amount, a.application) == ("5R01", 2024, ["P Q"], "O", 10.5, 7)
    assert (b.title, b.investigators, b.organization, b.amount) == ("", [], "", None)


def test_trials_cards_and_manifest(spark, tmp_path):
    body = {"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "T"}, "statusModule": {"overallStatus": "RECRUITING"}, "contactsLocationsModule": {"overallOfficials": [{"name": n} for n in "ABCD"]}}}
    r = S.flatten_trials(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    assert (r.id, r.status, list(r.conditions), list(r.team)) == ("NCT1", "RECRUITING", [], ["A", "B", "C"])
    html = "<div class=card><h3>D1</h3><i>P</i></div><div class=card><h3>D1</h3><i>P</i></div><div class=card><h3>D2</h3><i>Q</i></div>"
    cards = S.read_cards(spark.createDataFrame([(html,)], "html string"), r"<div class=card>.*?</div>", {"disease": "<h3>(.*?)</h3>", "program": "<i>(.*?)</i>"}, ["disease", "program"])
    assert sorted(tuple(r) for r in cards.collect()) == [("D1", "P"), ("D2", "Q")]
    put(tmp_path, "a.txt", "hello")
    m = S.manifest(spark, str(tmp_path))
    assert [(r.name, r.bytes, r.hash) for r in m.collect()] == [("a.txt", 5, "sha256:" + hashlib.sha256(b"hello").hexdigest())]
    assert len(S.registry_version(m).first().version) == 16


def test_archive_keeps_one_copy(spark, tmp_path):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    clean = F.regexp_replace("text", " +", " ")
    got = {r.doc_id: r.copies for r in A.archive(docs, clean).collect()}
    assert got == {1: 2, 3: 1}
    A.write_archive(docs, clean, str(tmp_path / "arch"))
    A.write_archive(docs.union(spark.createDataFrame([(4, "d")], docs.schema)), clean, str(tmp_path / "arch"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "arch")).collect()) == [1, 3, 4]
