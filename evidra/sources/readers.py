"""Domain files read with Spark's own readers. Paths may name folders or globs; text formats split across tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURIE = r"([A-Za-z]+)[_:]([0-9]+)$"
# Evidence codes an annotation may rest on (everything but electronic annotation and "no data")
EVIDENCE_CODES = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "HTP", "HDA", "HMP", "HGI", "HEP", "IBA", "IBD", "IKR", "IRD", "ISS", "ISO", "ISA", "ISM",
                  "IGC", "RCA", "TAS", "NAS", "IC")


# Fixed value: a member of a complex, as the public table writes it
MEMBER = r"([A-Z0-9]+)(?:-[A-Z0-9_]+)?\([0-9]+\)"


def _first(values: Column) -> Column:
    return F.get(values, 0)


# ---- ontologies -------------------------------------------------------------------------------------------------------
def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Graph-JSON ontology: terms, edges (is_a between live terms) and alt_ids."""
    schema = """graphs ARRAY<STRUCT<nodes: ARRAY<STRUCT<id: STRING, lbl: STRING, type: STRING, meta: STRUCT<deprecated: BOOLEAN, definition: STRUCT<val: STRING>,
        synonyms: ARRAY<STRUCT<pred: STRING, val: STRING, synonymType: STRING>>, basicPropertyValues: ARRAY<STRUCT<pred: STRING, val: STRING>>>>>,
        edges: ARRAY<STRUCT<sub: STRING, pred: STRING, obj: STRING>>>>"""
    graph = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("graphs").alias("g"))
    def curie(c):
        return F.concat_ws(":", F.regexp_extract(c, CURIE, 1), F.regexp_extract(c, CURIE, 2))
    nodes = (graph.select(F.explode("g.nodes").alias("n")).where((F.col("n.type") == "CLASS") & ~F.coalesce("n.meta.deprecated", F.lit(False)))
             .where(F.col("n.lbl").isNotNull()).withColumn("id", curie(F.col("n.id"))).where("id <> ':'"))
    syn = F.coalesce("n.meta.synonyms", F.array().cast("array<struct<pred:string,val:string,synonymType:string>>"))
    lay = lambda s: F.coalesce(F.contains(s["synonymType"], F.lit("layperson")), F.lit(False))
    terms = nodes.select("id", F.col("n.lbl").alias("name"), F.coalesce("n.meta.definition.val", F.lit("")).alias("definition"),
                         F.transform(F.filter(syn, lay), lambda s: s["val"]).alias("layperson"), F.transform(F.filter(syn, lambda s: ~lay(s)), lambda s: s["val"]).alias("synonyms"))
    alt = (nodes.select("id", F.explode("n.meta.basicPropertyValues").alias("p")).where(F.col("p.pred").endswith("hasAlternativeId"))
           .select(F.col("p.val").alias("alt"), "id"))
    live = terms.select("id")
    edges = (graph.select(F.explode("g.edges").alias("e")).where("e.pred = 'is_a'").select(curie(F.col("e.sub")).alias("child"), curie(F.col("e.obj")).alias("parent"))
             .join(live.withColumnRenamed("id", "child"), "child", "left_semi").join(live.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent"))
    return {"terms": terms, "edges": edges, "alt_ids": alt}


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """One row per live [Term] stanza: id, name, namespace, definition, alt_ids, parents, part_of, synonyms (text, scope),
    xrefs (id, sources), subsets, genes (germline causal)."""
    stanza = (spark.read.option("lineSep", "\n\n").text(path).where(F.ltrim("value").startswith("[Term]"))
              .select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l")).where(~F.array_contains("l", "is_obsolete: true")))

    def values(tag: str, pattern: str = r"^([^!{]*)") -> Column:
        rest = F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substring(x, len(tag) + 3, 1 << 30))
        return F.transform(rest, lambda x: F.trim(F.regexp_extract(x, pattern, 1)))
    raw = lambda tag: F.filter("l", lambda x: F.startswith(x, F.lit(f"{tag}: ")))
    synonyms = F.transform(raw("synonym"), lambda x: F.struct(F.regexp_extract(x, r'"((?:[^"\\]|\\.)*)"', 1).alias("text"), F.regexp_extract(x, r'" ([A-Z]+)', 1).alias("scope")))
    xrefs = F.transform(raw("xref"), lambda x: F.struct(F.regexp_extract(x, r"^xref: (\S+)", 1).alias("id"), F.regexp_extract_all(x, F.lit(r'source="([^"]+)"'), 1).alias("sources")))
    part_of = F.filter(F.transform(raw("relationship"), lambda x: F.regexp_extract(x, r"^relationship: part_of (\S+)", 1)), lambda x: x != "")
    genes = F.filter(F.transform(raw("relationship"), lambda x: F.regexp_extract(x, r"has_material_basis_in_germline_mutation_in \S*?hgnc[/:](\d+)", 1)), lambda x: x != "")
    return (stanza.select(_first(values("id")).alias("id"), _first(values("name", "^(.*)$")).alias("name"), _first(values("namespace")).alias("namespace"),
                          _first(F.transform(raw("def"), lambda x: F.regexp_extract(x, r'"((?:[^"\\]|\\.)*)"', 1))).alias("definition"),
                          values("alt_id").alias("alt_ids"), values("is_a", r"^(\S+)").alias("parents"), part_of.alias("part_of"), synonyms.alias("synonyms"), xrefs.alias("xrefs"),
                          values("subset", r"^(\S+)").alias("subsets"), F.array_distinct(F.transform(genes, lambda g: F.concat(F.lit("HGNC:"), g))).alias("genes"))
            .where("id IS NOT NULL"))


def read_annotations(spark: SparkSession, path: str, alt_ids: DataFrame) -> DataFrame:
    """Commented annotation TSV: database_id, aspect (P / I / C), term (alt ids resolved), frequency, refs (sorted).

    Rows with the NOT qualifier are dropped; rows of the same disease, aspect and term are merged.
    """
    cols = ["database_id", "disease_name", "qualifier", "hpo_id", "reference", "evidence", "onset", "frequency", "sex", "modifier", "aspect", "biocuration"]
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("database_id"))
    parts = F.split("value", "\t")
    rows = raw.select(*[F.get(parts, i).alias(c) for i, c in enumerate(cols)]).where("upper(coalesce(qualifier, '')) <> 'NOT' AND aspect IN ('P', 'I', 'C')")
    alt = alt_ids.select(F.col("alt").alias("hpo_id"), F.col("id").alias("_cur")).distinct()
    rows = rows.join(alt, "hpo_id", "left").withColumn("term", F.coalesce("_cur", "hpo_id"))
    base = rows.groupBy("database_id", "aspect", "term").agg(F.max("frequency").alias("frequency"))
    refs = (rows.select("database_id", "aspect", "term", F.explode(F.split("reference", ";")).alias("ref")).where("ref <> ''").distinct()
            .groupBy("database_id", "aspect", "term").agg(F.array_sort(F.collect_list("ref")).alias("refs")))
    return base.join(refs, ["database_id", "aspect", "term"], "left")


# ---- delimited tables -------------------------------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited file with a header; only the named columns are kept, everything as text."""
    return spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").option("escape", '"').csv(path).select(*[F.col(f"`{c}`") for c in columns])


def pipe_list(column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def id_list(column, prefix: str = "") -> Column:
    """Ids separated by comma or semicolon, an optional prefix stripped."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), "[,;]"), lambda x: F.regexp_replace(F.trim(x), f"^{prefix}", "")), lambda x: x != "")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path, ["hgnc_id", "symbol", "name", "status", "alias_symbol", "prev_symbol", "gene_group", "uniprot_ids", "entrez_id"]).where("status = 'Approved'")
    return raw.select("hgnc_id", "symbol", "name", pipe_list("alias_symbol").alias("aliases"), pipe_list("prev_symbol").alias("previous"),
                      pipe_list("gene_group").alias("groups"), pipe_list("uniprot_ids").alias("uniprot"), "entrez_id")


def read_validity(spark: SparkSession, path: str) -> DataFrame:
    """Curated validity CSV: preamble, header and '+' separator rows dropped, at least ten columns."""
    cols = ["gene", "hgnc_id", "disease", "mondo_id", "moi", "sop", "classification", "url", "date", "gcep"]
    raw = spark.read.csv(path, schema=", ".join(f"c{i} STRING" for i in range(len(cols))), mode="PERMISSIVE")
    return raw.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]).where("hgnc_id LIKE 'HGNC:%' AND mondo_id LIKE 'MONDO:%' AND gcep IS NOT NULL")


def read_dosage(spark: SparkSession, path: str) -> DataFrame:
    """Dosage TSV whose header is the last '#' line: symbol, haploinsufficiency_score, triplosensitivity_score."""
    p = F.split("value", "\t")
    return (spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
            .select(F.get(p, 0).alias("symbol"), F.get(p, 4).alias("haploinsufficiency_score"), F.get(p, 12).alias("triplosensitivity_score")))


def read_gene_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """Gene-phenotype CSV: record, gene, symbol, disease name and ids, allelic requirement, confidence, consequence, mechanism and its
    support, phenotypes, papers, mined papers, panels, date of the last review."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    def text(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))
    def parts(name):
        return F.filter(F.transform(F.split(text(name), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        text("g2p id").alias("record"), F.concat(F.lit("HGNC:"), "`hgnc id`").alias("gene"), text("gene symbol").alias("symbol"), text("disease name").alias("disease"),
        F.nullif(text("disease MONDO"), F.lit("")).alias("mondo_id"), F.concat(F.lit("OMIM:"), F.nullif(text("disease mim"), F.lit(""))).alias("omim_id"),
        text("allelic requirement").alias("allelic_requirement"), text("confidence").alias("confidence"), text("variant consequence").alias("consequence"),
        text("molecular mechanism").alias("mechanism"), text("molecular mechanism support").alias("mechanism_support"), parts("phenotypes").alias("phenotypes"),
        parts("publications").alias("pmids"), parts("additional mined publications").alias("mined_pmids"), parts("panel").alias("panels"),
        F.substring(text("date of last review"), 1, 10).alias("reviewed"))


def read_submissions(spark: SparkSession, path: str, prefix: str = "HGNC:") -> DataFrame:
    raw = read_table(spark, path, ["gene_curie", "disease_curie", "submitter_title", "classification_title", "submitted_as_pmids", "submitted_as_date"])
    return raw.where(F.col("gene_curie").startswith(prefix)).select(
        F.col("gene_curie").alias("gene"), F.col("disease_curie").alias("disease"), F.col("submitter_title").alias("submitter"), F.col("classification_title").alias("classification"),
        F.transform(id_list("submitted_as_pmids", "PMID:?\\s*"), lambda x: F.concat(F.lit("PMID:"), x)).alias("pmids"), F.substring("submitted_as_date", 1, 10).alias("date"))


# ---- XML --------------------------------------------------------------------------------------------------------------
def read_disorders(spark: SparkSession, path: str) -> DataFrame:
    """code, gene, kind, status, effect, pmids for every disorder-gene association."""
    schema = """OrphaCode STRING, DisorderGeneAssociationList STRUCT<DisorderGeneAssociation: ARRAY<STRUCT<SourceOfValidation: STRING,
        Gene: STRUCT<Symbol: STRING, ExternalReferenceList: STRUCT<ExternalReference: ARRAY<STRUCT<Source: STRING, Reference: STRING>>>>,
        DisorderGeneAssociationType: STRUCT<Name: STRUCT<_VALUE: STRING>>, DisorderGeneAssociationStatus: STRUCT<Name: STRUCT<_VALUE: STRING>>>>>"""
    rows = spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(path)
    a = rows.select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("code"), F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a"))
    hgnc = F.filter("a.Gene.ExternalReferenceList.ExternalReference", lambda x: x["Source"] == "HGNC")
    kind = F.coalesce(F.col("a.DisorderGeneAssociationType.Name._VALUE"), F.lit(""))
    from evidra.functions.vocab import association_effect
    return a.select("code", F.concat(F.lit("HGNC:"), _first(hgnc)["Reference"]).alias("gene"), kind.alias("kind"), F.col("a.DisorderGeneAssociationStatus.Name._VALUE").alias("status"),
                    association_effect(kind).alias("effect"), F.transform(F.regexp_extract_all(F.coalesce("a.SourceOfValidation", F.lit("")), F.lit(r"(\d+)\[PMID\]"), 1), lambda x: F.concat(F.lit("PMID:"), x)).alias("pmids"))


def read_prevalence(spark: SparkSession, path: str) -> DataFrame:
    schema = """OrphaCode STRING, PrevalenceList STRUCT<Prevalence: ARRAY<STRUCT<Source: STRING, PrevalenceType: STRUCT<Name: STRUCT<_VALUE: STRING>>, PrevalenceClass: STRUCT<Name: STRUCT<_VALUE: STRING>>,
        ValMoy: DOUBLE, PrevalenceGeographic: STRUCT<Name: STRUCT<_VALUE: STRING>>, PrevalenceValidationStatus: STRUCT<Name: STRUCT<_VALUE: STRING>>>>>"""
    rows = spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(path).select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("code"), F.explode("PrevalenceList.Prevalence").alias("p"))
    return rows.select("code", F.col("p.PrevalenceType.Name._VALUE").alias("kind"), F.col("p.PrevalenceClass.Name._VALUE").alias("klass"), F.col("p.ValMoy").alias("value"),
                       F.col("p.PrevalenceGeographic.Name._VALUE").alias("geography"), (F.col("p.PrevalenceValidationStatus.Name._VALUE") == "Validated").alias("validated"), F.col("p.Source").alias("source"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract (labelled parts), year, authors (last, fore, affiliation) with their position."""
    schema = """MedlineCitation STRUCT<PMID: STRUCT<_VALUE: STRING>, Article: STRUCT<ArticleTitle: STRING, Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_Label: STRING, _VALUE: STRING>>>,
        Journal: STRUCT<JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>,
        AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, AffiliationInfo: ARRAY<STRUCT<Affiliation: STRING>>>>>>>"""
    a = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select("MedlineCitation.PMID", "MedlineCitation.Article.*")
    parts = F.transform("Abstract.AbstractText", lambda x: F.concat(F.coalesce(F.concat(x["_Label"], F.lit(": ")), F.lit("")), F.coalesce(x["_VALUE"], F.lit(""))))
    authors = F.transform(F.filter("AuthorList.Author", lambda x: x["LastName"].isNotNull()), lambda x: F.struct(
        x["LastName"].alias("last"), F.coalesce(x["ForeName"], F.lit("")).alias("fore"), F.coalesce(_first(x["AffiliationInfo"])["Affiliation"], F.lit("")).alias("affiliation")))
    return a.select(F.concat(F.lit("PMID:"), F.col("PMID._VALUE")).alias("pmid"), F.col("ArticleTitle").alias("title"), F.array_join(parts, "\n\n").alias("abstract"),
                    F.coalesce("Journal.JournalIssue.PubDate.Year", F.substring("Journal.JournalIssue.PubDate.MedlineDate", 1, 4)).alias("year"), authors.alias("authors"))


# ---- gzip line formats ------------------------------------------------------------------------------------------------
def read_gaf(spark: SparkSession, path: str, codes: tuple[str, ...] = EVIDENCE_CODES, symbols: DataFrame | None = None,
             terms: DataFrame | None = None, alt_ids: DataFrame | None = None) -> DataFrame:
    """symbol, term, aspect, code of trusted process and component annotations; of several codes for one the smallest.

    With ``symbols`` (key, gene) the symbol is looked up in upper case and ``gene`` comes instead; with ``terms`` (id) and ``alt_ids``
    (alt, id) old term ids become current ones and unknown ones go. A gzip file is one task; many files are many.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("!")).select(
        F.get(p, 2).alias("symbol"), F.get(p, 3).alias("qualifier"), F.get(p, 4).alias("term"), F.get(p, 6).alias("code"), F.get(p, 8).alias("aspect"))
    rows = rows.where(F.col("aspect").isin("P", "C") & F.col("code").isin(*codes) & ~F.col("qualifier").startswith("NOT"))
    who = "symbol"
    if symbols is not None:
        rows, who = rows.withColumn("key", F.upper("symbol")).join(symbols.select("key", "gene"), "key"), "gene"
    if alt_ids is not None:
        rows = (rows.join(alt_ids.select(F.col("alt").alias("term"), F.col("id").alias("current")), "term", "left")
                .withColumn("term", F.coalesce("current", "term")).drop("current"))
    if terms is not None:
        rows = rows.join(terms.select(F.col("id").alias("term")).distinct(), "term", "left_semi")
    return rows.groupBy(who, "term", "aspect").agg(F.min("code").alias("code"))


def read_interactions(spark: SparkSession, links: str, info: str, floor: int = 700) -> DataFrame:
    """p1, p2 (symbols), score of links at or above the floor, each pair once with its best score."""
    names = spark.read.option("header", True).option("sep", "\t").csv(info).select(F.col("`#string_protein_id`").alias("p"), F.col("preferred_name").alias("s"))
    rows = spark.read.option("header", True).option("sep", " ").csv(links).select("protein1", "protein2", F.col("combined_score").cast("int").alias("score")).where(F.col("score") >= floor)
    return (rows.join(names.toDF("protein1", "a"), "protein1").join(names.toDF("protein2", "b"), "protein2").where("a <> b")
            .groupBy(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2")).agg(F.max("score").alias("score")))


def read_pathways(spark: SparkSession, path: str, species: str = "Homo sapiens") -> DataFrame:
    rows = spark.read.option("sep", "\t").schema("accession STRING, pathway STRING, url STRING, name STRING, evidence STRING, species STRING").csv(path)
    return rows.where(F.col("species") == species).select("accession", "pathway", "name", "url").distinct()


def read_complexes(spark: SparkSession, path: str) -> DataFrame:
    """complex, name, code, accession: the proteins inside one cell, taken with one pattern (suffixes of isoforms and chains dropped)."""
    cell = "Identifiers (and stoichiometry) of molecules in complex"
    rows = read_table(spark, path, ["#Complex ac", "Recommended name", "Evidence Code", cell])
    members = F.regexp_extract_all(F.col(f"`{cell}`"), F.lit(MEMBER), 1)
    return rows.select(F.col("#Complex ac").alias("complex"), F.col("Recommended name").alias("name"), F.col("Evidence Code").alias("code"),
                       F.explode(members).alias("accession")).distinct()


def crosswalk(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace accessions by gene ids, once per group. members: group columns + accession; mapping: accession, gene."""
    return members.join(mapping, "accession").drop("accession").distinct()


def read_variants(spark: SparkSession, path: str, assembly: str = "GRCh38") -> DataFrame:
    cols = ["VariationID", "Name", "Type", "HGNC_ID", "ClinicalSignificance", "ReviewStatus", "NumberSubmitters", "PhenotypeIDS", "PhenotypeList", "RS# (dbSNP)", "LastEvaluated"]
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return raw.where((F.col("Assembly") == assembly) & (F.col("OriginSimple") != "somatic")).select(*[F.col(f"`{c}`") for c in cols])


# ---- API JSON ---------------------------------------------------------------------------------------------------------
def flatten_trials(raw: DataFrame) -> DataFrame:
    """Registry records (column ``body``) to id, title, status, conditions, phases, contacts (officials when no contacts)."""
    schema = """protocolSection STRUCT<identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>, statusModule: STRUCT<overallStatus: STRING, lastUpdatePostDateStruct: STRUCT<date: STRING>>,
        conditionsModule: STRUCT<conditions: ARRAY<STRING>>, designModule: STRUCT<studyType: STRING, phases: ARRAY<STRING>>,
        contactsLocationsModule: STRUCT<centralContacts: ARRAY<STRUCT<name: STRING, email: STRING, phone: STRING>>, overallOfficials: ARRAY<STRUCT<name: STRING, affiliation: STRING, role: STRING>>>>"""
    p = raw.select(F.from_json("body", schema)["protocolSection"].alias("p"))
    contacts = F.transform("p.contactsLocationsModule.centralContacts", lambda c: c["name"])
    officials = F.transform("p.contactsLocationsModule.overallOfficials", lambda c: c["name"])
    return p.select(F.col("p.identificationModule.nctId").alias("id"), F.coalesce("p.identificationModule.briefTitle", F.lit("")).alias("title"), F.coalesce("p.statusModule.overallStatus", F.lit("")).alias("status"),
                    F.col("p.statusModule.lastUpdatePostDateStruct.date").alias("updated"), F.coalesce("p.conditionsModule.conditions", F.array().cast("array<string>")).alias("conditions"),
                    F.coalesce("p.designModule.phases", F.array().cast("array<string>")).alias("phases"),
                    F.slice(F.when(F.size(contacts) > 0, contacts).otherwise(F.coalesce(officials, F.array().cast("array<string>"))), 1, 3).alias("team"))


def study_team(raw: DataFrame) -> DataFrame:
    """Who runs a registered study (column ``body``): id, sponsor, collaborators, officials (name, affiliation, role), contacts (name, role,
    email), sites, countries, updated, status.

    Without named officials the responsible investigator stands in. The lists are cut as listings show them: 4 officials, 3 contacts, 5
    collaborators, 10 countries.
    """
    schema = """protocolSection STRUCT<identificationModule: STRUCT<nctId: STRING>, statusModule: STRUCT<overallStatus: STRING, lastUpdatePostDateStruct: STRUCT<date: STRING>>,
        sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING>, collaborators: ARRAY<STRUCT<name: STRING>>,
            responsibleParty: STRUCT<investigatorFullName: STRING, investigatorAffiliation: STRING>>,
        contactsLocationsModule: STRUCT<centralContacts: ARRAY<STRUCT<name: STRING, role: STRING, email: STRING>>, locations: ARRAY<STRUCT<country: STRING>>,
            overallOfficials: ARRAY<STRUCT<name: STRING, affiliation: STRING, role: STRING>>>>"""
    p = raw.select(F.from_json("body", schema)["protocolSection"].alias("p")).select(
        "p.identificationModule", "p.statusModule", F.col("p.sponsorCollaboratorsModule").alias("s"), F.col("p.contactsLocationsModule").alias("c"))
    def role(c):
        return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" "))
    def given(c):
        return F.coalesce(c, F.lit("")) != ""
    def listed(c, kind):
        return F.coalesce(c, F.array().cast(kind))
    person = "array<struct<name:string,affiliation:string,role:string>>"
    officials = F.transform(F.filter("c.overallOfficials", lambda o: given(o["name"])), lambda o: F.struct(
        o["name"].alias("name"), o["affiliation"].alias("affiliation"), role(o["role"]).alias("role")))
    lead = F.col("s.responsibleParty")
    stand_in = F.when(given(lead["investigatorFullName"]), F.array(F.struct(
        lead["investigatorFullName"].alias("name"), lead["investigatorAffiliation"].alias("affiliation"), F.lit("responsible investigator").alias("role"))))
    contacts = F.transform(F.filter("c.centralContacts", lambda x: given(x["name"]) | given(x["email"])), lambda x: F.struct(
        x["name"].alias("name"), role(x["role"]).alias("role"), x["email"].alias("email")))
    return p.select(
        F.col("identificationModule.nctId").alias("id"), F.col("s.leadSponsor.name").alias("sponsor"),
        F.slice(listed(F.filter(F.transform("s.collaborators", lambda x: x["name"]), given), "array<string>"), 1, 5).alias("collaborators"),
        F.when(F.size(listed(officials, person)) > 0, F.slice(officials, 1, 4)).otherwise(listed(stand_in, person)).alias("officials"),
        F.slice(listed(contacts, "array<struct<name:string,role:string,email:string>>"), 1, 3).alias("contacts"),
        F.size(listed("c.locations", "array<struct<country:string>>")).alias("sites"),
        F.slice(F.array_sort(F.array_distinct(F.filter(listed(F.transform("c.locations", lambda x: x["country"]), "array<string>"), given))), 1, 10).alias("countries"),
        F.col("statusModule.lastUpdatePostDateStruct.date").alias("updated"), F.col("statusModule.overallStatus").alias("status"))


def flatten_projects(raw: DataFrame) -> DataFrame:
    """Grant API pages (column ``body``): number, title, year, investigators, organization, amount, abstract, application."""
    schema = """results ARRAY<STRUCT<project_num: STRING, project_title: STRING, fiscal_year: INT, principal_investigators: ARRAY<STRUCT<full_name: STRING>>,
        organization: STRUCT<org_name: STRING>, award_amount: DOUBLE, abstract_text: STRING, appl_id: BIGINT>>"""
    r = raw.select(F.explode(F.from_json("body", schema)["results"]).alias("r")).select("r.*")
    def text(c):
        return F.coalesce(c, F.lit(""))
    people = F.transform("principal_investigators", lambda x: text(x["full_name"]))
    return r.select(text("project_num").alias("number"), text("project_title").alias("title"), F.col("fiscal_year").alias("year"),
                    F.coalesce(people, F.array().cast("array<string>")).alias("investigators"), text("organization.org_name").alias("organization"),
                    F.col("award_amount").alias("amount"), text("abstract_text").alias("abstract"), F.col("appl_id").alias("application"))


def read_cards(pages: DataFrame, card: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """Repeated cards of listing pages: one row per match of ``card``, its fields by pattern, distinct by ``keys``."""
    cards = pages.select(F.explode(F.regexp_extract_all("html", F.lit(card), 0)).alias("card"))
    return cards.select(*[F.trim(F.regexp_extract("card", pattern, 1)).alias(name) for name, pattern in fields.items()]).dropDuplicates(keys)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, modified, hash of every file under a folder, hashed on the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def registry_version(files: DataFrame) -> DataFrame:
    """One row version: hash of the name-ordered file hashes (one short row per dataset file)."""
    return files.agg(F.array_sort(F.collect_list(F.struct("name", "hash"))).alias("f")).select(
        F.substring(F.sha2(F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit("="), x["hash"])), "\n"), 256), 1, 16).alias("version"))
