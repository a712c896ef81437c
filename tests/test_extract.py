"""One reading of a text for all types against the joins by type, and the rules that decide what becomes a link."""

import random

from pyspark.sql import functions as F

from notewright.operators import extract, links, mentions, outline, sync

PIECES = [
    "modal", "multi-modal", "Glexwista", "glexwista/modal", "TP53", "P53", "KRAS-mutant", "AB1", "CAT", "ALK", "patient", "tumor", "is not an", "ADC", "crispr-based", "Lung Cancer", "melanx", "small cell lung cancer",
    "Head of Data Science at X", "Senior Director", "Director", "ex-Director", "Vice President", "NCT12345678", "trialx", "AX", "meeting", "bigconf", "M1234", "M12345", "MSC1234567", "nf-kb", "R&D", "he-la", "naïve", "İstanbul", "x" * 120, "\n", "face lift", "incl",
]


def _tables(spark):
    v = [("companies", "modal", "Modal", 0), ("companies", "glexwista", "Glex", 1), ("drugs", "glexwista", "Glexwista", 0), ("methods", "adc", "ADC", 0), ("methods", "crispr", "CRISPR", 1), ("methods", "ax", "AX assay", 2), ("pathways", "nf-kb", "NF-kB", 0), ("departments", "r&d", "R&D", 0), ("cell_lines", "he-la", "HeLa", 0), ("clinical_trials", "trialx", "TRIAL-X", 0), ("conferences", "ax", "AX", 0), ("conferences", "bigconf", "BigConf", 1), ("drugs", "na", "short", 2), ("companies", "naïve", "Naive", 5)]
    return (
        spark.createDataFrame(v, "entity_type string, variant string, canonical string, ord int"),
        spark.createDataFrame([("TP53", "H:1"), ("AB1", "H:2"), ("CAT", "H:3"), ("KRAS", None), ("ALK", "H:5"), ("ADC", "H:6")], "symbol string, hgnc_id string"),
        spark.createDataFrame([("P53", "TP53"), ("AX", "ALK")], "alias string, symbol string"),
        spark.createDataFrame([("lung cancer", "lung cancer", "M:1"), ("small cell lung cancer", "SCLC", "M:2"), ("melanx", "melanx", "M:3"), ("melanx tumor", "Melanx", "M:3"), ("incl", "x y", "M:4"), ("face lift", "face lift", "M:5"), ("cancer", "cancer", "M:6")], "key string, label string, mondo_id string"),
        spark.createDataFrame([("M1234", "Drugx")], "code string, canonical string"),
    )


def test_one_reading_equals_the_joins(spark):
    rng = random.Random(11)
    docs = [(k, rng.choice([" ", "  ", ", "]).join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14)))) for k in range(250)] + [(900, None), (901, ""), (902, " ")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    tables = _tables(spark)
    cols = ["doc_id", "entity_type", "ord", "text", "canonical", "ontology_id", "pos"]
    one = {tuple(r) for r in extract.all_mentions(d, *tables).select(cols).collect()}
    many = {tuple(r) for r in extract.all_mentions(d, *tables, most_entries=0).select(cols).collect()}
    assert one == many and len({r[1] for r in one}) == 12
    assert extract.all_mentions(d.limit(0), *tables).count() == 0
    assert extract.all_mentions(d, *[t.limit(0) for t in tables]).where("entity_type not in ('roles', 'compounds', 'clinical_trials')").count() == 0


def test_a_stop_list_is_a_parameter(spark):
    d = spark.createDataFrame([(1, "CAT and ALK in a tumor")], "doc_id int, text string")
    for n in (0, 500_000):
        got = {r.text for r in extract.all_mentions(d, *_tables(spark), never=["CAT", "ALK"], most_entries=n).where("entity_type = 'genes'").collect()}
        assert got == {"ALK"}


def test_names_after_a_hyphen_or_slash_are_linked(spark):
    docs = spark.createDataFrame([(1, "x", "pre-Budget talk and a/Budget talk"), (2, "x", "xBudget talk")], "doc_id int, name string, text string")
    names = spark.createDataFrame([("Budget talk", "Budget talk")], "text string, target string")
    assert {r.doc_id: r.text for r in links.link_mentions(docs, names).collect()} == {1: "pre-[[Budget talk]] and a/[[Budget talk]]", 2: "xBudget talk"}


def test_long_bodies_get_entity_links_but_no_page_links(spark):
    docs = spark.createDataFrame([(1, "x", "Glex " + "a " * 150_000)], "doc_id int, name string, text string")
    names = spark.createDataFrame([("Glex", "Glex")], "text string, target string")
    assert links.link_mentions(docs, names).collect()[0].text.startswith("Glex ")
    assert links.link_mentions(docs, names, longest=None).collect()[0].text.startswith("[[Glex]] ")
    assert links.link_mentions(docs, names, entities=True).collect()[0].text.startswith("[[Glex]] ")


def test_entities_are_not_linked_to_their_own_page():
    assert links.replace_longest_first("Glex is glex", [("Glex", "glex")], own="GLEX", entities=True) == "Glex is glex"
    assert links.replace_longest_first("the glexwista", [("glexwista", "Other")], own="Glexwista", entities=True) == "the glexwista"


def test_lists_know_ids_and_spellings(spark):
    m = spark.createDataFrame(
        [("d", "diseases", 1, "breast cancer", "M:1"), ("d", "diseases", 2, "Breast Carcinoma", "M:1"), ("d", "diseases", 3, "mamma ca", ""), ("d", "methods", 4, "CITE-seq", ""), ("d", "methods", 5, "cite seq", None), ("d", "companies", 6, "big co", ""), ("d", "companies", 7, "other", "")],
        "doc_id string, entity_type string, ord int, canonical string, ontology_id string",
    )
    v = spark.createDataFrame([("methods", "citeseq", "CiteSeq", 0), ("companies", "bigco", "BigCo", 1), ("companies", "big-co", "Later", 2)], "entity_type string, variant string, canonical string, ord int")
    n = spark.createDataFrame([("mamma ca", "x", "M:1")], "key string, label string, mondo_id string")
    assert {r.entity_type: r.names for r in mentions.lists(m, v, n).collect()} == {"diseases": ["breast cancer"], "methods": ["CiteSeq"], "companies": ["BigCo", "other"]}
    assert {r.entity_type: r.names for r in mentions.lists(m).collect()}["diseases"] == ["breast cancer", "mamma ca"]


def test_canonicals_are_link_texts_too(spark):
    m = spark.createDataFrame([("d", "genes", 1, "P53", "TP53"), ("d", "drugs", 2, "TP53", "Other"), ("d", "roles", 3, "CEO", "CEO"), ("d", "drugs", 4, "ab", "xyz")], "doc_id string, entity_type string, ord int, text string, canonical string")
    assert {(r.text, r.canonical) for r in mentions.link_texts(m).collect()} == {("P53", "TP53"), ("TP53", "Other"), ("Other", "Other"), ("xyz", "xyz")}


def test_paths_are_made_unique_however_often_they_meet(spark):
    rows = [(k, "a.md") for k in range(30)] + [(100 + k, f"a ({k}).md") for k in range(2, 25)] + [(200 + 10 * k + n, f"a ({k}) ({n}).md") for k in range(2, 9) for n in range(2, 6)] + [(900, "b")]
    got = {r.id: r.unique_path for r in outline.unique_paths(spark.createDataFrame(rows, "id int, path string"), "path", "id").collect()}
    assert len(set(got.values())) == len(rows) and got[0] == "a.md" and got[900] == "b" and got[102] == "a (2).md"


def test_summary_of_one_hot_type(spark):
    df = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("key"), F.when(F.col("id") % 3 == 0, "new").otherwise("update").alias("type")).repartition(5)
    got = {r.type: (r.n, r.examples) for r in sync.summary(df).collect()}
    assert got["new"] == (1667, [f"{k:05d}" for k in range(0, 30, 3)]) and got["update"][0] == 3333


def test_titles_in_odd_letters_are_found(spark):
    docs = spark.createDataFrame([(1, "the dırector"), (2, "Senıor Scientiſt, CſO"), (3, "HEAD OF Data"), (4, "ceo; exDirector"), (5, None)], "doc_id int, text string")
    assert {(r.doc_id, r.canonical) for r in extract.roles(docs).collect()} == {(1, "Director"), (2, "Senior Scientist"), (2, "CSO"), (3, "Head of Data"), (4, "CEO")}


def test_large_dictionaries_shuffle_no_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "modal patient")], "doc_id int, text string").repartition(2)
    plan = extract.all_mentions(docs, *_tables(spark), most_entries=0)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate explode" in x and "[\\p{L}\\p{N}]+" in x]
    assert not [x for x in plan.splitlines() if "Generate explode" in x and "[a-z]{4,}" in x]


def test_disease_names_without_a_long_run_are_found(spark):
    names = spark.createDataFrame([("als 1", "als 1", "M:1"), ("face lift", "face lift", "M:2"), ("ß-är", "ß-är", "M:3"), ("t2d (x)", "t2d (x)", "M:4"), ("7q11", "7q11", "M:5")], "key string, label string, mondo_id string")
    docs = spark.createDataFrame([(1, "patient with ALS 1, a face lift."), (2, "patient: ß-Är"), (3, "patient: T2D (x) was noted"), (4, "patient: T2D (x)a, als 12, pre-als 1, 7q11"), (5, "als 1 7q11")], "doc_id int, text string")
    want = {(1, "als 1"), (1, "face lift"), (2, "ß-är"), (3, "t2d (x)"), (4, "7q11"), (5, "als 1")}
    assert {(r.doc_id, r.canonical) for r in extract.diseases(docs, names).collect()} == want
    none = [t.limit(0) for t in _tables(spark)]
    for n in (0, 500_000):
        assert {(r.doc_id, r.canonical) for r in extract.all_mentions(docs, *none[:3], names, none[4], most_entries=n).where("entity_type = 'diseases'").collect()} == want
