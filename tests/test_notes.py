"""Golden cases and brute-force versions of the note operators."""

import random
import re

from pyspark.sql import functions as F

from notewright.functions import fragments
from notewright.functions import text as T
from notewright.operators import annotate, attachments, extract, lines, links, mentions, ontology, outline, profiles, sync


def _col(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


# ---- text


def test_names(spark):
    given = ["a:b", "..x..", "a<>b", "CON", "con.txt", "", "x" * 130, "a   b__c", None]
    assert _col(spark, given, T.file_name) == ["a -b", "x", "a_b", "_CON", "_con.txt", "Untitled", "x" * 100, "a b_c", None]
    assert _col(spark, ["#a[b]", "._ ", ""], T.note_name) == ["a_b", "unnamed", "unnamed"]
    assert _col(spark, ["A b/C!", "Ünï", " x "], T.tag_slug) == ["a-b/c", "n", "x"]


def test_without_parent(spark):
    df = spark.createDataFrame([("P: child", "P"), ("P_ child", "P"), ("P - child", "P"), ("P: ", "P"), ("Q", "P"), ("Q", None)], "n string, p string")
    assert [r[0] for r in df.select(T.without_parent(F.col("n"), F.col("p"))).collect()] == ["child", "child", "child", "P: ", "Q", "Q"]


def test_language(spark):
    en = "the cat and the dog have seen that there is nothing with them from the house and this was all they had"
    de = "der Hund und die Katze sind nicht mehr hier und das ist auch schon alles was wir über sie noch sagen dann"
    assert _col(spark, ["der die das", en, de, None], T.language) == ["en", "en", "de", None]
    assert _col(spark, [f"{en} {de} {de}"], T.language) == ["mixed"]


def test_front_matter(spark):
    md = "---\ntitle: x\n---\n\n# Head\nbody --- more"
    assert _col(spark, [md, "no front", "--- open"], T.body_of) == ["# Head\nbody --- more", "no front", "--- open"]
    assert _col(spark, [md], T.front_and_title) == ["---\ntitle: x\n---\n\n# Head\n"]


def test_repairs(spark):
    assert _col(spark, ['- "AB (CD)"\n- "CD"\n[[AB (CD)|x]] [[AB (CD)]]'], T.fix_gene_alias) == ['- "CD"\n[[CD|x]] [[CD|AB]]']
    assert _col(spark, ["[[Long Disease|risk]] [[Long Disease|something]]"], lambda c: T.fix_false_disease_link(c, ["something"])) == ["risk something"]
    assert _col(spark, ["&amp;lt;b&gt;"], T.html_entities) == ["<b>"]
    assert _col(spark, ["[a](javascript:x) <script>y</script> <FORM/>z"], T.safe_note) == ["a  z"]
    assert _col(spark, ["a_b *c* #d\n> e"], T.escape_markdown) == ["a\\_b \\*c\\* \\#d\n\\> e"]


# ---- outline


def _stack(levels):
    """Depth and parent by a stack, as a reader would."""
    stack, out = [], []
    for k, lv in enumerate(levels):
        while len(stack) >= lv:
            stack.pop()
        out.append((len(stack) + 1, stack[-1] if stack else None, list(stack)))
        stack.append(k)
    return out


def test_outline_equals_a_stack(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for s in range(40):
        levels = [rng.randrange(1, 7) for _ in range(rng.randrange(1, 25))] if s else list(range(1, 31)) + [20, 31, 2]
        for k, (lv, w) in enumerate(zip(levels, _stack(levels))):
            rows.append((s * 1000 + k, s, lv))
            want[s * 1000 + k] = (w[0], None if w[1] is None else s * 1000 + w[1], [s * 1000 + x for x in w[2]])
    df = outline.with_depth(spark.createDataFrame(rows, "id int, sec int, level int"), ["sec"], "id", "level")
    got = {r.id: (r.depth, r.parent_id) for r in outline.with_parents(df, ["sec"], "id", "id", deepest=5).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    shallow = {r.id: r.ancestor_names for r in outline.with_ancestors(df, ["sec"], "id", "id", deepest=31).collect()}
    assert shallow == {k: v[2] for k, v in want.items()}
    lin = {r.id: r.ancestor_ids for r in outline.lineage(outline.with_parents(df, ["sec"], "id", "id").select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id")), "id").collect()}
    assert lin == {str(k): [str(x) for x in reversed(v[2])] for k, v in want.items()}


def test_ancestors_of_deep_pages_are_whole_by_default(spark):
    levels = list(range(1, 31)) + [20, 31, 2, 14, 15]
    rows = [(k, s, lv, f"n{k}") for s in (None, "a") for k, lv in enumerate(levels)] + [(0, "b", 1, "n0"), (1, "b", 2, "n1")]
    df = outline.with_depth(spark.createDataFrame(rows, "ord int, sec string, level int, name string"), ["sec"], "ord", "level")
    got = {(r.sec, r.ord): r.ancestor_names for r in outline.with_ancestors(df, ["sec"], "ord", "name").collect()}
    want = {(s, k): [f"n{x}" for x in w[2]] for s in (None, "a") for k, w in enumerate(_stack(levels))}
    assert got == want | {("b", 0): [], ("b", 1): ["n0"]}


def test_paths_never_meet(spark):
    df = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a (2).md"), (4, "a.md"), (5, "b")], "id int, path string")
    got = [r.unique_path for r in outline.unique_paths(df, "path", "id").orderBy("id").collect()]
    assert len(set(got)) == 5 and got[0] == "a.md" and got[4] == "b"


# ---- sync


def test_every_line_of_the_decision_table(spark):
    pages = [("skip1", "Untitled", "m"), ("new1", "A", "m"), ("moved_path", "B", "m"), ("missing", "C", "m"), ("pending", "D", "m"), ("same", "E", "m"), ("no_file", "F", "m2"), ("gone_file", "G", "m2"), ("upd", "H", "m2"), ("conf", "I", "m2"), ("mv_new", "Old name", "m")]
    state = [("moved_path", "m", "other.md", "h", "synced", False), ("missing", "m", "C.md", "h", "synced", False), ("pending", "m", "D.md", "h", "synced", True), ("same", "m", "E.md", "h", "synced", False), ("no_file", "m", "", "h", "synced", False), ("gone_file", "m", "G.md", "h", "synced", False), ("upd", "m", "H.md", "h", "synced", False), ("conf", "m", "I.md", "h", "synced", False), ("orph", "m", "lost.md", "h", "synced", False), ("orph2", "m", "x.md", "h", "orphaned", False), ("mv_old", "m", "dir/Old name.md", "h", "synced", False)]
    files = [("D.md", "h"), ("E.md", "h"), ("H.md", "h"), ("I.md", "edited"), ("other.md", "h")]
    p = spark.createDataFrame([(k, n, m, f"{n}.md", n) for k, n, m in pages], "key string, name string, modified string, path string, display_name string")
    s = spark.createDataFrame(state, "key string, modified string, active_file string, content_hash string, status string, pending boolean")
    f = spark.createDataFrame(files, "path string, content_hash string")
    plan = sync.plan(p, s, f)
    assert {r.key: r.type for r in plan.collect()} == {"new1": "new", "moved_path": "reexport", "missing": "reexport", "pending": "ai-enrich", "no_file": "reexport", "gone_file": "reexport", "upd": "update", "conf": "conflict", "orph": "orphan", "mv_old": "orphan", "mv_new": "new"}
    moved = {(r.key, r.type): r.old_key for r in sync.with_moves(plan).collect()}
    assert moved[("mv_new", "move")] == "mv_old" and ("mv_old", "orphan") not in moved and ("orph", "orphan") in moved
    strict = sync.plan(p, s.withColumn("status", F.lit("user_deleted")), f, emulate_missing_status=False)
    assert "missing" not in {r.key for r in strict.collect()}
    assert sync.plan(p.limit(0), s.limit(0), f).count() == 0
    written = spark.createDataFrame([("new1", "m", "A.md", "h2", False)], "key string, modified string, active_file string, content_hash string, pending boolean")
    after = {r.key: r.status for r in sync.next_state(s, sync.with_moves(plan), written).collect()}
    assert after["orph"] == "orphaned" and after["new1"] == "synced" and "mv_old" not in after and after["same"] == "synced"


def test_moves_need_one_on_each_side(spark):
    schema = "key string, type string, old_path string, new_path string, display_name string"
    one = [("o1", "orphan", "a/X.md", None, None)]
    two = one + [("o2", "orphan", "b/X.md", None, None)]
    new = [("n1", "new", None, "c/X.md", "X")]
    for rows, moves in ((one + new, 1), (two + new, 0), (one + new + [("n2", "new", None, "d/X.md", "X")], 0)):
        got = sync.with_moves(spark.createDataFrame(rows, schema))
        assert got.where("type = 'move'").count() == moves and got.count() == len(rows) - moves


def test_rate_equals_brute_force(spark):
    rng = random.Random(2)
    times = sorted(86_400 * 2 - 90 + rng.random() * 400 for _ in range(300))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id int, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.recent for r in sync.rate(df, "ts", 60).collect()}
    sec = [round(t, 6) for t in times]
    near = {k for k, t in enumerate(sec) for u in sec if abs((t - u) - 60) < 1e-4}
    assert len(got) == 300 and all(got[k] == sum(t - 60 <= u <= t for u in sec) for k, t in enumerate(sec) if k not in near)


# ---- extraction


def test_variants_equal_brute_force(spark):
    rng = random.Random(8)
    ws = ["modal", "multi", "ADC", "kras", "naïve", "über", "x1", "beta", "mosaic"]
    seps = [" ", "-", "/", ", ", ". ", "_"]
    docs = [(k, "".join(rng.choice(ws) + rng.choice(seps) for _ in range(rng.randrange(1, 14)))) for k in range(300)] + [(900, None), (901, "")]
    terms = [("companies", v, v.upper(), k) for k, v in enumerate(["modal", "multi modal", "kras", "naïve", "beta", "x1 beta", "über", "adc/modal", "mosaic"])]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    v = spark.createDataFrame(terms, "entity_type string, variant string, canonical string, ord int")
    got = {(r.doc_id, r.canonical, r.pos) for r in extract.by_variants(d, v, "companies").collect()}
    want = set()
    for k, t in docs:
        for _, x, c, _ in terms:
            m = re.search(rf"(?<![A-Za-z0-9\-/]){re.escape(x)}\b", (t or "").lower())
            if m:
                want.add((k, c, m.start()))
    assert got == want


def test_known_false_and_true_positives(spark):
    docs = [(1, "multi-modal patient data"), (2, "Ourfirm's COMPO/MOSAIC approach for patient target discovery in oncology"), (3, "The deal covers $45M upfront (incl. $15M equity) plus royalties for patients"), (4, "This firm is not an ADC company"), (5, "KRAS-mutant NSCLC responded to treatment"), (6, "a CRISPR-based screening approach")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    v = spark.createDataFrame([("companies", "modal", "Modal", 0), ("methods", "adc", "ADC", 1), ("methods", "crispr", "CRISPR", 2)], "entity_type string, variant string, canonical string, ord int")
    symbols = spark.createDataFrame([("KRAS", "H:1"), ("EGFR", "H:2")], "symbol string, hgnc_id string")
    aliases = spark.createDataFrame([], "alias string, symbol string")
    names = spark.createDataFrame([("incl", "infantile x", "M:1"), ("mosaic", "mosaic", "M:2")], "key string, label string, mondo_id string")
    codes = spark.createDataFrame([], "code string, canonical string")
    got = {(r.doc_id, r.entity_type, r.canonical) for r in extract.all_mentions(d, v, symbols, aliases, names, codes).collect()}
    assert got == {(5, "genes", "KRAS"), (6, "methods", "CRISPR")}


def test_genes(spark):
    d = spark.createDataFrame([(1, "P53 then TP53"), (2, "TP53 then P53"), (3, "AB1 alone"), (4, "AB1 in a tumor"), (5, "THE cell"), (6, "x TP53-mutant, TP53 and PD-L1"), (7, None)], "doc_id int, text string")
    symbols = spark.createDataFrame([("TP53", "H:1"), ("AB1", "H:2"), ("THE", "H:3"), ("CD274", "H:4")], "symbol string, hgnc_id string")
    aliases = spark.createDataFrame([("P53", "TP53"), ("PD-L1", "CD274")], "alias string, symbol string")
    got = [(r.doc_id, r.text, r.canonical, r.pos) for r in extract.genes(d.withColumn("text", F.concat(F.col("text"), F.when(F.col("doc_id") < 3, " cancer").otherwise(""))), symbols, aliases).orderBy("doc_id", "ord").collect()]
    assert got == [(1, "P53", "TP53", 0), (2, "TP53", "TP53", 0), (2, "P53", "TP53", 10), (4, "AB1", "AB1", 0), (6, "TP53", "TP53", 2), (6, "PD-L1", "CD274", 24)]


def test_diseases_roles_trials_compounds_conferences(spark):
    d = spark.createDataFrame([(1, "A patient with small cell Lung Cancer."), (2, "lung is mentioned"), (3, "melanx in a patient"), (4, "melanx alone")], "doc_id int, text string")
    names = spark.createDataFrame([("lung cancer", "lung cancer", "M:1"), ("small cell lung cancer", "small cell LC", "M:2"), ("melanx", "melanx", "M:3"), ("cancer", "cancer", "M:4")], "key string, label string, mondo_id string")
    assert {(r.doc_id, r.ontology_id) for r in extract.diseases(d, names).collect()} == {(1, "M:1"), (1, "M:2"), (3, "M:3")}
    r = spark.createDataFrame([(1, "Head of Data Science at X, Senior Vice President"), (2, "Senior Director and Director"), (3, "the Director"), (4, "ex-Director")], "doc_id int, text string")
    assert {(x.doc_id, x.canonical) for x in extract.roles(r).collect()} == {(1, "Head of Data Science"), (1, "Senior Vice President"), (1, "Vice President"), (2, "Senior Director"), (3, "Director")}
    t = spark.createDataFrame([(1, "NCT12345678, NCT12345678 and trialx"), (2, "NCT1234567")], "doc_id int, text string")
    tv = spark.createDataFrame([("clinical_trials", "trialx", "TRIAL-X", 0)], "entity_type string, variant string, canonical string, ord int")
    assert [(x.doc_id, x.canonical, x.ord) for x in extract.clinical_trials(t, tv).orderBy("doc_id", "ord").collect()] == [(1, "NCT12345678", 1), (1, "TRIAL-X", 2)]
    c = spark.createDataFrame([(1, "M1234 and M 1234 and MSC1234567")], "doc_id int, text string")
    known = spark.createDataFrame([("M1234", "Drugx")], "code string, canonical string")
    assert {(x.text, x.canonical, x.ontology_id) for x in extract.compounds(c, known).collect()} == {("M1234", "Drugx", "M1234"), ("MSC1234567", "MSC1234567", "")}
    f = spark.createDataFrame([(1, "the AX meeting"), (2, "the ax fell"), (3, "bigconf")], "doc_id int, text string")
    fv = spark.createDataFrame([("conferences", "ax", "AX", 0), ("conferences", "bigconf", "BigConf", 1)], "entity_type string, variant string, canonical string, ord int")
    assert {(x.doc_id, x.canonical) for x in extract.conferences(f, fv).collect()} == {(1, "AX"), (3, "BigConf")}


# ---- mentions


def test_merge_and_lists(spark):
    schema = "doc_id string, entity_type string, ord int, canonical string, ontology_id string, text string"
    a = spark.createDataFrame([("d", "genes", 1, "kras", "", "kras"), ("d", "drugs", 2, "X", "", "x")], schema)
    b = spark.createDataFrame([("d", "genes", 1, "KRAS", "H:1", "KRAS"), ("d", "drugs", 2, "x", "", "xx"), ("d", "genes", 3, "K-Ras", "H:1", "K-Ras"), ("d", "roles", 4, "CEO", "", "CEO")], schema)
    m = mentions.merge(a, b)
    assert {(r.entity_type, r.canonical) for r in m.collect()} == {("genes", "KRAS"), ("drugs", "X"), ("roles", "CEO")}
    assert {(r.entity_type, tuple(r.names)) for r in mentions.lists(a.unionByName(b)).collect()} == {("genes", ("KRAS",)), ("drugs", ("X",)), ("roles", ("CEO",))}
    assert {(r.text, r.canonical) for r in mentions.link_texts(a.unionByName(b).where("text <> 'x'")).collect()} == {("kras", "kras"), ("KRAS", "KRAS"), ("K-Ras", "K-Ras")}
    assert mentions.entity_map(m).collect()[0].entities["drugs"] == ["X"]


def test_entity_page(spark):
    ix = spark.createDataFrame([("companies", "B Co", 3), ("genes", "KRAS", 1), ("compounds", "Xol", 2), ("compounds", "Yol", 1)], "entity_type string, canonical string, mention_count long")
    genes = spark.createDataFrame([("KRAS", "name", "H:1", ["a"])], "symbol string, name string, hgnc_id string, aliases array<string>")
    dis = spark.createDataFrame([], "key string, mondo_id string, parents array<string>")
    com = spark.createDataFrame([("Xol", "T", "c", ["xol", "m12"]), ("Yol", None, None, ["yol"])], "canonical string, target string, class string, variants array<string>")
    par = spark.createDataFrame([("A Co", "B Co"), ("B Co", "C Co")], "child string, parent string")
    pages = {r.file_name: r.content for r in mentions.pages(ix, genes, dis, com, par).collect()}
    assert '*Subsidiary of [[C Co]]*' in pages["B Co.md"] and "**Subsidiaries:** [[A Co]]" in pages["B Co.md"] and "mention_count: 3" in pages["B Co.md"]
    assert 'm_code: "M12"' in pages["Xol.md"] and "*Target: T — (c)*" in pages["Xol.md"] and "m_code" not in pages["Yol.md"]
    assert 'hgnc_id: "H:1"\naliases:\n  - "a"' in pages["KRAS.md"] and pages["KRAS.md"].startswith("---\ntitle: \"KRAS\"\nentity_type: genes\n")


def test_duplicate_files(spark):
    f = spark.createDataFrame([("g", "AB (CD).md"), ("g", "CD.md"), ("h", "AB (CD).md")], "folder string, file string")
    assert [tuple(r) for r in mentions.duplicate_alias_files(f).collect()] == [("g", "AB (CD).md")]


# ---- lines


def test_fence_islands(spark):
    def run(text):
        return lines.fence_islands(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()[0].text

    assert run("plain\nlibrary(x)\ny <- c(1)\nend") == "plain\n```r\nlibrary(x)\ny <- c(1)\n```\nend"
    assert run("plain\nlibrary(x)\nend") == "plain\nlibrary(x)\nend"
    assert run("```\nlibrary(x)\ny <- 1\n```") == "```\nlibrary(x)\ny <- 1\n```"
    assert run("import os\n    indented\n\\#note\n\nimport re") == "```python\nimport os\n    indented\n#note\n```\n\nimport re"


def test_islands_equal_a_line_scan(spark):
    rng = random.Random(6)
    kinds = ["text here", "library(x)", "    go on", "```", "x <- 1", "# note", ""]
    docs = [(k, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 15)))) for k in range(200)]
    rows = lines.code_islands(lines.split_lines(spark.createDataFrame(docs, "id int, text string"), "id", "text"))
    got = {(r.doc_id, r.n) for r in rows.where("in_code").collect()}
    want = set()
    for k, text in docs:
        inside, run = False, []

        def flush():
            if len(run) >= 2:
                want.update((k, i) for i in run)
            run.clear()

        for i, line in enumerate(text.split("\n")):
            if line.startswith("```"):
                flush()
                inside = not inside
            elif not inside and (line in ("library(x)", "x <- 1") or (run and line in ("    go on", "# note"))):
                run.append(i)
            elif not inside:
                flush()
        flush()
    assert got == want


def test_labels_embeds_numbers_lists(spark):
    d = spark.createDataFrame([(1, "```\nSELECT 1\n```\ntext\n```\nprose\n```\n```\nimport x")], "id int, text string")
    assert lines.label_fences(d, "id", "text").collect()[0].text == "```sql\nSELECT 1\n```\ntext\n```\nprose\n```\n```python\nimport x"
    e = spark.createDataFrame([(1, "intro\n![[a/x.png]] ![[y.png]]\nmid\n# Head\nmore\n![[f.pdf]]")], "id int, text string")
    assert [(r.type, r.filename, r.text) for r in lines.embeds(e, "id", "text").orderBy("ord").collect()] == [("text", None, "intro"), ("image", "x.png", None), ("text", None, "mid"), ("text", None, "# Head\nmore"), ("file", "f.pdf", None)]
    n = spark.createDataFrame([(1, k, x) for k, x in enumerate([True, True, False, True])], "d int, n int, num boolean")
    assert [r.item_no for r in lines.numbered(n, ["d"], "n", "num").orderBy("n").collect()] == [1, 2, None, 1]
    f = spark.createDataFrame([(1, '---\nentities:\n  - "Keep"\n  - "Drop"\nother:\n  - "Drop"\n---\n- Drop')], "id int, text string")
    assert lines.drop_list_entries(f, "id", "text", "entities", ["drop"]).collect()[0].text == '---\nentities:\n  - "Keep"\nother:\n  - "Drop"\n---\n- Drop'


# ---- attachments, profiles, annotation, links, fragments


def test_grouping(spark):
    def row(page, k, name, w, h, between=None, preceding="", title=""):
        return (page, k, name, w, h, between, preceding, title, "", "")

    rows = [row("p", k, f"{k}.png", 40, 30) for k in range(6)] + [row("q", 0, "a.png", 10, 10), row("q", 1, "b.png", 30, 10, None, "before b"), row("q", 2, "c.png", 30, 10, "# Next")]
    rows += [row("r", 0, "z.png", 10, 10, title="Poster session")]
    df = spark.createDataFrame(rows, "page_key string, ord int, filename string, width int, height int, between string, preceding string, page_title string, page_text string, section_path string")
    got = {(r.page_key, r.group_no): (r.worker_type, r.filenames, r.context) for r in attachments.group_images(df).collect()}
    assert got[("p", 0)] == ("slide_photo", [f"{k}.png" for k in range(6)], "")
    assert got[("q", 0)] == ("screenshot", ["a.png", "b.png", "c.png"], "before b") and got[("r", 0)][0] == "poster"
    assert attachments.group_images(df.limit(0)).count() == 0


def test_sample_hash_note(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 3, 8, 9, 20)], "a array<int>")
    assert [r[0] for r in df.select(attachments.even_sample(F.col("a"))).collect()] == [[], [0, 1, 2], list(range(8)), [int(k * 9 / 8) for k in range(8)], [int(k * 20 / 8) for k in range(8)]]
    a = spark.createDataFrame([("g", "x"), ("g", "y")], "g string, c string")
    assert attachments.group_hash(a, ["g"], "c").collect() == attachments.group_hash(a.orderBy(F.desc("c")), ["g"], "c").collect()
    n = spark.createDataFrame([(["one.png"], "k", ""), (["abcdefghij.png", "b.png"], "slide_photo", "# My Talk\nx"), (["abcdefghij.png", "b.png"], "k", "")], "f array<string>, w string, c string")
    assert [r[0] for r in n.select(attachments.note_file(F.col("f"), F.col("w"), F.col("c"))).collect()] == ["one_ai.md", "slide_photo_my_talk_abcdefgh_ai.md", "k_abcdefgh_ai.md"]


def test_profiles(spark):
    df = spark.createDataFrame([(2, None, "b"), (1, "x" * 60, None), (3, "z", "c")], "id int, a string, b string")
    assert [tuple(r) for r in profiles.profile(df, "id").collect()] == [(0, "a", "string", 2, 3, "x" * 50), (1, "b", "string", 2, 3, "b")]
    assert [r.row_count for r in profiles.profile(df.limit(0), "id").collect()] == [0, 0]
    for counts, want in (([1, 1, 8, 8], 2), ([1, 0, 1], 0), ([9, 9, 9], 0), ([6, 5, 20], 2)):
        rows = spark.createDataFrame([("s", k, n) for k, n in enumerate(counts)], "s string, row_no int, filled int")
        assert profiles.header_row(rows, ["s"]).collect()[0].header_row == want, counts


def test_json_and_answers(spark):
    for text, want in (('pre {"a": "}"} post', '{"a": "}"}'), ("```json\n[1, [2]]\n``` x", "[1, [2]]"), ('{"a": [1', '{"a": [1'), ("none", "none"), (None, None), ('{"a": "\\"}"} {', '{"a": "\\"}"}')):
        assert annotate.json_value(text) == want
    answers = ["TITLE: T\nAUTHORS: a, b\nDATE: unknown\nKEY_POINTS:\n- one\n- two\nBODY:\nx\n y\nTITLE: T2", None, "", "BODY: no block\nBODY:\n\n KEY_POINTS: none\nkept\nMETHODS: m\nlost\nBODY:\nmore\n  ", "CONTENT_TYPE:\nAUTHORS: Unknown\nAUTHORS: c ,, d\nMETHODS:\nKEY_POINTS:\n  - p\nq\nDATE: 1"]
    got = [(r["title"], r["authors"], r["date"], r["key_points"], r["body"], r["content_type"], r["extra"]) for r in _col(spark, answers, lambda c: annotate.structured(c, "d"))]
    assert got[0] == ("T2", ["a", "b"], "", ["one", "two"], "x\n y", "d", {})
    assert got[1] == got[2] == ("", [], "", [], "", "d", {})
    assert got[3] == ("", [], "", [], "KEY_POINTS: none\nkept\nmore", "d", {"methods": "m"})
    assert got[4] == ("", ["c", "d"], "1", ["p"], "", "d", {})
    df = spark.createDataFrame([('Sure: {"tags": ["A b", "a-b", "!"], "entities": {"genes": ["X"]}}',), ("nothing",)], "a string")
    got = [x[0] for x in df.select(annotate.tags_and_entities(F.col("a"))).collect()]
    assert got[0].tags == ["a-b"] and got[0].entities == {"genes": ["X"]} and got[1] is None


def test_tagging_uses_gate_and_cache(spark):
    body = "word " * 60
    pages = spark.createDataFrame([("a", "T", body), ("b", "T", "short"), ("c", None, "extraordinary " * 55), ("d", "T", None)], "page_key string, title string, body string")
    cache = pages.where("page_key = 'a'").select("page_key", T.hash16(F.col("body")).alias("hash"), F.array(F.lit("kept")).alias("tags"))
    vocabulary = spark.createDataFrame([("extraordinary", "special")], "tag string, canonical string")
    got = {r.page_key: r.tags for r in annotate.tagged(pages, cache, vocabulary).collect()}
    assert got == {"a": ["kept"], "c": ["special"]}


def test_links_are_made_longest_first(spark):
    assert links.replace_longest_first("alpha beta gamma delta", [("alpha beta", "alpha beta"), ("beta gamma delta", "beta gamma delta")]) == "alpha [[beta gamma delta]]"
    assert links.replace_longest_first("`Glex` [[Glex]] [Glex](u) glex Glexx", [("Glex", "Glex")]) == "`Glex` [[Glex]] [Glex](u) [[Glex]] Glexx"
    assert links.replace_longest_first("GLEX and Glexwista", [("glex", "Glexwista")], entities=True) == "[[Glexwista|GLEX]] and Glexwista"
    docs = spark.createDataFrame([(1, "Own", "---\na: b\n---\n# Glex title\nGlex here"), (2, "Glex", "Glex here"), (3, None, None), (4, "x", "nothing")], "doc_id int, name string, text string")
    names = spark.createDataFrame([("Glex", "Glex")], "text string, target string")
    got = {r.doc_id: r.text for r in links.link_mentions(docs, names).collect()}
    assert got == {1: "---\na: b\n---\n# Glex title\n[[Glex]] here", 2: "Glex here", 3: None, 4: "nothing"}


def test_aliases_and_resolution(spark):
    pages = spark.createDataFrame([("Onc_ Ada Lovelace (IHC)",), ("notes",), ("Ada Lovelace",), ("abc",)], "name string")
    assert {(r.text, r.target) for r in links.page_aliases(pages, "name").collect()} == {("Onc_ Ada Lovelace (IHC)", "Onc_ Ada Lovelace (IHC)"), ("Ada Lovelace", "Ada Lovelace")}
    h = spark.createDataFrame([("notes:x&page-id={AB}", "t"), ("notes:x&section-id={C}", "t"), ("notes:x&page-id=ZZ", "t"), ("http://u", "t")], "href string, text string")
    p = spark.createDataFrame([("{AB}", "Page")], "page_id string, name string")
    assert {r.link for r in links.resolve_links(h, p).collect()} == {"[[Page]]", "t *(section link)*", "t *(unresolved link)*", "[t](http://u)"}
    assert links.insert_callout("a ![[x/i.png]] b", "i.png", "N") == "a ![[x/i.png]]\n\n> [!note] [[N]]\n b"


def test_fragments():
    assert fragments.fragment("a &lt; *b*") == "a < \\*b\\*"
    assert fragments.fragment('<a href="u">t</a><br><span style="font-weight:bold">b</span><span style="font-family:Consolas">x_y</span><b>i</b>') == "[t](u)\n**b**`x_y`i"
    assert fragments.plain("<p>a &amp; b") == "a & b" and fragments.fragment(None) == "" and fragments.fragment("<unclosed") is not None


def test_ontology(spark):
    nodes = spark.createDataFrame([("http://x/MONDO_1", "Disease X", "CLASS", False, ["Syn One", "abc"]), ("http://x/MONDO_2", "ab", "CLASS", False, None), ("http://x/MONDO_3", "Gone", "CLASS", True, None), ("http://x/MONDO_4", "syn one", "CLASS", None, []), ("http://x/MONDO_5", None, None, None, None)], "node_id string, lbl string, node_type string, deprecated boolean, synonyms array<string>")
    edges = spark.createDataFrame([("MONDO:4", "is_a", "MONDO:1")], "sub string, pred string, obj string")
    assert {(r.key, r.mondo_id) for r in ontology.diseases(spark, nodes, edges, None).collect()} == {("disease x", "MONDO:1"), ("syn one", "MONDO:1")}
    assert {r.key for r in ontology.diseases(spark, nodes, edges, "MONDO:4").collect()} == {"syn one"}
    links_ = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "child string, parent string")
    assert {r.node for r in ontology.below(spark, "a", links_).collect()} == {"a", "b", "c", "d"}


def test_redaction(spark):
    given = [r"C:\Users\ada\x \\srv\share\y", r"AppData\Local\Temp\s1\f and OneDrive - Big Co\z", None]
    assert "ada" not in _col(spark, given, T.redact_paths)[0] and "Big Co" not in _col(spark, given, T.redact_paths)[1]
