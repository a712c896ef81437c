import base64
import io
import zipfile

import os

import pytest
from pyspark.sql import functions as F

from notewright.sources import files, pages, state
from notewright.streaming import increments

HIER = """<one:Notebooks xmlns:one="urn:x"><one:Notebook name="NB">
<one:Section name="S1"><one:Page ID="{1}" name="First" pageLevel="1" dateTime="t1" lastModifiedTime="t2"/><one:Page ID="{2}" name="" pageLevel="2"/></one:Section>
<one:SectionGroup name="G"><one:Section name="S2"><one:Page ID="{3}" name="Third"/></one:Section></one:SectionGroup>
<one:SectionGroup name="Bin" isRecycleBin="true"><one:Section name="S3"><one:Page ID="{4}" name="Lost"/></one:Section></one:SectionGroup>
</one:Notebook></one:Notebooks>"""
PAGE = """<one:Page xmlns:one="urn:x" lastModifiedBy="Cy">
<one:TagDef index="0" type="0" name="To Do"/><one:TagDef index="1" type="9" name="Very Important"/><one:QuickStyleDef index="1" name="h1"/><one:QuickStyleDef index="2" name="code" font="Consolas"/>
<one:Title><one:OE><one:T>My &amp;amp; page</one:T></one:OE></one:Title>
<one:Outline><one:OEChildren>
<one:OE author="Bo" creationTime="2" quickStyleIndex="1"><one:T>Head</one:T></one:OE>
<one:OE author="Ada" creationTime="1" lastModifiedBy="Bo"><one:Tag index="0" completed="true"/><one:T>done</one:T></one:OE>
<one:OE><one:List><one:Bullet/></one:List><one:Tag index="1"/><one:T><![CDATA[<span style='font-weight:bold'>b</span>]]></one:T><one:OEChildren><one:OE><one:List><one:Number/></one:List><one:T>n1</one:T></one:OE><one:OE><one:List><one:Number/></one:List><one:T>n2</one:T></one:OE></one:OEChildren></one:OE>
<one:OE quickStyleIndex="2"><one:T>x = 1</one:T></one:OE><one:OE quickStyleIndex="2"><one:T>y_z</one:T></one:OE>
<one:OE><one:Table hasHeaderRow="true"><one:Row><one:Cell><one:OEChildren><one:OE><one:T>a|b</one:T></one:OE></one:OEChildren></one:Cell><one:Cell/></one:Row><one:Row><one:Cell/><one:Cell/></one:Row></one:Table></one:OE>
<one:OE><one:Image><one:Data>IMG</one:Data></one:Image></one:OE>
</one:OEChildren></one:Outline></one:Page>""".replace("IMG", base64.b64encode(b"pixels").decode())


def test_hierarchy(spark, tmp_path):
    (tmp_path / "h.xml").write_text(HIER)
    rows = pages.read_hierarchy(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.page_id, r.name, r.level, r.section_path) for r in rows] == [("{3}", "Third", 1, "NB/G/S2"), ("{1}", "First", 1, "NB/S1"), ("{2}", "Untitled", 2, "NB/S1")]
    assert len(rows[0].page_key) == 16


def test_page(spark):
    df = spark.createDataFrame([("k", PAGE), ("bad", "<x"), ("evil", "<!DOCTYPE a [<!ENTITY b 'c'>]><a/>"), ("none", None)], "key string, xml string")
    got = {r.page_key: r for r in pages.convert_pages(df, "key", "xml").collect()}
    r = got["k"]
    assert (r.title, r.author, r.contributors, r.last_modified_by, r.tags) == ("My & page", "Ada", ["Bo", "Ada"], "Cy", ["very-important"])
    name = r.attachments[0].filename
    assert r.markdown == f"## Head\n- [x] done\n- **b**\n  1. n1\n  2. n2\n```\nx = 1\ny_z\n```\n| a\\|b |  |\n| --- | --- | --- |\n|  |  |\n![[attachments/{name}]]"
    assert got["bad"].error and got["evil"].error and got["none"].error and got["bad"].markdown is None
    text = pages.render(pages.convert_pages(df.where("key = 'k'"), "key", "xml").withColumn("section_path", F.lit("NB/S"))).collect()[0].text
    assert text.startswith('---\ntitle: "My & page"\nauthor: "Ada"\ncontributors:\n  - "Bo"\n  - "Ada"\nlast_modified_by: "Cy"\nnotebook: "NB"\nsection: "S"\ntags:\n  - "very-important"\n---\n\n# My & page\n\n## Head')


def test_state_versions(spark, tmp_path):
    root, schema = str(tmp_path), "key string, n int"
    assert state.load(spark, root, "t", schema).count() == 0
    state.save(spark.createDataFrame([("a", 1)], schema), root, "t")
    state.save(spark.createDataFrame([("a", 2)], schema), root, "t")
    assert [tuple(r) for r in state.load(spark, root, "t", schema).collect()] == [("a", 2)]
    other = spark.createDataFrame([("a", "x")], "key string, n string")
    state.save(other, root, "t")
    assert state.load(spark, root, "t", schema).count() == 0  # another layout: afresh
    state.save(spark.createDataFrame([("a", 3)], schema), root, "t")
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("CURRENT")]) == 2 and len([f for f in os.listdir(tmp_path / "t") if f.startswith("v-")]) == 2


def test_a_broken_save_leaves_the_old_state_and_a_broken_state_ends_the_run(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), "key string, n int"
    state.save(spark.createDataFrame([("a", 1)], schema), root, "t")
    failing = spark.createDataFrame([("a", 2)], schema).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        state.save(failing, root, "t")
    assert [tuple(r) for r in state.load(spark, root, "t", schema).collect()] == [("a", 1)]
    # Another run that ended in between keeps its number.
    (tmp_path / "t" / "CURRENT-000000000002").write_text((tmp_path / "t" / "CURRENT-000000000001").read_text())
    monkeypatch.setattr(state, "_pointers", lambda *a: [(1, "CURRENT-000000000001")])
    with pytest.raises(RuntimeError, match="another run"):
        state.save(spark.createDataFrame([("a", 3)], schema), root, "t")
    monkeypatch.undo()
    assert [tuple(r) for r in state.load(spark, root, "t", schema).collect()] == [("a", 1)]
    (tmp_path / "t" / "CURRENT-000000000002").write_text("v-missing")
    with pytest.raises(Exception):  # noqa: B017 - a state that cannot be read is no empty one
        state.load(spark, root, "t", schema).count()


def test_files_are_removed_with_their_empty_folders(spark, tmp_path):
    for f in ("a/b/x.md", "a/y.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    df = spark.createDataFrame([("a/b/x.md",), ("a/none.md",)], "p string")
    assert {r.path: r.removed for r in state.remove_files(df, str(tmp_path), "p").collect()} == {"a/b/x.md": True, "a/none.md": False}
    assert not (tmp_path / "a/b").exists() and (tmp_path / "a/y.md").exists()
    with pytest.raises(Exception, match="leaves the folder"):
        state.remove_files(spark.createDataFrame([("../x",)], "p string"), str(tmp_path), "p").collect()


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("CAT\n\n# none\nCAR # a car\n")
    assert files.read_words(spark, str(tmp_path / "w.txt")) == ["CAT", "CAR"]


def test_files_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "x"), ("c.md", "y")], "p string, c string")
    assert {r.path: r.written for r in state.write_files(df, str(tmp_path), "p", "c").collect()} == {"a/b.md": True, "c.md": True}
    assert {r.written for r in state.write_files(df, str(tmp_path), "p", "c").collect()} == {False}
    listed = {r.path: r.content_hash for r in state.listing(spark, str(tmp_path)).collect()}
    assert set(listed) == {"a/b.md", "c.md"}


def _zip(**parts) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n.replace("__", "/") + ".xml", t)
    return b.getvalue()


def test_file_texts_and_tables(spark):
    docx = _zip(word__document='<d xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></d>')
    pptx = _zip(ppt__slides__slide1='<s xmlns:a="u"><a:p><a:t>Hi</a:t></a:p><a:tbl><a:tr><a:tc><a:t>x</a:t></a:tc><a:tc><a:t>y</a:t></a:tc></a:tr></a:tbl></s>', ppt__notesSlides__notesSlide1='<n xmlns:a="u"><a:p><a:t>say</a:t></a:p></n>')
    xlsx = _zip(xl__workbook='<w><s><sheet name="A"/></s></w>', xl__sharedStrings="<s><si><t>name</t></si></s>", xl__worksheets__sheet1='<w><d><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></d></w>')
    df = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.pptx", bytearray(pptx)), ("c.html", bytearray(b"<style>q</style><p>T  x</p>")), ("d.docx", bytearray(b"broken")), ("e.xyz", bytearray(b""))], "filename string, content binary")
    got = {r.filename: (r.text, r.error) for r in files.extract_text(df, "filename", "content").collect()}
    assert got["a.docx"] == ("One\nTwo", None) and got["b.pptx"][0] == "--- Slide 1 ---\nHi\nx | y\n[speaker notes] say" and got["c.html"][0] == "T x"
    assert got["d.docx"][0] is None and got["d.docx"][1].startswith("BadZipFile") and got["e.xyz"] == (None, "no reader")
    t = spark.createDataFrame([("x.csv", bytearray(b"a,b\n1,\"2,3\"\n")), ("y.tsv", bytearray(b"p\tq\n")), ("z.xlsx", bytearray(xlsx))], "filename string, content binary")
    assert {(r.filename, r.row_no): r.cells for r in files.table_rows(t, "filename", "content").collect()} == {("x.csv", 0): ["a", "b"], ("x.csv", 1): ["1", "2,3"], ("y.tsv", 0): ["p", "q"], ("z.xlsx", 0): ["name", "", "5"]}


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\0" * 10
    assert files.image_size(png) == (640, 480) and files.image_size(jpg) == (40, 30) and files.image_size(b"x") == (1, 1)


def test_dictionaries(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"genes": {"KRAS": {"hgnc_id": "H:1"}}, "alias_map": {"K2": "KRAS"}}')
    symbols, aliases = files.read_genes(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in symbols.collect()] == [("KRAS", "H:1")] and [tuple(r) for r in aliases.collect()] == [("K2", "KRAS")]
    (tmp_path / "d.json").write_text('{"flu": {"label": "Flu", "mondo_id": "M:1"}}')
    assert [tuple(r) for r in files.read_diseases(spark, str(tmp_path / "d.json")).collect()] == [("flu", "Flu", "M:1")]
    (tmp_path / "o.json").write_text('{"graphs": [{"nodes": [{"id": "x/MONDO_1", "lbl": "A", "type": "CLASS", "meta": {"deprecated": false, "synonyms": [{"val": "s"}]}}], "edges": [{"sub": "a", "pred": "is_a", "obj": "b"}]}]}')
    nodes, edges = files.read_ontology(spark, str(tmp_path / "o.json"))
    assert nodes.collect()[0].synonyms == ["s"] and edges.collect()[0].pred == "is_a"
    (tmp_path / "c.yaml").write_text("Big Co:\n  variants: [big, big co]\n  parent: Holding\nSmall: [small]\n")
    v, p, _ = files.read_variants(spark, str(tmp_path / "c.yaml"), "companies")
    assert [(r.variant_name, r.canonical, r.ord) for r in v.collect()] == [("big", "Big Co", 0), ("big co", "Big Co", 1), ("small", "Small", 2)] and p.collect()[0].parent == "Holding"
    (tmp_path / "n.yaml").write_text("canonicals:\n  companies: [Small]\nvariants: [big]\n")
    from notewright.operators import ontology

    kept = ontology.without_denied(ontology.variants(v), files.read_denylist(spark, str(tmp_path / "n.yaml")))
    assert [r.variant for r in kept.collect()] == ["big co"]


def test_stream_takes_each_page_once(spark, tmp_path):
    inbox, root, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    seen = []
    page = lambda *rows: spark.createDataFrame([(k, n, m, f"{n}.md", n, "text " + m) for k, n, m in rows], increments.PAGES).write.mode("append").parquet(inbox)
    note = lambda df, n: seen.extend((r.key, r.type) for r in df.collect())
    page(("a", "A", "1"), ("b", "B", "1"), ("a", "A", "0"))
    increments.run_once(spark, inbox, root, check, note)
    assert sorted(seen) == [("a", "new"), ("b", "new")]
    seen.clear()
    page(("a", "A", "2"), ("b", "B", "1"))
    increments.run_once(spark, inbox, root, check, note)
    assert seen == [("a", "update")]
    increments.run_once(spark, inbox, root, check, note)
    assert {r.key: r.modified for r in state.load(spark, root, "pages", increments.STATE).collect()} == {"a": "2", "b": "1"}
