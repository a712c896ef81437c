import base64
import os

from pyspark.sql import functions as F

from notewright.operators import analysis, noting
from notewright.plans import jobs
from notewright.sources import state

MD = '---\ntitle: "T"\nauthor: "A"\ntags:\n  - "old"\nentities:\n  genes:\n    - "X"\n---\n\n# T\n\nbody'


def _one(spark, f, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'map<string,array<string>>' if isinstance(v, dict) else 'string'}" for n, v in cols.items()))
    return df.select(f(*map(F.col, names))).collect()[0][0]


def test_fields(spark):
    assert '  - "old"\n  - "new"\nentities:' in _one(spark, noting.with_tags, a=MD, b=["old", "new"])
    assert _one(spark, noting.with_tags, a=MD, b=["old"]) == MD
    assert _one(spark, noting.with_tags, a="---\ntitle: x\n---\nb", b=["b", "a"]) == '---\ntitle: x\ntags:\n  - "a"\n  - "b"\n---\nb'
    assert _one(spark, noting.with_tags, a="no front", b=["b"]) == "no front"
    got = _one(spark, noting.with_entities, a=MD, b={"drugs": ["d", "c", "d"], "genes": ["G"]})
    assert 'entities:\n  genes:\n    - "G"\n  drugs:\n    - "c"\n    - "d"\n---' in got and '"X"' not in got and got.endswith("body")
    assert _one(spark, noting.with_type, a=MD, b="meeting", c="adcs").startswith('---\ntitle: "T"\ntype: meeting\ndomain: adcs\nauthor: "A"')
    assert _one(spark, noting.with_type, a="---\ntype: x\ndomain: y\n---\n", b="meeting", c="adcs") == "---\ntype: x\ndomain: y\n---\n"
    assert _one(spark, noting.with_transcription, a="a\n\n---\n\n## Handwritten Notes\n\nold", b="new") == "a\n\n---\n\n## Handwritten Notes\n\nnew\n"
    assert _one(spark, noting.with_transcription, a="a \n", b="new") == "a\n\n---\n\n## Handwritten Notes\n\nnew\n"
    assert _one(spark, noting.conflict_copy, a="---\nt: x\n---\nbody", b="f.md").startswith("---\nt: x\n---\n\n> [!warning] Conflict")
    assert _one(spark, noting.conflict_path, a="d/f.md", b="2024-01-02") == "d/f (conflict 2024-01-02).md"


def test_repairs_in_order(spark):
    text = '---\nentities:\ndiseases:\n  - "Risk"\n  - "AB (CD)"\n---\na \\_b\\_ `\\_c` &amp;lt;\nFrom <[u](l)>\n\nlibrary(x)\ny <- 1\n\n```\nSELECT 1\n```'
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.changed) for r in noting.repaired(df, ["risk"], ["risk"]).collect()}
    assert got[2] == ("plain", False) and 3 not in got
    assert got[1] == ('---\nentities:\ndiseases:\n  - "CD"\n---\na _b_ `\\_c` <\nSource: [u](l)\n\n```r\nlibrary(x)\ny <- 1\n```\n\n```sql\nSELECT 1\n```', True)


def test_placeholders_and_moves(spark):
    f = spark.createDataFrame([("a/Untitled.md", "---\nx: y\n---\n![[i.png]]"), ("b/Untitled.md", "a long enough body to be kept"), ("c/Other.md", "")], "path string, text string")
    assert [r.path for r in noting.empty_placeholders(f).collect()] == ["a/Untitled.md"]
    assert noting.missing_from(f, f.limit(2)).count() == 1


def _export(tmp, names):
    pages = "".join(f'<Page ID="{{{k}}}" name="{n}" pageLevel="{1 if k == 1 else 2}" lastModifiedTime="{m}"/>' for k, (n, m) in names.items())
    (tmp / "h").mkdir(exist_ok=True)
    (tmp / "h" / "h.xml").write_text(f'<Notebooks><Notebook name="NB"><Section name="Meetings">{pages}</Section></Notebook></Notebooks>')


def test_a_run_and_the_next(spark, tmp_path):
    root, vault = str(tmp_path / "state"), tmp_path / "vault"
    vault.mkdir()
    _export(tmp_path, {1: ("Plan", "1"), 2: ("Plan - Budget talk", "1")})
    body = "<Page><Outline><OEChildren><OE><T>{}</T></OE></OEChildren></Outline></Page>"
    variants = spark.createDataFrame([("companies", "glexwista", "Glexwista", 0)], "entity_type string, variant string, canonical string, ord int")
    o = jobs.Options(dictionaries={"variants": variants}, day="2024-01-02")

    def xml(**texts):
        keys = {r.page_id: r.page_key for r in __import__("notewright.sources.pages", fromlist=["x"]).read_hierarchy(spark, str(tmp_path / "h")).collect()}
        return spark.createDataFrame([(keys["{" + k[1:] + "}"], body.format(t)) for k, t in texts.items()], "key string, xml string")

    first = {r.type: r.n for r in jobs.run_sync(spark, str(tmp_path / "h"), xml(p1="Glexwista and the Budget talk", p2="nothing"), root, str(vault), o).collect()}
    assert first == {"new": 2}
    text = (vault / "NB/Meetings/Plan.md").read_text()
    assert text.startswith('---\ntitle: "Plan"\ntype: meeting\n') and "[[Glexwista]] and the [[Budget talk]]" in text and 'companies:\n    - "Glexwista"' in text and "language: en" in text
    assert (vault / "NB/Meetings/Plan/Budget talk.md").exists()
    assert jobs.run_sync(spark, str(tmp_path / "h"), xml(p1="x"), root, str(vault), o).count() == 0
    # One page changes at the source, the other at both ends.
    _export(tmp_path, {1: ("Plan", "2"), 2: ("Plan - Budget talk", "2")})
    (vault / "NB/Meetings/Plan/Budget talk.md").write_text("my edit")
    second = {r.type: r.n for r in jobs.run_sync(spark, str(tmp_path / "h"), xml(p1="new words", p2="their words"), root, str(vault), o).collect()}
    assert second == {"update": 1, "conflict": 1}
    assert "new words" in (vault / "NB/Meetings/Plan.md").read_text() and (vault / "NB/Meetings/Plan/Budget talk.md").read_text() == "my edit"
    assert "their words" in (vault / "NB/Meetings/Plan/Budget talk (conflict 2024-01-02).md").read_text()
    index = state.load(spark, root, "index", "entity_type string, canonical string, mention_count long")
    assert index.count() == 0  # the mention went with the old text
    assert {r.status for r in state.load(spark, root, "pages", jobs.STATE).collect()} == {"synced", "conflict"}


def _keys(spark, tmp):
    from notewright.sources import pages

    return {r.name: r.page_key for r in pages.read_hierarchy(spark, str(tmp / "h")).collect()}


PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (40).to_bytes(4, "big") + (30).to_bytes(4, "big")).decode()


def test_every_action_with_tags_and_analyses(spark, tmp_path):
    """Moves keep the file's text, orphans and old files go, unreadable pages are told, caches spare the models."""
    root, vault = str(tmp_path / "state"), tmp_path / "vault"
    _export(tmp_path, {1: ("Plan", "1"), 2: ("Loose end", "1"), 3: ("Talk", "1"), 4: ("Broken", "1")})
    page = "<Page><Outline><OEChildren><OE><T>{}</T></OE>{}</OEChildren></Outline></Page>"
    image = f"<OE><T>structure of the team</T></OE><OE><Image><Data>{PNG}</Data></Image></OE>"

    def tagger(prompts):
        with open(tmp_path / "asked", "a") as f:
            f.write("x" * len(prompts))
        return ['{"tags": ["Big Topic"], "entities": {}}'] * len(prompts)

    o = jobs.Options(day="2024-01-02", tags=True, tagger=tagger, analyze=True, orphans="delete")
    keys = _keys(spark, tmp_path)
    long = "word " * 60

    def xml(**texts):
        return spark.createDataFrame([(keys[n], x) for n, x in texts.items()], "key string, xml string")

    first = {r.type: (r.n, r.examples) for r in jobs.run_sync(spark, str(tmp_path / "h"), xml(Plan=page.format(long, image), **{"Loose end": page.format("gone soon", "")}, Talk=page.format("talk", ""), Broken="<Page"), root, str(vault), o).collect()}
    assert first["new"][0] == 4 and first["unreadable"] == (1, [keys["Broken"]])
    text = (vault / "NB/Meetings/Plan.md").read_text()
    assert 'tags:\n  - "big-topic"' in text and "> [!ai]- AI Analysis — Diagram" in text and (tmp_path / "asked").read_text() == "x"
    notes = os.listdir(vault / "NB/Meetings/_ai_notes")
    assert len(notes) == 1 and f"![[_ai_notes/{notes[0]}]]" in text
    note = (vault / "NB/Meetings/_ai_notes" / notes[0]).read_text()
    assert "source_type: diagram" in note and "content_type: diagram" in note
    assert not (vault / "NB/Meetings/Broken.md").exists()
    # The page moves under a new id and name of the section; its reader has added a line. Another page is gone.
    (vault / "NB/Meetings/Plan.md").write_text(text + "\nmine")
    (tmp_path / "h" / "h.xml").write_text('<Notebooks><Notebook name="NB"><Section name="Moved"><Page ID="{9}" name="Plan" pageLevel="1" lastModifiedTime="1"/></Section><Section name="Meetings"><Page ID="{3}" name="Talk" pageLevel="1" lastModifiedTime="1"/></Section></Notebook></Notebooks>')
    keys.update(_keys(spark, tmp_path))
    second = {r.type: r.n for r in jobs.run_sync(spark, str(tmp_path / "h"), xml(Plan=page.format("not read", ""), Talk=page.format("talk", "")), root, str(vault), o).collect()}
    assert second["move"] == 1 and second["orphan"] >= 1
    assert (vault / "NB/Moved/Plan.md").read_text() == text + "\nmine" and not (vault / "NB/Meetings/Plan.md").exists()
    assert os.listdir(vault / "NB/Moved/attachments") and not (vault / "NB/Meetings/attachments").exists()
    assert not (vault / "NB/Meetings/Plan").exists() and (vault / "NB/Meetings/Talk.md").exists()
    rows = {r.key: r.status for r in state.load(spark, root, "pages", jobs.STATE).collect()}
    assert set(rows.values()) == {"synced"} and keys["Plan"] in rows and len(rows) == 2
    assert jobs.run_sync(spark, str(tmp_path / "h"), xml(), root, str(vault), o).count() == 0


def test_analyses_are_cached_merged_and_fail_alone(spark):
    groups = spark.createDataFrame([("p", 0, "screenshot", ["a.png", "b.png", "gone.png"], "# Ctx"), ("p", 1, "document", ["d.docx"], None), ("p", 2, "poster", ["p.png"], ""), ("q", 0, "poster", ["gone.png"], ""), ("q", 1, "unknown", ["a.png"], "")], "page_key string, group_no int, worker_type string, filenames array<string>, context string")
    files = spark.createDataFrame([("p", f, f.encode()) for f in ("a.png", "b.png", "d.docx", "p.png")] + [("q", "a.png", b"a")], "page_key string, filename string, content binary")
    none = spark.createDataFrame([], analysis.CACHE)

    def broken(tasks):
        raise ValueError("no model")

    workers = {**analysis.REGISTRY, "poster": broken}
    done = analysis.analyzed(groups, files, none, F.lit("day"), workers=workers)
    got = {(r.page_key, r.worker_type): r for r in done.collect()}
    assert set(got) == {("p", "screenshot"), ("p", "document"), ("p", "poster")}
    shot = got["p", "screenshot"]
    assert shot.filenames == ["a.png", "b.png"] and shot.cache_key == "screenshot_a_b" and "screenshot_count: 2" in shot.note and "\n\n---\n\n" in shot.note
    assert got["p", "poster"].note is None and got["p", "poster"].error == "ValueError: no model"
    cache = analysis.cache_after(none, done)
    again = {r.worker_type: (r.cached, r.note) for r in analysis.analyzed(groups, files, cache, F.lit("day"), workers={**workers, "screenshot": broken, "document": broken}).collect()}
    assert again["screenshot"] == (True, None) and again["document"] == (True, None)
    forced = {r.worker_type: r.cached for r in analysis.analyzed(groups, files, cache, F.lit("day"), workers=analysis.REGISTRY, force=True).collect()}
    assert not any(forced.values())
    pages = spark.createDataFrame([("p", "x ![[attachments/a.png]] y ![[attachments/b.png]] z [[attachments/d.docx]]"), ("r", "none"), ("s", None)], "page_key string, text string")
    out = {r.page_key: r.text for r in analysis.with_callouts(pages, done).collect()}
    assert "b.png]]\n\n> [!ai]- AI Analysis — Screenshot — # Ctx — (2 files)\n> ![[_ai_notes/" in out["p"] and out["r"] == "none" and out["s"] is None
    assert {r.page_key: r.text for r in analysis.with_callouts(spark.createDataFrame([("p", out["p"])], "page_key string, text string"), done).collect()} == {"p": out["p"]}
