"""Text and tables out of attached files, and dictionaries out of JSON and YAML."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import ontology

#: How many rows of a table and pages of a PDF are read; None reads all.
MOST_ROWS: int | None = 100
MOST_PAGES: int | None = 20


def _xml(data: bytes) -> ET.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:4096], re.I):
        raise ValueError("a document must not declare entities")
    return ET.fromstring(data)


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs by lines."""
    root = _xml(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p")
    return "\n".join(x for x in lines if x.strip())


def pptx_text(data: bytes) -> str:
    """Slides in order with their tables' cells joined by bars and the speaker's notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))

    def text(e: ET.Element) -> list[str]:
        if _local(e) == "tbl":
            return [" | ".join(" ".join(t.text or "" for t in c.iter() if _local(t) == "t") for c in r if _local(c) == "tc") for r in e if _local(r) == "tr"]
        if _local(e) == "p":
            line = "".join(t.text or "" for t in e.iter() if _local(t) == "t")
            return [line] if line.strip() else []
        return [x for c in e for x in text(c)]

    out = []
    for k, n in enumerate(slides, 1):
        parts = text(_xml(z.read(n)))
        notes = n.replace("slides/slide", "notesSlides/notesSlide")
        if notes in names and (spoken := text(_xml(z.read(notes)))):
            parts.append("[speaker notes] " + " ".join(spoken))
        if parts:  # a slide without text is left out
            out.append(f"--- Slide {k} ---\n" + "\n".join(parts))
    return "\n\n".join(out)


def html_file_text(data: bytes) -> str:
    s = re.sub(r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "", data.decode("utf-8", "replace"))
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s)).strip()


def pdf_text(data: bytes) -> str:
    """The text of the first pages; needs an optional library."""
    import pypdf  # noqa: PLC0415 - optional

    return "\n\n".join((p.extract_text() or "") for p in pypdf.PdfReader(io.BytesIO(data)).pages[:MOST_PAGES])


READERS = {"docx": docx_text, "pptx": pptx_text, "html": html_file_text, "pdf": pdf_text}


def extract_text(files: DataFrame, filename: str, content: str) -> DataFrame:
    """``files`` with ``text`` and ``error``: what cannot be read has a null text and says why."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def one(name: str, data: bytes) -> tuple[str | None, str | None]:
        reader = READERS.get(name.rsplit(".", 1)[-1].lower())
        if reader is None:
            return None, "no reader"
        try:
            return reader(bytes(data)), None
        except Exception as e:  # noqa: BLE001 - one broken file must not end the job
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(n, c) for n, c in zip(pdf[filename], pdf[content])]
            yield pdf.assign(text=[g[0] for g in got], error=[g[1] for g in got])

    return files.mapInPandas(run, fields + ", text string, error string")


def xlsx_rows(data: bytes) -> dict[str, list[list[str]]]:
    """By sheet the cells of the first rows as text, from the package's own XML."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name", "") for s in _xml(z.read("xl/workbook.xml")).iter() if _local(s) == "sheet"]
    out: dict[str, list[list[str]]] = {}
    for k, name in enumerate(names, 1):
        part = f"xl/worksheets/sheet{k}.xml"
        if part not in z.namelist():
            continue
        rows = []
        for r in (e for e in _xml(z.read(part)).iter() if _local(e) == "row"):
            cells: list[str] = []
            for c in r:
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                v = next((x.text or "" for x in c.iter() if _local(x) in ("v", "t")), "")
                cells += [""] * (at - len(cells)) + [shared[int(v)] if c.get("t") == "s" and v else v]
            rows.append(cells)
            if MOST_ROWS is not None and len(rows) >= MOST_ROWS:
                break
        out[name] = rows
    return out


def table_rows(files: DataFrame, filename: str, content: str) -> DataFrame:
    """(filename, sheet, sheet_no, row_no, cells): the first rows of CSV, TSV and XLSX files."""

    def one(name: str, data: bytes) -> list[tuple]:
        kind = name.rsplit(".", 1)[-1].lower()
        if kind == "xlsx":
            return [(name, s, k, n, cells) for k, (s, rows) in enumerate(xlsx_rows(data).items()) for n, cells in enumerate(rows)]
        lines = csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter="\t" if kind == "tsv" else ",")
        return [(name, "", 0, n, cells) for n, cells in enumerate(islice(lines, MOST_ROWS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for n, c in zip(pdf["f"], pdf["c"]) if n.rsplit(".", 1)[-1].lower() in ("csv", "tsv", "xlsx") for r in one(n, bytes(c))]
            yield pd.DataFrame(rows, columns=["filename", "sheet", "sheet_no", "row_no", "cells"])

    return files.select(F.col(filename).alias("f"), F.col(content).alias("c")).mapInPandas(run, "filename string, sheet string, sheet_no int, row_no int, cells array<string>")


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the headers of PNG, GIF, BMP and JPEG; (1, 1) for what is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            k = 2
            while k + 9 < len(data):
                marker, length = data[k + 1], struct.unpack(">H", data[k + 2 : k + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[k + 5 : k + 9])
                    return w, h
                k += 2 + length
    except struct.error:
        pass
    return 1, 1


def image_sizes(files: DataFrame, content: str) -> DataFrame:
    """``files`` with ``width`` and ``height``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [image_size(bytes(c)) for c in pdf[content]]
            yield pdf.assign(width=[g[0] for g in got], height=[g[1] for g in got])

    return files.mapInPandas(run, fields + ", width int, height int")


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, mtime, size, content) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")


# ---- dictionaries


def read_genes(spark: SparkSession, path: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(symbol, hgnc_id) and (alias, symbol) of the built gene JSON."""
    raw = spark.read.schema("genes map<string,struct<hgnc_id:string>>, alias_map map<string,string>").option("multiLine", True).json(path)
    symbols = raw.select(F.explode("genes").alias("symbol", "g")).select("symbol", "g.hgnc_id")
    return ontology.check_size(symbols, least), raw.select(F.explode("alias_map").alias("alias", "symbol"))


def read_diseases(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(key, label, mondo_id) of the built disease JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<label:string,mondo_id:string>>").alias("m"))
    return ontology.check_size(raw.select(F.explode("m").alias("key", "d")).select("key", "d.label", "d.mondo_id"), least)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an ontology's JSON graph, in the columns the dictionary builder reads."""
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,type:string,meta:struct<deprecated:boolean,synonyms:array<struct<val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
    graph = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("graphs")[0].alias("g"))
    nodes = graph.select(F.explode("g.nodes").alias("n")).select(F.col("n.id").alias("node_id"), "n.lbl", F.col("n.type").alias("node_type"), F.col("n.meta.deprecated").alias("deprecated"), F.transform("n.meta.synonyms", lambda s: s["val"]).alias("synonyms"))
    return nodes, graph.select(F.explode("g.edges").alias("e")).select("e.*")


def read_gene_table(spark: SparkSession, path: str) -> DataFrame:
    """The gene TSV with its rows numbered in file order."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').csv(path)
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def read_variants(spark: SparkSession, path: str, entity_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants, parents and compound facts of one curated YAML: ``canonical: [variant]`` or ``canonical: {variants,
    parent, target, class}``. Dictionaries are curated by hand, so one is read by the driver."""
    import yaml

    data = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect())) or {}
    variants, parents, facts = [], [], []
    for canonical, v in data.items():
        v = v if isinstance(v, dict) else {"variants": v}
        variants += [(entity_type, str(x), canonical, 0) for x in v.get("variants") or []]
        if v.get("parent"):
            parents.append((canonical, v["parent"]))
        facts.append((canonical, v.get("target"), v.get("class"), [str(x) for x in v.get("variants") or []]))
    variants = [(t, x, c, k) for k, (t, x, c, _) in enumerate(variants)]
    return (
        spark.createDataFrame(variants, "entity_type string, variant_name string, canonical string, ord int"),
        spark.createDataFrame(parents, "child string, parent string"),
        spark.createDataFrame(facts, "canonical string, target string, class string, variants array<string>"),
    )


def read_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a curated list, one a line; blank lines and what follows ``#`` do not count."""
    return [w for r in spark.read.text(path).collect() if (w := r.value.split("#")[0].strip())]


def read_denylist(spark: SparkSession, path: str) -> DataFrame:
    """(guard, entity_type, term) of the denylist YAML."""
    import yaml

    data = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect())) or {}
    rows = [("canonicals", t, str(x)) for t, xs in (data.get("canonicals") or {}).items() for x in xs or []] + [("variants", None, str(x)) for x in data.get("variants") or []]
    return spark.createDataFrame(rows, "guard string, entity_type string, term string")
