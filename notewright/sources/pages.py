"""Page sources: the hierarchy export and the pages' XML as flat tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.functions.fragments import Page, _local

HIERARCHY = "page_id string, name string, level int, created string, modified string, notebook string, section_path string, ord long"
RECYCLE_ENDING = "recyclebin"  # fixed value: how the format names its bins
PAGE = (
    "page_key string, title string, markdown string, author string, contributors array<string>, last_modified_by string, last_modified_at string, tags array<string>, "
    "has_ink boolean, attachments array<struct<filename:string,content:binary>>, error string"
)


def flatten(xml: str) -> list[tuple]:
    """The pages of one hierarchy file in order. Section groups come before sections; recycle bins are left out."""
    rows: list[tuple] = []

    def walk(e: ET.Element, notebook: str, path: str) -> None:
        for kind in ("SectionGroup", "Section"):
            for c in e:
                if _local(c) != kind or c.get("isRecycleBin") == "true" or c.get("name", "").lower().replace("_", "").endswith(RECYCLE_ENDING):
                    continue
                here = f"{path}/{(c.get('name') or '').strip() or 'Untitled'}"
                if kind == "SectionGroup":
                    walk(c, notebook, here)
                    continue
                for p in c:
                    if _local(p) == "Page":
                        level = p.get("pageLevel", "1")
                        rows.append((p.get("ID", ""), (p.get("name") or "").strip() or "Untitled", int(level) if level.isdigit() else 1, p.get("dateTime", ""), p.get("lastModifiedTime", ""), notebook, here, len(rows)))

    root = ET.fromstring(xml)
    for n in [root] if _local(root) == "Notebook" else [e for e in root if _local(e) == "Notebook"]:
        name = (n.get("name") or "").strip() or "Untitled"
        walk(n, name, name)
    return rows


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of all hierarchy files under ``path``; each file is parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in HIERARCHY.split(", ")]
        for pdf in batches:
            for xml in pdf["value"]:
                yield pd.DataFrame(flatten(xml), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, HIERARCHY).withColumn("page_key", T.hash16(F.col("page_id")))


def convert_pages(pages: DataFrame, key: str, xml: str, skip_images: bool = False) -> DataFrame:
    """Pages' XML as Markdown with fields and attachments; what cannot be read gives a row with ``error`` and nulls."""

    def one(k: str, x: str | None) -> tuple:
        try:
            p = Page(x or "", skip_images)
            a = p.authorship()
            body = p.body()
            ink = any(_local(c) in ("InkParagraph", "InkDrawing") for c in p.root)
            return (k, p.title(""), body, a["author"], a["contributors"], a["last_modified_by"], a["last_modified_at"], p.tags(), ink, [{"filename": n, "content": c} for n, c in p.attachments], None)
        except (ET.ParseError, ValueError) as e:
            return (k, None, None, None, None, None, None, None, None, None, str(e)[:200])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in "page_key,title,markdown,author,contributors,last_modified_by,last_modified_at,tags,has_ink,attachments,error".split(",")]
        for pdf in batches:
            yield pd.DataFrame([one(k, x) for k, x in zip(pdf["k"], pdf["x"])], columns=names)

    return pages.select(F.col(key).alias("k"), F.col(xml).alias("x")).mapInPandas(run, PAGE)


def render(page: DataFrame) -> DataFrame:
    """``text``: front matter, title and body. Optional columns created, modified, section_path, parent, children and
    source are written if they are there."""
    has = set(page.columns)

    def line(name: str, quoted: bool = True):
        v = F.col(name)
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{name}: "' if quoted else f"{name}: "), v, F.lit('"' if quoted else "")))

    def items(label: str, column: str, linked: bool = False):
        a, b = ('  - "[[', ']]"') if linked else ('  - "', '"')
        return F.when(F.size(column) > 0, F.concat(F.lit(label + ":\n"), F.array_join(F.transform(column, lambda x: F.concat(F.lit(a), F.replace(x, F.lit('"'), F.lit("'")), F.lit(b))), "\n")))

    parts = [F.lit("---"), F.concat(F.lit('title: "'), F.replace("title", F.lit('"'), F.lit("'")), F.lit('"')), line("author"), F.when(F.size("contributors") > 1, items("contributors", "contributors")), line("last_modified_by"), line("last_modified_at", False)]
    parts += [line(c, False) for c in ("created", "modified", "source") if c in has]
    if "section_path" in has:
        sections = F.split("section_path", "/")
        parts += [F.concat(F.lit('notebook: "'), sections[0], F.lit('"')), F.when(F.size(sections) > 1, F.concat(F.lit('section: "'), F.array_join(F.slice(sections, 2, 1 << 20), "/"), F.lit('"')))]
    if "parent" in has:
        parts.append(F.when(F.coalesce("parent", F.lit("")) != "", F.concat(F.lit('parent: "[['), F.replace("parent", F.lit('"'), F.lit("'")), F.lit(']]"'))))
    if "children" in has:
        parts.append(items("children", "children", linked=True))
    parts += [items("tags", "tags"), F.lit("---\n")]
    return page.withColumn("text", F.concat_ws("\n", *parts, F.concat(F.lit("# "), F.col("title"), F.lit("\n")), F.col("markdown")))
