"""Notes as they are written: fields in the front matter, sections replaced, conflict copies, repairs in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import lines
from notewright.operators.extract import TYPES

INK = "## Handwritten Notes"  # fixed value: the section's title
PLACEHOLDER_FILES = ("Untitled page.md", "Untitled page (2).md", "Untitled page (3).md", "Untitled.md", "Neuer Abschnitt.md")


def _items(values: Column, indent: str = "  ") -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit(f'{indent}- "'), v, F.lit('"'))), "\n")


def _before_end(text: Column, block: Column) -> Column:
    """A block put before the front matter's end; a text without front matter, or an empty block, changes nothing."""
    close = F.regexp_instr(text, F.lit(r"(?s)\A---\n(?:.*?\n)?---(?=\n|\z)"))
    head = F.regexp_extract(text, r"(?s)\A(---\n(?:.*?\n)?)---(?=\n|\z)", 1)
    return F.when((close > 0) & (block != ""), F.concat(head, block, F.lit("\n"), F.substr(text, F.length(head) + 1))).otherwise(text)


def listed_tags(text: Column) -> Column:
    """The tags of the front matter's list."""
    block = F.regexp_extract(text, r"(?s)\A---\n(?:.*?\n)?tags:\n((?:  - [^\n]*\n)*)", 1)
    return F.regexp_extract_all(block, F.lit(r"""  - ["']?([^"'\n]*)["']?"""), F.lit(1))


def with_tags(text: Column, tags: Column) -> Column:
    """New tags after the listed ones, or a sorted list where there was none; tags that are listed are not repeated."""
    old = listed_tags(text)
    new = F.array_except(F.coalesce(tags, F.array().cast("array<string>")), old)
    block = F.regexp_extract(text, r"(?s)\A(---\n(?:.*?\n)?tags:\n(?:  - [^\n]*\n)*)", 1)
    grown = F.concat(block, _items(new), F.lit("\n"), F.substr(text, F.length(block) + 1))
    fresh = _before_end(text, F.concat(F.lit("tags:\n"), _items(F.array_sort(new))))
    return F.when(F.size(new) == 0, text).when(block != "", grown).otherwise(fresh)


def with_entities(text: Column, entities: Column) -> Column:
    """The entity block (a map from type to names) instead of the one that was there, types in their fixed order."""
    bare = F.regexp_replace(text, r"(?s)\A(---\n(?:.*?\n)?)entities:\n(?:(?:[ \t][^\n]*)?\n)*(?=[^\n])", "$1")
    parts = [F.when(F.size(entities[t]) > 0, F.concat(F.lit(f"  {t}:\n"), _items(F.array_sort(F.array_distinct(entities[t])), "    "))) for t in TYPES]
    block = F.concat_ws("\n", *parts)
    return F.when(entities.isNull(), text).otherwise(_before_end(bare, F.when(block != "", F.concat(F.lit("entities:\n"), block)).otherwise("")))


def with_type(text: Column, note_type: Column, domain: Column) -> Column:
    """Type and domain after the first title or author line, each only where it is not there yet."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)---", 1)
    t = F.when((note_type != "") & ~front.rlike(r"(?m)^type:"), F.concat(F.lit("type: "), note_type))
    d = F.when((F.coalesce(domain, F.lit("")) != "") & ~front.rlike(r"(?m)^domain:"), F.concat(F.lit("domain: "), domain))
    new = F.concat_ws("\n", t, d)
    head = F.regexp_extract(text, r"(?s)\A(---\n(?:(?!title:|author:)[^\n]*\n)*?(?:title|author):[^\n]*\n(?:  [^\n]*\n)*)", 1)
    head = F.when(head != "", head).otherwise(F.regexp_extract(text, r"\A(---\n[^\n]*\n)", 1))
    return F.when((front == "") | (new == ""), text).otherwise(F.concat(head, new, F.lit("\n"), F.substr(text, F.length(head) + 1)))


def with_language(text: Column, lang: Column) -> Column:
    return F.when(F.regexp_extract(text, r"(?s)\A---\n(.*?\n)---", 1).rlike(r"(?m)^language:"), text).otherwise(_before_end(text, F.concat(F.lit("language: "), lang)))


def with_transcription(text: Column, said: Column) -> Column:
    """The handwriting section from the rule before it to the end replaced, or put at the end."""
    at = F.locate(INK, text)
    before = F.regexp_replace(F.substr(text, F.lit(1), at - 1), r"(?s)\n---\n\s*\z", "\n")
    new = F.concat(F.lit(f"---\n\n{INK}\n\n"), said, F.lit("\n"))
    return F.when(at > 0, F.concat(before, new)).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n\n"), new))


def conflict_copy(text: Column, kept: Column) -> Column:
    """A conflict's notice after the front matter."""
    notice = F.concat(F.lit("> [!warning] Conflict\n> Both the source and your file changed since the last run. Your edits are kept in:\n> `"), kept, F.lit("`\n\n"))
    end = T.front_end(text)
    return F.when(end > 0, F.concat(F.substr(text, F.lit(1), end), F.lit("\n\n"), notice, F.substr(text, end + 1))).otherwise(F.concat(notice, text))


def conflict_path(path: Column, day: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", F.concat(F.lit(" (conflict "), day, F.lit(").md")))


def analysis_note(result: Column, worker: Column, filenames: Column, context: Column, model: str, analyzed: Column) -> Column:
    """A note about a group of attachments: what was found as front matter, then the cleaned body. ``result`` is a struct
    as ``annotate.structured`` gives it."""

    def field(name: str, v: Column) -> Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), T.yaml_value(v)))

    def items(name: str, v: Column) -> Column:
        return F.when(F.size(v) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("  - "), T.yaml_value(x))), "\n")))

    authors = F.when(F.size(result["authors"]) == 1, F.concat(F.lit("authors: ["), T.yaml_value(result["authors"][0]), F.lit("]"))).otherwise(items("authors", result["authors"]))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries(result["extra"])), lambda e: F.concat(e["key"], F.lit(": "), T.yaml_value(e["value"]))), "\n")
    front = F.concat_ws(
        "\n", F.lit("---"), field("title", result["title"]), field("content_type", result["content_type"]), authors, field("date", result["date"]), items("key_points", result["key_points"]),
        F.when(extra != "", extra), F.concat(F.lit("source_type: "), worker), F.concat(F.lit("source_files:\n"), _items(filenames)), F.lit(f"vision_model: {model}"), F.concat(F.lit("analyzed: "), analyzed),
        field("context", F.trim(F.split(F.coalesce(context, F.lit("")), "\n")[0])), F.lit("cssclasses:\n  - ai-generated\ngraph_exclude: true\n---"),
    )
    body = T.safe_note(F.coalesce(result["body"], F.lit("")))
    return F.when(body != "", F.concat(front, F.lit("\n\n"), body)).otherwise(F.concat(front, F.lit("\n")))


def without_broken_callouts(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\n> \[!(?:note|ai)\][^\n]*\n> !\[\[_ai_notes/[^\]]*[#\[\]][^\]]*\]\](?:\n|$)", "")


def empty_placeholders(files: DataFrame) -> DataFrame:
    """(path) of placeholder pages (path, text) with fewer than 20 characters beside embeds."""
    body = F.trim(F.regexp_replace(T.body_of(F.col("text")), r"!\[\[[^\]]+\]\]", ""))
    return files.where(F.element_at(F.split("path", "/"), -1).isin(*PLACEHOLDER_FILES) & (F.length(body) < 20)).select("path")


def missing_from(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of the old place that the new one lacks; a move may clear the old place only if there are none."""
    return old.select("path").join(new.select("path"), "path", "left_anti")


def repaired(docs: DataFrame, common_words: list[str], false_diseases: list[str]) -> DataFrame:
    """(doc_id, text, changed): the repairs of old exports in their fixed order, on (doc_id, text)."""
    c = T.fix_false_disease_link(T.html_entities(F.col("text")), common_words)
    first = lines.drop_list_entries(docs.where("text is not null").select("doc_id", c.alias("text")), "doc_id", "text", "diseases", false_diseases)
    second = first.select("doc_id", T.fix_gene_alias(T.fix_citation(F.col("text"))).alias("text"))
    third = unescaped(lines.fence_islands(second, "doc_id", "text"))
    last = lines.label_fences(third, "doc_id", "text")
    return last.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").select("doc_id", "text", (F.col("text") != F.col("was")).alias("changed"))


def unescaped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): escapes taken back outside front matter, fences, code spans and links."""
    rows = lines.with_fences(lines.split_lines(docs, "doc_id", "text"))
    w = lines._by_doc()
    opens = F.first("line").over(w) == "---"
    dashes = F.sum((F.col("line") == "---").cast("int")).over(w)
    in_front = opens & ((dashes < 2) | ((dashes == 2) & (F.col("line") == "---")))
    # Protected spans and the rest of a line alternate; only the rest is changed.
    span = r"`[^`]*`|\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)"
    rest = F.split("line", span)
    kept = F.regexp_extract_all("line", F.lit(f"({span})"), F.lit(1))
    free = F.transform(rest, lambda s: F.regexp_replace(s, r"\\([_*\[\]#~`>])", "$1"))
    line = F.array_join(F.transform(F.arrays_zip(free.alias("f"), kept.alias("k")), lambda z: F.concat(F.coalesce(z["f"], F.lit("")), F.coalesce(z["k"], F.lit("")))), "")
    fixed = F.when(F.col("is_fence") | F.col("inside") | in_front, F.col("line")).otherwise(line)
    return lines.join_lines(rows.withColumn("fixed", fixed).select("doc_id", "n", F.col("fixed").alias("line")))
