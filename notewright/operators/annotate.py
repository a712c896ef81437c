"""Annotation by an outside model: what is asked, how answers are read, and what is kept.

The model is a plug-in: a function from a list of prompts to a list of answers, called in each task for batches. The
stub below needs no network and gives the same answer to the same text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from notewright.functions import patterns as P
from notewright.functions import text as T

MIN_WORDS, PROMPT = 50, 3000


def json_value(text: str | None) -> str | None:
    """The first balanced JSON object or array of a text; the rest from its begin if it never closes; the text itself if
    none begins."""
    if text is None:
        return None
    begin = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if begin < 0:
        return text
    depth, quoted, escaped = 0, False, False
    for k in range(begin, len(text)):
        ch = text[k]
        if quoted:
            quoted, escaped = not (ch == '"' and not escaped), ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return text[begin : k + 1]
    return text[begin:]


@F.pandas_udf(Y.StringType())
def json_value_udf(s: pd.Series) -> pd.Series:
    return s.map(json_value)


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```\w*\n?", ""), r"\n?```\s*$", ""))


def tags_and_entities(answer: Column) -> Column:
    """struct(tags, entities) of an answer in JSON; null where it cannot be read. Tags are slugged, once each."""
    parsed = F.from_json(json_value_udf(without_fences(answer)), "tags array<string>, entities map<string,array<string>>")
    tags = F.array_distinct(F.filter(F.transform(F.coalesce(parsed["tags"], F.array().cast("array<string>")), T.tag_slug), lambda t: t != ""))
    return F.when(parsed["tags"].isNotNull() | parsed["entities"].isNotNull(), F.struct(tags.alias("tags"), parsed["entities"].alias("entities")))


# The labels of an answer's sections; the last two hold the lines below them.
LABELS = ("TITLE", "CONTENT_TYPE", "AUTHORS", "DATE", "METHODS")
BLOCKS = ("KEY_POINTS", "BODY")


def structured(answer: Column, default: str = "") -> Column:
    """struct(title, content_type, authors, date, key_points, body, extra) of an answer in labelled sections; the last of
    repeated labels holds, repeated blocks follow each other. A null answer is an empty one."""
    label = "^(" + "|".join([f"{x}(?=:)" for x in LABELS] + [f"{x}(?=:$)" for x in BLOCKS]) + ")"

    def marked(lines: Column) -> Column:
        marks = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(P.strip(x), label, 1).alias("label"), i.alias("at"), P.strip(x).alias("line")))
        return _let(F.filter(marks, lambda m: m["label"] != ""), lambda heads: sections(lines, heads))

    def sections(lines: Column, heads: Column) -> Column:
        """The sections in order, each with what stands below it up to the next."""
        end = lambda i: F.coalesce(F.get(heads, i + 1)["at"], F.size(lines))
        found = F.transform(heads, lambda h, i: F.struct(h["label"].alias("label"), h["line"].alias("line"), F.slice(lines, h["at"] + 2, F.greatest(end(i) - h["at"] - 1, F.lit(0))).alias("below")))
        return _let(found, _answer)

    def _answer(heads: Column) -> Column:
        def values(name: str) -> Column:
            return F.transform(F.filter(heads, lambda h: h["label"] == name), lambda h: P.strip(F.substr(h["line"], F.lit(len(name) + 2))))

        def last(found: Column, otherwise: str = "") -> Column:
            return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(otherwise))

        def told(name: str) -> Column:
            return F.filter(values(name), lambda v: F.lower(v) != "unknown")

        def below(name: str) -> Column:
            return F.flatten(F.transform(F.filter(heads, lambda h: h["label"] == name), lambda h: h["below"]))

        kind = last(F.filter(F.slice(F.reverse(values("CONTENT_TYPE")), 1, 1), lambda v: v != ""), default)
        methods = last(F.filter(values("METHODS"), lambda v: v != ""))
        points = F.filter(F.transform(below("KEY_POINTS"), P.strip), lambda x: F.startswith(x, F.lit("- ")))
        return F.struct(
            last(values("TITLE")).alias("title"),
            kind.alias("content_type"),
            F.filter(F.transform(F.split(last(told("AUTHORS")), ","), P.strip), lambda x: x != "").alias("authors"),
            last(told("DATE")).alias("date"),
            F.transform(points, lambda x: F.substr(x, F.lit(3))).alias("key_points"),
            P.strip(F.array_join(below("BODY"), "\n")).alias("body"),
            F.when(methods != "", F.create_map(F.lit("methods"), methods)).otherwise(F.create_map().cast("map<string,string>")).alias("extra"),
        )

    return _let(F.split(P.strip(F.coalesce(answer, F.lit(""))), "\n"), marked)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def stub(prompts: list[str]) -> list[str]:
    """Answers without a model: the longest words as tags."""
    out = []
    for p in prompts:
        ws = sorted(set(re.findall(r"[a-z]{6,}", p.lower())), key=lambda w: (-len(w), w))[:5]
        out.append("Here it is:\n```json\n" + json.dumps({"tags": ws, "entities": {}}) + "\n```")
    return out


def ask(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]] = stub) -> DataFrame:
    """``rows`` with ``answer``. Rows keep their partitions; the number of them bounds how many ask at once."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=model(pdf[prompt].tolist()))

    return rows.mapInPandas(run, fields + ", answer string")


def tagged(pages: DataFrame, cache: DataFrame, vocabulary: DataFrame | None = None, model: Callable[[list[str]], list[str]] = stub, longest: int | None = PROMPT) -> DataFrame:
    """(page_key, hash, tags) of pages (page_key, title, body) with ``MIN_WORDS`` words or more.

    What the cache (page_key, hash, tags) holds for the same text is taken from it; the gate and the cache come before
    the model. ``vocabulary`` (tag, canonical) renames tags. A prompt holds a body's first ``longest`` characters (None:
    all of it)."""
    gated = pages.where(P.word_count(F.col("body")) >= MIN_WORDS).withColumn("hash", T.hash16(F.col("body")))
    known = gated.join(cache.select("page_key", "hash", "tags"), ["page_key", "hash"]).select("page_key", "hash", "tags")
    open_ = gated.join(cache.select("page_key", "hash"), ["page_key", "hash"], "left_anti").select("page_key", "hash", F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("body", 1, longest) if longest else F.col("body")).alias("prompt"))
    fresh = ask(open_, "prompt", model).select("page_key", "hash", F.coalesce(tags_and_entities(F.col("answer"))["tags"], F.array().cast("array<string>")).alias("tags"))
    if vocabulary is not None:
        one = fresh.select("page_key", "hash", F.posexplode_outer("tags").alias("k", "tag")).join(vocabulary, "tag", "left")
        fresh = one.groupBy("page_key", "hash").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("k", F.coalesce("canonical", "tag").alias("t"))))), lambda x: x["t"])).alias("tags"))
    return known.unionByName(fresh)


def upsert(cache: DataFrame, rows: DataFrame, key: str = "page_key") -> DataFrame:
    return cache.join(rows.select(key), key, "left_anti").unionByName(rows)


# Tags that tell a domain; the first domain that is met holds.
DOMAIN_TAGS = {
    "adcs": ["adc-development", "antibody-drug-conjugates", "adc-design", "adc-optimization", "adc-payloads", "adc-targets", "adc-therapy"],
    "computational-biology": [
        "computational-oncology", "bioinformatics-pipeline", "scrna-seq", "single-cell-genomics", "bulk-rna-seq", "computational-biology",
        "genomics", "transcriptomics", "wes", "variant-calling",
    ],
    "ai-ml": ["machine-learning", "deep-learning", "artificial-intelligence", "neural-networks", "ai-tools", "ai-applications"],
    "drug-discovery": ["drug-discovery", "target-identification", "virtual-screening", "small-molecule", "hit-identification", "lead-optimization"],
    "immuno-oncology": ["immuno-oncology", "immunotherapy", "checkpoint-inhibitors", "tumor-microenvironment", "car-t", "immune-evasion", "oncology"],
}
# Methods that tell a domain where no tag does.
DOMAIN_METHODS = {
    "adcs": ["adc", "bispecific antibody", "monoclonal antibody"],
    "computational-biology": ["scrna-seq", "bulk rna-seq", "spatial transcriptomics", "deconvolution", "clustering", "differential expression"],
    "ai-ml": ["deep learning", "machine learning", "neural network"],
}


def note_type(notebook: Column, section: Column) -> Column:
    n, s = F.lower(F.coalesce(notebook, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    return F.when(F.contains(n, F.lit("meeting")) | F.contains(s, F.lit("meeting")), "meeting").when(n.isin("projects", "project_lead", "assignment"), "project-note").otherwise("knowledge")


def domain(notebook: Column, section: Column, tags: Column, methods: Column) -> Column:
    """Tags speak first, then methods, then the names of section and notebook; empty if none does."""
    n, s = F.lower(F.coalesce(notebook, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    empty = F.array().cast("array<string>")
    low_tags, low_methods = F.transform(F.coalesce(tags, empty), F.lower), F.transform(F.coalesce(methods, empty), F.lower)
    tests = [(F.arrays_overlap(low_tags, F.array(*map(F.lit, ws))), d) for d, ws in DOMAIN_TAGS.items()] + [(F.arrays_overlap(low_methods, F.array(*map(F.lit, ws))), d) for d, ws in DOMAIN_METHODS.items()]
    tests += [(F.contains(s, F.lit("adc")), "adcs"), (F.contains(n, F.lit("omics")) | F.contains(s, F.lit("pipeline")) | F.contains(s, F.lit("bioinformatics")), "computational-biology"), (F.contains(n, F.lit("conference")), "oncology")]
    out = F.when(F.coalesce(tests[0][0], F.lit(False)), tests[0][1])
    for test, d in tests[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), d)
    return out.otherwise("")
