"""Analysis of attachment groups: workers by kind, results kept by content hash, notes and the callouts that show them.

A worker is a plug-in: a function from a list of tasks to a list of answers in labelled sections. The registry names one
for each kind; the stubs below need no model and give the same answer to the same files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import annotate, attachments, noting

Worker = Callable[[list[dict]], list[str]]
#: Fixed value: the folder of the notes, beside the page.
FOLDER = "_ai_notes"
#: Kinds that are asked image by image, their answers then put together.
PER_IMAGE = ("diagram", "screenshot", "histology_slide")
CACHE = "page_key string, cache_key string, content_hash string, note_file string, pipeline string"


def stub(kind: str, tasks: list[dict]) -> list[str]:
    """Answers without a model: what was given."""
    return [f"TITLE: {kind.replace('_', ' ')} {t['filenames'][0]}\nCONTENT_TYPE: {kind}\nKEY_POINTS:\n" + "\n".join(f"- {n}: {len(c)} bytes" for n, c in zip(t["filenames"], t["contents"])) + f"\nBODY:\n{t['context']}" for t in tasks]


#: The workers by kind.
REGISTRY: dict[str, Worker] = {k: partial(stub, k) for k in ("slide_photo", "poster", "document", "presentation", "diagram", "tabular_data", "screenshot", "histology_slide")}


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def keyed(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``groups`` (page_key, group_no, worker_type, filenames, context) without files that are missing and groups that are
    then empty, with ``cache_key``, ``content_hash`` and ``note_file``. The hash of several files is that of their sorted
    hashes."""
    each = groups.select("page_key", "group_no", "worker_type", "context", F.posexplode("filenames").alias("k", "filename"))
    each = each.join(files.select("page_key", "filename", F.sha2("content", 256).alias("hash")).dropDuplicates(["page_key", "filename"]), ["page_key", "filename"])
    whole = each.groupBy("page_key", "group_no", "worker_type", "context").agg(F.array_sort(F.collect_list(F.struct("k", "filename", "hash"))).alias("m"))
    names, hashes = F.transform("m", lambda x: x["filename"]), F.transform("m", lambda x: x["hash"])
    rows = whole.select("page_key", "group_no", "worker_type", "context", names.alias("filenames"), F.when(F.size("m") == 1, hashes[0]).otherwise(F.sha2(F.array_join(F.array_sort(hashes), ""), 256)).alias("content_hash"))
    many = F.concat_ws("_", "worker_type", F.transform(F.slice("filenames", 1, 3), lambda f: F.substring(stem(f), 1, 6)))
    rows = rows.withColumn("cache_key", F.when(F.size("filenames") == 1, stem(F.col("filenames")[0])).otherwise(many))
    return rows.withColumn("note_file", attachments.note_file(F.col("filenames"), F.col("worker_type"), F.col("context")))


def analyzed(groups: DataFrame, files: DataFrame, cache: DataFrame, day: Column, *, existing: DataFrame | None = None, workers: Mapping[str, Worker] = REGISTRY, model: str = "stub", force: bool = False) -> DataFrame:
    """(page_key, group_no, worker_type, filenames, context, cache_key, content_hash, note_file, cached, note, error) of
    each group. What ``cache`` (``CACHE``) knows of the same content is not asked again while its note is there
    (``existing`` (page_key, note_file); None: taken as there) and bears a good name; its ``note`` is null. A group of a
    kind without a worker gives no row; where a worker fails or answers nothing, ``error`` says why and there is no note."""
    rows = keyed(groups.where(F.col("worker_type").isin(*workers)), files)
    known = cache.where(~F.col("note_file").rlike(r"[#\[\]]")).select("page_key", "cache_key", "content_hash", F.col("note_file").alias("kept"))
    if existing is not None:
        known = known.join(existing.select("page_key", F.col("note_file").alias("kept")).distinct(), ["page_key", "kept"], "left_semi")
    rows = rows.join(known.where(F.lit(not force)).dropDuplicates(["page_key", "cache_key", "content_hash"]), ["page_key", "cache_key", "content_hash"], "left")
    keys = ["page_key", "group_no", "worker_type"]
    open_ = rows.where("kept is null")
    asked = open_.select(*keys, "context", "filenames", F.explode(F.when(F.col("worker_type").isin(*PER_IMAGE), F.sequence(F.lit(0), F.size("filenames") - 1)).otherwise(F.array(F.lit(-1)))).alias("part"))
    asked = asked.withColumn("of", F.when(F.col("part") < 0, F.col("filenames")).otherwise(F.slice("filenames", F.greatest(F.col("part"), F.lit(0)) + 1, 1))).select(*keys, "context", "part", F.posexplode("of").alias("k", "filename"))
    given = files.select("page_key", "filename", "content").dropDuplicates(["page_key", "filename"])
    tasks = asked.join(given, ["page_key", "filename"]).groupBy(*keys, "context", "part").agg(F.array_sort(F.collect_list(F.struct("k", "filename", "content"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, of in pdf.groupby("worker_type"):
                given = [{"filenames": [x["filename"] for x in m], "contents": [x["content"] for x in m], "context": c or ""} for m, c in zip(of["m"], of["context"])]
                try:
                    answers, error = workers[kind](given), None
                except Exception as e:  # noqa: BLE001 - one worker's failure must not end the run
                    answers, error = [None] * len(given), f"{type(e).__name__}: {e}"[:200]
                yield of.drop(columns=["m", "context"]).assign(answer=answers, error=error)

    answers = tasks.mapInPandas(run, f"page_key {groups.schema['page_key'].dataType.simpleString()}, group_no int, worker_type string, part int, answer string, error string")
    result = merged(answers.where("trim(answer) <> ''").withColumn("r", annotate.structured(F.col("answer"))), keys)
    failed = answers.groupBy(*keys).agg(F.max("error").alias("error"))
    rows = rows.join(result, keys, "left").join(failed, keys, "left")
    note = noting.analysis_note(F.col("r"), F.col("worker_type"), F.col("filenames"), F.col("context"), model, day)
    fresh = F.col("kept").isNull()
    return rows.select(*keys, "filenames", "context", "cache_key", "content_hash", F.coalesce("kept", "note_file").alias("note_file"), (~fresh).alias("cached"), F.when(fresh & F.col("r").isNotNull(), note).alias("note"), F.when(fresh & F.col("r").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))


def merged(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r): the results of one group as one: title and type of the first, all key points, bodies with rules between
    them, and how many there were. A single result stays as it is."""
    all_ = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "r")), lambda x, y: x["part"] - y["part"]).alias("a")).withColumn("a", F.transform("a", lambda x: x["r"]))
    first = F.col("a")[0]
    bodies = F.filter(F.transform("a", lambda r: r["body"]), lambda b: b != "")
    one = F.struct(
        first["title"].alias("title"), first["content_type"].alias("content_type"), F.array().cast("array<string>").alias("authors"), F.lit("").alias("date"),
        F.flatten(F.transform("a", lambda r: r["key_points"])).alias("key_points"), F.array_join(bodies, "\n\n---\n\n").alias("body"),
        F.create_map(F.concat(F.regexp_replace(keys[-1], "_slide$", ""), F.lit("_count")), F.size("a").cast("string")).alias("extra"),
    )
    return all_.select(*keys, F.when(F.size("a") == 1, first).otherwise(one).alias("r"))


def cache_after(cache: DataFrame, done: DataFrame) -> DataFrame:
    """The cache with the groups that were analysed now."""
    fresh = done.where("note is not null").select("page_key", "cache_key", "content_hash", "note_file", F.col("worker_type").alias("pipeline")).dropDuplicates(["page_key", "cache_key"])
    return cache.join(fresh.select("page_key", "cache_key"), ["page_key", "cache_key"], "left_anti").unionByName(fresh)


def label(worker: Column, context: Column, files: Column) -> Column:
    """What a callout says beside its note."""
    first = F.substring(F.trim(F.split(F.coalesce(context, F.lit("")), "\n")[0]), 1, 40)
    return F.concat_ws(" — ", F.initcap(F.replace(worker, F.lit("_"), F.lit(" "))), F.when(F.coalesce(context, F.lit("")) != "", first), F.when(files > 1, F.concat(F.lit("("), files.cast("string"), F.lit(" files)"))))


def with_callouts(pages: DataFrame, done: DataFrame, folder: str = "attachments") -> DataFrame:
    """(page_key, text): pages (page_key, text) with a callout for each note after the last embed of its group's last file
    that is embedded. Notes that are shown or linked already, and groups without an embed, change nothing; callouts with
    broken names are taken off first. A page's notes are applied in order, as each moves what follows."""
    notes = done.where("note is not null or cached").select("page_key", F.struct("group_no", "filenames", "note_file", label(F.col("worker_type"), F.col("context"), F.size("filenames")).alias("label")).alias("n"))
    rows = pages.select("page_key", noting.without_broken_callouts(F.col("text")).alias("text")).join(notes.groupBy("page_key").agg(F.array_sort(F.collect_list("n")).alias("notes")), "page_key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, notes in zip(pdf["text"], pdf["notes"]):
                for n in notes if notes is not None and text is not None else ():
                    text = insert_callout(text, list(n["filenames"]), n["note_file"], n["label"], folder)
                out.append(text)
            yield pd.DataFrame({"page_key": pdf["page_key"], "text": out})

    return rows.mapInPandas(run, f"page_key {pages.schema['page_key'].dataType.simpleString()}, text string")


def insert_callout(text: str, filenames: list[str], note_file: str, label: str, folder: str = "attachments") -> str:
    shown = f"![[{FOLDER}/{note_file}]]"
    if shown in text or f"[[{FOLDER}/{note_file.removesuffix('.md')}]]" in text:
        return text
    at = next((p for f in reversed(filenames) if (p := _embed_end(text, f, folder)) >= 0), -1)
    return text if at < 0 else f"{text[:at]}\n\n> [!ai]- AI Analysis — {label}\n> {shown}{text[at:]}"


def _embed_end(text: str, filename: str, folder: str) -> int:
    """Where the last embed of a file ends, or else the last of a file whose name holds its stem; -1 if none is there."""
    whole = f"[[{folder}/{filename}]]"
    if (at := text.rfind(whole)) >= 0:
        return at + len(whole)
    found = list(re.finditer(rf"!?\[\[{re.escape(folder)}/[^\]]*{re.escape(filename.rsplit('.', 1)[0])}[^\]]*\]\]", text))
    return found[-1].end() if found else -1
