"""Whole runs: an incremental sync from exported XML to notes, state, entity index and manifest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import analysis, annotate, attachments, extract, lines, links, mentions, noting, outline, sync
from notewright.runtime import Scratch
from notewright.sources import files as read_files
from notewright.sources import pages as source
from notewright.sources import state as store
from notewright.streaming.increments import STATE

TAGS = "page_key string, hash string, tags array<string>"
ENTITIES = "page_key string, hash string, entity_type string, ord int, text string, canonical string, ontology_id string"


@dataclass
class Options:
    """What a run may be told. ``only`` and ``but`` name notebooks; ``multi`` leaves the notebook out of paths;
    ``orphans`` is keep (marked in the state), drop (out of the state) or delete (their files too); ``dry`` plans without
    writing. ``tags`` asks the model ``tagger`` about pages of enough words, with ``vocabulary`` (tag, canonical) to
    rename tags; ``analyze`` gives attachment groups to ``workers``."""

    only: list[str] | None = None
    but: list[str] | None = None
    multi: bool = False
    orphans: str = "keep"
    force: bool = False
    dry: bool = False
    skip_images: bool = False
    day: str = "today"
    tags: bool = False
    tagger: Callable[[list[str]], list[str]] = annotate.stub
    vocabulary: DataFrame | None = None
    analyze: bool = False
    workers: Mapping[str, analysis.Worker] = field(default_factory=lambda: analysis.REGISTRY)
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)


def planned(spark: SparkSession, hierarchy: str, root: str, vault: str, o: Options) -> tuple[DataFrame, DataFrame]:
    """The pages with their outline and paths, and the actions they need."""
    raw = outline.in_notebooks(source.read_hierarchy(spark, hierarchy), "notebook", o.only, o.but)
    deep = outline.with_parents(outline.with_depth(raw, ["section_path"], "ord", "level"), ["section_path"], "ord", "page_id")
    deep = outline.with_ancestors(deep, ["section_path"], "ord", "name")
    parents = raw.select(F.col("page_id").alias("parent_id"), F.col("name").alias("parent"))
    named = deep.join(parents, "parent_id", "left").withColumn("display_name", T.display_name(F.col("name"), F.col("parent")))
    placed = named.withColumn("path", T.output_path(F.col("section_path"), F.col("ancestor_names"), F.col("display_name"), o.multi))
    pages = outline.unique_paths(placed, "path", "ord").drop("path").withColumnRenamed("unique_path", "path").withColumnRenamed("page_key", "key")
    state = store.load(spark, root, "pages", STATE)
    files = store.listing(spark, vault).select("path", "content_hash") if store.exists(spark, vault) else spark.createDataFrame([], "path string, content_hash string")
    return pages, sync.with_moves(sync.plan(pages, state, files, force=o.force))


def run_sync(spark: SparkSession, hierarchy: str, page_xml: DataFrame, root: str, vault: str, o: Options | None = None) -> DataFrame:
    """One incremental run; the plan's summary comes back, with pages that could not be read as ``unreadable``.

    ``page_xml`` has (key, xml). Only pages with work are converted; a moved page keeps its file's text, which goes to its
    new place with what it embeds. Entities, tags and analyses come from their caches while a content is the same. Files,
    state, index and manifest are written at the end of the run, each as a whole; old files go last, so that a run that
    breaks off loses none."""
    o = o or Options()
    # Long chains are cut where their parts are read more than once.
    keep = Scratch(spark)
    pages, actions = planned(spark, hierarchy, root, vault, o)
    pages, actions = keep.save(pages), keep.save(actions)
    summary = sync.summary(actions)
    if o.dry:
        return summary
    kids = outline.children(pages, "page_id", "ord", "display_name").withColumnRenamed("parent_id", "page_id")
    todo = pages.join(actions.where("type in ('new', 'update', 'reexport', 'conflict', 'ai-enrich')").select("key", "type", "old_path"), "key").join(kids, "page_id", "left")
    read = keep.save(source.convert_pages(todo.join(page_xml, "key"), "key", "xml", o.skip_images).withColumnRenamed("page_key", "key"))
    summary = summary.unionByName(sync.summary(read.where("error is not null").select("key", F.lit("unreadable").alias("type"))))
    done = read.where("error is null")
    notes = keep.save(source.render(done.join(todo.select("key", "type", "old_path", "path", "name", "display_name", "section_path", "parent", "children", "created", "modified"), "key").withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("name")))))
    bodies = notes.select(F.col("key").alias("page_key"), "title", F.col("markdown").alias("body"))
    found = keep.save(entities(spark, bodies.drop("title"), root, o))
    tags = keep.save(tagged(spark, bodies, root, o))
    by_type = mentions.entity_map(found.withColumnRenamed("page_key", "doc_id"), o.dictionaries.get("variants"), o.dictionaries.get("diseases")).withColumnRenamed("doc_id", "key")
    asked = tags.select(F.col("page_key").alias("key"), F.col("tags").alias("new_tags"))
    notes = notes.join(by_type, "key", "left").join(asked, "key", "left")
    section = F.concat_ws("/", F.slice(F.split("section_path", "/"), 2, 1 << 20))
    notebook = F.split("section_path", "/")[0]
    # Each step is a projection of its own: an expression put into the next would be written out many times.
    all_tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("new_tags", F.array().cast("array<string>")))
    notes = notes.withColumn("kind", annotate.note_type(notebook, section)).withColumn("domain", annotate.domain(notebook, section, all_tags, F.col("entities")["methods"])).withColumn("lang", T.language(F.col("markdown")))
    notes = notes.withColumn("text", noting.with_tags(F.col("text"), F.col("new_tags"))).withColumn("text", noting.with_entities(F.col("text"), F.col("entities"))).withColumn("text", noting.with_type(F.col("text"), F.col("kind"), F.col("domain")))
    notes = keep.save(notes.withColumn("text", noting.with_language(F.col("text"), F.col("lang"))))
    docs = notes.select(F.col("key").alias("doc_id"), F.col("display_name").alias("name"), "text")
    linked = links.link_mentions(docs, mentions.link_texts(found.withColumnRenamed("page_key", "doc_id")).select("doc_id", "text", F.col("canonical").alias("target")), entities=True)
    linked = keep.save(linked)
    linked = links.link_mentions(docs.drop("text").join(linked, "doc_id"), links.page_aliases(pages, "display_name"))
    final = notes.drop("text").join(linked.withColumnRenamed("doc_id", "key"), "key")
    conflict = F.col("type") == "conflict"
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if o.day == "today" else F.lit(o.day)
    final = final.withColumn("file", F.when(conflict, noting.conflict_path(F.col("path"), day)).otherwise(F.col("path"))).withColumn("text", F.when(conflict, noting.conflict_copy(F.col("text"), F.element_at(F.split("path", "/"), -1))).otherwise(F.col("text")))
    ready = keep.save(final.select("key", "type", "path", "old_path", "file", "modified", "title", "section_path", "markdown", "text", "attachments"))
    if o.analyze:
        ready = keep.save(_analyzed(spark, keep, ready, root, vault, day, o))
    moved = keep.save(_moved(spark, actions, pages, vault)) if store.exists(spark, vault) else None
    _write(store.write_files(ready, vault, "file", "text"))
    parts = ready.select(_folder("file").alias("folder"), F.explode("attachments").alias("a")).select(F.concat("folder", F.lit("attachments/"), F.col("a.filename")).alias("file"), F.col("a.content").alias("content")).dropDuplicates(["file"])
    _write(store.write_files(parts, vault, "file", "content"))
    written = ready.select("key", "modified", F.col("path").alias("active_file"), F.when(F.col("type") == "conflict", F.lit("")).otherwise(T.hash16(F.col("text"))).alias("content_hash"), F.lit(False).alias("pending"))
    if moved is not None:
        _write(store.write_files(moved, vault, "new_path", "content"))
        written = written.unionByName(moved.where("key is not null").select("key", "modified", F.col("new_path").alias("active_file"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.lit(False).alias("pending")))
    # A page that could not be read, and a move without a file, stay as they were and are tried again.
    kept = actions.where("type = 'orphan'").unionByName(actions.where("type <> 'orphan'").join(written.select("key"), "key", "left_semi"))
    after = keep.save(sync.next_state(store.load(spark, root, "pages", STATE), kept, written))
    store.save(after if o.orphans == "keep" else after.where("status <> 'orphaned'"), root, "pages")
    cache = keep.save(annotate_cache(spark, root, notes.select(F.col("key").alias("page_key")), found))
    store.save(cache, root, "entities")
    if o.tags:
        store.save(keep.save(annotate.upsert(store.load(spark, root, "tags", TAGS), tags)), root, "tags")
    live = after.where("status <> 'orphaned'").select(F.col("key").alias("page_key"))
    store.save(mentions.index(cache, "page_key", live), root, "index")
    store.save(outline.folders(after, "active_file"), root, "manifest")
    gone = moved.select("old_path") if moved is not None else spark.createDataFrame([], "old_path string")
    # The old file of a page whose path changed, and, if asked for, those of pages that are no more.
    gone = gone.unionByName(ready.where("type = 'reexport' and old_path <> '' and old_path <> file").select("old_path"))
    if o.orphans == "delete":
        gone = gone.unionByName(actions.where("type = 'orphan' and old_path <> ''").select("old_path"))
    standing = after.where("status <> 'orphaned'").select(F.col("active_file").alias("old_path"))
    store.remove_files(gone.where("old_path is not null").distinct().join(standing, "old_path", "left_anti"), vault, "old_path").agg(F.sum(F.col("removed").cast("int"))).collect()
    return keep.result(summary)


def _write(done: DataFrame) -> None:
    done.agg(F.sum(F.col("written").cast("int"))).collect()


def _folder(path: str):
    return F.regexp_replace(path, r"[^/]*$", "")


def _moved(spark: SparkSession, actions: DataFrame, pages: DataFrame, vault: str) -> DataFrame:
    """(key, modified, old_path, new_path, content): the files of moved pages, and under a null key the attachments they
    show; ``old_path`` is null for an attachment that another file of its folder shows too, so it stays there."""
    files = store.contents(spark, vault)
    moves = actions.where("type = 'move' and old_path is not null").join(pages.select("key", "modified"), "key").select("key", "modified", "old_path", "new_path")
    notes = moves.join(files.withColumnRenamed("path", "old_path"), "old_path")
    text = F.col("content").cast("string")
    shown = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[(attachments/[^\]|]+)"), F.lit(1)))).alias("part")
    parts = notes.select(_folder("old_path").alias("from"), _folder("new_path").alias("to"), shown)
    parts = parts.where(F.col("from") != F.col("to")).select(F.concat("from", "part").alias("old_path"), F.concat("to", "part").alias("new_path")).distinct()
    others = files.where("path like '%.md'").join(moves.select(F.col("old_path").alias("path")), "path", "left_anti").select(_folder("path").alias("from"), shown).select(F.concat("from", "part").alias("old_path"), F.lit(True).alias("shared")).distinct()
    parts = parts.join(files.withColumnRenamed("path", "old_path"), "old_path").join(others, "old_path", "left")
    parts = parts.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("modified"), F.when(F.col("shared").isNull(), F.col("old_path")).alias("old_path"), "new_path", "content")
    return notes.select("key", "modified", "old_path", "new_path", "content").unionByName(parts)


def _analyzed(spark: SparkSession, keep: Scratch, ready: DataFrame, root: str, vault: str, day, o: Options) -> DataFrame:
    """``ready`` with callouts for the notes of its attachments; the notes and their cache are written."""
    files = keep.save(ready.select(F.col("key").alias("page_key"), F.explode("attachments").alias("a")).select("page_key", "a.filename", "a.content"))
    groups = attachment_groups(ready.select(F.col("key").alias("page_key"), F.col("title").alias("page_title"), F.col("markdown").alias("page_text"), "section_path"), files)
    cache = store.load(spark, root, "analyses", analysis.CACHE)
    places = ready.select(F.col("key").alias("page_key"), _folder("file").alias("folder"))
    there = None
    if store.exists(spark, vault):
        listed = store.listing(spark, vault, with_hash=False).select("path")
        there = cache.join(places, "page_key").withColumn("path", F.concat("folder", F.lit(analysis.FOLDER + "/"), F.col("note_file"))).join(listed, "path", "left_semi").select("page_key", "note_file")
    done = keep.save(analysis.analyzed(groups, files, cache, day, existing=there, workers=o.workers, force=o.force))
    notes = done.where("note is not null").join(places, "page_key").select(F.concat("folder", F.lit(analysis.FOLDER + "/"), F.col("note_file")).alias("file"), "note").dropDuplicates(["file"])
    _write(store.write_files(notes, vault, "file", "note"))
    store.save(keep.save(analysis.cache_after(cache, done)), root, "analyses")
    texts = analysis.with_callouts(ready.select(F.col("key").alias("page_key"), "text"), done).withColumnRenamed("page_key", "key")
    return ready.drop("text").join(texts, "key")


def attachment_groups(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(page_key, group_no, worker_type, filenames, context): the attachments of pages (page_key, page_title, page_text,
    section_path) in groups: images as they stand on the page, any other file by itself."""
    routed = files.select("page_key", "filename", "content", attachments.route(F.col("filename")).alias("kind"))
    events = lines.embeds(pages, "page_key", "page_text")
    images = attachments.ordered_images(sized(routed.where("kind = 'image'")).withColumn("listed", F.lit(0)), events)
    groups = attachments.group_images(images.join(pages, "page_key"))
    most = groups.groupBy("page_key").agg(F.max("group_no").alias("most"))
    said = F.concat_ws(" ", "page_title", "page_text")
    # What a PDF's pages look like is not read here: it is taken as one landscape page without text.
    kind = F.when(F.col("kind") == "pdf", attachments.pdf_kind(said, F.col("filename"), F.lit(1), F.lit(True), F.length("content"), F.lit(0))).otherwise(F.col("kind"))
    single = routed.where("kind <> 'image'").join(pages, "page_key").join(most, "page_key", "left")
    place = F.row_number().over(W.partitionBy("page_key").orderBy("filename"))
    single = single.select("page_key", (F.coalesce("most", F.lit(-1)) + place).cast("int").alias("group_no"), kind.alias("worker_type"), F.array("filename").alias("filenames"), F.lit("").alias("context"))
    return groups.unionByName(single)


def sized(files: DataFrame) -> DataFrame:
    return read_files.image_sizes(files, "content").drop("content", "kind")


def tagged(spark: SparkSession, bodies: DataFrame, root: str, o: Options) -> DataFrame:
    """(page_key, hash, tags) of the pages that have words enough; none if tags are not asked for."""
    if not o.tags:
        return spark.createDataFrame([], TAGS)
    return annotate.tagged(bodies, store.load(spark, root, "tags", TAGS), o.vocabulary, o.tagger)


def entities(spark: SparkSession, bodies: DataFrame, root: str, o: Options) -> DataFrame:
    """Mentions of the pages (page_key, body): from the cache where the text is the same, else extracted."""
    d = o.dictionaries
    hashed = bodies.withColumn("hash", T.hash16(F.col("body")))
    cache = store.load(spark, root, "entities", ENTITIES)
    known = cache.join(hashed.select("page_key", "hash"), ["page_key", "hash"], "left_semi")
    open_ = hashed.join(cache.select("page_key", "hash").distinct(), ["page_key", "hash"], "left_anti")
    none = {
        "variants": "entity_type string, variant string, canonical string, ord int", "symbols": "symbol string, hgnc_id string", "aliases": "alias string, symbol string",
        "diseases": "key string, label string, mondo_id string", "codes": "code string, canonical string",
    }
    given = [d[k] if k in d else spark.createDataFrame([], s) for k, s in none.items()]
    never = [r[0] for r in d["never_genes"].collect()] if "never_genes" in d else extract.NEVER_GENES  # a curated list
    found = extract.all_mentions(open_.select(F.col("page_key").alias("doc_id"), F.col("body").alias("text")), *given, never=never).withColumnRenamed("doc_id", "page_key")
    fresh = found.join(open_.select("page_key", "hash"), "page_key").select("page_key", "hash", "entity_type", "ord", "text", "canonical", "ontology_id")
    return known.select(*fresh.columns).unionByName(fresh)


def annotate_cache(spark: SparkSession, root: str, done: DataFrame, rows: DataFrame) -> DataFrame:
    """The entity cache with the pages of ``done`` replaced; a page whose new text has no mention keeps none."""
    return store.load(spark, root, "entities", ENTITIES).join(done.distinct(), "page_key", "left_anti").unionByName(rows)
