"""What is done with mentions: merging, lists by type, link texts, the entity index and its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.functions import text as T

#: Types that have no index pages.
NOT_INDEXED = ("methods", "roles", "departments", "conferences")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second-tier mentions joined to the first's. Of one type and lower canonical the first stays, unless only a later
    one has an ontology id; of one ontology id the first stays."""
    both = first.withColumn("tier", F.lit(0)).unionByName(second.withColumn("tier", F.lit(1)))
    name = W.partitionBy("doc_id", "entity_type", F.lower("canonical")).orderBy(F.coalesce("ontology_id", F.lit("")) == "", "tier", "ord")
    by_name = both.withColumn("n", F.row_number().over(name)).where("n = 1")
    ident = W.partitionBy("doc_id", "entity_type", F.when(F.coalesce("ontology_id", F.lit("")) != "", F.col("ontology_id")).otherwise(F.concat(F.lit("\x01"), F.lower("canonical")))).orderBy("tier", "ord")
    return by_name.withColumn("n", F.row_number().over(ident)).where("n = 1").drop("n", "tier")


def lists(mentions: DataFrame, variants: DataFrame | None = None, disease_names: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_type, names): distinct lower canonicals, sorted. Of several spellings the last one with an upper
    initial stands, else the first.

    Of one ontology id of a type the first mention stands; a disease without one takes it from ``disease_names`` (key,
    mondo_id) if that knows its name. With ``variants`` (entity_type, variant, canonical, ord) methods and companies
    come out as the dictionary spells them, with or without blanks and hyphens."""
    rows = mentions.withColumn("__id", F.coalesce("ontology_id", F.lit("")))
    if disease_names is not None:
        known = disease_names.groupBy(F.col("key").alias("__key")).agg(F.min("mondo_id").alias("__known"))
        rows = rows.withColumn("__key", F.when((F.col("entity_type") == "diseases") & (F.col("__id") == ""), F.lower("canonical")))
        rows = rows.join(known, "__key", "left").withColumn("__id", F.when(F.col("__id") == "", F.coalesce("__known", F.lit(""))).otherwise(F.col("__id"))).drop("__key", "__known")
    # Partial minima: a page with a third of all mentions is no burden.
    seen = rows.where("__id <> ''").groupBy("doc_id", "entity_type", "__id").agg(F.min("ord").alias("__first"))
    rows = rows.join(seen, ["doc_id", "entity_type", "__id"], "left").where("__first is null or ord = __first")
    if variants is not None:
        rows = _named(rows, variants).withColumn("canonical", F.coalesce("__named", "canonical"))
    upper = F.substring("canonical", 1, 1) != F.lower(F.substring("canonical", 1, 1))
    one = rows.groupBy("doc_id", "entity_type", F.lower("canonical").alias("l")).agg(F.max(F.when(upper, F.struct("ord", "canonical"))).alias("u"), F.min(F.struct("ord", "canonical")).alias("f"))
    return one.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.coalesce("u.canonical", "f.canonical"))).alias("names"))


def _bare(c: str):
    return F.regexp_replace(F.lower(c), "[ -]", "")


def _named(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """``__named``: what the dictionary calls a method or company. Both dictionaries are one list, methods first; of one
    variant the last entry's canonical holds, of several variants that are alike without blanks and hyphens the first."""
    listed = variants.where(F.col("entity_type").isin("methods", "companies"))
    place = F.struct((F.col("entity_type") == "companies").alias("c"), "ord", "canonical")
    whole = listed.groupBy(F.col("variant").alias("__v")).agg(F.max_by("canonical", place).alias("__whole"), F.min(place).alias("__place"))
    alike = whole.groupBy(_bare("__v").alias("__b")).agg(F.min_by("__whole", "__place").alias("__alike"))
    named = F.col("entity_type").isin("methods", "companies")
    rows = rows.withColumn("__v", F.when(named, F.lower("canonical"))).withColumn("__b", F.when(named, _bare("canonical")))
    rows = rows.join(whole.drop("__place"), "__v", "left").join(alike, "__b", "left")
    return rows.withColumn("__named", F.coalesce("__whole", "__alike")).drop("__v", "__b", "__whole", "__alike")


def entity_map(mentions: DataFrame, variants: DataFrame | None = None, disease_names: DataFrame | None = None) -> DataFrame:
    """(doc_id, entities): a map from type to its list."""
    return lists(mentions, variants, disease_names).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "names")))).alias("entities"))


def link_texts(mentions: DataFrame, shortest: int = 3) -> DataFrame:
    """(doc_id, text, canonical): what may become a link: the texts of the mentions and their canonicals themselves.
    Roles never do, nor texts of two characters; types come in their order, and the last mention that names a text
    holds, its canonical after its text."""
    from notewright.operators.extract import TYPES

    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("entity_type")), F.lit(0))
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("canonical").alias("t")))).alias("x")
    rows = mentions.where((F.col("entity_type") != "roles") & F.col("canonical").isNotNull()).select("doc_id", "ord", rank.alias("rank"), "canonical", both)
    rows = rows.where(F.length("x.t") >= shortest)
    return rows.groupBy("doc_id", F.col("x.t").alias("text")).agg(F.max_by("canonical", F.struct("rank", "ord", "x.k")).alias("canonical"))


def index(mentions: DataFrame, page: str = "page_key", live: DataFrame | None = None) -> DataFrame:
    """(entity_type, canonical, mention_count): pages a name is on. Partial sums first: distinct (name, page) pairs are
    formed before any name is gathered, so a name on most pages is no burden. ``live`` (page) leaves out pages gone."""
    rows = mentions.where(~F.col("entity_type").isin(*NOT_INDEXED) & F.col("canonical").isNotNull() & F.col(page).isNotNull())
    if live is not None:
        rows = rows.join(live.select(page).distinct(), page, "left_semi")
    return rows.select("entity_type", "canonical", page).distinct().groupBy("entity_type", "canonical").agg(F.count("*").alias("mention_count"))


def subsidiaries(parents: DataFrame) -> DataFrame:
    """(parent, children): sorted names."""
    return parents.where("parent is not null and child is not null").select("parent", "child").distinct().groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))


def pages(index_rows: DataFrame, genes: DataFrame, diseases: DataFrame, compounds: DataFrame, parents: DataFrame, most_aliases: int | None = 10, most_parents: int | None = 5) -> DataFrame:
    """(file_name, content): one Markdown page for each entity of the index, with what the ontologies know about it. A
    page lists the first ``most_aliases`` aliases and ``most_parents`` parents (None: all).

    ``genes`` (symbol, name, hgnc_id, aliases), ``diseases`` (key, mondo_id, parents), ``compounds`` (canonical, target,
    class, variants), ``parents`` (child, parent)."""
    g = genes.select(F.lit("genes").alias("entity_type"), F.col("symbol").alias("canonical"), F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("hgnc_id", F.lit("")).alias("id"), F.slice(F.coalesce("aliases", F.array()), 1, most_aliases or 1 << 30).alias("aliases")).alias("g"))
    d = diseases.select(F.col("key").alias("k"), F.struct("mondo_id", F.slice(F.coalesce("parents", F.array()), 1, most_parents or 1 << 30).alias("parents")).alias("d"))
    c = compounds.select(F.lit("compounds").alias("entity_type"), "canonical", F.struct("target", "class", F.get(F.filter("variants", lambda v: v.rlike(r"^[mM]\d+$")), F.lit(0)).alias("code")).alias("c"))
    p = parents.groupBy(F.col("child").alias("canonical")).agg(F.max("parent").alias("parent"))
    kids = subsidiaries(parents).withColumnRenamed("parent", "canonical")
    company = F.col("entity_type") == "companies"
    rows = index_rows.join(g, ["entity_type", "canonical"], "left").join(c, ["entity_type", "canonical"], "left")
    rows = rows.join(d, (F.lower("canonical") == F.col("k")) & (F.col("entity_type") == "diseases"), "left").drop("k")
    rows = rows.join(p, "canonical", "left").join(kids, "canonical", "left").withColumn("parent", F.when(company, F.col("parent"))).withColumn("children", F.when(company, F.col("children")))

    def field(name: str, v) -> F.Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{name}: "'), v, F.lit('"')))

    def items(name: str, v) -> F.Column:
        return F.when(F.size(v) > 0, F.concat(F.lit(name + ":\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit('  - "'), x, F.lit('"'))), "\n")))

    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), F.col("canonical"), F.lit('"')),
        F.concat(F.lit("entity_type: "), F.col("entity_type")),
        F.when(F.col("g").isNotNull(), F.concat(F.lit('full_name: "'), F.col("g.name"), F.lit('"\nhgnc_id: "'), F.col("g.id"), F.lit('"'))),
        items("aliases", F.col("g.aliases")),
        field("mondo_id", F.col("d.mondo_id")),
        items("parent_diseases", F.col("d.parents")),
        field("target", F.col("c.target")),
        field("class", F.col("c.class")),
        field("m_code", F.upper("c.code")),
        field("parent_company", F.col("parent")),
        items("subsidiaries", F.col("children")),
        F.concat(F.lit("mention_count: "), F.col("mention_count").cast("string")),
        F.lit("auto_generated: true\n---\n"),
    )
    subtitle = F.concat_ws(
        "\n",
        F.when(F.col("g").isNotNull(), F.concat(F.lit("*"), F.col("g.name"), F.lit("*\n"))),
        F.when(F.coalesce("c.target", "c.class").isNotNull(), F.concat(F.lit("*"), F.concat_ws(" — ", F.concat(F.lit("Target: "), F.col("c.target")), F.concat(F.lit("("), F.col("c.class"), F.lit(")"))), F.lit("*\n"))),
        F.when(F.col("parent").isNotNull(), F.concat(F.lit("*Subsidiary of [["), F.col("parent"), F.lit("]]*\n"))),
        F.when(F.size("children") > 0, F.concat(F.lit("**Subsidiaries:** "), F.array_join(F.transform("children", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", "), F.lit("\n"))),
    )
    query = F.concat(F.lit('## References\n\n```dataview\nLIST\nFROM ""\nWHERE contains(entities.'), F.col("entity_type"), F.lit(', "'), F.col("canonical"), F.lit('")\nSORT file.mtime DESC\n```'))
    body = F.concat_ws("\n", front, F.concat(F.lit("# "), F.col("canonical"), F.lit("\n")), F.when(subtitle != "", subtitle), query)
    return rows.select("entity_type", F.concat(T.index_name(F.col("canonical")), F.lit(".md")).alias("file_name"), body.alias("content"))


def duplicate_alias_files(files: DataFrame) -> DataFrame:
    """(folder, file): ``ALIAS (NAME).md`` where ``NAME.md`` is in the same folder."""
    named = files.withColumn("target", F.concat(F.regexp_extract("file", r"^.+ \(([^()]+)\)\.md$", 1), F.lit(".md"))).where("target <> '.md'")
    return named.join(files.select("folder", F.col("file").alias("target")), ["folder", "target"], "left_semi").select("folder", "file")
