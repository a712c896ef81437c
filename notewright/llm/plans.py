"""Queries of the language-model data problems and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import canonical, frequency, leakage, markup, mixing, residue
from notewright.runtime import read_table


def _filled(c: str):
    return F.regexp_replace(F.col(c), r"(?U)[\s\p{Z}]+", "") != ""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = frequency.plural_type(F.col("entity_type"))
    mentions = read_table(spark, sf_dir, "entity_mentions").select("mention_id", kind.alias("kind"), "text", "canonical")
    open_ones = mentions.where(F.col("kind").isin("companies", "drugs") & ~F.coalesce(_filled("canonical"), F.lit(False)) & _filled("text"))
    entries = read_table(spark, sf_dir, "dict_variants").select(frequency.plural_type(F.col("entity_type")).alias("type"), F.col("variant_name").alias("name"), "canonical", "ord")
    return canonical.map_names(open_ones, entries, "mention_id", "kind", "text")


def _marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = read_table(spark, sf_dir, "entity_mentions")
    pages = mentions.where("page_key is not null").select("page_key").distinct().count()
    pair = F.concat_ws("\x01", frequency.plural_type(F.coalesce("entity_type", F.lit(""))), frequency.tidy(F.col("canonical")))
    rows = mentions.where(_filled("canonical")).select(pair.alias("term"), F.col("page_key").alias("record"))
    marked = frequency.mark_terms(frequency.term_counts(rows), pages)
    part = F.split("term", "\x01")
    return marked.select(part[0].alias("entity_type"), part[1].alias("canonical"), "mentions", F.col("records").alias("pages"), "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_terms(spark, sf_dir).where("mark is not null").select("entity_type", "canonical", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_terms(spark, sf_dir)


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_items").select("item_id", F.col("text").alias("item_text"))
    return leakage.leaked(read_table(spark, sf_dir, "documents"), items, "doc_id", "text", "item_id", "item_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaked(spark, sf_dir).select("doc_id", "item_id")


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaked(spark, sf_dir)


def _marked_up(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    pages = of(read_table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text").withColumnRenamed("page_row_id", "record_id")
    bodies = of(read_table(spark, sf_dir, "analysis_results"), "analysis_id", "body").withColumnRenamed("analysis_id", "record_id")
    return pages.select(F.lit("page_contexts").alias("source_table"), "*").unionByName(bodies.select(F.lit("analysis_results").alias("source_table"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_up(spark, sf_dir, markup.elements)


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_up(spark, sf_dir, markup.cleaned)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(read_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
}

_PAIRS = """
WITH named AS (
  SELECT CASE t WHEN 'gene' THEN 'genes' WHEN 'drug' THEN 'drugs' WHEN 'disease' THEN 'diseases' WHEN 'compound' THEN 'compounds'
                WHEN 'company' THEN 'companies' WHEN 'role' THEN 'roles' WHEN 'method' THEN 'methods' WHEN 'clinical_trial' THEN 'clinical_trials'
                WHEN 'cell_line' THEN 'cell_lines' WHEN 'conference' THEN 'conferences' WHEN 'pathway' THEN 'pathways'
                WHEN 'department' THEN 'departments' ELSE t END AS entity_type, canonical, page_key
  FROM (SELECT lower(trim(regexp_replace(coalesce(entity_type, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) AS t,
               lower(trim(regexp_replace(canonical, '[\\s\\p{Z}]+', ' ', 'g'))) AS canonical, page_key FROM entity_mentions)
  WHERE canonical <> ''),
counted AS (SELECT entity_type, canonical, count(*) AS mentions, count(DISTINCT page_key) AS pages FROM named GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN pages < 3 THEN 'rare' WHEN pages > (SELECT count(DISTINCT page_key) FROM entity_mentions) * 0.05 THEN 'common' END AS mark FROM counted)
"""

SQL = {
    "p4_found": _PAIRS + "SELECT entity_type, canonical, mark FROM marked WHERE mark IS NOT NULL",
    "p4_counts": _PAIRS + "SELECT entity_type, canonical, mentions, pages, mark FROM marked",
}
