"""Queries of the general training-data problems: packed fields and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import ancestry, packed
from notewright.runtime import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.explode_packed(read_table(spark, sf_dir, "hgnc_complete_set"), "row_id", ["alias_symbol", "prev_symbol"])


def _both(spark: SparkSession, sf_dir: str, with_paths: bool) -> ancestry.Ancestry:
    """Both hierarchies in one graph; the first part of a node's name keeps them apart."""
    links, nodes = ancestry.disease_links(read_table(spark, sf_dir, "mondo_edges"))
    more, names = ancestry.company_links(read_table(spark, sf_dir, "company_parents"))

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.concat(F.lit(prefix), F.col(c)).alias(c) for c in df.columns])

    links = named(links, "mondo|").unionByName(named(more, "company|"))
    nodes = named(nodes, "mondo|").unionByName(named(names, "company|"))
    return ancestry.build(spark, links, nodes, with_paths)


def _bare(c: str):
    return F.element_at(F.split(c, r"\|", 2), -1)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _both(spark, sf_dir, False)
    rows = a.finish(ancestry.roots_of(a))
    return rows.select(F.split("node", r"\|", 2)[0].alias("hierarchy"), _bare("node").alias("node_key"), _bare("root").alias("root_key"), F.col("d").alias("node_depth"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, with the exact path from the node to the root; null for circles and nodes without a root."""
    a = _both(spark, sf_dir, True)
    rows = a.finish(ancestry.roots_of(a))
    path = F.array_join(F.transform("path", lambda x: F.element_at(F.split(x, r"\|", 2), -1)), " > ")
    return rows.select(F.split("node", r"\|", 2)[0].alias("hierarchy"), _bare("node").alias("node_key"), _bare("root").alias("root_key"), F.col("d").alias("node_depth"), path.alias("node_path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _both(spark, sf_dir, False)
    rows = a.finish(ancestry.descendants_of(a))
    return rows.select(F.split("node", r"\|", 2)[0].alias("hierarchy"), _bare("node").alias("node_key"), _bare("descendant").alias("descendant_key"), F.col("d").alias("links_between"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_LINKS = """
raw AS (
  SELECT 'mondo' AS h,
         CASE WHEN regexp_extract(sub, '(?i)mondo[:_](\\d+)', 1) <> '' THEN 'MONDO:' || regexp_extract(sub, '(?i)mondo[:_](\\d+)', 1) END AS c,
         CASE WHEN regexp_extract(obj, '(?i)mondo[:_](\\d+)', 1) <> '' THEN 'MONDO:' || regexp_extract(obj, '(?i)mondo[:_](\\d+)', 1) END AS p
  FROM mondo_edges WHERE lower(trim(pred)) = 'is_a'
  UNION ALL
  SELECT 'company', nullif(lower(trim(regexp_replace(child, '[\\s\\p{Z}]+', ' ', 'g'))), ''), nullif(lower(trim(regexp_replace(parent, '[\\s\\p{Z}]+', ' ', 'g'))), '')
  FROM company_parents),
link AS (SELECT DISTINCT h, c, p FROM raw WHERE c IS NOT NULL AND p IS NOT NULL),
node AS (SELECT DISTINCT h, n FROM (SELECT h, c AS n FROM raw UNION ALL SELECT h, p FROM raw) WHERE n IS NOT NULL),
reach(h, n, a, d) AS (
  SELECT h, n, n, 0::BIGINT FROM node
  UNION
  SELECT r.h, r.n, l.p, r.d + 1 FROM reach r JOIN link l ON l.h = r.h AND l.c = r.a
  WHERE r.d < (SELECT count(*) FROM node)),
way AS (SELECT h, n, a, min(d) AS d FROM reach WHERE d > 0 OR n = a GROUP BY ALL),
cyc AS (SELECT DISTINCT h, n FROM reach WHERE d > 0 AND n = a),
root AS (SELECT h, n FROM node EXCEPT SELECT h, c FROM link)
"""

_GOOD = """
, dist AS MATERIALIZED (SELECT w.h, w.n, w.a, w.d FROM way w JOIN root r ON r.h = w.h AND r.n = w.a),
good AS MATERIALIZED (SELECT * FROM dist WHERE (h, n) NOT IN (SELECT (h, n) FROM cyc)),
lost AS (SELECT h, n FROM node EXCEPT SELECT h, n FROM good EXCEPT SELECT h, n FROM cyc)"""

SQL = {
    "p5_found": "WITH RECURSIVE " + _LINKS + _GOOD + """
SELECT h AS hierarchy, n AS node_key, a AS root_key, d AS node_depth FROM good
UNION ALL SELECT h, n, 'CYCLE', -1 FROM cyc
UNION ALL SELECT h, n, 'NONE', -1 FROM lost""",
    "p5_paths": "WITH RECURSIVE " + _LINKS + _GOOD + """
, step AS MATERIALIZED (SELECT g.h, g.n, g.a, min(l.p) AS p FROM dist g JOIN link l ON l.h = g.h AND l.c = g.n JOIN dist u ON u.h = g.h AND u.n = l.p AND u.a = g.a AND u.d = g.d - 1 GROUP BY ALL),
walk(h, n, a, d, cur, path) AS (
  SELECT h, n, a, d, n, n FROM good
  UNION ALL
  SELECT w.h, w.n, w.a, w.d, s.p, w.path || ' > ' || s.p FROM walk w JOIN step s ON s.h = w.h AND s.n = w.cur AND s.a = w.a)
SELECT h AS hierarchy, n AS node_key, a AS root_key, d AS node_depth, path AS node_path FROM walk WHERE cur = a
UNION ALL SELECT h, n, 'CYCLE', -1, NULL FROM cyc
UNION ALL SELECT h, n, 'NONE', -1, NULL FROM lost""",
    "p5_descendants": "WITH RECURSIVE " + _LINKS + """
SELECT h AS hierarchy, a AS node_key, n AS descendant_key, d AS links_between FROM way w
WHERE n <> a AND NOT EXISTS (SELECT 1 FROM cyc c WHERE c.h = w.h AND (c.n = w.n OR c.n = w.a))""",
}
