"""Queries over the driver's tables, one for each operator of the note pipeline, and their SQL.

Where SQL cannot say what an operator does (recursive formats, sequential replacement, plug-ins), a query has none and
its operator is held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.functions import fragments
from notewright.functions import patterns as P
from notewright.functions import text as T
from notewright.operators import ancestry, annotate, attachments, extract, lines, links, mentions, ontology, outline, profiles, sync
from notewright.runtime import read_table as table
from notewright.sources import pages as source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _words(ws) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# ---- text expressions

_LANG = f"""
SELECT doc_id, lang, CASE WHEN n < 20 THEN 'en' WHEN de > 0.08 * n AND en > 0.05 * n THEN 'mixed' WHEN de > 0.06 * n THEN 'de' ELSE 'en' END AS detected
FROM (SELECT doc_id, lang, len(w) AS n, len(list_filter(w, lambda x: list_contains({_words(T.GERMAN)}, x))) AS de,
             len(list_filter(w, lambda x: list_contains({_words(T.ENGLISH)}, x))) AS en
      FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-züöäß]+') AS w FROM documents WHERE text IS NOT NULL))"""


@query(_LANG)
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", T.language(F.col("text")).alias("detected"))


@query(f"SELECT lang, detected, count(*) AS n FROM ({_LANG}) GROUP BY ALL")
def lang_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_detect(spark, sf_dir).groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(page_key), 1, 16) AS key FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.hash16(F.col("text")).alias("hash"), T.hash16(F.col("page_key")).alias("key"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')) >= 50")
def word_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.word_count(F.col("text")).alias("words")).where(f"words >= {annotate.MIN_WORDS}")


@query(r"""SELECT page_row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(page_text, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS txt
FROM page_contexts WHERE page_text IS NOT NULL""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.html_text(F.col("page_text")).alias("txt"))


@query("""SELECT page_row_id, replace(replace(replace(replace(page_text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS txt FROM page_contexts WHERE page_text IS NOT NULL""")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.html_entities(F.col("page_text")).alias("txt"))


_FILE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, ':', ' -'), '[<>"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), '  +', ' ', 'g'), '_+', '_', 'g'))"""
_RESERVED = ", ".join(f"'{n}'" for n in T.RESERVED_NAMES)


def _file_sql(c: str) -> str:
    s = _FILE.format(c=c)
    return f"CASE WHEN {s} = '' THEN 'Untitled' ELSE substr(CASE WHEN upper(string_split({s}, '.')[1]) IN ({_RESERVED}) THEN '_' || {s} ELSE {s} END, 1, 100) END"


@query(rf"""SELECT page_row_id, {_file_sql("page_title")} AS file_name,
CASE WHEN regexp_replace(regexp_replace(regexp_replace(page_title, '[<>:"/\\|?*#\[\]\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') = '' THEN 'unnamed'
     ELSE substr(regexp_replace(regexp_replace(regexp_replace(page_title, '[<>:"/\\|?*#\[\]\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g'), 1, 120) END AS note_name,
substr(regexp_replace(regexp_replace(page_title, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 100) AS index_name
FROM page_contexts WHERE page_title IS NOT NULL""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("page_title")
    return table(spark, sf_dir, "page_contexts").where("page_title is not null").select("page_row_id", T.file_name(c).alias("file_name"), T.note_name(c).alias("note_name"), T.index_name(c).alias("index_name"))


@query(r"SELECT mention_id, substr(regexp_replace(replace(trim(lower(text)), ' ', '-'), '[^a-z0-9_/\-]', '', 'g'), 1, 80) AS slug FROM entity_mentions WHERE text IS NOT NULL")
def tag_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_mentions").where("text is not null").select("mention_id", T.tag_slug(F.col("text")).alias("slug"))


_NAMED = """page AS (SELECT page_row_id, coalesce(page_title, '') AS name, parent_page AS parent, coalesce(section_path, '') AS section_path FROM page_contexts),
shown AS (SELECT *, coalesce(CASE WHEN starts_with(name, parent || ': ') AND length(name) > length(parent) + 2 THEN substr(name, length(parent) + 3) END,
  CASE WHEN starts_with(name, parent || '_ ') AND length(name) > length(parent) + 2 THEN substr(name, length(parent) + 3) END,
  CASE WHEN starts_with(name, parent || '- ') AND length(name) > length(parent) + 2 THEN substr(name, length(parent) + 3) END,
  CASE WHEN starts_with(name, parent || ' - ') AND length(name) > length(parent) + 3 THEN substr(name, length(parent) + 4) END, name) AS bare FROM page)"""


def _display(df: DataFrame) -> DataFrame:
    named = df.select("page_row_id", F.coalesce("page_title", F.lit("")).alias("name"), F.col("parent_page").alias("parent"), F.coalesce("section_path", F.lit("")).alias("section_path"))
    return named.withColumn("display_name", T.display_name(F.col("name"), F.col("parent")))


@query(f"WITH {_NAMED} SELECT page_row_id, {_file_sql('bare')} AS display_name FROM shown")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _display(table(spark, sf_dir, "page_contexts")).select("page_row_id", "display_name")


_PATHS = f"""WITH {_NAMED}, path AS (
SELECT page_row_id, array_to_string(list_transform(string_split(section_path, '/'), lambda p: {_file_sql("p")}), '/') || '/' || {_file_sql("bare")} || '.md' AS path FROM shown)"""


@query(f"{_PATHS} SELECT page_row_id, path FROM path")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _display(table(spark, sf_dir, "page_contexts"))
    return rows.select("page_row_id", T.output_path(F.col("section_path"), F.array().cast("array<string>"), F.col("display_name")).alias("path"))


@query(f"""{_PATHS}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_row_id) AS k FROM path)
SELECT page_row_id, CASE WHEN k = 1 THEN path ELSE regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || ' (' || k || ')' || regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 2) END AS unique_path FROM n""")
def path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.unique_paths(output_paths(spark, sf_dir), "path", "page_row_id").select("page_row_id", "unique_path")


@query("""SELECT list_sort(list(f))::VARCHAR AS folders FROM (SELECT DISTINCT string_split(section_path, '/')[1] AS f FROM page_contexts WHERE string_split(section_path, '/')[1] <> '')""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline.folders(table(spark, sf_dir, "page_contexts"), "section_path")
    return rows.select(F.concat(F.lit("["), F.array_join("folders", ", "), F.lit("]")).alias("folders"))


@query("""SELECT section, count(*) AS pages FROM (SELECT string_split(section_path, '/')[1] AS section FROM page_contexts)
WHERE section IN (SELECT min(string_split(section_path, '/')[1]) FROM page_contexts WHERE section_path <> '') GROUP BY 1""")
def notebook_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_contexts").withColumn("section", F.split("section_path", "/")[0])
    first = rows.where("section_path <> ''").agg(F.min("section")).first()[0]
    return outline.in_notebooks(rows, "section", only=[first]).groupBy("section").agg(F.count("*").alias("pages"))


@query(r"""SELECT page_row_id, CASE WHEN e > 0 THEN regexp_replace(substr(page_text, e + 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE page_text END AS body
FROM (SELECT *, CASE WHEN starts_with(page_text, '---') AND strpos(substr(page_text, 4), '---') > 0 THEN strpos(substr(page_text, 4), '---') + 5 ELSE 0 END AS e FROM page_contexts WHERE page_text IS NOT NULL)""")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.body_of(F.col("page_text")).alias("body"))


@query(r"""SELECT analysis_id, CASE WHEN title IS NULL OR title = '' THEN '""' WHEN regexp_matches(title, '[:{}\[\]&*?|>!%@`#,\n"'']') THEN '"' || replace(replace(title, '\', '\\'), '"', '\"') || '"' ELSE title END AS yaml FROM analysis_results""")
def yaml_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analysis_results").select("analysis_id", T.yaml_value(F.col("title")).alias("yaml"))


@query(rf"""SELECT page_row_id, CASE WHEN regexp_matches(page_text, {_lit(P.CODE_LANGUAGE["r"])}) THEN 'r' WHEN regexp_matches(page_text, {_lit(P.CODE_LANGUAGE["python"])}) THEN 'python'
WHEN regexp_matches(page_text, {_lit(P.CODE_LANGUAGE["bash"])}) THEN 'bash' ELSE '' END AS code_lang,
CASE WHEN regexp_matches(page_text, {_lit(P.FENCE_LANGUAGE["r"])}) THEN 'r' WHEN regexp_matches(page_text, {_lit(P.FENCE_LANGUAGE["python"])}) THEN 'python' WHEN regexp_matches(page_text, {_lit(P.FENCE_LANGUAGE["bash"])}) THEN 'bash'
WHEN regexp_matches(page_text, {_lit(P.FENCE_LANGUAGE["powershell"])}) THEN 'powershell' WHEN regexp_matches(page_text, {_lit(P.FENCE_LANGUAGE["sql"])}) THEN 'sql' ELSE '' END AS fence_lang
FROM page_contexts WHERE page_text IS NOT NULL""")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("page_text")
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.code_language(c).alias("code_lang"), T.code_language(c, P.FENCE_LANGUAGE).alias("fence_lang"))


@query(r"""SELECT page_row_id, regexp_replace(page_text, 'From <\[([^\]]+)\]\(([^)]+)\)>', 'Source: [\1](\2)', 'g') AS cited,
regexp_replace(regexp_replace(regexp_replace(page_text, '([\\`*_\[\]~#])', '\\\1', 'g'), '(?m)^(#{1,6}\s|>)', '\\\1', 'g'), '\x00', '', 'g') AS escaped,
regexp_replace(page_text, '\[\[[^\[\]|]+\|([^\[\]|]{1,6})\]\]', '\1', 'g') AS unlinked FROM page_contexts WHERE page_text IS NOT NULL""")
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("page_text")
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.fix_citation(c).alias("cited"), T.escape_markdown(c).alias("escaped"), T.fix_false_disease_link(c, []).alias("unlinked"))


@query(r"""SELECT page_row_id, regexp_replace(regexp_replace(regexp_replace(page_text, '(?i)\[([^\]]*)\]\(javascript:[^)]*\)', '\1', 'g'), '(?i)\[([^\]]*)\]\(data:[^)]*\)', '\1', 'g'),
'(?is)<script[^>]*>.*?</script>|<iframe[^>]*>.*?</iframe>|<object[^>]*>.*?</object>|<embed[^>]*>.*?</embed>|<form[^>]*>.*?</form>|<(?:script|iframe|object|embed|form)[^>]*/>', '', 'g') AS safe FROM page_contexts WHERE page_text IS NOT NULL""")
def safe_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", T.safe_note(F.col("page_text")).alias("safe"))


@query(r"SELECT node_id, regexp_matches(node_id, '^[A-Za-z0-9\-{}/ ._:]{1,500}$') AS is_page_id, NOT regexp_matches(node_id, '(?:^|[\\/])\.\.(?:[\\/]|$)|^\\\\|^[A-Za-z]:|^/|[\x00-\x1f]') AND node_id <> '' AS is_cache_path FROM mondo_nodes")
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mondo_nodes").select("node_id", T.is_page_id(F.col("node_id")).alias("is_page_id"), T.is_cache_path(F.col("node_id")).alias("is_cache_path"))


# ---- outline

_LEVELS = """lv AS (SELECT page_row_id, page_key, coalesce(section_path, '') AS section, coalesce(page_title, '') AS name, 1 + length(coalesce(page_title, '')) % 4 AS level, row_number() OVER (PARTITION BY coalesce(section_path, '') ORDER BY page_row_id) AS rn FROM page_contexts),
dp AS (SELECT *, least(rn, rn + min(level - rn) OVER (PARTITION BY section ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS depth FROM lv),
up AS (SELECT c.page_row_id, max(p.page_row_id) AS parent_id FROM dp c JOIN dp p ON p.section = c.section AND p.depth = c.depth - 1 AND p.rn < c.rn GROUP BY 1)"""


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by section with a level from the title's length, as the data has none."""
    name = F.coalesce("page_title", F.lit(""))
    rows = table(spark, sf_dir, "page_contexts").select("page_row_id", F.coalesce("section_path", F.lit("")).alias("section"), name.alias("name"), (F.length(name) % 4 + 1).alias("level"))
    return outline.with_depth(rows, ["section"], "page_row_id", "level")


@query(f"WITH {_LEVELS} SELECT page_row_id, depth FROM dp")
def outline_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlined(spark, sf_dir).select("page_row_id", "depth")


@query(f"WITH {_LEVELS} SELECT dp.page_row_id, parent_id FROM dp LEFT JOIN up USING (page_row_id)")
def outline_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.with_parents(_outlined(spark, sf_dir), ["section"], "page_row_id", "page_row_id").select("page_row_id", "parent_id")


@query(f"WITH {_LEVELS} SELECT parent_id, array_to_string(list(name ORDER BY dp.page_row_id), '|') AS children FROM dp JOIN up USING (page_row_id) GROUP BY 1")
def outline_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline.with_parents(_outlined(spark, sf_dir), ["section"], "page_row_id", "page_row_id")
    return outline.children(rows, "page_row_id", "page_row_id", "name").select("parent_id", F.array_join("children", "|").alias("children"))


@query(f"""WITH RECURSIVE {_LEVELS}, anc(page_row_id, cur, names) AS (
SELECT page_row_id, page_row_id, ''::VARCHAR FROM dp UNION ALL
SELECT a.page_row_id, u.parent_id, d.name || CASE WHEN a.names = '' AND a.cur = a.page_row_id THEN '' ELSE '|' || a.names END FROM anc a JOIN up u ON u.page_row_id = a.cur JOIN dp d ON d.page_row_id = u.parent_id)
SELECT a.page_row_id, names AS ancestors FROM anc a LEFT JOIN up u ON u.page_row_id = a.cur WHERE u.parent_id IS NULL""")
def outline_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline.with_ancestors(_outlined(spark, sf_dir), ["section"], "page_row_id", "name")
    return rows.select("page_row_id", F.array_join("ancestor_names", "|").alias("ancestors"))


@query("SELECT page_title, arg_min(page_key, page_row_id) AS page_key FROM page_contexts WHERE page_title IS NOT NULL AND page_key IS NOT NULL GROUP BY 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.first_wins(table(spark, sf_dir, "page_contexts").where("page_title is not null and page_key is not null"), "page_title", "page_key", "page_row_id")


# ---- sync: the pages now against what the analyses and documents knew of them

_SNAPSHOTS = f"""WITH {_NAMED},
one AS (SELECT page_key, arg_min(page_row_id, page_row_id) AS page_row_id, arg_min(coalesce(page_title, ''), page_row_id) AS name, max(modified) AS modified FROM page_contexts WHERE page_key IS NOT NULL GROUP BY 1),
pg AS (SELECT o.page_key AS key, o.name, o.modified, {_file_sql("o.name")} AS display_name, 'vault/' || {_file_sql("o.name")} || '.md' AS path FROM one o),
st AS (SELECT page_key AS key, max(analysis_date) AS modified, 'vault/' || {_file_sql("coalesce(min(title), '')")} || '.md' AS active_file, substr(sha256(coalesce(min(body), '')), 1, 16) AS content_hash,
              CASE WHEN count(*) > 2 THEN 'orphaned' ELSE 'synced' END AS status, max(content_type) = 'document' AS pending FROM analysis_results WHERE page_key IS NOT NULL GROUP BY 1),
fl AS (SELECT active_file AS path, min(CASE WHEN status = 'synced' THEN content_hash ELSE '' END) AS content_hash FROM st GROUP BY 1),
act AS (
SELECT coalesce(p.key, s.key) AS key, s.active_file AS old_path, p.path AS new_path, p.display_name,
  CASE WHEN p.key IS NULL AND coalesce(s.status, '') <> 'orphaned' THEN 'orphan' WHEN p.key IS NULL THEN NULL
       WHEN s.key IS NULL AND p.name IN ('Untitled', 'Untitled page', 'Neuer Abschnitt') THEN NULL WHEN s.key IS NULL THEN 'new'
       WHEN coalesce(s.active_file <> '', false) AND s.active_file <> p.path THEN 'reexport'
       WHEN p.modified IS NOT DISTINCT FROM s.modified AND coalesce(s.active_file <> '', false) AND f.path IS NULL THEN 'reexport'
       WHEN p.modified IS NOT DISTINCT FROM s.modified AND coalesce(s.pending, false) THEN 'ai-enrich'
       WHEN p.modified IS NOT DISTINCT FROM s.modified THEN NULL
       WHEN NOT coalesce(s.active_file <> '', false) THEN 'reexport' WHEN f.path IS NULL THEN 'reexport'
       WHEN f.content_hash = coalesce(s.content_hash, '') THEN 'update' ELSE 'conflict' END AS type
FROM pg p FULL JOIN st s ON p.key = s.key LEFT JOIN fl f ON s.active_file = f.path)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    one = table(spark, sf_dir, "page_contexts").where("page_key is not null").groupBy(F.col("page_key").alias("key")).agg(F.min_by(F.coalesce("page_title", F.lit("")), "page_row_id").alias("name"), F.max("modified").alias("modified"))
    pages = one.withColumn("display_name", T.file_name(F.col("name"))).withColumn("path", F.concat(F.lit("vault/"), F.col("display_name"), F.lit(".md")))
    state = table(spark, sf_dir, "analysis_results").where("page_key is not null").groupBy(F.col("page_key").alias("key")).agg(
        F.max("analysis_date").alias("modified"),
        F.concat(F.lit("vault/"), T.file_name(F.coalesce(F.min("title"), F.lit(""))), F.lit(".md")).alias("active_file"),
        T.hash16(F.coalesce(F.min("body"), F.lit(""))).alias("content_hash"),
        F.when(F.count("*") > 2, "orphaned").otherwise("synced").alias("status"),
        (F.max("content_type") == "document").alias("pending"),
    )
    files = state.groupBy(F.col("active_file").alias("path")).agg(F.min(F.when(F.col("status") == "synced", F.col("content_hash")).otherwise("")).alias("content_hash"))
    return pages, state, files


@query(f"{_SNAPSHOTS} SELECT key, type, old_path, new_path, display_name FROM act WHERE type IS NOT NULL")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.plan(*_snapshots(spark, sf_dir))


_MOVES = _SNAPSHOTS + r""",
todo AS (SELECT * FROM act WHERE type IS NOT NULL),
orp AS (SELECT key AS old_key, old_path, regexp_replace(list_last(string_split(old_path, '/')), '\.[^.]*$', '') AS stem, count(*) OVER (PARTITION BY regexp_replace(list_last(string_split(old_path, '/')), '\.[^.]*$', '')) AS n FROM todo WHERE type = 'orphan'),
fre AS (SELECT key, new_path, display_name AS stem, count(*) OVER (PARTITION BY display_name) AS n FROM todo WHERE type = 'new'),
mov AS (SELECT fre.key, orp.old_key, orp.old_path, fre.new_path FROM orp JOIN fre USING (stem) WHERE orp.n = 1 AND fre.n = 1),
fin AS (SELECT key, type, NULL AS old_key, old_path, new_path FROM todo WHERE NOT (type = 'new' AND key IN (SELECT key FROM mov)) AND NOT (type = 'orphan' AND key IN (SELECT old_key FROM mov))
UNION ALL SELECT key, 'move', old_key, old_path, new_path FROM mov)"""


@query(_MOVES + " SELECT key, type, old_key, old_path, new_path FROM fin")
def sync_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.with_moves(sync_plan(spark, sf_dir))


@query(_MOVES + " SELECT type, count(*) AS n, array_to_string(list(key ORDER BY key)[1:10], ',') AS examples FROM fin GROUP BY 1")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.summary(sync_moves(spark, sf_dir)).select("type", "n", F.array_join("examples", ",").alias("examples"))


@query(_MOVES + """ SELECT key, modified, active_file, content_hash, CASE WHEN key IN (SELECT key FROM fin WHERE type = 'orphan') THEN 'orphaned' ELSE status END AS status, pending
FROM st WHERE key NOT IN (SELECT key FROM fin WHERE type NOT IN ('orphan')) AND key NOT IN (SELECT old_key FROM fin WHERE type = 'move')
UNION ALL SELECT f.key, p.modified, f.new_path, substr(sha256(p.name), 1, 16), CASE WHEN f.type = 'conflict' THEN 'conflict' ELSE 'synced' END, false FROM fin f JOIN pg p ON p.key = f.key WHERE f.type <> 'orphan'""")
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, state, _ = _snapshots(spark, sf_dir)
    actions = sync_moves(spark, sf_dir)
    written = actions.where("type <> 'orphan'").join(pages, "key").select("key", "modified", F.col("new_path").alias("active_file"), T.hash16(F.col("name")).alias("content_hash"), F.lit(False).alias("pending"))
    return sync.next_state(state, actions, written)


@query("SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def window_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.rate(table(spark, sf_dir, "events"), "ts").select("event_id", "recent")


@query("""WITH e AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events),
f AS (SELECT user_id, event_type, min(event_id) AS first FROM e GROUP BY 1, 2)
SELECT user_id, (SELECT arg_min(event_type, (t, event_id)) FROM e WHERE e.user_id = f.user_id) AS author, string_agg(event_type, '|' ORDER BY first) AS contributors,
(SELECT arg_max(event_type, event_id) FROM e WHERE e.user_id = f.user_id) AS last_editor FROM f GROUP BY 1""")
def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each user's events, its elements written by the kinds of events."""
    one = F.concat(F.lit('<OE author="'), F.col("event_type"), F.lit('" creationTime="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('" lastModifiedBy="'), F.col("event_type"), F.lit('"/>'))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("x")))).alias("a"))
    xml = F.concat(F.lit("<Page><Outline><OEChildren>"), F.array_join(F.transform("a", lambda s: s["x"]), ""), F.lit("</OEChildren></Outline></Page>"))
    read = source.convert_pages(pages.select(F.col("user_id").cast("string").alias("key"), xml.alias("xml")), "key", "xml")
    return read.select(F.col("page_key").cast("long").alias("user_id"), "author", F.array_join("contributors", "|").alias("contributors"), F.col("last_modified_by").alias("last_editor"))


# ---- lines


def _lang_sql(c: str, languages: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {_lit(p)}) THEN '{k}'" for k, p in languages.items()) + " ELSE '' END"


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_LINES}, k AS (SELECT *, regexp_matches(line, '^\s*\d{{1,3}}[.)]\s') AS num FROM ln), r AS (SELECT *, sum((NOT num)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM k)
SELECT doc_id, n, (sum(num::INT) OVER (PARTITION BY doc_id, run ORDER BY n))::BIGINT AS item_no FROM r QUALIFY num""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("num", F.col("line").rlike(r"^\s*\d{1,3}[.)]\s"))
    return lines.numbered(rows, ["doc_id"], "n", "num").where("num").select("doc_id", "n", "item_no")


_CODE_RE = _lit("(?m)" + P.CODE_LINE[4:])
_PAGE_LINES = "ln AS (SELECT page_row_id AS doc_id, unnest(string_split(page_text, chr(10))) AS line, generate_subscripts(string_split(page_text, chr(10)), 1) - 1 AS n FROM page_contexts WHERE page_text IS NOT NULL)"
_FENCED = "fc AS (SELECT *, starts_with(line, '```') AS is_fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AND NOT starts_with(line, '```') AS inside FROM ln)"


@query(f"WITH {_PAGE_LINES}, {_FENCED} SELECT doc_id, count(*) AS n_lines, sum(is_fence::INT)::BIGINT AS fences, sum(inside::INT)::BIGINT AS fenced FROM fc GROUP BY 1")
def fence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.with_fences(lines.split_lines(table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("is_fence").cast("int")).alias("fences"), F.sum(F.col("inside").cast("int")).alias("fenced"))


_ISLANDS = rf"""{_PAGE_LINES}, {_FENCED},
s AS (SELECT *, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM fc),
h AS (SELECT *, NOT is_fence AND NOT inside AND regexp_matches(line, {_CODE_RE}) AS hit,
  t <> '' AND ((regexp_matches(t, '^\\?#') AND NOT contains(t, '(')) OR regexp_matches(t, '\b\w+\s*(?:<-|=)\s') OR regexp_matches(t, '^\w[\w.]+\s*\(') OR regexp_matches(line, '^\s{{4,}}') OR regexp_matches(t, '^(?:-\w|--\w)') OR regexp_matches(t, '^(?:[)\]}}|+]|%>%|&&)')) AS cont FROM s),
b AS (SELECT *, is_fence OR inside OR NOT (hit OR cont) AS stop FROM h),
w AS (SELECT *, coalesce(max(CASE WHEN hit THEN n END) OVER d, -1) AS lh, coalesce(max(CASE WHEN stop THEN n END) OVER d, -1) AS ls FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, NOT stop AND lh > ls AS inn FROM w),
f AS (SELECT *, inn AND NOT coalesce(lag(inn) OVER (PARTITION BY doc_id ORDER BY n), false) AS first FROM i),
g AS (SELECT *, CASE WHEN inn THEN sum(first::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) END AS island FROM f),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS size FROM g)"""


@query(f"WITH {_ISLANDS} SELECT doc_id, n FROM c WHERE inn AND size >= 2")
def code_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.code_islands(lines.split_lines(table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text"))
    return rows.where("in_code").select("doc_id", "n")


def _unescaped_sql(c: str) -> str:
    for ch in "#_*[]`><":
        c = f"replace({c}, '\\{ch}', '{ch}')"
    return c


@query(rf"""WITH {_ISLANDS}, o AS (SELECT *, inn AND size >= 2 AS coded FROM c),
e AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY n) AS code, min(n) AS a, max(n) AS b FROM o WHERE coded GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN coded THEN CASE WHEN n = a THEN '```' || {_lang_sql("code", P.CODE_LANGUAGE)} || chr(10) ELSE '' END || {_unescaped_sql("line")} || CASE WHEN n = b THEN chr(10) || '```' ELSE '' END ELSE line END, chr(10) ORDER BY n) AS text
FROM o LEFT JOIN e USING (doc_id, island) GROUP BY 1""")
def fence_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fence_islands(table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text")


@query(rf"""WITH {_PAGE_LINES}, b AS (SELECT *, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS bare FROM ln),
f AS (SELECT *, starts_with(bare, '```') AS fence, sum(starts_with(bare, '```')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM b),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY n) AS code FROM f WHERE NOT fence AND k % 2 = 1 GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN fence AND f.k % 2 = 1 AND bare = '```' AND coalesce(code, '') <> '' THEN '```' || {_lang_sql("code", P.FENCE_LANGUAGE)} ELSE line END, chr(10) ORDER BY n) AS text FROM f LEFT JOIN c USING (doc_id, k) GROUP BY 1""")
def label_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.label_fences(table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text")


@query(rf"""WITH {_PAGE_LINES}, f AS (SELECT *, regexp_extract(line, '!?\[\[(?:[^\[\]|]*/)?([^\[\]|/]+\.[A-Za-z0-9]{{2,5}})(?:\|[^\[\]]*)?\]\]', 1) AS file FROM ln),
p AS (SELECT *, sum((file <> '' OR starts_with(line, '#'))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM f),
t AS (SELECT doc_id, min(n) AS n, 1 AS k, 'text' AS type, NULL AS filename, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM p WHERE file = '' GROUP BY doc_id, part),
a AS (SELECT * FROM t WHERE text <> '' UNION ALL SELECT doc_id, n, 0, CASE WHEN regexp_matches(lower(file), '\.(png|jpe?g|bmp|tiff?|gif)$') THEN 'image' ELSE 'file' END, file, NULL FROM f WHERE file <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS ord, type, filename, text FROM a""")
def embed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.embeds(table(spark, sf_dir, "page_contexts"), "page_row_id", "page_text")


@query()
def fragments_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_contexts").where("page_text is not null").select("page_row_id", fragments.fragment_udf("page_text").alias("markdown"), fragments.plain_udf("page_text").alias("plain"))


# ---- ontologies

_GENES = "g AS (SELECT row_id, trim(symbol) AS symbol, hgnc_id, alias_symbol, prev_symbol FROM hgnc_complete_set WHERE trim(status) = 'Approved' AND trim(symbol) <> '')"


@query(f"WITH {_GENES} SELECT symbol, arg_max(hgnc_id, row_id) AS hgnc_id FROM g GROUP BY 1")
def gene_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.genes(table(spark, sf_dir, "hgnc_complete_set"))


@query(f"""WITH {_GENES}, a AS (SELECT row_id, symbol, trim(unnest(list_concat(string_split(coalesce(alias_symbol, ''), '|'), string_split(coalesce(prev_symbol, ''), '|')))) AS alias FROM g)
SELECT alias, arg_max(symbol, row_id) AS symbol FROM a WHERE alias <> '' AND alias NOT IN (SELECT symbol FROM g) GROUP BY 1""")
def gene_bar_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.bar_aliases(table(spark, sf_dir, "hgnc_complete_set"))


@query()
def gene_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.gene_aliases(table(spark, sf_dir, "hgnc_complete_set"))


_DISEASES = rf"""SELECT key, arg_min(lbl, (id, o)) AS label, arg_min(id, (id, o)) AS mondo_id FROM
(SELECT id, lbl, o, lower(trim(regexp_replace(name, '[\s\p{{{{Z}}}}]+', ' ', 'g'))) AS key FROM
(SELECT id, lbl, unnest(list_concat([lbl], list_filter(coalesce(synonyms, []::VARCHAR[]), lambda s: length(trim(s)) >= 4))) AS name, generate_subscripts(list_concat([lbl], list_filter(coalesce(synonyms, []::VARCHAR[]), lambda s: length(trim(s)) >= 4)), 1) AS o FROM
(SELECT 'MONDO:' || regexp_extract(node_id, '(?i)mondo[:_](\d+)', 1) AS id, lbl, synonyms FROM mondo_nodes WHERE upper(trim(node_type)) = 'CLASS' AND regexp_extract(node_id, '(?i)mondo[:_](\d+)', 1) <> '' AND NOT coalesce(deprecated, false) AND length(trim(lbl)) >= 3) {{under}}))
WHERE key NOT IN ({", ".join("'" + s + "'" for s in ontology.DISEASE_STOP)}) GROUP BY 1"""
_DISEASE_LINKS = r"""l AS (SELECT DISTINCT 'MONDO:' || regexp_extract(sub, '(?i)mondo[:_](\d+)', 1) AS c, 'MONDO:' || regexp_extract(obj, '(?i)mondo[:_](\d+)', 1) AS p FROM mondo_edges
WHERE lower(trim(pred)) = 'is_a' AND regexp_extract(sub, '(?i)mondo[:_](\d+)', 1) <> '' AND regexp_extract(obj, '(?i)mondo[:_](\d+)', 1) <> '')"""
_BELOW = "r AS (SELECT min(p) AS node FROM l WHERE p NOT IN (SELECT c FROM l)), b(node) AS (SELECT node FROM r UNION SELECT l.c FROM l JOIN b ON l.p = b.node)"


def _root(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The first root of the disease links, and these."""
    found, _ = ancestry.disease_links(table(spark, sf_dir, "mondo_edges"))
    return found.join(found.select(F.col("child").alias("parent")), "parent", "left_anti").agg(F.min("parent")).first()[0], found


@query(f"WITH RECURSIVE {_DISEASE_LINKS}, {_BELOW} {_DISEASES.format(under='WHERE id IN (SELECT node FROM b)')}")
def disease_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.diseases(spark, table(spark, sf_dir, "mondo_nodes"), table(spark, sf_dir, "mondo_edges"), _root(spark, sf_dir)[0])


@query(_DISEASES.format(under=""))
def disease_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.diseases(spark, table(spark, sf_dir, "mondo_nodes"), table(spark, sf_dir, "mondo_edges"), None)


@query(f"WITH RECURSIVE {_DISEASE_LINKS}, {_BELOW} SELECT node FROM b")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.below(spark, *_root(spark, sf_dir))


_VARIANTS = r"""v AS (SELECT lower(trim(entity_type)) AS entity_type, lower(trim(regexp_replace(variant_name, '[\s\p{Z}]+', ' ', 'g'))) AS variant, canonical, ord FROM dict_variants WHERE trim(regexp_replace(variant_name, '[\s\p{Z}]+', ' ', 'g')) <> '' AND canonical IS NOT NULL),
a AS (SELECT * FROM v UNION ALL SELECT entity_type, lower(trim(regexp_replace(canonical, '[\s\p{Z}]+', ' ', 'g'))), canonical, ord FROM v WHERE entity_type = 'drugs'),
d AS (SELECT entity_type, variant, arg_max(canonical, (ord, canonical)) AS canonical, min(ord) AS ord FROM a GROUP BY 1, 2)"""


@query(f"WITH {_VARIANTS} SELECT * FROM d")
def variant_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.variants(table(spark, sf_dir, "dict_variants"))


@query(f"WITH {_VARIANTS} SELECT * FROM d WHERE NOT (entity_type = 'companies' AND lower(canonical) IN (SELECT lower(child) FROM company_parents WHERE child IS NOT NULL))")
def denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = table(spark, sf_dir, "company_parents").where("child is not null").select(F.lit("canonicals").alias("guard"), F.lit("companies").alias("entity_type"), F.col("child").alias("term"))
    return ontology.without_denied(variant_dictionary(spark, sf_dir), denied)


# ---- extraction


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _match_sql(kind: str) -> str:
    return rf"""WITH {_VARIANTS}, t AS (SELECT * FROM d WHERE entity_type = '{kind}' AND length(variant) >= 3),
h AS (SELECT doc_id, canonical, ord, variant FROM documents JOIN t ON contains(lower(text), variant) WHERE regexp_matches(lower(text), '(^|[^A-Za-z0-9\-/])' || regexp_escape(variant) || '([^\p{{L}}\p{{N}}_]|$)')),
b AS (SELECT doc_id, canonical, min((ord, variant)) AS m FROM h GROUP BY 1, 2)
SELECT doc_id, '{kind}' AS entity_type, row_number() OVER (PARTITION BY doc_id ORDER BY m) AS ord, m[2] AS text, canonical FROM b"""


def _variant_match(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return extract.by_variants(_docs(spark, sf_dir), variant_dictionary(spark, sf_dir), kind).select("doc_id", "entity_type", "ord", "text", "canonical")


@query(_match_sql("companies"))
def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant_match(spark, sf_dir, "companies")


@query(_match_sql("drugs"))
def drug_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant_match(spark, sf_dir, "drugs")


_SAID = "sd AS (SELECT mention_id AS doc_id, 'One patient: ' || text || ' was noted' AS text FROM entity_mentions WHERE text IS NOT NULL)"


def _said_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mentions say, each in a sentence of its own: texts that hold the names of all types."""
    rows = table(spark, sf_dir, "entity_mentions").where("text is not null")
    return rows.select(F.col("mention_id").alias("doc_id"), F.concat(F.lit("One patient: "), F.col("text"), F.lit(" was noted")).alias("text"))


_ALONE = r"regexp_matches(lower(text), '(^|[^A-Za-z0-9\-/])' || regexp_escape(key) || '([^\p{L}\p{N}_]|$)')"


@query(rf"""WITH {_SAID}, {_GENES}, sy AS (SELECT symbol, arg_max(hgnc_id, row_id) AS hgnc_id FROM g GROUP BY 1),
ba AS (SELECT row_id, symbol, trim(unnest(list_concat(string_split(coalesce(alias_symbol, ''), '|'), string_split(coalesce(prev_symbol, ''), '|')))) AS alias FROM g),
al AS (SELECT alias, arg_max(symbol, row_id) AS symbol FROM ba WHERE alias <> '' AND alias NOT IN (SELECT symbol FROM g) GROUP BY 1),
tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)*)\b', 1)) AS token, generate_subscripts(regexp_extract_all(text, '\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)*)\b', 1), 1) AS k FROM sd),
kn AS (SELECT doc_id, token, min(k) AS k, coalesce(any_value(s.symbol), any_value(al.symbol)) AS canonical FROM tk LEFT JOIN sy s ON s.symbol = token LEFT JOIN al ON al.alias = token
  WHERE NOT list_contains({_words(extract.NEVER_GENES)}, token) OR list_contains({_words(extract.ALWAYS_GENES)}, token) GROUP BY 1, 2),
fd AS (SELECT * FROM kn WHERE canonical IS NOT NULL)
SELECT doc_id, token AS text, canonical, coalesce(sy.hgnc_id, '') AS ontology_id FROM fd LEFT JOIN sy ON sy.symbol = canonical
WHERE token <> canonical OR NOT EXISTS (SELECT 1 FROM fd o WHERE o.doc_id = fd.doc_id AND o.canonical = fd.canonical AND o.token <> o.canonical AND o.k < fd.k)""")
def gene_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text names a patient, so each symbol is in context."""
    t = table(spark, sf_dir, "hgnc_complete_set")
    return extract.genes(_said_docs(spark, sf_dir), ontology.genes(t), ontology.bar_aliases(t)).select("doc_id", "text", "canonical", "ontology_id")


@query(rf"""WITH {_SAID}, dn AS ({_DISEASES.format(under="")}),
an AS (SELECT * FROM dn WHERE length(key) >= 4 AND NOT list_contains({_words([*extract.DISEASE_GENERIC, *extract.DISEASE_NEVER])}, key) AND NOT list_contains({_words(extract.DISEASE_GENERIC)}, lower(label))),
ht AS (SELECT doc_id, key, label, mondo_id FROM sd JOIN an ON contains(lower(text), key) WHERE {_ALONE}),
bt AS (SELECT doc_id, lower(label) AS l, min((-length(key), key, label, mondo_id)) AS m FROM ht GROUP BY 1, 2)
SELECT doc_id, m[2] AS text, m[3] AS canonical, coalesce(m[4], '') AS ontology_id FROM bt""")
def disease_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ontology.disease_keys(spark, table(spark, sf_dir, "mondo_nodes"), table(spark, sf_dir, "mondo_edges"), None)
    return extract.diseases(_said_docs(spark, sf_dir), disease_names(spark, sf_dir), keys).select("doc_id", "text", "canonical", "ontology_id")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known compounds as the mentions name them."""
    kind = F.lower(P.strip(F.col("entity_type")))
    return table(spark, sf_dir, "entity_mentions").where(kind.isin("compounds", "compound") & F.col("canonical").isNotNull()).groupBy(F.upper(P.strip(F.col("canonical"))).alias("code")).agg(F.min("canonical").alias("canonical"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(rf"""WITH {_SAID}, cd AS (SELECT upper({_STRIP.format("canonical")}) AS code, min(canonical) AS canonical FROM entity_mentions WHERE lower({_STRIP.format("entity_type")}) IN ('compounds', 'compound') AND canonical IS NOT NULL GROUP BY 1),
fd AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\bM(\d{{4}})\b', 0))) AS code, true AS short FROM sd UNION SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\bMSC(\d{{6,9}})\b', 0))), false FROM sd)
SELECT doc_id, fd.code AS text, CASE WHEN short AND canonical IS NOT NULL THEN canonical ELSE fd.code END AS canonical, CASE WHEN short AND canonical <> fd.code THEN fd.code ELSE '' END AS ontology_id FROM fd LEFT JOIN cd ON cd.code = fd.code""")
def compound_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.compounds(_said_docs(spark, sf_dir), _codes(spark, sf_dir)).select("doc_id", "text", "canonical", "ontology_id")


_STOPS = "['at', 'in', 'for', 'from', 'since', 'who', 'with', 'is', 'was']"


@query(rf"""WITH {_SAID}, hd AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\bHead of ([\w/-]+(?:[ \t]+[\w/-]+){{0,5}})', 1)) AS said FROM sd),
wd AS (SELECT doc_id, said, regexp_split_to_array(said, '[ \t]+') AS w FROM hd),
ct AS (SELECT doc_id, said, w, coalesce(list_min(list_filter(range(2, len(w) + 1), lambda i: list_contains({_STOPS}, lower(regexp_extract(w[i], '^\w+'))))), len(w) + 1) AS n FROM wd),
tt AS (SELECT doc_id, t AS title FROM sd, (SELECT unnest({_words(extract.ROLES)}) AS t) WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9\-/])' || t || '([^\p{{L}}\p{{N}}_]|$)')),
al AS (SELECT doc_id, 'Head of ' || array_to_string(w[1:n - 1], ' ') AS title FROM ct UNION SELECT doc_id, title FROM tt
  WHERE title <> 'Director' OR NOT EXISTS (SELECT 1 FROM tt o WHERE o.doc_id = tt.doc_id AND o.title IN ('Executive Director', 'Associate Director', 'Senior Director')))
SELECT DISTINCT doc_id, title AS canonical FROM al""")
def role_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.roles(_said_docs(spark, sf_dir)).select("doc_id", "canonical")


_TRIALS = r"tr AS (SELECT lower(trim(canonical)) AS key, min(trim(canonical)) AS named FROM entity_mentions WHERE lower(trim(entity_type)) IN ('clinical_trials', 'clinical_trial') AND length(trim(canonical)) >= 4 GROUP BY 1)"


@query(rf"""WITH {_SAID}, {_TRIALS}, n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b(NCT\d{{8}})\b', 1))) AS canonical FROM sd)
SELECT doc_id, canonical FROM n UNION SELECT doc_id, named FROM sd JOIN tr ON contains(lower(text), key) WHERE {_ALONE}""")
def trial_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry numbers, and trials by the names the mentions give them."""
    m = table(spark, sf_dir, "entity_mentions").where(F.lower(F.trim("entity_type")).isin("clinical_trials", "clinical_trial") & F.trim("canonical").isNotNull())
    named = m.groupBy(F.lower(F.trim("canonical")).alias("variant")).agg(F.min(F.trim("canonical")).alias("canonical")).select(F.lit("clinical_trials").alias("entity_type"), "variant", "canonical", F.lit(0).alias("ord"))
    return extract.clinical_trials(_said_docs(spark, sf_dir), named).select("doc_id", "canonical")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the types without a dictionary table, as the mentions show them."""
    plural = {"method": "methods", "pathway": "pathways", "conference": "conferences", "department": "departments", "cell_line": "cell_lines", "clinical_trial": "clinical_trials"}
    kind = F.lower(P.strip(F.col("entity_type")))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in plural.items() for x in kv])[kind], kind)
    m = table(spark, sf_dir, "entity_mentions").select(named.alias("entity_type"), P.strip(F.col("canonical")).alias("canonical")).where("canonical <> ''")
    return m.where(F.col("entity_type").isin(*plural.values())).groupBy("entity_type", F.lower("canonical").alias("variant")).agg(F.min("canonical").alias("canonical")).withColumn("ord", F.lit(0))


@query()
def all_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve types over the documents; SQL checks the types one by one."""
    t = table(spark, sf_dir, "hgnc_complete_set")
    return extract.all_mentions(_docs(spark, sf_dir), variant_dictionary(spark, sf_dir).unionByName(_known(spark, sf_dir)), ontology.genes(t), ontology.gene_aliases(t), disease_names(spark, sf_dir), _codes(spark, sf_dir))


# ---- mentions

_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CLEAN = f"""m AS (SELECT mention_id, page_key, lower({_TRIM.format("entity_type")}) AS entity_type, {_TRIM.format("canonical")} AS canonical, ontology_id, confidence, text FROM entity_mentions WHERE canonical IS NOT NULL AND {_TRIM.format("canonical")} <> '' AND entity_type IS NOT NULL AND page_key IS NOT NULL)"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "entity_mentions").where("entity_type is not null and page_key is not null")
    return m.select(F.col("mention_id").alias("ord"), F.col("page_key").alias("doc_id"), F.lower(P.strip(F.col("entity_type"))).alias("entity_type"), P.strip(F.col("canonical")).alias("canonical"), "ontology_id", "confidence", "text").where("canonical <> ''")


@query(f"WITH {_CLEAN} SELECT entity_type, canonical, count(DISTINCT page_key) AS mention_count FROM m WHERE entity_type NOT IN ('methods', 'roles', 'departments', 'conferences') GROUP BY 1, 2")
def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.index(_clean(spark, sf_dir), "doc_id")


@query(f"WITH {_CLEAN} SELECT entity_type, canonical, count(DISTINCT page_key) AS mention_count FROM m WHERE entity_type NOT IN ('methods', 'roles', 'departments', 'conferences') AND page_key IN (SELECT page_key FROM page_contexts) GROUP BY 1, 2")
def live_entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "page_contexts").where("page_key is not null").select(F.col("page_key").alias("doc_id"))
    return mentions.index(_clean(spark, sf_dir), "doc_id", live)


@query(f"""WITH {_CLEAN}, t AS (SELECT *, CASE WHEN confidence = 1.0 THEN 0 ELSE 1 END AS tier FROM m),
a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page_key, entity_type, lower(canonical) ORDER BY coalesce(ontology_id, '') = '', tier, mention_id) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page_key, entity_type, CASE WHEN coalesce(ontology_id, '') <> '' THEN ontology_id ELSE chr(1) || lower(canonical) END ORDER BY tier, mention_id) = 1)
SELECT mention_id AS ord, page_key AS doc_id, entity_type, canonical, ontology_id FROM b""")
def merge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _clean(spark, sf_dir)
    return mentions.merge(m.where("confidence = 1.0"), m.where("confidence is null or confidence <> 1.0")).select("ord", "doc_id", "entity_type", "canonical", "ontology_id")


@query(f"""WITH {_VARIANTS}, {_CLEAN}, dn AS (SELECT key, min(mondo_id) AS mondo_id FROM ({_DISEASES.format(under="")}) GROUP BY 1),
i AS (SELECT m.* EXCLUDE (ontology_id), CASE WHEN coalesce(ontology_id, '') = '' AND entity_type = 'diseases' THEN coalesce(dn.mondo_id, '') ELSE coalesce(ontology_id, '') END AS id FROM m LEFT JOIN dn ON dn.key = lower(m.canonical)),
k AS (SELECT * FROM i QUALIFY id = '' OR mention_id = min(mention_id) OVER (PARTITION BY page_key, entity_type, id)),
w AS (SELECT variant, arg_max(canonical, (entity_type = 'companies', ord, canonical)) AS whole, min((entity_type = 'companies', ord, canonical)) AS place FROM d WHERE entity_type IN ('methods', 'companies') GROUP BY 1),
b AS (SELECT regexp_replace(variant, '[ -]', '', 'g') AS bare, arg_min(whole, place) AS alike FROM w GROUP BY 1),
n AS (SELECT k.* EXCLUDE (canonical), CASE WHEN entity_type IN ('methods', 'companies') THEN coalesce(w.whole, b.alike, canonical) ELSE canonical END AS canonical FROM k LEFT JOIN w ON w.variant = lower(canonical) LEFT JOIN b ON b.bare = regexp_replace(lower(canonical), '[ -]', '', 'g')),
o AS (SELECT page_key, entity_type, lower(canonical) AS l, arg_max(canonical, mention_id) FILTER (substr(canonical, 1, 1) <> lower(substr(canonical, 1, 1))) AS u, arg_min(canonical, mention_id) AS f FROM n GROUP BY 1, 2, 3)
SELECT page_key AS doc_id, entity_type, array_to_string(list_sort(list(coalesce(u, f))), '|') AS names FROM o GROUP BY 1, 2""")
def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ontology.diseases(spark, table(spark, sf_dir, "mondo_nodes"), table(spark, sf_dir, "mondo_edges"), None)
    return mentions.lists(_clean(spark, sf_dir), variant_dictionary(spark, sf_dir), names).select("doc_id", "entity_type", F.array_join("names", "|").alias("names"))


@query(f"""WITH {_CLEAN}, r AS (SELECT *, coalesce(list_position({_words(extract.TYPES)}, entity_type), 0) AS rank FROM m WHERE entity_type <> 'roles'),
e AS (SELECT page_key, text AS t, canonical, rank, mention_id, 0 AS k FROM r UNION ALL SELECT page_key, canonical, canonical, rank, mention_id, 1 FROM r)
SELECT page_key AS doc_id, t AS text, arg_max(canonical, (rank, mention_id, k)) AS canonical FROM e WHERE length(t) >= 3 GROUP BY 1, 2""")
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.link_texts(_clean(spark, sf_dir))


@query("SELECT parent, array_to_string(list_sort(list(DISTINCT child)), '|') AS children FROM company_parents WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY 1")
def subsidiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.subsidiaries(table(spark, sf_dir, "company_parents")).select("parent", F.array_join("children", "|").alias("children"))


@query()
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = ontology.genes(table(spark, sf_dir, "hgnc_complete_set"))
    aliases = ontology.gene_aliases(table(spark, sf_dir, "hgnc_complete_set")).groupBy("symbol").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    genes = genes.join(aliases, "symbol", "left").select("symbol", F.col("symbol").alias("name"), "hgnc_id", "aliases")
    links_, _ = ancestry.disease_links(table(spark, sf_dir, "mondo_edges"))
    names = disease_names(spark, sf_dir)
    up = links_.join(names.groupBy(F.col("mondo_id").alias("parent")).agg(F.min("label").alias("p")), "parent").groupBy(F.col("child").alias("mondo_id")).agg(F.array_sort(F.collect_set("p")).alias("parents"))
    diseases = names.join(up, "mondo_id", "left").select("key", "mondo_id", "parents")
    # Of a compound the tables know the code only.
    compounds = _codes(spark, sf_dir).select("canonical", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("class"), F.array("code").alias("variants"))
    return mentions.pages(entity_index(spark, sf_dir), genes, diseases, compounds, table(spark, sf_dir, "company_parents"))


_GENERIC = ", ".join("'" + n + "'" for n in links.GENERIC_NAMES)


@query(rf"""WITH n AS (SELECT DISTINCT page_title AS target FROM page_contexts WHERE length(page_title) > 3 AND lower(page_title) NOT IN ({_GENERIC})),
p AS (SELECT trim(regexp_replace(trim(regexp_extract(target, '^.+_ +(.+)', 1)), '\s*\([^)]*\)\s*$', '')) AS text, target FROM n),
a AS (SELECT target AS text, target, 0 AS r FROM n UNION ALL SELECT text, target, 1 FROM p WHERE regexp_full_match(text, '\p{{Lu}}\S*(?:\s+\p{{Lu}}\S*)+') AND lower(text) NOT IN ({_GENERIC}))
SELECT text, arg_min(target, (r, target)) AS target FROM a GROUP BY 1""")
def page_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_aliases(table(spark, sf_dir, "page_contexts"), "page_title")


@query()
def wikified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the companies and drugs of the dictionary linked."""
    names = variant_dictionary(spark, sf_dir).where("length(variant) > 2").select(F.col("variant").alias("text"), F.col("canonical").alias("target"))
    pages = table(spark, sf_dir, "page_contexts").where("page_text is not null").select(F.col("page_row_id").alias("doc_id"), F.col("page_title").alias("name"), F.col("page_text").alias("text"))
    return links.link_mentions(pages, names, entities=True)


# ---- attachments and profiles

_NAMES = "f AS (SELECT doc_id, coalesce(source, 'none') || '.' || CASE n_chars % 9 WHEN 0 THEN 'PPTX' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'png' WHEN 4 THEN 'csv' WHEN 5 THEN 'gif' WHEN 6 THEN 'zip' WHEN 7 THEN 'JPG' ELSE 'html' END AS filename, coalesce(text, '') AS text, n_chars FROM documents)"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if they were the contexts of files; the ending follows from the length."""
    endings = F.array(*map(F.lit, ["PPTX", "docx", "pdf", "png", "csv", "gif", "zip", "JPG", "html"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("."), F.get(endings, (F.col("n_chars") % 9).cast("int"))).alias("filename"), F.coalesce("text", F.lit("")).alias("text"), "n_chars")


@query(f"""WITH {_NAMES} SELECT doc_id, CASE lower(regexp_extract(filename, '\\.([^.]+)$', 1)) WHEN 'pptx' THEN 'presentation' WHEN 'docx' THEN 'document' WHEN 'html' THEN 'document' WHEN 'csv' THEN 'tabular_data' WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' END AS worker FROM f""")
def attachment_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("doc_id", attachments.route(F.col("filename")).alias("worker"))


def _kind_sql(c: str, kind: str) -> str:
    return f"regexp_matches(lower({c}), {_lit(P.KIND_WORDS[kind])})"


@query(f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {_kind_sql('text', k)} THEN '{k}' END" for k in P.KIND_WORDS)}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents WHERE text IS NOT NULL""")
def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(attachments.kinds(F.col("text")), ",").alias("kinds"))


def _said(kind: str) -> str:
    return f"({_kind_sql('text', kind)} OR {_kind_sql('filename', kind)})"


@query(f"""WITH {_NAMES}, p AS (SELECT *, 1 + n_chars % 4 AS pages, n_chars % 2 = 0 AS landscape, n_chars * 2000 AS size, n_chars / (1 + n_chars % 4) % 101 AS density FROM f)
SELECT doc_id, CASE WHEN {_said("poster")} AND pages <= 2 THEN 'poster' WHEN {_said("document")} THEN 'document' WHEN {_said("presentation")} THEN 'presentation'
WHEN pages = 1 THEN CASE WHEN landscape AND size > 2000000 THEN 'poster' WHEN density > 50 THEN 'document' WHEN landscape THEN 'poster' ELSE 'document' END WHEN density > 50 THEN 'document' ELSE 'presentation' END AS kind FROM p""")
def pdf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.col("n_chars") % 4 + 1
    rows = _attached(spark, sf_dir)
    return rows.select("doc_id", attachments.pdf_kind(F.col("text"), F.col("filename"), pages, F.col("n_chars") % 2 == 0, F.col("n_chars") * 2000, (F.col("n_chars") / pages) % 101).alias("kind"))


@query(rf"""SELECT doc_id, CASE WHEN {_kind_sql("text", "histology_slide")} THEN 'histology_slide' WHEN {_kind_sql("text", "diagram")} OR ((n_chars % 7 + 1) / greatest(n_chars % 5, 1) > 1.5 AND regexp_matches(lower(text), '\b(?:org|team|structure|pipeline)\b')) THEN 'diagram' ELSE 'screenshot' END AS kind FROM documents WHERE text IS NOT NULL""")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", attachments.image_kind(F.col("text"), F.col("n_chars") % 7 + 1, F.col("n_chars") % 5).alias("kind"))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey::VARCHAR AS page_key, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity) AS f, l_quantity::INT / 20 AS ratio, l_returnflag = 'R' AS sep, l_linenumber FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY l_linenumber, f) AS rn FROM i),
r(page_key, rn, f, head, g, ctx) AS (
  SELECT page_key, rn, f, ratio, 0, '' FROM o WHERE rn = 1
  UNION ALL
  SELECT o.page_key, o.rn, o.f, CASE WHEN o.sep OR abs(o.ratio - r.head) > 0.25 * greatest(r.head, 0.1) THEN o.ratio ELSE r.head END,
    r.g + (o.sep OR abs(o.ratio - r.head) > 0.25 * greatest(r.head, 0.1))::INT, CASE WHEN o.sep THEN '# Next' WHEN abs(o.ratio - r.head) > 0.25 * greatest(r.head, 0.1) THEN '' ELSE r.ctx END
  FROM r JOIN o ON o.page_key = r.page_key AND o.rn = r.rn + 1),
p AS (SELECT page_key, g, list(f ORDER BY rn) AS names, CASE WHEN count(*) >= 5 OR (count(*) > 1 AND any_value(head) > 1.2) THEN 'slide_photo' ELSE 'screenshot' END AS worker, any_value(ctx) AS ctx FROM r GROUP BY 1, 2),
m(page_key, g, k, names, worker, ctx) AS (
  SELECT page_key, g, 0, names, worker, ctx FROM p WHERE g = 0
  UNION ALL
  SELECT p.page_key, p.g, m.k + (NOT (greatest(len(m.names), len(p.names)) < 5 AND m.worker = p.worker))::INT,
    CASE WHEN greatest(len(m.names), len(p.names)) < 5 AND m.worker = p.worker THEN list_concat(m.names, p.names) ELSE p.names END, p.worker,
    CASE WHEN greatest(len(m.names), len(p.names)) < 5 AND m.worker = p.worker AND m.ctx <> '' THEN m.ctx ELSE p.ctx END
  FROM m JOIN p ON p.page_key = m.page_key AND p.g = m.g + 1)
SELECT page_key, k AS group_no, arg_max(worker, g) AS worker_type, array_to_string(arg_max(names, g), '|') AS filenames, arg_max(ctx, g) AS context FROM m GROUP BY 1, 2""")
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as if they were the images of a page, with quantities as widths."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("page_key"), F.col("l_linenumber").alias("ord"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("filename"), F.col("l_quantity").cast("int").alias("width"), F.lit(20).alias("height"),
        F.when(F.col("l_returnflag") == "R", "# Next").alias("between"), F.lit("").alias("preceding"), F.col("l_linestatus").alias("page_title"), F.lit("").alias("page_text"), F.lit("").alias("section_path"),
    )
    return attachments.group_images(rows).withColumn("filenames", F.array_join("filenames", "|"))


@query("SELECT l_orderkey, sha256(array_to_string(list_sort(list(sha256(l_partkey || '/' || l_suppkey))), '')) AS group_hash FROM lineitem GROUP BY 1")
def group_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("content", F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return attachments.group_hash(rows, ["l_orderkey"], "content")


@query("""WITH s AS (SELECT user_id, list(event_id ORDER BY event_id) AS e FROM events GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN len(e) <= 8 THEN e ELSE list_transform([0,1,2,3,4,5,6,7], lambda i: e[(i * len(e)) // 8 + 1]) END, ',') AS sample FROM s""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    return rows.select("user_id", F.array_join(attachments.even_sample(F.col("e")).cast("array<string>"), ",").alias("sample"))


@query("""SELECT 0 AS column_no, 'c_name' AS column_name, 'string' AS data_type, count(c_name) AS non_null, count(*) AS row_count, substr(arg_min(c_name, c_custkey), 1, 50) AS first_value FROM customer
UNION ALL SELECT 1, 'c_nationkey', 'int', count(c_nationkey), count(*), arg_min(c_nationkey, c_custkey)::VARCHAR FROM customer
UNION ALL SELECT 2, 'c_acctbal', 'double', count(c_acctbal), count(*), arg_min(c_acctbal, c_custkey)::VARCHAR FROM customer
UNION ALL SELECT 3, 'c_mktsegment', 'string', count(c_mktsegment), count(*), arg_min(c_mktsegment, c_custkey) FROM customer""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(table(spark, sf_dir, "customer"), "c_custkey")


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER o AS row_no, l_quantity AS filled, median(l_quantity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
SELECT l_orderkey, coalesce(min(row_no) FILTER (filled >= 5 AND m IS NOT NULL AND filled >= 3 * greatest(m, 1)), arg_max(row_no, (filled, -row_no))) AS header_row FROM r GROUP BY 1""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("row_no"), F.col("l_quantity").alias("filled"))
    return profiles.header_row(rows, ["l_orderkey"])


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS sheet FROM orders GROUP BY 1")
def best_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("sheet_no"), F.col("o_totalprice").alias("filled"))
    return profiles.best_sheet(rows, ["o_custkey"])


# ---- annotation


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The value stands in prose, as in an answer; the parser has to find it.
    said = F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" - anything else?"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(annotate.json_value_udf(said), "k long")["k"].alias("k"))


_BARE = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(rf"""WITH tx AS (SELECT doc_id, {_BARE.format("text")} AS text FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM tx),
b AS (SELECT *, {_BARE.format("line")} AS bare FROM ln),
l AS (SELECT *, CASE WHEN regexp_matches(bare, '^(TITLE|CONTENT_TYPE|AUTHORS|DATE|METHODS):') THEN regexp_extract(bare, '^([A-Z_]+):', 1) WHEN bare IN ('KEY_POINTS:', 'BODY:') THEN replace(bare, ':', '') END AS label FROM b),
s AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS sec, {_BARE.format("substr(bare, strpos(bare, ':') + 1)")} AS val FROM l),
g AS (SELECT doc_id, coalesce(arg_max(val, n) FILTER (label = 'TITLE'), '') AS title, coalesce(arg_max(val, n) FILTER (label = 'AUTHORS' AND lower(val) <> 'unknown'), '') AS said, coalesce(arg_max(val, n) FILTER (label = 'DATE' AND lower(val) <> 'unknown'), '') AS date,
count(*) FILTER (label IS NULL AND sec = 'KEY_POINTS' AND starts_with(bare, '- ')) AS points, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (label IS NULL AND sec = 'BODY'), '') AS below FROM s GROUP BY 1)
SELECT doc_id, title, array_to_string(list_filter(list_transform(string_split(said, ','), lambda x: {_BARE.format("x")}), lambda x: x <> ''), '|') AS authors, date, points, {_BARE.format("below")} AS body FROM g""")
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", annotate.structured(F.col("text")).alias("r")).select("doc_id", "r.title", F.array_join("r.authors", "|").alias("authors"), "r.date", F.size("r.key_points").alias("points"), "r.body")


@query(r"""WITH p AS (SELECT page_key, arg_min(coalesce(page_title, ''), page_row_id) AS title, (list(page_text ORDER BY page_row_id))[1] AS body FROM page_contexts WHERE page_key IS NOT NULL GROUP BY 1),
g AS (SELECT * FROM p WHERE len(list_filter(regexp_split_to_array(body, '[\s\p{Z}]+'), lambda x: x <> '')) >= 50),
t AS (SELECT page_key, body, list_sort(list_transform(list_distinct(regexp_extract_all(lower('Title: ' || title || chr(10) || substr(body, 1, 3000)), '[a-z]{6,}')), lambda w: {'n': -length(w), 'w': w}))[1:5] AS w FROM g)
SELECT page_key, substr(sha256(body), 1, 16) AS hash, CASE WHEN substr(page_key, 1, 1) < '8' THEN 'kept' ELSE array_to_string(list_transform(w, lambda x: x.w), '|') END AS tags FROM t""")
def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_contexts").where("page_key is not null").groupBy("page_key").agg(F.min_by(F.struct("page_title", "page_text"), "page_row_id").alias("p"))
    pages = pages.select("page_key", F.col("p.page_title").alias("title"), F.col("p.page_text").alias("body"))
    # About half of the pages were tagged before.
    cache = pages.where(F.substring("page_key", 1, 1) < "8").select("page_key", T.hash16(F.col("body")).alias("hash"), F.array(F.lit("kept")).alias("tags"))
    return annotate.tagged(pages, cache).select("page_key", "hash", F.array_join("tags", "|").alias("tags"))


def _domain_sql() -> str:
    cases = [f"WHEN list_has_any(t, {_words(ws)}) THEN '{d}'" for d, ws in annotate.DOMAIN_TAGS.items()] + [f"WHEN list_has_any(t, {_words(ws)}) THEN '{d}'" for d, ws in annotate.DOMAIN_METHODS.items()]
    return " ".join(cases)


@query(f"""SELECT page_row_id, CASE WHEN contains(s, 'meeting') THEN 'meeting' WHEN nb IN ('projects', 'project_lead', 'assignment') THEN 'project-note' ELSE 'knowledge' END AS note_type,
CASE {_domain_sql()} WHEN contains(s, 'adc') THEN 'adcs' WHEN contains(nb, 'omics') OR contains(s, 'pipeline') OR contains(s, 'bioinformatics') THEN 'computational-biology' WHEN contains(nb, 'conference') THEN 'oncology' ELSE '' END AS domain
FROM (SELECT page_row_id, lower(coalesce(section_path, '')) AS s, lower(string_split(coalesce(section_path, ''), '/')[1]) AS nb, regexp_split_to_array(lower(coalesce(page_title, '')), ' ') AS t FROM page_contexts)""")
def domain_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.coalesce("section_path", F.lit(""))
    nb, tags = F.split(s, "/")[0], F.split(F.lower(F.coalesce("page_title", F.lit(""))), " ")
    return table(spark, sf_dir, "page_contexts").select("page_row_id", annotate.note_type(nb, s).alias("note_type"), annotate.domain(nb, s, tags, tags).alias("domain"))
