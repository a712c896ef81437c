"""Incremental runs as differences of snapshots: what is new, changed, in conflict, gone or moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of pages that hold nothing yet.
PLACEHOLDERS = ("Untitled", "Untitled page", "Neuer Abschnitt")


def plan(pages: DataFrame, state: DataFrame, files: DataFrame, *, force: bool = False, emulate_missing_status: bool = True) -> DataFrame:
    """(key, type, old_path, new_path): one row for each page or state row that needs work.

    ``pages`` (key, name, modified, path, display_name), ``state`` (key, modified,
    active_file, content_hash, status, pending), ``files`` (path, content_hash). Keys are unique on either side; a null
    key matches nothing. The rules hold in this order: not in the state: ``new``, but placeholders are skipped; the
    tracked path differs from the computed one: ``reexport``; unchanged and the file missing: ``reexport``; unchanged
    and enrichment pending: ``ai-enrich``; unchanged: nothing; changed without a tracked file or with a missing one:
    ``reexport``; changed and the file as it was left: ``update``, else ``conflict``; in the state only: ``orphan``.
    With ``emulate_missing_status`` off, a file the user deleted is not written again. One shuffle by key.
    """
    p, s, f = pages.alias("p"), state.alias("s"), files.alias("f")
    both = p.join(s, F.col("p.key") == F.col("s.key"), "full_outer").join(f, F.col("s.active_file") == F.col("f.path"), "left")
    new, gone = F.col("s.key").isNull(), F.col("p.key").isNull()
    tracked = F.coalesce(F.col("s.active_file") != "", F.lit(False))
    missing = F.col("f.path").isNull()
    same = F.col("p.modified").eqNullSafe(F.col("s.modified"))
    deleted = F.lit(False) if emulate_missing_status else F.coalesce(F.col("s.status") == "user_deleted", F.lit(False))
    kind = (
        F.when(gone & (F.coalesce(F.col("s.status"), F.lit("")) != "orphaned"), "orphan")
        .when(gone, None)
        .when(new & F.col("p.name").isin(*PLACEHOLDERS), None)
        .when(new, "new")
        .when(tracked & (F.col("s.active_file") != F.col("p.path")), "reexport")
        .when(same & tracked & missing & ~deleted, "reexport")
        .when(same & F.coalesce(F.col("s.pending"), F.lit(False)), "ai-enrich")
        .when(same, None)
        .when(~tracked, "reexport")
        .when(missing, F.when(F.lit(force) | ~deleted, "reexport"))
        .when(F.col("f.content_hash") == F.coalesce(F.col("s.content_hash"), F.lit("")), "update")
        .otherwise("conflict")
    )
    return both.select(F.coalesce("p.key", "s.key").alias("key"), kind.alias("type"), F.col("s.active_file").alias("old_path"), F.col("p.path").alias("new_path"), F.col("p.display_name").alias("display_name")).where("type is not null")


def stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def with_moves(actions: DataFrame) -> DataFrame:
    """(key, type, old_key, old_path, new_path): an orphan and a new page of one name, if neither has a namesake of its
    kind, are one ``move``; all others stay."""
    orphans = actions.where("type = 'orphan'").select(F.col("key").alias("old_key"), F.col("old_path").alias("from_path"), stem(F.col("old_path")).alias("stem"))
    fresh = actions.where("type = 'new'").select("key", "new_path", F.col("display_name").alias("stem"))

    def alone(df: DataFrame) -> DataFrame:
        return df.withColumn("n", F.count("*").over(W.partitionBy("stem"))).where("n = 1 and stem is not null").drop("n")

    moves = alone(orphans).join(alone(fresh), "stem").select("key", F.lit("move").alias("type"), "old_key", F.col("from_path").alias("old_path"), "new_path")
    used = moves.select(F.explode(F.array(F.struct(F.col("key").alias("k"), F.lit("new").alias("t")), F.struct(F.col("old_key").alias("k"), F.lit("orphan").alias("t")))).alias("u")).select("u.k", "u.t")
    rest = actions.join(used, (actions["key"] == used["k"]) & (actions["type"] == used["t"]), "left_anti")
    return rest.select("key", "type", F.lit(None).cast("string").alias("old_key"), "old_path", "new_path").unionByName(moves)


def summary(actions: DataFrame, first: int = 10) -> DataFrame:
    """(type, n, examples): the count of each type and its first keys, for a dry run. The first keys are taken inside
    each task before any is sent on, so a type that most rows have is no burden."""
    ranked = actions.withColumn("rn", F.row_number().over(W.partitionBy("type").orderBy("key"))).where(F.col("rn") <= first)
    examples = ranked.groupBy("type").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return actions.groupBy("type").agg(F.count("*").alias("n")).join(examples, "type")


def next_state(state: DataFrame, actions: DataFrame, written: DataFrame) -> DataFrame:
    """The state after a run: rows of ``written`` (key, modified, active_file, content_hash, pending) replace their
    keys as ``synced`` or ``conflict``, moved rows change keys, orphans are marked, the rest stays."""
    moved = actions.where("type = 'move'").select(F.col("old_key").alias("key"))
    orphaned = actions.where("type = 'orphan'").select("key", F.lit("orphaned").alias("mark"))
    kept = state.join(written.select("key"), "key", "left_anti").join(moved, "key", "left_anti").join(orphaned, "key", "left")
    kept = kept.withColumn("status", F.coalesce("mark", "status")).drop("mark").select("key", "modified", "active_file", "content_hash", "status", "pending")
    kinds = actions.select("key", F.when(F.col("type") == "conflict", "conflict").otherwise("synced").alias("status"))
    fresh = written.join(kinds, "key", "left").select("key", "modified", "active_file", "content_hash", F.coalesce("status", F.lit("synced")).alias("status"), "pending")
    return kept.unionByName(fresh)


def rate(events: DataFrame, ts: str, seconds: int = 60, by: list[str] | None = None) -> DataFrame:
    """``recent``: how many calls came in the ``seconds`` up to each, itself included. Without ``by`` the calls are cut
    into time blocks that overlap by the window, so no task holds them all."""
    second = F.col(ts).cast("timestamp").cast("double")
    if by:
        w = W.partitionBy(*by).orderBy(F.col("__s")).rangeBetween(-seconds, 0)
        return events.withColumn("__s", second).withColumn("recent", F.count("*").over(w)).drop("__s")
    width = 3600 * 24
    block = F.floor(second / width)
    rows = events.withColumn("__s", second).withColumn("__b", F.explode(F.array_distinct(F.array(block, F.floor((second + seconds) / width)))))
    w = W.partitionBy("__b").orderBy("__s").rangeBetween(-seconds, 0)
    return rows.withColumn("recent", F.count("*").over(w)).where(F.col("__b") == block).drop("__s", "__b")
