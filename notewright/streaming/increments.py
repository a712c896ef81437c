"""Incremental runs as a stream: new page files are picked up once, planned against the state and committed by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import sync
from notewright.sources import state as store

PAGES = "key string, name string, modified string, path string, display_name string, content string"
STATE = "key string, modified string, active_file string, content_hash string, status string, pending boolean"
FILES = "path string, content_hash string"


def run_once(spark: SparkSession, inbox: str, root: str, checkpoint: str, on_actions: Callable[[DataFrame, int], None] | None = None) -> None:
    """Take what came to ``inbox`` (Parquet of ``PAGES``) since the last run, then end. Each batch is planned and
    committed by itself, so a crash repeats one batch; the plan of a repeated batch finds its pages done. A batch holds
    only what came, so pages it lacks are no orphans: those come from a full run."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("key").agg(F.max_by(F.struct(*[c for c in df.columns if c != "key"]), "modified").alias("v")).select("key", "v.*")
        known = store.load(spark, root, "pages", STATE)
        files = known.where("active_file <> ''").select(F.col("active_file").alias("path"), "content_hash")
        actions = sync.with_moves(sync.plan(latest, known, files).where("type <> 'orphan'"))
        work = actions.join(latest.select("key", "modified", "content"), "key")
        written = work.select("key", "modified", F.col("new_path").alias("active_file"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.lit(False).alias("pending"))
        if on_actions is not None:
            on_actions(work, number)
        store.save(sync.next_state(known, actions, written), root, "pages")

    query = spark.readStream.schema(PAGES).parquet(inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def page_activity(spark: SparkSession, inbox: str, schema: str, ts: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by time window and kind of an event stream, with a bound on how late events may come."""
    events = spark.readStream.schema(schema).parquet(inbox)
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
