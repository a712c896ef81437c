"""Counts of every distinct term and of the records that hold it, in heavy-light fashion.

A summary of bounded size finds the terms that may hold a large part of all rows. Those are counted exactly in
counter arrays inside each task, so however often one comes, a task sends one number for it; only the remaining
terms' rows are shuffled, summed before they are sent. Both count tables together hold every term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE, COMMON = "rare", "common"

# The entity types in the plural, by their singular.
PLURAL = {
    "gene": "genes",
    "drug": "drugs",
    "disease": "diseases",
    "compound": "compounds",
    "company": "companies",
    "role": "roles",
    "method": "methods",
    "clinical_trial": "clinical_trials",
    "cell_line": "cell_lines",
    "conference": "conferences",
    "pathway": "pathways",
    "department": "departments",
}


def plural_type(c: Column) -> Column:
    """An entity type in its plural form, whatever its case and surrounding white space."""
    low = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    pairs = [F.lit(x) for kv in PLURAL.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[low], low)


def tidy(c: Column) -> Column:
    """Trimmed, inner white space made one blank, lower-cased; null if blank."""
    out = F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\p{Z}]+", " ")))
    return F.when(out != "", out)


def _summaries(size: int):
    """Of each task at most ``size`` terms with counts: every term with more than 1/size of the task's rows is among
    them (Misra and Gries), with a count that is too low by at most that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for v, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                kept[v] = kept.get(v, 0) + n
            if len(kept) > size:
                cut = sorted(kept.values(), reverse=True)[size]
                kept = {v: n - cut for v, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["term", "n"])

    return run


def heavy_terms(rows: DataFrame, size: int = 512) -> list[str]:
    """At most ``size`` terms of ``rows`` (term): all that hold more than about 1/size of the rows."""
    top = rows.select("term").mapInArrow(_summaries(size), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    return sorted(r.term for r in top.collect())


def _count(heavy: list[str]):
    """(term, record, n) of each task: for a heavy term one row with its counter and no record, and its distinct
    records with n = 0; for the others summed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        counters = np.zeros(len(heavy), dtype=np.int64)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            slot = pc.index_in(batch.column(0), value_set=names)
            is_heavy = pc.is_valid(slot)
            counters += np.bincount(slot.filter(is_heavy).to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(heavy))
            held = t.filter(pc.and_(is_heavy, pc.is_valid(batch.column(1)))).group_by(["term", "record"]).aggregate([])
            held = held.append_column("n", pa.array(np.zeros(len(held), dtype=np.int64)))
            light = t.filter(pc.invert(is_heavy)).group_by(["term", "record"]).aggregate([([], "count_all")]).rename_columns(["term", "record", "n"])
            for part in (held, light):
                yield from part.cast(pa.schema([("term", pa.string()), ("record", pa.string()), ("n", pa.int64())])).to_batches()
        some = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(counters[some])], names=["term", "record", "n"])

    return run


def term_counts(rows: DataFrame, heavy_size: int = 512) -> DataFrame:
    """(term, mentions, records) of ``rows`` (term, record), each term once.

    ``mentions`` counts rows, ``records`` the distinct non-null records. Rows with a null term do not count; a null
    record counts as a mention only. Repeated rows count each. An empty table gives no rows. The heavy list has at
    most ``heavy_size`` terms whatever the input; no term is dropped or estimated.
    """
    rows = rows.where("term is not null").select("term", F.col("record").cast("string").alias("record"))
    heavy = heavy_terms(rows, heavy_size)
    counted = rows.mapInArrow(_count(heavy), "term string, record string, n long")
    # A heavy term's records are spread by the record, so no key is hot here; what follows is one row a record.
    return counted.groupBy("term", "record").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("mentions"), F.count("record").alias("records"))


def mark_terms(counts: DataFrame, total_records: int, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: ``rare`` for fewer than ``rare_below`` records, else ``common`` for more than ``common_share`` of
    all records, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, RARE).when(F.col("records") > F.lit(common_share * total_records), COMMON))
