"""Profiles of tables: per column the type, how many values and the first one; header rows; the fullest sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profile(table: DataFrame, order: str, widest: int | None = 30, example: int = 50) -> DataFrame:
    """(column_no, column_name, data_type, non_null, row_count, first_value): one pass, all columns in one aggregation.
    The first value is that of the least ``order``, cut to ``example`` characters; of a wide table
    the first ``widest`` columns are told (None: all). An empty table gives zero counts."""
    columns = [f for f in table.schema.fields if f.name != order][:widest]
    aggs = [F.count("*").alias("rows")]
    for k, f in enumerate(columns):
        v = F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(F.struct(f"`{f.name}`"))
        aggs += [F.count(v).alias(f"n{k}"), F.min_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col(order))).alias(f"v{k}")]
    one = table.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(k).alias("column_no"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{k}").alias("non_null"), F.col("rows").alias("row_count"), F.substring(f"v{k}", 1, example).alias("first_value")) for k, f in enumerate(columns)])
    return one.select(F.inline(entries))


def header_row(counts: DataFrame, by: list[str], least: int = 5, factor: float = 3.0) -> DataFrame:
    """(by, header_row): of a sheet's filled cells per row (row_no, filled) the first row with ``least`` or more and
    ``factor`` times the median before it; else the fullest, the first of equal ones."""
    w = W.partitionBy(*by).orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
    rows = counts.withColumn("__m", F.percentile("filled", F.lit(0.5)).over(w))
    jump = (F.col("filled") >= least) & (F.col("__m").isNotNull()) & (F.col("filled") >= factor * F.greatest(F.col("__m"), F.lit(1.0)))
    return rows.groupBy(*by).agg(F.coalesce(F.min(F.when(jump, F.col("row_no"))), F.max_by("row_no", F.struct("filled", -F.col("row_no")))).alias("header_row"))


def best_sheet(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, sheet): the sheet with the fullest row, the first of equal ones."""
    return counts.groupBy(*by).agg(F.max_by("sheet", F.struct("filled", -F.col("sheet_no"))).alias("sheet"))
