"""State between runs: versioned Parquet snapshots behind a pointer, and files written one a row."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _pointers(spark: SparkSession, root: str, table: str) -> list[tuple[int, str]]:
    """(number, name) of a table's pointers, the newest first."""
    fs, p, jvm = _fs(spark, f"{root}/{table}")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(((int(m[1]), n) for n in names if (m := re.fullmatch(r"CURRENT-(\d{12})", n))), reverse=True)


def current(spark: SparkSession, root: str, table: str) -> str | None:
    """The path of a table's current version; None if there is none."""
    found = _pointers(spark, root, table)
    return f"{root}/{table}/" + spark.read.text(f"{root}/{table}/{found[0][1]}").first().value.strip() if found else None


def load(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A table's current version. Missing, or of another version or layout, it is empty and the run starts afresh; any
    other error ends the run, as an empty state would make every page a new one."""
    empty = spark.createDataFrame([], schema)
    path = current(spark, root, table)
    if path is None:
        return empty
    found = spark.read.parquet(path)
    wanted = {f.name: f.dataType for f in empty.schema.fields}
    alike = all(f.dataType == wanted[f.name] for f in found.schema.fields if f.name in wanted)
    if not alike or "state_version" not in found.columns or not found.where(F.col("state_version") != VERSION).isEmpty():
        return empty
    return empty.unionByName(found.select("state_version", *[c for c in found.columns if c in wanted]).drop("state_version"), allowMissingColumns=True)


def save(df: DataFrame, root: str, table: str, keep: int = 2) -> str:
    """Write a new version, then a pointer to it under the next number: a reader takes the newest pointer, so it sees the
    old version or the new one, never a half and never none. A crash leaves at most an unused version. Two runs that end
    at once cannot take one number: the later one fails. Beyond the last ``keep`` versions older ones are deleted."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    before = _pointers(spark, root, table)
    df.withColumn("state_version", F.lit(VERSION)).write.parquet(f"{root}/{table}/{name}")
    fs, draft, jvm = _fs(spark, f"{root}/{table}/.draft-{name}")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/CURRENT-{before[0][0] + 1 if before else 1:012d}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{target} was written by another run")
    for _, old in before[keep - 1 :]:
        version = spark.read.text(f"{root}/{table}/{old}").first().value.strip()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{old}"), False)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{version}"), True)
    return f"{root}/{table}/{name}"


def write_files(df: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """One file for each row, written where the row is; (path, written): files that stand already stay and count as not
    written. ``root`` is a folder all executors share. Paths that climb out of it fail the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        base = os.path.realpath(root)
        for pdf in batches:
            done = []
            for p, c in zip(pdf["p"], pdf["c"]):
                full = os.path.realpath(os.path.join(base, p))
                if not full.startswith(base + os.sep):
                    raise ValueError(f"{p!r} leaves the folder")
                data = c.encode() if isinstance(c, str) else bytes(c)
                same = os.path.exists(full) and open(full, "rb").read() == data
                if not same:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    draft = f"{full}.{uuid.uuid4().hex}.tmp"
                    with open(draft, "wb") as f:
                        f.write(data)
                    os.replace(draft, full)
                done.append(not same)
            yield pd.DataFrame({"path": pdf["p"], "written": done})

    return df.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, written boolean")


def remove_files(df: DataFrame, root: str, path: str) -> DataFrame:
    """(path, removed): the files named by ``path`` deleted where the row is, with the folders that this leaves empty.
    Files that are not there count as not removed; paths that climb out of ``root`` fail the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        base = os.path.realpath(root)
        for pdf in batches:
            done = []
            for p in pdf["p"]:
                full = os.path.realpath(os.path.join(base, p))
                if not full.startswith(base + os.sep):
                    raise ValueError(f"{p!r} leaves the folder")
                try:
                    os.remove(full)
                    done.append(True)
                except FileNotFoundError:  # also after a task was repeated
                    done.append(False)
                folder = os.path.dirname(full)
                while folder != base:
                    try:
                        os.rmdir(folder)
                    except OSError:  # not empty, or gone already
                        break
                    folder = os.path.dirname(folder)
            yield pd.DataFrame({"path": pdf["p"], "removed": done})

    return df.select(F.col(path).alias("p")).mapInPandas(run, "path string, removed boolean")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root).alias("path"), "content")


def _below(root: str):
    return F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^\\Q" + root.rstrip("/") + "/\\E", "")


def listing(spark: SparkSession, root: str, pattern: str = "*.md", with_hash: bool = True) -> DataFrame:
    """(path, mtime, size[, content_hash]) of the files below ``root``; contents are read only if hashes are wanted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    out = [_below(root).alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")]
    if with_hash:
        out.append(F.substring(F.sha2(F.col("content"), 256), 1, 16).alias("content_hash"))
    return files.select(*out)
