"""Session building, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "notewright") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables that cut the lineage of iterative jobs.

    They go below the folder named by ``spark.checkpoint.dir``, which all executors of a cluster share, so
    that a lost executor loses none of them. Only where that setting is absent on a local master (tests) is
    a temporary folder taken. A job drops what nothing reads any more; what is left when the program ends goes then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "notewright-scratch")
        self.root = f"{base.rstrip('/')}/notewright-{uuid.uuid4().hex}"
        self._live: set[str] = set()
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, partitions: int | None = None, total: str | None = None) -> DataFrame:
        """Write ``df`` and return it read back, free of lineage; its rows are counted, and ``total`` summed, as it is
        written."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        seen = Observation()
        sums = [F.sum(total).alias("total")] if total else []
        (df.coalesce(partitions) if partitions else df).observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.parquet(path)
        self._live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._notewright_path = path  # type: ignore[attr-defined]
        out._notewright_rows = seen.get["rows"]  # type: ignore[attr-defined]
        out._notewright_total = seen.get["total"] if total else None  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete saved tables that nothing reads any more."""
        for path in {getattr(df, "_notewright_path", None) for df in tables} & self._live:
            self._live.discard(path)
            _delete(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """Write a job's result and delete every other table of this scratch."""
        out = self.save(df)
        for path in self._live - {out._notewright_path}:
            _delete(self.spark, path)
        self._live = {out._notewright_path}
        return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:  # the session has ended: its shared folder is cleared with it
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Py4JError:  # the JVM is gone
        pass


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no row; one that was saved is known without reading it."""
    rows = getattr(df, "_notewright_rows", None)
    return rows == 0 if rows is not None else len(df.head(1)) == 0
