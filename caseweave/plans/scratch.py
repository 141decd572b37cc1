"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage, survives the loss of any executor and is computed once, so loops and
tables that are read more than once use it in place of caching.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []
_scopes: list[list] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-caseweave-"))
    return _own_dir[0]


@contextmanager
def _files_removed_after_write(spark: SparkSession):
    """The shuffle files of a finished write are of no more use; without this they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Writes tables to the shared folder and reads them back.

    ``drop`` removes tables that no later plan reads, ``keep_only`` all but the given ones. Tables that the returned result still reads stay; ``scope`` clears them too.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []  # held, so that their ids stay theirs
        for made in _scopes:
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/caseweave-{uuid.uuid4().hex}"
        with _files_removed_after_write(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._remove([self.paths.pop(id(df)) for df in tables if id(df) in self.paths])

    def keep_only(self, *tables: DataFrame) -> None:
        kept = {id(df) for df in tables}
        self._remove([self.paths.pop(key) for key in list(self.paths) if key not in kept])

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope():
    """Removes, at its end, every table that was written inside: for results that were written elsewhere meanwhile."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for scratch in made:
            scratch.keep_only()


def numbered(nodes: DataFrame, buckets: int = 64) -> DataFrame:
    """``nodes`` (node) with places 0, 1, 2, ...; the driver sees a count for each of the buckets."""
    dealt_out = nodes.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"))
    counts = dict(dealt_out.groupBy("bucket").count().collect())
    before = F.array(*[F.lit(sum(counts.get(j, 0) for j in range(i))) for i in range(buckets)])
    return dealt_out.select("node", (F.element_at(before, F.col("bucket") + 1) + F.row_number().over(Window.partitionBy("bucket").orderBy("node")) - 1).cast("int").alias("place"))
