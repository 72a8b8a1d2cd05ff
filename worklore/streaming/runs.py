"""A table kept as few runs: each batch adds one, runs of like size are merged.

A manifest, one small file per batch, names the runs that make up the tables
as of that batch.  It is written last, as one file, so a batch that stops on
the way leaves the earlier state readable and is loaded again as a whole.  A
run is merged with the ones before it as long as those are at most ``RATIO``
times as long, so the number of runs, and how often a row is written again,
grow with the logarithm of the number of batches.  Runs that no longer belong
to the newest manifest stay for readers of an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATIO = 2
_MANIFEST = "name string, folder string, first long, last long, rows long, version long"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


@dataclass(frozen=True)
class Run:
    """Rows of the batches ``first`` to ``last`` of one table."""

    name: str
    folder: str
    first: int
    last: int
    rows: int


@dataclass
class Runs:
    """Tables under ``base``; ``folds`` has, by table, how rows of several runs become one run's rows."""

    spark: SparkSession
    base: str
    folds: dict[str, Callable[[DataFrame], DataFrame]]

    def _manifests(self) -> DataFrame | None:
        path = f"{self.base}/manifest"
        return self.spark.read.schema(_MANIFEST).parquet(path) if exists(self.spark, path) else None

    def done(self, batch: int) -> bool:
        """Whether this batch is part of the tables."""
        rows = self._manifests()
        return rows is not None and not rows.filter(F.col("version") == batch).isEmpty()

    def of(self, name: str, batch: int) -> list[Run]:
        """The runs of a table as of the newest manifest before ``batch``, oldest first."""
        rows = self._manifests()
        if rows is None:
            return []
        # a manifest has a few rows per table
        before = rows.filter(F.col("version") < batch)
        newest = before.join(before.agg(F.max("version").alias("version")), "version").filter(F.col("name") == name).collect()
        return sorted((Run(r.name, r.folder, r.first, r["last"], r.rows) for r in newest), key=lambda r: r.first)

    def read(self, name: str, batch: int) -> DataFrame | None:
        """All rows of a table before ``batch``; None if there are none."""
        runs = self.of(name, batch)
        return self._rows(runs) if runs else None

    def _rows(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.base}/{r.folder}" for r in runs])

    def _written(self, rows: DataFrame, name: str, first: int, last: int) -> Run:
        folder = f"{name}/run-{first}-{last}"
        rows.write.mode("overwrite").parquet(f"{self.base}/{folder}")
        # a count of a file just written reads its footers alone
        return Run(name, folder, first, last, self.spark.read.parquet(f"{self.base}/{folder}").count())

    def add(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """This batch's rows, by table, become part of the tables, all or none."""
        runs = []
        for name, rows in tables.items():
            own = [*self.of(name, batch), self._written(rows.withColumn("batch", F.lit(batch).cast("long")), name, batch, batch)]
            tail, total = 1, own[-1].rows
            while tail < len(own) and own[-tail - 1].rows <= RATIO * total:
                total += own[-tail - 1].rows
                tail += 1
            if tail > 1:
                own[-tail:] = [self._written(self.folds[name](self._rows(own[-tail:])), name, own[-tail].first, batch)]
            runs += own
        self._swap(batch, runs)

    def _swap(self, batch: int, runs: list[Run]) -> None:
        rows = self.spark.createDataFrame([(r.name, r.folder, r.first, r.last, r.rows) for r in runs], _MANIFEST.removesuffix(", version long"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/version={batch}")
