"""Aggregated tables fed by a stream: a small folder per micro-batch, folded now and then.

Micro-batch ``N`` adds ``<root>/delta/epoch=N``: its own rows, aggregated. Every ``fold_every``
micro-batches the table so far is folded into ``<root>/base/upto=N``. A reader takes the newest complete
base and the deltas after it, so it opens a bounded number of folders however long the stream runs, and
a micro-batch writes what it brought, not the table.

A replayed micro-batch replaces its own delta (or one that a base already holds, which no reader takes),
and a base without its ``_SUCCESS`` file is not read, so the table is exact after any failure. Folders
that a reader of the last base may still be reading are kept until the next fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored_bytes, tasks_for

#: Micro-batches between two folds.
FOLD_EVERY = 16


def _located(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _located(spark, name)
    return fs.exists(path)


def remove(spark: SparkSession, name: str) -> None:
    fs, path = _located(spark, name)
    fs.delete(path, True)


def folder_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root``; none if there is no such folder."""
    fs, path = _located(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def numbered(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the complete folders ``<root>/<name>=<number>``, ascending."""
    found = [f for f in folder_names(spark, root) if re.fullmatch(rf"{name}=\d+", f)]
    return sorted(int(f.split("=")[1]) for f in found if exists(spark, f"{root}/{f}/_SUCCESS"))


def claim(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Tie a sink to the checkpoint that numbers its micro-batches: another checkpoint would start at 0 again
    and replace what is there, so it is refused."""
    name = f"{root.rstrip('/')}/stream"
    if exists(spark, name):
        owner = spark.read.schema("checkpoint string").json(name).first()
        if owner and owner[0] != checkpoint:
            raise ValueError(f"{root} belongs to the stream of {owner[0]}")
    spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1).write.mode("overwrite").json(name)


@dataclass
class EpochTable:
    """A table of ``keys`` and values, each with the aggregate that joins partial values (``F.sum``, ``F.max``)."""

    spark: SparkSession
    root: str
    schema: StructType
    keys: list[str]
    merge: dict[str, Callable[[Column], Column]]
    fold_every: int = FOLD_EVERY

    def _merged(self, rows: DataFrame, n_bytes: int) -> DataFrame:
        """A task holds the groups of its share of the rows, whatever the size of a scan split."""
        dealt = rows.repartition(tasks_for(self.spark, n_bytes), *self.keys)
        return dealt.groupBy(*self.keys).agg(*[fn(F.col(c)).alias(c) for c, fn in self.merge.items()])

    def _folders(self, upto: int | None = None) -> tuple[int, list[str]]:
        """The newest base's number (-1: none), and the folders that make up the table (up to a micro-batch)."""
        within = lambda n: upto is None or n <= upto
        base = max(filter(within, numbered(self.spark, f"{self.root}/base", "upto")), default=-1)
        deltas = [n for n in numbered(self.spark, f"{self.root}/delta", "epoch") if n > base and within(n)]
        return base, ([f"{self.root}/base/upto={base}"] if base >= 0 else []) + [f"{self.root}/delta/epoch={n}" for n in deltas]

    def read(self, upto: int | None = None) -> DataFrame:
        folders = self._folders(upto)[1]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self.spark.read.schema(self.schema).parquet(*folders), sum(stored_bytes(self.spark, f) for f in folders))

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Add a micro-batch's aggregated rows; fold when enough deltas lie after the base."""
        rows.write.mode("overwrite").parquet(f"{self.root}/delta/epoch={epoch}")
        base, folders = self._folders(epoch)
        if len(folders) - (base >= 0) >= self.fold_every:
            self.fold(epoch)

    def fold(self, upto: int) -> None:
        last = self._folders(upto)[0]
        if last == upto:
            return
        self.read(upto).write.mode("overwrite").parquet(f"{self.root}/base/upto={upto}")
        for n in numbered(self.spark, f"{self.root}/delta", "epoch"):
            if n <= last:
                remove(self.spark, f"{self.root}/delta/epoch={n}")
        for n in numbered(self.spark, f"{self.root}/base", "upto"):
            if n < last:
                remove(self.spark, f"{self.root}/base/upto={n}")
