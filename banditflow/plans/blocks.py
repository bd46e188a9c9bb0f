"""Tables of a replay by name and block, with a manifest of finished blocks.

A replay writes what a block produced (decisions and state of each stage, graph, counts) under one folder and
then a manifest row with the block's totals.  A block without that row does not count: a replay that was
killed starts again after the last block that has one, and overwrites whatever the broken block left.  State and
graph of earlier blocks go once a later block is finished; decisions and counts stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.session import ensure_checkpoint_dir

MANIFEST = "block int, stage string, rounds long, reward double"


class BlockTables:
    """Written tables ``<folder>/<name>/block=<n>`` and the manifest beside them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/replays/{uuid.uuid4().hex}").rstrip("/")

    # files --------------------------------------------------------------------
    def _path(self, name: str, block: int | None = None) -> str:
        return f"{self.folder}/{name}" if block is None else f"{self.folder}/{name}/block={block}"

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def has(self, name: str, block: int | None = None) -> bool:
        fs, where = self._at(self._path(name, block) + "/_SUCCESS")
        return fs.exists(where)

    def drop(self, name: str, block: int | None = None) -> None:
        fs, where = self._at(self._path(name, block))
        fs.delete(where, True)

    def names(self) -> list[str]:
        """Tables there are, as ``name/block=n``."""
        fs, root = self._at(self.folder)
        out = []
        for table in fs.listStatus(root) if fs.exists(root) else []:
            for part in fs.listStatus(table.getPath()):
                if part.getPath().getName().startswith("block="):
                    out.append(f"{table.getPath().getName()}/{part.getPath().getName()}")
        return sorted(out)

    # tables -------------------------------------------------------------------
    def write(self, name: str, df: DataFrame, block: int | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
        """Write and read back; ``parts`` become folders, so that one of them can be dropped alone."""
        path = self._path(name, block)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: T.StructType | str, block: int | None = None) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name, block))

    def load(self, name: str, block: int | None = None) -> DataFrame:
        """Read with the schema of the files."""
        return self.spark.read.parquet(self._path(name, block))

    def latest(self, name: str, block: int) -> int | None:
        """The last block up to ``block`` that wrote the table."""
        return next((b for b in range(block, -1, -1) if self.has(name, b)), None)

    def blocks(self, name: str) -> list[int]:
        """The blocks that wrote the table, in order."""
        fs, where = self._at(self._path(name) + "/block=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(where) or [])

    # manifest -----------------------------------------------------------------
    def finished(self) -> int:
        """The last block that is finished, -1 if none is."""
        if not self.blocks("manifest"):
            return -1
        return int(self.manifest().agg(F.max("block")).first()[0])

    def finish(self, block: int, totals: list[tuple[str, int, float]]) -> None:
        row = F.explode(F.array(*[
            F.struct(F.lit(block).alias("block"), F.lit(stage).alias("stage"), F.lit(rounds).cast("long").alias("rounds"), F.lit(reward).alias("reward"))
            for stage, rounds, reward in totals
        ]))
        self.spark.range(1).select(row.alias("r")).select("r.*").coalesce(1).write.mode("overwrite").parquet(self._path("manifest", block))

    def finish_many(self, last: int, totals: DataFrame) -> None:
        """Blocks played together, up to ``last``: ``totals`` has a manifest row for each."""
        kinds = T.StructType.fromDDL(MANIFEST)
        rows = totals.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
        rows.coalesce(1).write.mode("overwrite").parquet(self._path("manifest", last))

    def manifest(self) -> DataFrame:
        """block, stage, rounds, reward of the finished blocks."""
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(self._path("manifest"))


class Totals:
    """Rounds and reward of a fold, observed while its output is written."""

    def __init__(self):
        self._seen = Observation()

    def watch(self, out: DataFrame) -> DataFrame:
        played = F.col("_kind") == 1
        return out.observe(
            self._seen, F.count(F.when(played, 1)).alias("rounds"), F.coalesce(F.sum(F.when(played, F.col("reward"))), F.lit(0.0)).alias("reward")
        )

    def row(self, stage: str) -> tuple[str, int, float]:
        got = self._seen.get
        return stage, int(got["rounds"]), float(got["reward"])
