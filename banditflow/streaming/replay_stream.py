"""The replays as a Structured Streaming query.

Rounds arrive in any order and in any micro-batches.  ``foreachBatch`` puts a micro-batch into an inbox,
partitioned by block; a block whose rounds are all there is played with the batch replay's own block step
(``plans.two_stage.play_block``: users in lockstep, graph refresh, cluster fold), starting from the state the
block before left.  Without clusters, blocks that became whole with the same micro-batch are played by one fold.  The user state is in tables and not in a stateful operator, because the cluster
fold of a block updates the same state after the graph was refreshed.

Restart: the query's checkpoint replays an unfinished micro-batch under the same id, its inbox folder is
overwritten, and the manifest of blocks says which block comes next.  A round that is delivered twice
counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banditflow.config import ReplayConfig
from banditflow.operators import state as S
from banditflow.plans.blocks import BlockTables
from banditflow.plans.two_stage import ReplayResult, play_block, play_user_blocks, replayed, state_after
from banditflow.session import ensure_checkpoint_dir

COLUMNS = ("round_id", "user_id", "arms")


class ReplayStream:
    """A replay fed by a stream; ``folder`` holds its inbox, tables and offsets, and is where it starts again.

    ``users`` (user_id) is the initial state: everybody starts from (I, 0, 0) and the graph from complete.
    ``clusters=False`` plays all rounds by user (F1 alone).
    """

    def __init__(self, spark: SparkSession, folder: str, cfg: ReplayConfig, k: int, d: int, users: DataFrame | None = None, clusters: bool = True):
        self.spark, self.folder, self.cfg, self.k, self.d, self.clusters = spark, folder.rstrip("/"), cfg, k, d, clusters
        self.tables = BlockTables(spark, f"{self.folder}/tables")
        if not self.tables.has("users"):
            self.tables.write("users", S.init_state(users, d))

    # stream ------------------------------------------------------------------
    def start(self, rounds: DataFrame) -> StreamingQuery:
        """``rounds``: a streaming table of round_id (dense from 0), user_id, arms, rewards (or label)."""
        value = "label" if self.cfg.reward == "label" else "rewards"
        return (
            rounds.select(*COLUMNS, value).writeStream.foreachBatch(self._arrived)
            .option("checkpointLocation", f"{self.folder}/offsets").start()
        )

    def _arrived(self, batch: DataFrame, batch_id: int) -> None:
        block = F.floor(F.col("round_id") / self.cfg.iteration_length).cast("int")
        batch.withColumn("block", block).write.mode("overwrite").partitionBy("block").parquet(f"{self.folder}/inbox/batch={batch_id}")
        self._play_ready()

    def _inbox(self) -> DataFrame | None:
        """Rounds that arrived and are not played, of all blocks."""
        fs, where = self.tables._at(f"{self.folder}/inbox/batch=*/block=*")
        if not fs.globStatus(where):
            return None
        kept = self.spark.read.option("basePath", f"{self.folder}/inbox").parquet(f"{self.folder}/inbox/batch=*")
        return kept.where(F.col("block") > self.tables.finished())

    def _whole(self, inbox: DataFrame, n_rounds: int | None) -> dict[int, bool]:
        """The blocks from the next one on that are whole, in order, and whether a round came twice; one pass over narrow columns."""
        length, blk = self.cfg.iteration_length, self.tables.finished() + 1
        sizes = inbox.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("round_id").alias("there"))
        sizes = {r.block: (r.rows, r.there) for r in sizes.collect()}
        whole = {}
        while blk in sizes and (n_rounds is None or blk * length < n_rounds):
            rows, there = sizes[blk]
            if there < self._end(blk, n_rounds) - blk * length:
                break
            whole[blk] = rows > there
            blk += 1
        return whole

    def _end(self, blk: int, n_rounds: int | None) -> int:
        end = (blk + 1) * self.cfg.iteration_length
        return end if n_rounds is None else min(end, n_rounds)

    def _play_ready(self, n_rounds: int | None = None) -> None:
        """Play the blocks that are whole, from the next one on (``n_rounds``: the stream has ended after so many).

        Without clusters nothing happens between two blocks, so those that became whole together are played by one
        fold; with clusters block by block.
        """
        inbox = self._inbox()
        whole = {} if inbox is None else self._whole(inbox, n_rounds)
        if not whole:
            return
        runs = [[blk] for blk in whole] if self.clusters else [list(whole)]
        for run in runs:
            rounds = inbox.where(F.col("block").between(run[0], run[-1])).drop("block", "batch")
            if any(whole[blk] for blk in run):
                rounds = rounds.dropDuplicates(["round_id"])
            self._play(run[0], run[-1], rounds, n_rounds)

    def _play(self, blk: int, last: int, rounds: DataFrame, n_rounds: int | None) -> None:
        """Blocks ``blk`` to ``last``; more than one only without clusters."""
        t1, t2 = blk * self.cfg.iteration_length, self._end(last, n_rounds)
        state = state_after(self.tables, blk - 1, self.cfg, self.k, self.d) if blk else self.tables.load("users")
        if not self.clusters:
            play_user_blocks(self.tables, blk, last, state, rounds, self.cfg, self.k, self.d)
            return
        mid = min(t1 + self.cfg.user_rounds, t2)
        first, second = rounds.where(F.col("round_id") < mid), rounds.where(F.col("round_id") >= mid)
        play_block(
            self.tables, blk, t1, t2, state, first if mid > t1 else None, second if t2 > mid else None,
            self.cfg, self.k, self.d,
        )

    # result ------------------------------------------------------------------
    def finish(self, n_rounds: int) -> ReplayResult:
        """The stream has ended: play what is left, a last short block too."""
        self._play_ready(n_rounds)
        n_blocks = -(-n_rounds // self.cfg.iteration_length)
        if self.tables.finished() + 1 < n_blocks:
            raise ValueError(f"rounds of block {self.tables.finished() + 1} are missing")
        return replayed(self.tables, n_blocks, self.cfg, self.k, self.d, clusters=self.clusters)


def run_stream(
    spark: SparkSession, log: DataFrame, cfg: ReplayConfig, k: int, d: int, clusters: bool = True,
    files: int = 16, files_a_batch: int = 4, folder: str | None = None,
) -> ReplayResult:
    """Feed a log through ``ReplayStream``: written once as ``files`` files, ``files_a_batch`` a micro-batch."""
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    source = f"{folder}/source"
    value = "label" if cfg.reward == "label" else "rewards"
    log.select(*COLUMNS, value).repartitionByRange(files, "round_id").write.mode("overwrite").parquet(source)
    written = spark.read.parquet(source)
    stream = ReplayStream(spark, folder, cfg, k, d, written.select("user_id").distinct(), clusters)
    query = stream.start(spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.finish(int(written.agg(F.max("round_id")).first()[0]) + 1)
