"""Session helpers: building a local session for tests and cutting lineage.

On a cluster the session comes from the caller; nothing here overrides its
settings.  The only thing we add is a checkpoint directory, and only when the
session has none (``spark.checkpoint.dir`` unset), which is the test case.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


_REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _export_package_path() -> None:
    """Python workers of a local session import this package from the repo root.

    (On a cluster ship the package with ``--py-files`` / ``spark.submit.pyFiles``.)
    """
    parts = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO_ROOT not in parts:
        os.environ["PYTHONPATH"] = os.pathsep.join([_REPO_ROOT, *parts])


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "banditflow") -> SparkSession:
    """Session used by tests, the bench and the driver contract."""
    _export_package_path()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint directory.

    Reads ``spark.checkpoint.dir`` (the shared folder a cluster names); only
    when it is unset and the master is local -- tests -- a fresh private folder
    is created.  (``local-cluster`` counts as a cluster.)
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="banditflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write the table under the checkpoint directory and read it back.

    Used between the blocks of the iterative replays, in the connected
    components loop, and for fold outputs that are read twice (decisions and
    state come out of one fold run).  A written Parquet table survives executor
    loss like a reliable checkpoint, and -- unlike ``Dataset.checkpoint``, which
    carries the source plan's size estimate along -- the re-read plan is sized
    by its files, so size estimates do not compound over iterations.  ``by``
    clusters the table by ranges of a column, so that a later range filter on it
    reads only the files and row groups it needs.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    if by is not None:
        df = df.repartitionByRange(by).sortWithinPartitions(by)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    return out


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A materialized table and its number of rows (read from the footers of its files)."""
    out = materialize(df)
    return out, out.count()


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_materialized_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            df._materialized_path = None
