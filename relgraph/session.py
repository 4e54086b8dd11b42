"""Session settings and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "relgraph", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RELGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master, where every task sees the driver's disk, may fall back to a
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    # the setting can't be changed in a running session, so the folder is kept here
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="relgraph-checkpoints-")
    return _local_folders[app]


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A path in the shared folder for a table that is read inside the block only, and removed after it."""
    path = f"{shared_dir(spark)}/relgraph-scratch/{name}"
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Bytes of the row groups of tables whose rows are tens of kilobytes and more; a reader holds thousands of rows of a group at once.
SMALL_GROUP = 1 << 20


def compressed(df: DataFrame, path: str, group: int | None = None) -> DataFrame:
    """``df`` written to ``path`` as a compressed table; for wide rows, which a checkpoint writes as they lie in memory.

    ``group`` bounds the compressed bytes of a row group, checked after each row.
    """
    sizes = {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group else {}
    df.write.option("compression", "zstd").options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
