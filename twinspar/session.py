"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_session(app: str = "twinspar", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow; settings given outside stay."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g")  # all of Spark is in the driver there
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where none is set in local mode (tests) a temporary one is made. On a cluster without it this raises: a folder of one
    machine would not be seen by the others."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"twinspar-{uuid.uuid4().hex[:12]}")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut: written once as Parquet into the shared folder and read again.

    All executors see that folder, so a lost executor loses nothing. Spark knows the size of what was written, so a
    later join broadcasts it only if it is small. `forget` or the end of the process removes the files.
    """
    spark = df.sparkSession
    where = scratch(spark, "cut")
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._cut_at = where
    return out


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed at the end of the process."""
    where = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(forget_all)
    _WRITTEN[where] = spark
    return where


def forget(df: DataFrame) -> None:
    """Remove the files behind a table made by `cut`; nothing may read it afterwards."""
    where = getattr(df, "_cut_at", None)
    if where and _WRITTEN.pop(where, None):
        _remove(df.sparkSession, where)


def _remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_all() -> None:
    """Remove all that `cut` has written, as far as sessions are still there."""
    for where, spark in list(_WRITTEN.items()):
        try:
            _remove(spark, where)
        except Exception:  # noqa: BLE001 - the session is gone
            pass
    _WRITTEN.clear()


#: Inputs with more bytes than this for each core are cut into enough tasks by their files.
SPREAD_BELOW = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df with a partition for each core: for work that costs far more than moving its input, when a small file would give it to one task.

    The size is that of the files below the plan, which the optimizer knows; nothing is run. Larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * SPREAD_BELOW else df


_SCHEMAS: dict[tuple, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder. Its schema is read from the files once, and again when the files have changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (f"{sf_dir}/{name}", state.getModificationTime(), state.getLen())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.read.schema(_SCHEMAS[key]).parquet(f"{sf_dir}/{name}.parquet")
