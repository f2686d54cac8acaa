"""Session, checkpoint and broadcast helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors' Python workers.

    Python code on the executors refers to this package, so it is zipped once per application and added with
    ``addPyFile`` (Spark distributes it to every executor).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="cxpulse-pkg-")
    archive = shutil.make_archive(os.path.join(tmp, "cxpulse"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "cxpulse",
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (a cluster provides its own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def configure(spark: SparkSession) -> SparkSession:
    """Settings the engine relies on; applied to whatever session the caller owns."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # row_number() <= k is cut on the map side whatever k is (Spark's default stops at 1000)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(2 ** 31 - 1))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="cxpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    checkpoint_dir(spark or df.sparkSession)
    return df.checkpoint(eager=True)


#: tables written by `materialize_table` and not yet dropped, by application
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, listed by `scratch_tables`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cxpulse-{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize_table(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used for a large intermediate read by several later passes: the readers
    get column pruning and compression, and a lost executor never forces the
    producing pass to run again.  `scratch_tables` lists what was written,
    `drop_scratch` removes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # an empty partitioned table has no file to read it from


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables this application has written and not dropped."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove intermediate tables (all of them by default); frames that still read them become unusable."""
    kept = _SCRATCH.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(kept) if paths is None else paths:
        if path in kept:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            kept.remove(path)
