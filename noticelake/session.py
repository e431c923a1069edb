"""Session settings the jobs rely on, and the place lineage cuts are written to."""

from __future__ import annotations

import contextlib
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "noticelake") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        # local data is small but the work per row is not: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # one-file tables are one scan task: joining them by shuffle gives the later steps all cores
        .config("spark.sql.autoBroadcastJoinThreshold", "512k")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a temporary folder: on a cluster a machine-local
    folder would lose the checkpoint together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="noticelake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, for tables a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action inside go when it ends, not when the driver next collects its garbage.

    For jobs whose steps are written and read again. A frame executed twice inside shuffles twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def kept(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows, written to a scratch folder and read from there: packed, unlike a checkpoint, and gone after the block."""
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        rows.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application (like --py-files)."""
    sc = spark.sparkContext
    if getattr(sc, "_noticelake_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="noticelake-package-")) / package.name
    sc.addPyFile(shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name))
    sc._noticelake_shipped = True
