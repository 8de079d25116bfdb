"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_on_release: list[Callable[[str], None]] = []


def build_session(app: str = "lastleg", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# Settings the jobs rely on.
#  - Timestamps carry no zone: the session is UTC.
#  - The JVM compiles no method above 8000 bytes. Wide projections fused into one larger
#    method would run interpreted, several times slower than unfused.
#  - Files written by pandas may hold nanosecond timestamps; the reader turns them back.
#  - Adaptive execution splits skewed shuffle partitions, also below an aggregate.
#  - What a finished query has shuffled is deleted at once, not when the driver happens to collect its garbage.
#  - A task reads or is dealt a bounded share of a table, so that what it sorts fits its memory at any size of the input.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
}
INPUT_PER_PARTITION = 4 * 2**20


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the results and the plans depend on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def deal(spark: SparkSession, input_bytes: int) -> None:
    """Cut shuffles into more partitions for a larger input; adaptive execution joins what turns out small."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-input_bytes // INPUT_PER_PARTITION))))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="lastleg-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[sc.applicationId] = path
    return _local_dirs[sc.applicationId]


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the program's folder.

    It is enough where workers see that folder; elsewhere ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage, in the folder the session names."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lastleg/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def on_release(forget: Callable[[str], None]) -> None:
    """Have ``forget(application id)`` called when an application's stored tables are deleted."""
    _on_release.append(forget)


def path_exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Number and bytes of the files below the paths, and a hash of their names, sizes and times. Executors list them; no file is opened."""
    there = [p for p in paths if path_exists(spark, p)]
    if not there:
        return (0, 0, None)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.sum(each)).first())


def delete_path(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def release_stages(spark: SparkSession) -> None:
    """Delete what this application stored in the shared folder, and forget the tables and models over it."""
    application = spark.sparkContext.applicationId
    delete_path(spark, f"{shared_dir(spark)}/lastleg/{application}")
    for forget in _on_release:
        forget(application)


def stage(df: DataFrame, name: str, folders_by: str | None = None, path: str | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage for tables with several consumers: each of them then scans only the
    columns it needs, and a lost executor costs a re-read instead of a recomputation.
    ``folders_by`` makes one folder for each value of a column, so filters on it skip files;
    a rebalance splits a hot value over several files and merges small partitions. Rows that were ``dealt`` by it already stay where they are.
    """
    spark = df.sparkSession
    path = path or new_stage_path(spark, name)
    if folders_by:
        (df if dealt else df.hint("rebalance", folders_by)).write.mode("overwrite").partitionBy(folders_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
