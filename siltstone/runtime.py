"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Setting that names the shared folder for a session; ``spark.checkpoint.dir`` where it is not set.
SHARED = "spark.siltstone.shared.dir"
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def session(cores: str = "8", app: str = "siltstone") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once, as Spark sends any Python file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(_temporary()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.siltstone.shared.dir``, or ``spark.checkpoint.dir``.

    Where neither is set, a local session gets a temporary folder for its lifetime; on a
    cluster that is an error, since no folder of one machine is shared.
    """
    named = spark.conf.get(SHARED, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir, or {SHARED} on the session, to a folder that all executors share")
        named = f"file://{_temporary()}"
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads files), but keeps the
    columnar form, so that later reads prune columns and the copy is compressed. The shuffle
    files of what was written are no longer needed; Spark deletes them when the driver has
    collected their plan, which is asked for here, since a driver with little to do would keep
    them to the job's end (not of a local session, whose heap holds its tasks' data too).
    ``release`` deletes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not spark.sparkContext.master.startswith("local"):
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what ``settle`` has written for the session, once its results are used; how many folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)
