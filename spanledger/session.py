"""Session helpers: the shared folder, written intermediate tables and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from io import BytesIO
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def local_session(cores: str = "8", app: str = "spanledger") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPANLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine.

    A cluster must name the folder; only a local[...] master gets one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spanledger-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return "file://" + _OWN_DIRS[app]


def materialize(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a frame that reads it.

    Cuts the lineage so that a lost executor costs at most the stages after this table. The table is
    dropped when the driver ends, whether or not its session was stopped before, or earlier by release() or temporary_tables().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _drop_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanledger_path = path
    return out


def scratch(df: DataFrame, label: str, form: str) -> str:
    """Write df in some format below the shared folder, to be read back by a reader under test of that format; dropped with the others."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.format(form).save(path)
    _drop_later(df.sparkSession, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    files, p = _file_system(spark, path)
    return files.exists(p)


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_spanledger_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """The intermediate tables of the queries run inside are dropped at its end: for drivers that run for long.

    What a query returns reads those tables, so write or collect it inside.
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        mine = _WRITTEN[before:]
        del _WRITTEN[before:]
        for path in mine:
            _delete(spark, path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _drop_later(spark: SparkSession, path: str) -> None:
    """Registered with the file system of the driver's JVM, which outlives spark.stop() and deletes what is left when it ends."""
    _WRITTEN.append(path)
    files, p = _file_system(spark, path)
    files.deleteOnExit(p)


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _file_system(spark, path)
    files.delete(p, True)
    files.cancelDeleteOnExit(p)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, so that their Python workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    held = BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    folder = shared_dir(spark).removeprefix("file://")
    if folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    if "://" in folder:
        return  # an object store: the package comes with --py-files or an installation
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"spanledger-{uuid.uuid4().hex}.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    atexit.register(path.unlink, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
