"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with the settings that the engine is tuned for."""
    return (
        SparkSession.builder.master(master)
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder of its own; on a
    cluster a missing setting is an error, for a folder of one machine would be lost with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _OWN:
        atexit.register(_remove_own)
    _OWN.append((spark, path))
    return path


def _remove_own() -> None:
    for spark, path in _OWN:
        try:
            remove_path(spark, path)
        except Exception:  # the session may have ended before
            local = path.removeprefix("file://")
            if os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table", tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage like ``checkpoint()``, survives the loss of executors, and stays columnar,
    so that later stages read only the columns they need. With ``tidy`` the shuffle files of the
    write go as soon as it ends instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, str(tidy or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_path(table.sparkSession, path)
