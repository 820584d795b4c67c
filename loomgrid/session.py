"""Session helpers: a local session for tests, table access and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOMGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own; a cluster is refused one that its executors don't share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgrid-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Write a frame to the checkpoint folder and read it from there: later passes see the same rows and partitions."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager)


def written(frame: DataFrame) -> DataFrame:
    """A frame as a table written to the checkpoint folder, in columns: what several passes read is made once and survives lost executors. It is deleted by ``release``, or when the program ends."""
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/loomgrid-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(release, spark)
    _tables.append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Folders written by this program and not yet deleted.
_tables: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes all tables written so far; frames made of them can't be read any more."""
    if not _tables or spark.sparkContext._jsc is None:
        return
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(_tables[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        while _tables:
            files.delete(path(_tables.pop()), True)
    except Exception:  # the session is gone: its folder is the cluster's to clean
        _tables.clear()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_loomgrid_shipped", False):
        return
    home = pathlib.Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="loomgrid-package-"), "loomgrid.zip")  # on the driver; its file server hands it out
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    context.addPyFile(archive)
    context._loomgrid_shipped = True
