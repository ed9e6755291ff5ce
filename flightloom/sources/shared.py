"""The folder that all executors share, for what is written on the way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder already set. Where the session names none, a temporary folder of this
    machine if all tasks run on it, as in tests; else there is none to share, and an error says so."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="flightloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of this process in the shared one, not yet made, which goes when the process ends."""
    return delete_at_exit(spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


_TO_DELETE: list[tuple[SparkSession, str]] = []


def delete_at_exit(spark: SparkSession, folder: str) -> str:
    """Marks a folder that only this process reads: results are lazy, so it has to stay until then, and no longer."""
    if not _TO_DELETE:
        atexit.register(_delete_all)
    _TO_DELETE.append((spark, folder))
    return folder


def _delete_all() -> None:
    while _TO_DELETE:
        spark, folder = _TO_DELETE.pop()
        try:
            remove_folder(spark, folder)
        except Exception:  # noqa: BLE001  the session may be gone, and its store with it: then the folder stays
            return


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark can write to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there: cuts lineage, outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
