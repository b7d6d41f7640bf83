"""Session defaults, table access and checkpoint handling."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``, else the one set for checkpoints.

    Only a session within one process, as in tests, gets a folder of this machine; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


_STORED: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``drop_stored``."""
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(drop_stored)
    _STORED.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table written to the shared folder: columns, compressed, of which a reader takes those it needs.

    Tables stay until ``drop_stored`` or the end of the driver, since results may still read them.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ONCE: dict[tuple, tuple[str, DataFrame]] = {}


def stored_once(spark: SparkSession, name: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files at ``path``, written by the first that asks for it and read by all others.

    It is made anew when the path's files have changed, by name, length or time, or when the table is gone.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = lambda p: at(p).getFileSystem(spark._jsc.hadoopConfiguration())
    files = system(path).listStatus(at(path))
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, name, path, state)
    if key not in _ONCE or not system(_ONCE[key][0]).exists(at(_ONCE[key][0])):
        df = stored(make())
        _ONCE[key] = (_STORED[-1][1], df)
    return _ONCE[key][1]


def drop_stored() -> None:
    """Deletes the tables of ``stored``; no result may read them afterwards."""
    _ONCE.clear()
    while _STORED:
        spark, path = _STORED.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
