"""Cutting lineage of iterative jobs, and derived tables that several queries read."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_stored: dict[tuple, tuple] = {}
#: Seconds that each derived table took when it was last made.
made_in: dict[str, float] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a session of one machine gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", "") or _own.get(sc.applicationId, "")
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = _own[sc.applicationId] = tempfile.mkdtemp(prefix="lagloom-shared-")
    return d


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    jsc = df.sparkSession.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _state(spark: SparkSession, path: str) -> tuple | None:
    """Bytes and time of change of a file or folder, None without it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], **parameters) -> DataFrame:
    """A table derived from the files ``sources``: written to the shared folder by the first query of an application that needs it, read back by all.

    ``sources`` are all files that ``make`` reads, ``parameters`` all settings that change its
    rows. The table is made anew when a source has changed or the table is gone; the one it
    supersedes is deleted.
    """
    what = (spark.sparkContext.applicationId, name, tuple(sources), tuple(sorted(parameters.items())))
    state = [_state(spark, s) for s in sources]
    known = _stored.get(what)
    if known is None or known[0] != state or _state(spark, known[1]) is None:
        began = time.time()
        df = make()
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made_in[name] = round(time.time() - began, 3)
        _stored[what] = (state, path, df.schema)
        if known is not None:
            _delete(spark, known[1])
    _, path, schema = _stored[what]
    return spark.read.schema(schema).parquet(path)
