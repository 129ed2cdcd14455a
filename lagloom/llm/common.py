"""Shared helpers: table reading, staging in the shared folder, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_sent: set[tuple[str, str]] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that task functions import there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        out = os.path.join(tempfile.mkdtemp(prefix="lagloom-"), "lagloom.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        p = os.path.join(folder, n)
                        z.write(p, os.path.join("lagloom", os.path.relpath(p, top)))
        sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's to the executors, once per application; tasks find it by its name."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine gets a temporary folder; on a
    cluster it is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", "") or _own.get(sc.applicationId, "")
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = _own[sc.applicationId] = tempfile.mkdtemp(prefix="lagloom-shared-")
    return d


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more, and let Spark drop shuffle files of jobs that are done."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/lagloom-" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()  # shuffle files go with the driver's last reference to them


def sample_of(df: DataFrame, key: str, n: int, *columns: str) -> list:
    """``columns`` of the ``n`` rows of least key hash, one row for each key.

    Keys are picked first, so that no task sends more than ``n`` keys, and the driver
    gets at most ``n`` rows.
    """
    picked = df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)
    rows = df.join(F.broadcast(picked), key, "left_semi").select(key, *columns)  # n keys at most
    least = F.min_by(F.struct(*columns), F.xxhash64(*columns))
    return [r.v for r in rows.groupBy(key).agg(least.alias("v")).select("v", F.xxhash64(key).alias("r"), key).orderBy("r", key).collect()]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table.

    Returns (id, component) for every id that occurs in an edge between two
    different ids; component is the smallest id reachable. Label propagation
    with pointer jumping; each round is one staged table, nothing is collected
    but the number of labels that changed.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    sym = stage(e.union(e.select("b", "a")).distinct(), "edges")
    lab = stage(sym.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        seen = sym.join(lab.hint("shuffle_merge"), sym.b == lab.id).groupBy("a").agg(F.min("component").alias("seen"))
        low = lab.join(seen.hint("shuffle_merge"), lab.id == seen.a).select(
            "id", F.col("component").alias("old"), F.least("component", "seen").alias("component")
        )
        low = stage(low, "labels")
        up = low.select(F.col("id").alias("pid"), F.col("component").alias("up"))
        new = low.join(up.hint("shuffle_merge"), low.component == up.pid).select(
            "id", "old", F.least("component", "up").alias("component")
        )
        new = stage(new, "labels")
        changed = new.filter("component <> old").limit(1).count()
        unstage(low)
        unstage(lab)
        lab = new.select("id", "component")
        if not changed:
            unstage(sym)
            return lab
