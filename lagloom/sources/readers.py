"""Sources and sinks: inventories, alias resolution, segments, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names by which a coordinate or variable is known.
ALIASES = {
    "ts": ("time", "valid_time", "date", "datetime"),
    "lat": ("lat", "latitude", "y", "nav_lat"),
    "lon": ("lon", "longitude", "x", "nav_lon"),
    "node": ("node", "nodes", "point", "points", "gridpoint", "location", "station"),
    "temperature": ("temperature", "temp", "t", "t2m", "t850", "air_temperature", "2m_temperature"),
    "humidity": ("specific_humidity", "humidity", "q", "q850", "rh", "relative_humidity"),
    "wind": ("wind", "wind_speed", "windspeed", "speed", "wspd"),
    "cloud_cover": ("cloud_cover", "total_cloud_cover", "tcc", "cloud", "cc", "cloud_fraction"),
    "u": ("u", "u10", "u850", "u_component", "u_wind", "eastward_wind"),
    "v": ("v", "v10", "v850", "v_component", "v_wind", "northward_wind"),
}


def resolve(columns: list[str], more: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Canonical name to column: exact matches first, then by substring for aliases of three letters and more. ``more`` adds aliases."""
    plain = {c: "".join(x for x in c.lower() if x.isalnum()) for c in columns}
    names = {n: (*(more or {}).get(n, ()), *ALIASES.get(n, ())) for n in [*ALIASES, *(n for n in more or {} if n not in ALIASES)]}
    found: dict[str, str] = {}
    for exact in (True, False):
        for name, aliases in names.items():
            if name in found:
                continue
            for a in aliases:
                k = "".join(x for x in a.lower() if x.isalnum())
                hit = next((c for c, p in plain.items() if (p == k if exact else len(k) >= 3 and k in p) and c not in found.values()), None)
                if hit:
                    found[name] = hit
                    break
    return found


def canonical(df: DataFrame, more: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Columns under their canonical names; others go."""
    return df.select(*[F.col(c).alias(n) for n, c in resolve(df.columns, more).items()])


def decode_arrays(found: DataFrame) -> DataFrame:
    """(path, content) of NPY and NPZ files as long rows path, variable, t, node, value.

    An array has time first and nodes in what follows. A file with ``variable_names``
    holds one array with the variables last; other archives hold one array per
    variable. One file is one row: its arrays are read in a task.
    """
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def tables(content: bytes):
        data = np.load(io.BytesIO(content), allow_pickle=False)
        if isinstance(data, np.ndarray):
            yield "value", data
            return
        if "variable_names" in data.files:
            joint = next(data[n] for n in data.files if data[n].ndim >= 3)
            for i, n in enumerate(data["variable_names"].astype(str).tolist()):
                yield n, joint[..., i]
        else:
            for n in data.files:
                if data[n].ndim >= 2:
                    yield n, data[n]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                for name, x in tables(bytes(content)):
                    flat = x.reshape(len(x), -1).astype(float)
                    t, node = np.indices(flat.shape)
                    yield pd.DataFrame({"path": path, "variable": name, "t": t.ravel(), "node": node.ravel(), "value": flat.ravel()})

    return found.select("path", "content").mapInPandas(run, "path string, variable string, t long, node long, value double")


def array_files(spark: SparkSession, root: str) -> DataFrame:
    """The arrays of all .npy and .npz files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(root)
    return decode_arrays(f)


def csv_sink(df: DataFrame, path: str) -> DataFrame:
    """``df`` as CSV files with a header and without row numbers, and the same rows read back."""
    df.write.option("header", "true").csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", "true").csv(path)


def files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """path, length and time of every file below a root, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


#: Endings of the files that a scan reports, and of folders that are one array store.
SCANNED = ("nc", "nc4", "cdf", "npy", "npz", "csv", "parquet")
STORE = "zarr"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, name, format, bytes of every data file below a root, sorted by path; an array store counts once, without bytes, and what lies in it not at all.

    Names that begin with a dot, and what lies in such folders, are left out. Contents are not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    store = F.regexp_extract("path", rf"^(.*?\.{STORE})/", 1)
    f = f.select(F.when(store != "", store).otherwise(F.col("path")).alias("path"), F.when(store == "", F.col("bytes")).alias("bytes")).groupBy("path").agg(F.max("bytes").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    f = f.select("path", name.alias("name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("format"), "bytes")
    return f.filter(F.col("format").isin(*SCANNED, STORE) & ~F.col("name").startswith(".")).orderBy("path")


def check_artifacts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status of each listed or found artifact (path, bytes, sha256)."""
    f = found.select("path", F.col("bytes").alias("fb"), F.col("sha256").alias("fh"))
    status = F.when(F.col("fb").isNull(), "missing").when(F.col("bytes").isNull(), "unlisted").when(F.col("fb") != F.col("bytes"), "size").when(F.col("fh") != F.col("sha256"), "hash").otherwise("ok")
    return manifest.join(f, "path", "full").select("path", status.alias("status"))


def concat_segments(segments: list[DataFrame], keys: list[str]) -> DataFrame:
    """Segments one after another; of rows with the same keys the earliest segment's stays."""
    from pyspark.sql import Window

    out = None
    for i, s in enumerate(segments):
        s = s.withColumn("segment", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("segment"))).filter("_r = 1").drop("_r")
