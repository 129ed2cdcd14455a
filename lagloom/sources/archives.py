"""Archives of arrays on any axis order, levels by pressure, and contracts over sets of files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.readers import resolve

_COMBINED = ("data", "X", "x", "array", "values")
_TIMES = ("timestamps", "time", "times", "valid_time")


def _coordinates(lat: np.ndarray | None, lon: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Flat float coordinates; longitudes beyond 180 are turned to [-180, 180)."""
    lat = None if lat is None else np.asarray(lat, np.float64)
    lon = None if lon is None else np.asarray(lon, np.float64)
    if lon is not None and lon.size and lon.max() > 180:
        lon = (lon + 180) % 360 - 180
    return lat, lon


def time_first(x: np.ndarray, n_times: int | None, lat: np.ndarray | None, lon: np.ndarray | None) -> np.ndarray:
    """An array as (time, node): the first axis as long as the timestamps is time, else the first of all; of two others the one as long as the latitudes comes first."""
    axis = next((i for i, n in enumerate(x.shape) if n == n_times), 0) if n_times is not None else 0
    x = np.moveaxis(x, axis, 0)
    if x.ndim == 3 and lat is not None and lon is not None and lat.ndim == lon.ndim == 1 and x.shape[1:] == (len(lon), len(lat)) and len(lat) != len(lon):
        x = np.swapaxes(x, 1, 2)
    return x.reshape(len(x), -1)


def read_archive(content: bytes) -> tuple[dict[str, np.ndarray], np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """Variables as (time, node), timestamps, latitudes and longitudes of an NPY or NPZ file.

    A combined array has its variables on the axis as long as ``variable_names``. Wind is the
    speed if there is one, else from both components, else the one component there is.
    """
    z = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(z, np.ndarray):
        return {"value": time_first(z.astype(float), None, None, None)} if z.ndim >= 2 else {}, None, None, None
    arrays = {k: z[k] for k in z.files}
    names = {k.lower(): k for k in arrays}
    lat, lon = _coordinates(*(next((arrays[names[a]] for a in keys if a in names), None) for keys in (("lat", "latitude"), ("lon", "longitude"))))
    times = next((arrays[names[a]] for a in _TIMES if a in names), None)
    n = None if times is None else len(times)
    out: dict[str, np.ndarray] = {}
    joint = next((arrays[k] for k in _COMBINED if k in arrays), None)
    if joint is not None and "variable_names" in arrays:
        labels = arrays["variable_names"].astype(str).tolist()
        axis = next((i for i in range(joint.ndim - 1, -1, -1) if joint.shape[i] == len(labels) and not (joint.shape[i] == n and (joint.shape.index(n) == i))), None)
        if axis is not None:
            parts = np.moveaxis(joint.astype(float), axis, 0)
            out = {v: time_first(p, n, lat, lon) for v, p in zip(labels, parts, strict=True)}
    if not out:
        out = {k: time_first(a.astype(float), n, lat, lon) for k, a in arrays.items() if a.ndim >= 2 and a.dtype.kind in "fiu" and k.lower() not in ("lat", "lon", "latitude", "longitude")}
    found = resolve(list(out))
    held = {name: out[k] for name, k in found.items() if name not in ("ts", "lat", "lon", "node")}
    if "wind" not in held and "u" in held and "v" in held:
        t, m = min(len(held["u"]), len(held["v"])), min(held["u"].shape[1], held["v"].shape[1])
        held["wind"] = np.sqrt(held["u"][:t, :m] ** 2 + held["v"][:t, :m] ** 2)
    elif "wind" not in held and ("u" in held or "v" in held):
        held["wind"] = held["u"] if "u" in held else held["v"]
    taken = set(found.values())
    held |= {k: a for k, a in out.items() if k not in taken}
    if lat is not None and lon is not None:
        size = next((a.shape[1] for a in held.values()), 0)
        if lat.ndim == lon.ndim == 1 and len(lat) * len(lon) == size and not (len(lat) == len(lon) == size):
            lat, lon = (g.ravel() for g in np.meshgrid(lat, lon, indexing="ij"))
        lat, lon = (c.ravel() if c.size == size else None for c in (lat, lon))
    return held, times, lat, lon


def decode(found: DataFrame) -> DataFrame:
    """(path, content) of NPY and NPZ files as rows path, variable, t, ts, node, lat, lon, value; what a file lacks is null.

    One file is one row: its arrays are read in a task, and leave it variable by variable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, times, lat, lon = read_archive(bytes(content))
                stamps = None if times is None else times.astype("datetime64[us]").astype(np.int64)
                for name, x in held.items():
                    t, node = (a.ravel() for a in np.indices(x.shape))
                    n = len(t)
                    cols = [
                        pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(t), pa.array(stamps[t] if stamps is not None and len(stamps) >= len(x) else [None] * n, pa.int64()),
                        pa.array(node), pa.array(lat[node] if lat is not None else [None] * n, pa.float64()), pa.array(lon[node] if lon is not None else [None] * n, pa.float64()), pa.array(x.ravel()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "variable", "t", "us", "node", "lat", "lon", "value"])

    rows = found.select("path", "content").mapInArrow(run, "path string, variable string, t long, us long, node long, lat double, lon double, value double")
    return rows.select("path", "variable", "t", F.timestamp_micros("us").alias("ts"), "node", "lat", "lon", "value")


def at_level(rows: DataFrame, level: Column, pressure: float | None) -> DataFrame:
    """Rows of one level: the one nearest to ``pressure`` (hPa; coordinates in Pa are told by their size), the smaller of two as near; without a pressure the first."""
    r = rows.withColumn("_l", level.cast("double"))
    top = r.agg(F.max("_l").alias("m"))
    scale = F.when(F.col("m") > 2000, 100.0).otherwise(1.0)
    levels = r.select("_l").distinct().crossJoin(F.broadcast(top))  # one row
    off = F.abs(F.col("_l") / scale - pressure) if pressure is not None else F.col("_l")
    best = levels.agg(F.min(F.struct(off.alias("off"), F.col("_l"))).alias("b")).select(F.col("b._l").alias("_l"))
    return r.join(F.broadcast(best), "_l").drop("_l")  # one row


def violations(rows: DataFrame, fields: DataFrame, calendar: DataFrame, grid: DataFrame) -> DataFrame:
    """file, what, n: what each file breaks of the contract that all files share.

    rows: file, variable, t, node, units, level, lat, lon; fields: variable, units, level;
    calendar: t of all steps that must be there; grid: node, lat, lon. Kinds: ``field`` (a
    variable that is not asked for, or one that the file lacks), ``units``, ``level``, ``grid``,
    ``calendar`` (a step outside of it), ``gap`` (steps missing between a file's ends), ``twice``
    (a step that another file has too; told of the later file by name). Steps that no file has
    come with a null file as ``absent``.
    """
    kinds = rows.groupBy("file", "variable").agg(F.first("units").alias("units"), F.first("level").alias("level"), F.count_distinct("units", "level").alias("k"))
    j = kinds.join(fields.select("variable", F.col("units").alias("u"), F.col("level").alias("l")).hint("shuffle_merge"), "variable", "left")
    unknown, found = F.col("u").isNull(), []
    tell = lambda df, what: df.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(what).alias("what"), "n")
    found.append(tell(j.filter(unknown), "field"))
    found.append(tell(j.filter(~unknown & (F.col("u") != F.col("units"))), "units"))
    found.append(tell(j.filter(~unknown & ~F.col("l").eqNullSafe(F.col("level"))), "level"))
    lacks = rows.select("file").distinct().join(F.broadcast(fields.select("variable")))  # the fields of the contract
    found.append(tell(lacks.join(kinds.select("file", "variable").hint("shuffle_merge"), ["file", "variable"], "left_anti"), "field"))
    places = rows.select("file", "node", "lat", "lon").distinct().join(grid.select("node", F.col("lat").alias("gy"), F.col("lon").alias("gx")).hint("shuffle_merge"), "node", "left")
    found.append(tell(places.filter(F.col("gy").isNull() | (F.col("gy") != F.col("lat")) | (F.col("gx") != F.col("lon"))), "grid"))
    steps = rows.select("file", "variable", "t").distinct()
    found.append(tell(steps.join(calendar.select("t").hint("shuffle_merge"), "t", "left_anti"), "calendar"))
    w = Window.partitionBy("file", "variable").orderBy("t")
    found.append(steps.withColumn("g", F.col("t") - F.lag("t").over(w) - 1).filter("g > 0").groupBy("file").agg(F.sum("g").alias("n")).select("file", F.lit("gap").alias("what"), "n"))
    found.append(tell(steps.withColumn("r", F.row_number().over(Window.partitionBy("variable", "t").orderBy("file"))).filter("r > 1"), "twice"))
    asked = calendar.select("t").join(F.broadcast(fields.select("variable")))  # the fields of the contract
    gone = asked.join(steps.select("variable", "t").distinct().hint("shuffle_merge"), ["variable", "t"], "left_anti")
    found.append(gone.groupBy().agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("file"), F.lit("absent").alias("what"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("file", "what").agg(F.sum("n").alias("n"))
