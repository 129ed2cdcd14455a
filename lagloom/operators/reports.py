"""Reports over tables of tested and selected edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source_region", "target_region", "source_var", "target_var", "lag"]


def chains(sig: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wind to humidity to cloud chains: an edge into a region's humidity followed by one out of it."""
    by = by or ["regime"]
    cols = ["source_region", "target_region", "lag", "effect", "p_value"]
    one = sig.filter("source_var = 'wind' and target_var = 'humidity'").select(*by, *[F.col(c).alias("a_" + c) for c in cols])
    two = sig.filter("source_var = 'humidity' and target_var = 'cloud_cover'").select(*by, *[F.col(c).alias("b_" + c) for c in cols])
    two = two.withColumn("a_target_region", F.col("b_source_region"))
    return one.join(two, [*by, "a_target_region"]).withColumnRenamed("a_target_region", "mediator")


def both_seasons(e: DataFrame) -> DataFrame:
    """KEY, edge_type, p1 and e1 of winter, p2 and e2 of summer: a row for each key, null where a season has no test of it.

    Edges are shuffled once; those of a key that lie in one file meet before that.
    """
    of = lambda season, c: F.max(F.when(F.col("regime") == season, F.col(c)))
    g = e.groupBy(*KEY).agg(of("winter", "p_value").alias("p1"), of("winter", "effect").alias("e1"), of("summer", "p_value").alias("p2"), of("summer", "effect").alias("e2"))
    return g.withColumn("edge_type", F.concat_ws("->", "source_var", "target_var"))


def jaccard(df: DataFrame, set_col: str, key: list[str]) -> DataFrame:
    """Jaccard distance of each pair of sets of keys; 0 for two empty ones."""
    d = df.select(set_col, *key).distinct()
    n = d.groupBy(set_col).count()
    a, b = d.withColumnRenamed(set_col, "a"), d.withColumnRenamed(set_col, "b")
    both = a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    names = n.select(F.col(set_col).alias("a"), F.col("count").alias("na"))
    other = n.select(F.col(set_col).alias("b"), F.col("count").alias("nb"))
    pairs = names.join(F.broadcast(other), F.col("a") < F.col("b"))  # one row per set
    out = pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.withColumn("union", F.col("na") + F.col("nb") - F.col("both")).withColumn("distance", F.when(F.col("union") == 0, 0.0).otherwise(1 - F.col("both") / F.col("union")))


def flatten(df: DataFrame, key: str) -> DataFrame:
    """Rows of nested columns as (path, value): the key, then the names of columns and fields; arrays by position as text."""
    from pyspark.sql import types as T

    paths: list[tuple[str, F.Column]] = []

    def walk(name: str, c, kind) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}", c[f.name], f.dataType)
        else:
            paths.append((name, c.cast("string") if not isinstance(kind, T.ArrayType | T.MapType) else F.to_json(c)))

    for f in df.schema.fields:
        if f.name != key:
            walk(f.name, F.col(f.name), f.dataType)
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("value")) for n, c in paths]))
    return df.select(F.col(key).cast("string").alias("k"), pair.alias("p")).select(F.concat_ws("/", "k", "p.n").alias("path"), "p.value")


def compare_metadata(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """path, status of two flattened tables: numbers by relative tolerance, all else exactly."""
    j = a.withColumnRenamed("value", "va").withColumn("in_a", F.lit(True)).join(b.withColumnRenamed("value", "vb").withColumn("in_b", F.lit(True)).hint("shuffle_merge"), "path", "full")
    x, y = F.expr("try_cast(va AS double)"), F.expr("try_cast(vb AS double)")
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(y))).otherwise(F.col("va").eqNullSafe(F.col("vb")))
    return j.select("path", F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(same, "same").otherwise("different").alias("status"))
