"""The event panel as a stream: the same buckets as the batch panel, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_panel(events: DataFrame, hours: int = 6, late: str = "2 hours") -> DataFrame:
    """t, node, variable, value of each closed bucket; events later than ``late`` behind the newest are left out.

    events: a streaming (or static) table ts, user_id, event_type, value. State holds
    one row per open bucket, node and variable.
    """
    w = F.window("ts", f"{hours} hours")
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), (F.col("user_id") % 4).alias("node"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))
    return g.select(F.floor(F.unix_seconds("w.start") / (3600 * hours)).cast("long").alias("t"), "node", "variable", "value")
