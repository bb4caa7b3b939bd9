"""Metrics at first look on a stream: a window is emitted at its close, and what is delivered later stays invisible to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import GRAINS, Metric


def stream_first_look(events: DataFrame, metric: Metric, grain: str, group_by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, dimensions, numerator and denominator of a stream of normalized events in delivery order.

    The watermark trails the latest business time by one window. Every row that was delivered by a window's close
    arrives before a row that occurred a window later, so nothing that counts is late; rows delivered after the close
    are filtered, exactly as in batch. Only metrics over plain event columns can be streamed this way.
    """
    if metric.source != "plain":
        raise ValueError(f"{metric.name} needs more than the event's own columns")
    seconds = GRAINS[grain]
    start = F.col("occurred_at") - F.col("occurred_at") % seconds
    rows = events.where(metric.where).where(F.col("ingested_at") <= start + seconds).withColumn("at", F.timestamp_seconds("occurred_at"))
    top = F.sum(metric.total) if metric.total else F.count("*") if metric.num is None else F.count_if(F.expr(metric.num))
    low = F.max(F.lit(metric.den)) if isinstance(metric.den, int) else F.count("*") if metric.den is None else F.count_if(F.expr(metric.den))
    found = rows.withWatermark("at", f"{seconds} seconds").groupBy(F.window("at", f"{seconds} seconds"), *group_by).agg(top.cast("long").alias("numerator"), low.cast("long").alias("denominator"))
    return found.select(F.unix_timestamp("window.start").alias("window_start"), *group_by, "numerator", "denominator")
