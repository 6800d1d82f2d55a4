"""Watching a change feed: stateless filters, a sink with checkpoints, and studies that have
become stable."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.columns import glob_match


def watched(changes: DataFrame, kinds: Iterable[str] = (), tags: dict[str, str] | None = None) -> DataFrame:
    """Changes of the given types whose columns match all the glob patterns."""
    kinds = list(kinds)
    out = changes.where(F.col("change_type").isin(kinds)) if kinds else changes
    for column, pattern in (tags or {}).items():
        out = out.where(glob_match(F.col(column), pattern))
    return out


def write_json(changes: DataFrame, path: str, checkpoint: str, *, every: str | None = None):
    """Append as JSON lines.  Without ``every`` all that is there is read once and the query
    ends; offsets also pass over changes that were filtered out."""
    w = changes.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def stable_studies(instances: DataFrame, gap: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """(study_id, first, last, n): studies that got no new instance for ``gap``; columns
    study_id and ts (a timestamp); instances later than ``late`` are dropped."""
    w = F.session_window("ts", gap)
    return (
        instances.withWatermark("ts", late)
        .groupBy("study_id", w)
        .agg(F.count("*").alias("n"))
        .select("study_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")
    )
