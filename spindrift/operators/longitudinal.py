"""Differences and trends over timepoints, all from one grouping of the table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.columns import numeric_columns


def differences(
    df: DataFrame,
    pairs: dict[str, tuple[str, str]],
    *,
    features: Iterable[str] | None = None,
    keys: Iterable[str] = ("patient_id", "roi_name"),
    timepoint: str = "timepoint",
    time_index: str | None = None,
    trend: bool = False,
    complete: bool = False,
) -> DataFrame:
    """Late minus early of each (late, early) pair, and slopes over time, in one shuffle.

    A pair named ``p`` gives ``p_<feature>``, NULL where either timepoint is missing;
    ``trend`` adds ``slope_<feature>``, the least-squares slope over ``time_index``, or over
    the lexical rank of the timepoint, where two values at different times exist.  With
    ``complete`` groups that lack any of the pairs are dropped.  Key columns that the table
    doesn't have are ignored, rows with a NULL key are dropped, and two rows of one group
    at one timepoint raise.
    """
    keys = [k for k in keys if k in df.columns]
    feats = list(features) if features is not None else numeric_columns(df, [*keys, timepoint, *([time_index] if time_index else [])])
    df = df.na.drop(subset=keys)
    t = F.col(time_index).cast("double") if time_index else None
    if trend and t is None:
        df = df.withColumn("__t", (F.row_number().over(Window.partitionBy(*keys).orderBy(timepoint)) - 1).cast("double"))
        t = F.col("__t")
    at = lambda c, tp: F.max(F.when(F.col(timepoint) == tp, F.col(c)))
    have = lambda tp: F.count_if(F.col(timepoint) == tp)
    out = []
    for name, (late, early) in pairs.items():
        out += [(at(c, late) - at(c, early)).alias(f"{name}_{c}") for c in feats]
    for late, early in pairs.values():
        for tp in (late, early):
            out.append(have(tp).alias(f"__n_{tp}"))
    if trend:
        out += [F.when(F.count(c) >= 2, F.regr_slope(F.col(c).cast("double"), t)).alias(f"slope_{c}") for c in feats]
        out.append(F.count("*").alias("__rows"))
    seen, unique = set(), []
    for c in out:
        name = c._jc.toString() if hasattr(c, "_jc") else str(c)
        if name not in seen:
            seen.add(name)
            unique.append(c)
    got = df.groupBy(*keys).agg(*unique)
    marks = sorted({f"__n_{tp}" for p in pairs.values() for tp in p})
    for m in marks:
        got = got.withColumn(m, F.when(F.col(m) > 1, F.raise_error(F.lit(f"several rows of one group at one timepoint ({m[4:]})")).cast("long")).otherwise(F.col(m)))
    if complete or (pairs and not trend and len(pairs) == 1):
        for m in marks:
            got = got.where(F.col(m) >= 1)
    elif pairs:
        any_pair = F.lit(False)
        for late, early in pairs.values():
            any_pair = any_pair | ((F.col(f"__n_{late}") >= 1) & (F.col(f"__n_{early}") >= 1))
        got = got.where(any_pair | (F.col("__rows") >= 2) if trend else any_pair)
    elif trend:
        got = got.where("__rows >= 2")
    return got.drop(*marks, "__rows")


def delta(df: DataFrame, late: str, early: str, **options) -> DataFrame:
    return differences(df, {"delta": (late, early)}, **options)


def slopes(df: DataFrame, **options) -> DataFrame:
    return differences(df, {}, trend=True, **options)
