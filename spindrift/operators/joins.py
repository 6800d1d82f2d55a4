"""Joins of feature, clinical and image tables.  Strategies are left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import columns as C


def merge_outcome(
    features: DataFrame,
    clinical: DataFrame,
    clinical_id: str,
    *,
    time: str | None = None,
    event: str | None = None,
    outcome: str | None = None,
    key: str = "patient_id",
) -> DataFrame:
    """Features joined with the survival pair (``OS_months``, ``OS_event``) and the outcome.

    Clinical columns that weren't asked for never reach the result, rows that miss one that
    was are dropped before the join, and duplicate ids fan out.  A requested column that the
    features have too replaces theirs.
    """
    out = [F.col(f"`{clinical_id}`").alias(key)]
    if time is not None:
        out.append(C.months(clinical, f"`{time}`").alias("OS_months"))
    if event is not None:
        out.append(C.to_number(F.col(f"`{event}`")).cast("int").alias("OS_event"))
    if outcome is not None and outcome not in ("OS_months", "OS_event"):
        out.append(F.col(f"`{outcome}`").alias(outcome))
    asked = clinical.select(*out)
    new = [c for c in asked.columns if c != key]
    asked = asked.na.drop(subset=[key, *new])
    kept = features.select(*[F.col(f"`{c}`") for c in features.columns if c not in new])
    return kept.join(asked, key)


def unmatched(features: DataFrame, clinical: DataFrame, key: str = "patient_id", show: int = 5) -> DataFrame:
    """(n_unmatched, sample): distinct ids of the features without a clinical row, and the
    first few of them in order."""
    lost = features.select(key).distinct().join(clinical.select(key), key, "left_anti")
    first = lost.orderBy(key).limit(show).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return lost.agg(F.count("*").alias("n_unmatched")).crossJoin(first)


def merge_engines(tables: dict[str, DataFrame], key: str = "patient_id") -> DataFrame:
    """Outer join of one feature table per engine, columns prefixed by the engine's name.

    One table passes unchanged; tables without the key are left out.
    """
    tables = {n: t for n, t in tables.items() if key in t.columns}
    if len(tables) == 1:
        return next(iter(tables.values()))
    named = [t.withColumnsRenamed({c: f"{n}_{c}" for c in t.columns if c != key}) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows, columns in the order in which they are first seen, NULL where missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def patients_with_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def first_per(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def image_mask_manifest(series: DataFrame, image: str, mask: str, order: str, key: str = "patient_id") -> DataFrame:
    """(key, image_path, mask_path, status): first image and first mask of each patient.

    ``status`` is ``ok``, ``no image`` or ``no mask``; one conditional aggregation.
    """
    pick = lambda m: F.min_by(F.when(F.col("modality") == m, F.col("path")), F.when(F.col("modality") == m, F.col(order)))
    got = series.groupBy(key).agg(pick(image).alias("image_path"), pick(mask).alias("mask_path"))
    status = F.when(F.col("image_path").isNull(), "no image").when(F.col("mask_path").isNull(), "no mask").otherwise("ok")
    return got.withColumn("status", status)


def referenced_or_largest(structures: DataFrame, series: DataFrame) -> DataFrame:
    """Each structure set with the series it references, else its study's largest one.

    structures(rt_id, study_id, referenced), series(series_id, study_id, n).
    """
    largest = series.groupBy("study_id").agg(F.max_by("series_id", F.struct("n", "series_id")).alias("largest"))
    known = series.select(F.col("series_id").alias("matched"))
    return (
        structures.join(known, structures["referenced"] == known["matched"], "left")
        .join(largest, "study_id", "left")
        .select("rt_id", "study_id", F.coalesce("matched", "largest").alias("series_id"))
    )


def lookup_any_case(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    r = right.withColumn("__k", F.lower(F.trim(right_on)))
    return left.join(r, F.lower(F.trim(F.col(left_on))) == r["__k"], "left").drop("__k")


def compare_features(a: DataFrame, b: DataFrame, abs_tol: float = 1e-9, rel_tol: float = 1e-9) -> DataFrame:
    """Differences of two long tables (case_id, feature, value).

    ``status`` is ``missing`` (only in a), ``extra`` (only in b) or ``changed``; a value is
    changed when it differs by more than max(abs_tol, rel_tol * |b|), or when only one of
    the two is not finite.  Two NaN or two equal infinities are equal.
    """
    j = a.select("case_id", "feature", F.col("value").alias("va"), F.lit(1).alias("ina")).join(
        b.select("case_id", "feature", F.col("value").alias("vb"), F.lit(1).alias("inb")), ["case_id", "feature"], "full_outer"
    )
    odd = lambda c: F.col(c).isNull() | F.isnan(c)
    gap = F.abs(F.col("va") - F.col("vb"))
    same = (odd("va") & odd("vb")) | (F.col("va") == F.col("vb")) | (~odd("va") & ~odd("vb") & (gap <= F.greatest(F.lit(abs_tol), rel_tol * F.abs("vb"))) & ~F.isnan(gap) & (F.abs("va") != float("inf")) & (F.abs("vb") != float("inf")))
    status = F.when(F.col("inb").isNull(), "missing").when(F.col("ina").isNull(), "extra").when(~F.coalesce(same, F.lit(False)), "changed")
    return j.withColumn("status", status).where("status is not null").select("case_id", "feature", "va", "vb", gap.alias("gap"), "status")
