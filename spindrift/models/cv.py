"""Folds that keep groups together, and checks that they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 256


def _group_hash(df: DataFrame, group: str, seed: int):
    """Hash of the row's group; of the row itself where it has none, so that it stays the
    same when a partition is computed again."""
    whole = [c for c in df.columns if "map" not in df.schema[c].dataType.simpleString() and df.schema[c].dataType.typeName() != "variant"]
    own = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in whole])
    if group not in df.columns:
        return own
    return F.when(F.col(group).isNull(), own).otherwise(F.xxhash64(F.lit(seed), F.col(group).cast("string")))


def group_folds(df: DataFrame, group: str, folds: int, *, label: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` in 0..folds-1: all rows of a group in one fold, groups spread by
    a seeded hash, and, with ``label``, dealt out evenly within each label's groups.

    Rows without a group are groups of their own; equal ones of those share a fold.  Groups
    may be of any type.  Groups of a label are numbered within buckets of the hash, so no
    task sees all of them.
    """
    d = df.withColumn("__g", _group_hash(df, group, seed))
    if label is None:
        return d.withColumn("fold", F.pmod("__g", F.lit(folds)).cast("int")).drop("__g")
    per = d.groupBy("__g").agg(F.max(label).alias("__l")).withColumn("__b", F.pmod(F.xxhash64("__g"), F.lit(BUCKETS)))
    earlier = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = per.groupBy("__l", "__b").agg(F.count("*").alias("__n")).select(F.col("__l").alias("__cl"), F.col("__b").alias("__cb"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    inside = Window.partitionBy("__l", "__b").orderBy("__g")
    ranked = per.withColumn("__k", F.row_number().over(inside)).join(counts, (F.col("__b") == F.col("__cb")) & F.col("__l").eqNullSafe(F.col("__cl"))).select("__g", (F.col("__k") + F.col("__n")).alias("__k"), F.hash("__l").alias("__h"))
    return d.join(ranked.select("__g", F.pmod(F.col("__k") + F.col("__h"), F.lit(folds)).cast("int").alias("fold")), "__g").drop("__g")


def ranked_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``fold`` by the dense rank of the group, of any type that has an order, for results
    that others must reproduce.  Rows without a group get no fold."""
    from spindrift.functions.prefix import dense_ranks

    ranks = dense_ranks(df, group).withColumnRenamed(group, "__k")
    return df.join(ranks, df[group] == ranks["__k"], "left").withColumn("fold", F.col("rank") % folds).drop("__k", "rank")


def leaks(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(group, folds): the groups that are in more than one fold; empty when all is well."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def assert_no_leak(df: DataFrame, group: str, fold: str = "fold") -> None:
    bad = leaks(df, group, fold).limit(5).collect()
    if bad:
        raise ValueError(f"leakage: groups in several folds: {[r[0] for r in bad]}")


def fold_count(df: DataFrame, group: str, folds: int) -> tuple[int, bool]:
    """How many folds there can be, and whether groups repeat and must be kept together."""
    if group not in df.columns:
        return folds, False
    n, g = df.agg(F.count("*"), F.countDistinct(group)).first()
    return (max(2, min(folds, g)), True) if g < n else (folds, False)
