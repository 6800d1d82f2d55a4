"""Small summaries of result tables: folds, repeats, stability, parity, status, orders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.prefix import average_ranks


def icc_fractions(table: DataFrame) -> DataFrame:
    """(n, good, excellent): shares of the features whose ICC isn't NULL with at least 0.75
    and 0.90."""
    x = table.where("icc3 is not null and not isnan(icc3)")
    share = lambda t: F.round(F.avg((F.col("icc3") >= t).cast("double")), 6)
    return x.agg(F.count("*").alias("n"), share(0.75).alias("good"), share(0.90).alias("excellent"))


def mean_std(df: DataFrame, columns: Iterable[str], by: Iterable[str] = (), digits: int = 6) -> DataFrame:
    """``<column>_mean`` and ``<column>_std`` (of the population) per ``by``: the summary of
    folds, and with four digits that of repeated fits."""
    parts = [f for c in columns for f in (F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_pop(c), digits).alias(f"{c}_std"))]
    return df.groupBy(*by).agg(*parts)


def modal(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """The most common value of each column per ``by``; of equally common ones the least."""
    return df.groupBy(*by).agg(*[F.mode(c, True).alias(c) for c in columns])


def accuracy_interval(df: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(accuracy, ci_lo, ci_hi) of columns y and pred, of any classes, by Wilson's interval;
    NULL without rows."""
    d = df.where("y is not null and pred is not null").agg(F.count("*").cast("double").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("a"))
    n, a = F.col("n"), F.col("a")
    mid = (a + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(a * (1 - a) / n + z * z / (4 * n * n))
    return d.select(F.round("a", 6).alias("accuracy"), F.round(F.when(n > 0, mid - half), 6).alias("ci_lo"), F.round(F.when(n > 0, mid + half), 6).alias("ci_hi"))


def prevalence(df: DataFrame, outcome: str) -> DataFrame:
    """(rows, events, prevalence) of a 0/1 outcome."""
    return df.agg(F.count(outcome).alias("rows"), F.count_if(F.col(outcome) == 1).alias("events"), F.round(F.avg(F.col(outcome).cast("double")), 6).alias("prevalence"))


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, distinct, median, q10, q90) of a value, exact, with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(value).alias("distinct"), q.alias("q"))
    return g.select(group, "n", "distinct", *[F.round(F.col("q")[i], 4).alias(n) for i, n in ((1, "median"), (0, "q10"), (2, "q90"))])


def group_means(df: DataFrame, keys: Iterable[str], values: Iterable[str], first: Iterable[str] = (), order: Iterable[str] = ()) -> DataFrame:
    """Means of ``values`` per ``keys``, and of the row that is first in ``order`` the columns
    ``first``."""
    at = F.struct(*order) if list(order) else F.lit(0)
    return df.groupBy(*keys).agg(*[F.round(F.avg(v), 4).alias(v) for v in values], *[F.min_by(c, at).alias(c) for c in first])


def status_counts(df: DataFrame, status: str = "status", size: str | None = None) -> DataFrame:
    """(status, n[, bytes]): how many of each, and their total size."""
    return df.groupBy(status).agg(F.count("*").alias("n"), *([F.coalesce(F.sum(size), F.lit(0)).alias("bytes")] if size else []))


def sweep_summary(compared: DataFrame, case: str = "case") -> DataFrame:
    """(case, n, equal, max_abs, max_rel) of a comparison with columns a and b, per case."""
    gap = F.abs(F.col("a") - F.col("b"))
    rel = F.try_divide(gap, F.greatest(F.abs("a"), F.abs("b")))
    return compared.groupBy(case).agg(F.count("*").alias("n"), F.count_if(gap == 0).alias("equal"), F.round(F.max(gap), 6).alias("max_abs"), F.round(F.coalesce(F.max(rel), F.lit(0.0)), 6).alias("max_rel"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho): Pearson correlation of average ranks over rows that have both."""
    x = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    ra, rb = (average_ranks(x, c).select(c, F.col("rank").alias(f"r{c}")) for c in ("a", "b"))
    return x.join(ra, "a").join(rb, "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def ranked(df: DataFrame, score: str, name: str = "model") -> DataFrame:
    """Rows by descending score, then by name; NULL scores last."""
    return df.orderBy(F.desc_nulls_last(score), name)


def best(df: DataFrame, score: str, by: Iterable[str] = (), name: str = "model") -> DataFrame:
    """The row of the greatest score per ``by``; of equal ones the least name."""
    rest = [c for c in df.columns if c not in by]
    top = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("x"))
    return top.select(*by, "x.*")


def by_method(df: DataFrame, top: int | None = None) -> DataFrame:
    """(method, feature, importance ...) by method and descending importance, the ``top`` of
    each method where given."""
    if top is not None:
        w = Window.partitionBy("method").orderBy(F.desc("importance"), "feature")
        df = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top).drop("__k")
    return df.orderBy("method", F.desc("importance"), "feature")


def slice_index(df: DataFrame, series: str, z: str) -> DataFrame:
    """``slice``: the number of a row in its series by ascending position, from 0."""
    return df.withColumn("slice", F.row_number().over(Window.partitionBy(series).orderBy(z)) - 1)


def numbered_names(df: DataFrame, key: str, order: Iterable[Column | str], name: str = "case") -> DataFrame:
    """``name``: the key for its first row in order, ``key-1``, ``key-2`` ... for the others."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(name, F.concat(F.col(key).cast("string"), F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise("")))


def sampled_negatives(df: DataFrame, label: str, key: str, ratio: int = 3, seed: int = 42) -> DataFrame:
    """All rows of label 1, and of the others about ``ratio`` times as many, without
    replacement: those whose hash of the key is least.

    The bound of the hash comes from a running count over ranges of it, so no task sorts all
    negatives."""
    from spindrift.functions.prefix import running_totals

    wanted = df.agg(F.count_if(F.col(label) == 1).alias("__want")).select((F.col("__want") * ratio).alias("__want"))
    negatives = df.where((F.col(label) != 1) | F.col(label).isNull()).withColumn("__h", F.xxhash64(F.lit(seed), key).cast("double")).withColumn("__one", F.lit(1))
    kept = running_totals(negatives, "__h", {"__k": "__one"}).crossJoin(F.broadcast(wanted)).where("__k <= __want")
    return df.where(F.col(label) == 1).unionByName(kept.select(*df.columns))


def shared_columns(a: DataFrame, b: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that both tables have, in the order of the first."""
    from spindrift.operators.columns import numeric_columns

    have = set(numeric_columns(b, exclude))
    return [c for c in numeric_columns(a, exclude) if c in have]


def with_positions(df: DataFrame, positions: DataFrame, on: str, value: str, low: int = 0, high: int | None = None) -> DataFrame:
    """``df`` with the position that ``positions`` has for its ``on``; rows without one, or
    with one outside [low, high), go."""
    got = df.join(positions.select(on, value), on)
    inside = F.col(value) >= low
    return got.where(inside if high is None else inside & (F.col(value) < high))


def with_mean(df: DataFrame, other: DataFrame, on: str, value: str, default: float = 0.0) -> DataFrame:
    """``df`` with the mean of ``other``'s value for its ``on``, ``default`` where there is
    none."""
    m = other.groupBy(on).agg(F.avg(value).alias(value))
    return df.join(m, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def parity(ours: DataFrame, reference: DataFrame, digits: int = 3) -> DataFrame:
    """(tag, value, expected, tolerance, passes): our values (tag, value) against published
    ones (tag, expected, tolerance), both rounded to ``digits`` significant digits; tags that
    we don't have don't pass."""

    def significant(c):
        scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
        return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)

    both = reference.join(ours, "tag", "left")
    close = F.abs(significant(F.col("value")) - significant(F.col("expected"))) <= F.col("tolerance") + 1e-12
    return both.select("tag", "value", "expected", "tolerance", F.coalesce(close, F.lit(False)).alias("passes"))
