"""Stability, harmonisation, confounders and correlation of features."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.metrics import dominance
from spindrift.functions.prefix import average_ranks, running_totals


def icc31(pairs: DataFrame) -> DataFrame:
    """ICC(3,1), two-way mixed, consistency, of two measurements a and b of each subject,
    per ``feature`` where there is such a column: one pass of sums.

    NULL with fewer than two subjects or without variance.
    """
    d = pairs.where("a is not null and b is not null")
    keys = ["feature"] if "feature" in pairs.columns else []
    # sums of squares of the two-way layout of k = 2: between subjects from a + b, error from a - b
    s = d.groupBy(*keys).agg(F.var_samp(F.col("a") + F.col("b")).alias("vs"), F.var_samp(F.col("a") - F.col("b")).alias("vd"))
    msr, mse = F.col("vs") / 2, F.col("vd") / 2
    return s.select(*keys, F.round(F.try_divide(msr - mse, msr + mse), 6).alias("icc3"))


def icc_table(a: DataFrame, b: DataFrame, features: Iterable[str], key: str) -> DataFrame:
    """(feature, icc3) of two wide tables joined on ``key``, in long form."""
    def long(df, name):
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias(name)) for c in features])).alias("x")).select(key, "x.feature", f"x.{name}")

    return icc31(long(a, "a").join(long(b, "b"), [key, "feature"]))


def icc_keep(table: DataFrame, threshold: float = 0.75) -> list[str]:
    return [r["feature"] for r in table.where(F.col("icc3") >= threshold).orderBy("feature").collect()]


def kruskal_h(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, df): the tie-corrected Kruskal-Wallis statistic and its degrees of freedom."""
    d = df.select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).na.drop()
    ranks = average_ranks(d, "v")
    ties = ranks.agg(F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("n").cast("double") * F.col("n") - 1)).alias("t"))
    q = d.join(ranks.select("v", "rank"), "v").groupBy("g").agg((F.sum("rank") * F.sum("rank") / F.count("*")).alias("q")).agg(F.sum("q").alias("q"), (F.count("*") - 1).alias("df"))
    n = F.col("nn").cast("double")
    h = F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return q.crossJoin(ties).select(F.round(F.try_divide(h, 1 - F.try_divide(F.col("t").cast("double"), n * (n * n - 1))), 4).alias("h"), F.col("df").cast("int").alias("df"))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with a whole number of degrees of freedom > x), by the recurrence."""
    if x <= 0:
        return 1.0
    if df % 2:
        p, k, term = math.erfc(math.sqrt(x / 2)), 1, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    else:
        p, k, term = math.exp(-x / 2), 2, x / 2 * math.exp(-x / 2)
    while k < df:
        p += term
        k += 2
        term *= x / k
    return min(1.0, p)


def residualize(df: DataFrame, features: Iterable[str], confounders: Iterable[str], *, keep_mean: bool = True) -> DataFrame:
    """Features without what a linear fit on the confounders (mean-imputed) explains.

    The normal equations of every feature come from one aggregation of the table; they are
    (confounders + 1) squared numbers for each feature, solved on the driver, and applied as
    a projection.  A feature with no more rows than parameters stays as it is.
    """
    features, confounders = list(features), list(confounders)
    if not confounders or not features:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in confounders]).first()
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) for c in confounders]]
    k = len(x)
    exprs = []
    for f in features:
        y = F.col(f).cast("double")
        ok = y.isNotNull() & ~F.isnan(y)
        exprs.append(F.count_if(ok).alias(f"{f}|n"))
        for i in range(k):
            exprs.append(F.sum(F.when(ok, x[i] * y)).alias(f"{f}|y{i}"))
            exprs += [F.sum(F.when(ok, x[i] * x[j])).alias(f"{f}|x{i},{j}") for j in range(i, k)]
    got = {}
    for a in range(0, len(exprs), 300):  # keeps each generated aggregate small
        got |= df.agg(*exprs[a : a + 300]).first().asDict()
    out = {}
    for f in features:
        if got[f"{f}|n"] < k + 1:
            continue
        xtx = np.array([[got[f"{f}|x{min(i, j)},{max(i, j)}"] for j in range(k)] for i in range(k)])
        beta, *_ = np.linalg.lstsq(xtx, np.array([got[f"{f}|y{i}"] for i in range(k)]), rcond=None)
        fit = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        back = got[f"{f}|y0"] / got[f"{f}|n"] if keep_mean else 0.0
        out[f] = F.col(f).cast("double") - fit + F.lit(float(back))
    return df.withColumns(out)


def combat(df: DataFrame, features: Iterable[str], batch: str, *, categorical: Iterable[str] = (), continuous: Iterable[str] = (), eb: bool = True, max_iter: int = 500, tol: float = 1e-4) -> DataFrame:
    """Location and scale harmonisation of batches, with empirical Bayes shrinkage.

    The linear model has one intercept for each batch, dummies of the categorical and the
    mean-imputed continuous covariates.  All statistics come from two aggregations over the
    table; what reaches the driver are matrices of batches, parameters and features.  With
    fewer than two batches the table is returned unchanged.  Rows without a batch keep their
    values.
    """
    features, categorical, continuous = list(features), list(categorical), list(continuous)
    batches = [r[0] for r in df.where(F.col(batch).isNotNull()).select(batch).distinct().orderBy(batch).collect()]
    if len(batches) < 2 or not features:
        return df
    x = [(F.col(batch) == F.lit(b)).cast("double") for b in batches]
    for c in categorical:
        levels = [r[0] for r in df.select(c).na.drop().distinct().orderBy(c).collect()]
        x += [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels[1:]]
    if continuous:
        means = df.agg(*[F.avg(c).alias(c) for c in continuous]).first()
        x += [F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) for c in continuous]
    nb, k = len(batches), len(x)
    d = df.where(F.col(batch).isNotNull())
    ys = [F.col(f).cast("double") for f in features]

    def sums(exprs):
        out = {}
        for a in range(0, len(exprs), 300):
            out |= d.agg(*exprs[a : a + 300]).first().asDict()
        return out

    s = sums(
        [F.sum(x[i] * x[j]).alias(f"x{i},{j}") for i in range(k) for j in range(i, k)]
        + [F.sum(x[i] * y).alias(f"y{i},{f}") for f, y in zip(features, ys) for i in range(k)]
    )
    xtx = np.array([[s[f"x{min(i, j)},{max(i, j)}"] for j in range(k)] for i in range(k)])
    xty = np.array([[s[f"y{i},{f}"] or 0.0 for f in features] for i in range(k)])
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    size = np.array([xtx[i, i] for i in range(nb)])
    grand = size @ beta[:nb] / size.sum()
    fit = [sum((float(b) * c for b, c in zip(beta[:, m], x)), F.lit(0.0)) for m in range(len(features))]
    r = sums([F.avg((y - f_) ** 2).alias(f) for f, y, f_ in zip(features, ys, fit)])
    pooled = np.array([max(r[f] or 0.0, 1e-12) for f in features])
    cov = [sum((float(b) * c for b, c in zip(beta[nb:, m], x[nb:])), F.lit(0.0)) for m in range(len(features))]
    base = [F.lit(float(grand[m])) + cov[m] for m in range(len(features))]
    z = [(ys[m] - base[m]) / F.lit(float(math.sqrt(pooled[m]))) for m in range(len(features))]
    by = {}
    exprs = [e for m, f in enumerate(features) for e in (F.avg(z[m]).alias(f"m{f}"), F.var_pop(z[m]).alias(f"v{f}"))]
    for a in range(0, len(exprs), 300):
        for row in d.groupBy(batch).agg(F.count("*").alias("__n"), *exprs[a : a + 300]).collect():
            by.setdefault(row[batch], {}).update(row.asDict())
    gamma = np.array([[by[b][f"m{f}"] or 0.0 for f in features] for b in batches])
    delta = np.array([[max(by[b][f"v{f}"] or 0.0, 1e-12) for f in features] for b in batches])
    count = np.array([by[b]["__n"] for b in batches])
    if eb:
        gamma, delta = _shrink(gamma, delta, count, max_iter, tol)
    out = {}
    for m, f in enumerate(features):
        new = F.lit(None).cast("double")
        for i, b in enumerate(batches):
            adjusted = (z[m] - float(gamma[i, m])) / float(math.sqrt(delta[i, m])) * float(math.sqrt(pooled[m])) + base[m]
            new = F.when(F.col(batch) == F.lit(b), adjusted).otherwise(new)
        out[f] = F.when(F.col(batch).isNull(), ys[m]).otherwise(new)
    return df.withColumns(out)


def _shrink(gamma, delta, count, max_iter, tol):
    """Parametric posterior means of each batch's locations and scales."""
    g_out, d_out = gamma.copy(), delta.copy()
    for i, n in enumerate(count):
        mean, tau2 = gamma[i].mean(), gamma[i].var(ddof=1) if gamma.shape[1] > 1 else 0.0
        m, s2 = delta[i].mean(), delta[i].var(ddof=1) if delta.shape[1] > 1 else 0.0
        if tau2 <= 0 or s2 <= 0:
            continue
        a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
        g, d = gamma[i].copy(), delta[i].copy()
        for _ in range(max_iter):
            g2 = (n * tau2 * gamma[i] + d * mean) / (n * tau2 + d)
            ss = n * delta[i] + n * (gamma[i] - g2) ** 2
            d2 = (b + ss / 2) / (n / 2 + a - 1)
            change = max(np.abs(g2 - g).max() / max(np.abs(g).max(), 1e-12), np.abs(d2 - d).max() / np.abs(d).max())
            g, d = g2, d2
            if change < tol:
                break
        g_out[i], d_out[i] = g, d
    return g_out, d_out


def correlations(df: DataFrame, features: Iterable[str]) -> np.ndarray:
    """Pearson matrix of complete rows; the result is features squared, the table one pass."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    features = list(features)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    v = VectorAssembler(inputCols=features, outputCol="v").transform(rows).select("v")
    return Correlation.corr(v, "v").head()[0].toArray()


def prune_correlated(features: list[str], r: np.ndarray, threshold: float = 0.95, *, against_kept: bool = True) -> list[str]:
    """Features in order without the ones that correlate with an earlier one.

    ``against_kept`` compares with kept features only and drops at |r| >= threshold; without
    it every earlier feature counts and |r| must exceed the threshold.
    """
    r = np.nan_to_num(np.abs(r))
    keep: list[int] = []
    for i in range(len(features)):
        if against_kept:
            if not any(r[i, j] >= threshold for j in keep):
                keep.append(i)
        elif not (r[i, :i] > threshold).any():
            keep.append(i)
    return [features[i] for i in keep]


def correlation_with(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """(feature, r): Pearson correlation of each feature with the target, in long form."""
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")).select("y", "x.*")
    return long.groupBy("feature").agg(F.corr("v", "y").alias("r"))


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """(t, s): the survival curve at every time at which not all at risk fail."""
    d = df.groupBy(F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("double")).alias("d"), F.count("*").cast("double").alias("n"))
    r = running_totals(d, "t", {"at_risk": "n"}, descending=True).where("d < at_risk")
    steps = r.withColumn("l", F.log(1 - F.col("d") / F.col("at_risk")))
    return running_totals(steps, "t", {"sum_l": "l"}).select("t", F.round(F.exp("sum_l"), 6).alias("s"))


def concordance_index(time, risk, event) -> float | None:
    """Harrell's c in O(n log n), for groups that fit a task."""
    time, risk, event = (np.asarray(a, float) for a in (time, risk, event))
    if len(time) < 3 or event.sum() < 2:
        return None
    pairs, below, same = dominance(time, risk, event)
    return (below + same / 2) / pairs if pairs else None
