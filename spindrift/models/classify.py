"""Logistic models in one task and over features, resampled intervals, and a benchmark of
``pyspark.ml`` models with nested, group-aware cross-validation."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions.prefix import with_ranges
from spindrift.models.cv import group_folds
from spindrift.models.survival import long_form, normal_p
from spindrift.operators.columns import columns_with_gaps, fill, medians, numeric_columns
from spindrift.shipping import ship


def rank_auc(y: np.ndarray, p: np.ndarray) -> float | None:
    y = np.asarray(y)
    n1 = int((y == 1).sum())
    if n1 == 0 or n1 == len(y):
        return None
    _, inv, cnt = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(cnt) - (cnt - 1) / 2)[inv]
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def logit(x: np.ndarray, y: np.ndarray, ridge: float = 0.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with the intercept first, covariance) by Newton's method; raises
    ArithmeticError where the classes are separated."""
    a = np.column_stack([np.ones(len(y)), np.asarray(x, float).reshape(len(y), -1)])
    mean, scale = a.mean(axis=0), a.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale = np.where(scale > 0, scale, 1.0)
    z = (a - mean) / scale
    b = np.zeros(z.shape[1])
    pen = ridge * np.eye(len(b))
    pen[0, 0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        h = (z * (p * (1 - p))[:, None]).T @ z + pen
        step = np.linalg.solve(h, z.T @ (y - p) - pen @ b)
        b = b + step
        if np.abs(b).max() > 50:
            raise ArithmeticError("separated")
        if np.abs(step).max() < 1e-9:
            back = np.diag(1 / scale)
            back[0, 1:] = -mean[1:] / scale[1:]
            return back @ b, back @ np.linalg.inv(h) @ back.T
    raise ArithmeticError("no convergence")


def logit_scan(df: DataFrame, outcome: str, features: Iterable[str] | None = None, exclude: Iterable[str] = ("patient_id",)) -> DataFrame:
    """One logistic model for each feature: (feature, coef, auc, p), with Wald p; features
    with fewer than 10 rows, without spread, with one class or separated are left out."""
    ship(df.sparkSession)
    feats = list(features) if features is not None else numeric_columns(df, [outcome, *exclude])
    long = long_form(df, feats, [outcome]).na.drop(subset=[outcome])

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        y = g[outcome].to_numpy(float)
        if len(g) >= 10 and g["value"].std() > 0 and 0 < y.mean() < 1:
            try:
                b, v = logit(g[["value"]].to_numpy(), y)
                out.append((key[0], b[1], rank_auc(y, b[1] * g["value"].to_numpy()), normal_p(b[1] / math.sqrt(v[1, 1]))))
            except (ArithmeticError, np.linalg.LinAlgError):
                pass
        return pd.DataFrame(out, columns=["feature", "coef", "auc", "p"])

    return long.groupBy("feature").applyInPandas(one, "feature string, coef double, auc double, p double")


def bootstrap_auc(df: DataFrame, n_boot: int = 2000, seed: int = 42, tasks: int = 8) -> DataFrame:
    """(auc, ci_lo, ci_hi, n_boot): percentile interval of the AUC of y and p.

    Replicates draw Poisson(1) weights.  Scores are cut into ``tasks`` ranges; the task of a
    range gives, for each replicate, its positives, its negatives and the area between
    them, and the ranges of a replicate are put together in order.  Nothing is collected;
    replicates with one class are skipped.
    """
    ship(df.sparkSession)
    g = M._clean(df).groupBy("p").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))

    def run(key, tab):
        tab = tab.sort_by("p")
        pos, neg = tab["pos"].to_numpy(), tab["neg"].to_numpy()
        out = []
        for k in range(-1, n_boot):  # -1: the rows themselves
            rng = np.random.default_rng([seed, k + 1, int(key[0].as_py())])
            a, b = (pos, neg) if k < 0 else (rng.poisson(pos).astype(float), rng.poisson(neg).astype(float))
            out.append((k, int(key[0].as_py()), float(((np.cumsum(b) - b / 2) * a).sum()), float(a.sum()), float(b.sum())))
        return pa.table(dict(zip(("k", "part", "area", "pos", "neg"), map(pa.array, zip(*out)))))

    cut = with_ranges(g, "p", "part", tasks)
    sums = cut.groupBy("part").applyInArrow(run, "k long, part long, area double, pos double, neg double")
    # a range's positives also beat the negatives of the ranges before
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    add = lambda s, x: F.struct((s["area"] + x["area"] + x["pos"] * s["neg"]).alias("area"), (s["pos"] + x["pos"]).alias("pos"), (s["neg"] + x["neg"]).alias("neg"))
    each = sums.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("part", "area", "pos", "neg"))), start, add).alias("s"))
    v = each.select("k", F.try_divide("s.area", F.col("s.pos") * F.col("s.neg")).alias("v"))
    boot = F.when(F.col("k") >= 0, F.col("v"))
    q = v.agg(F.max(F.when(F.col("k") < 0, F.col("v"))).alias("auc"), F.percentile(boot, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(boot).alias("n_boot"))
    return q.select("auc", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "n_boot")


def registry(seed: int = 42) -> dict:
    """name -> (estimator, parameter grid); models that Spark doesn't have raise KeyError."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
    from pyspark.ml.tuning import ParamGridBuilder

    lr, rf, gbt, dt = LogisticRegression(maxIter=100), RandomForestClassifier(seed=seed, numTrees=100), GBTClassifier(seed=seed, maxIter=30), DecisionTreeClassifier(seed=seed)
    return {
        "logistic": (lr, ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0]).build()),
        "random_forest": (rf, ParamGridBuilder().addGrid(rf.maxDepth, [4, 8]).build()),
        "gradient_boosting": (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, [2, 4]).build()),
        "decision_tree": (dt, ParamGridBuilder().addGrid(dt.maxDepth, [3, 6]).build()),
        "naive_bayes": (NaiveBayes(modelType="gaussian"), []),
    }


def nested_cv(df: DataFrame, features: Iterable[str], outcome: str, group: str, *, models: Iterable[str] = ("logistic",), folds: int = 5, inner: int = 3, seed: int = 42) -> DataFrame:
    """(model, fold, y, p): out-of-fold probabilities; parameters are chosen by inner
    cross-validation on the training rows, medians and scales come from the training rows
    only, and no group is on both sides of any split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator

    feats, known = list(features), registry(seed)
    base = group_folds(df.where(F.col(outcome).isNotNull()), group, folds, seed=seed).select(group, F.col(outcome).cast("double").alias("y"), "fold", *[F.col(f).cast("double").alias(f) for f in feats]).cache()
    gaps = columns_with_gaps(base, feats)
    out = None
    for name in models:
        est, grid = known[name]
        est = est.copy({est.getParam("featuresCol"): "scaled", est.getParam("labelCol"): "y"})
        for k in range(folds):
            tr, te = base.where(F.col("fold") != k), base.where(F.col("fold") == k)
            middle = medians(tr, gaps)  # of the training rows, once for all fits
            tr, te = fill(tr, middle), fill(te, middle)
            tr = group_folds(tr.drop("fold"), group, inner, seed=seed + 1)
            steps = [VectorAssembler(inputCols=feats, outputCol="v", handleInvalid="skip"), StandardScaler(inputCol="v", outputCol="scaled", withMean=True)]
            if grid:
                ev = BinaryClassificationEvaluator(labelCol="y")
                est_ = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=inner, foldCol="fold", seed=seed)
            else:
                est_ = est
            fit = Pipeline(stages=[*steps, est_]).fit(tr)
            part = fit.transform(te).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "y", vector_to_array("probability")[1].alias("p"))
            out = part if out is None else out.unionAll(part)
    return out
