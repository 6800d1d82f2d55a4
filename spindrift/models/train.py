"""Choosing features, training with group-aware folds, saved models, prediction, evaluation
and feature importance, on ``pyspark.ml``."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions import stats as S
from spindrift.functions.summaries import by_method
from spindrift.models.cv import fold_count, group_folds
from spindrift.operators.columns import columns_with_gaps, fill, impute_median, medians, numeric_columns, usable_columns


def sanitize(df: DataFrame, features: Iterable[str], *, site: str | None = None, label: str | None = None, confounders: Iterable[str] = (), icc_threshold: float | None = None, key: str | None = "patient_id", residualize: bool = True) -> tuple[DataFrame, list[str]]:
    """(table, kept features): columns with gaps or without spread go; ComBat over ``site``
    keeps the label's and the confounders' effects; features whose values before and after
    agree less than ``icc_threshold`` go; confounders are regressed out.

    Every step is optional.  One site, or none, skips ComBat and the agreement; a table
    without the key column skips the agreement.
    """
    confounders = list(confounders)
    kept, out = usable_columns(df, features, 0.0), df
    several = site is not None and df.select(site).distinct().limit(2).count() > 1
    if several:
        out = S.combat(out, kept, site, categorical=[label] if label else [], continuous=confounders)
    if several and icc_threshold is not None and key in df.columns:
        good = set(S.icc_keep(S.icc_table(df, out, kept, key), icc_threshold))
        out, kept = out.drop(*[c for c in kept if c not in good]), [c for c in kept if c in good]
    if confounders and residualize:
        out = S.residualize(out, kept, confounders)
    return out.select(*[c for c in df.columns if c in out.columns and (c in kept or c not in set(features))]), kept


def stable_features(before: DataFrame, after: DataFrame, features: Iterable[str], key: str, threshold: float = 0.75) -> DataFrame:
    """(feature, icc3) of the features whose ICC is at least the threshold."""
    return S.icc_table(before, after, features, key).where(F.col("icc3") >= threshold)


def fitted_logistic(df: DataFrame, features: list[str], outcome: str, c: float = 0.1):
    """Scaled logistic regression with ridge 1 / (c n), of two or more classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    n = df.count()
    filled = [f"__{f}" for f in features]
    steps = [
        Imputer(strategy="median", relativeError=1e-6, inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__v"),
        StandardScaler(inputCol="__v", outputCol="__scaled", withMean=True),
        LogisticRegression(featuresCol="__scaled", labelCol=outcome, regParam=1 / (c * max(n, 1)), standardization=False, maxIter=500, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred"),
    ]
    return Pipeline(stages=steps).fit(df)


def choose(df: DataFrame, features: Iterable[str], outcome: str, *, top: int = 50, threshold: float = 0.95) -> list[str]:
    """Features with spread (standard deviation above 1e-6) that don't correlate with an
    earlier one, and of those the ``top`` by the size of their logistic coefficients."""
    feats = usable_columns(df, features, 1e-12, complete=False)
    if not feats:
        return []
    gaps = columns_with_gaps(df, feats)
    filled = fill(df, medians(df, gaps))
    feats = S.prune_correlated(feats, S.correlations(filled, feats), threshold)
    if len(feats) <= top:
        return feats
    size = np.abs(fitted_logistic(filled, feats, outcome).stages[-1].coefficientMatrix.toArray()).max(axis=0)
    best = np.argsort(-size, kind="stable")[:top]
    return [feats[i] for i in sorted(best)]


@dataclass
class Classifier:
    """A fitted pipeline with what prediction needs to know."""

    pipeline: PipelineModel
    features: list[str]
    classes: list[int]
    metrics: dict

    def save(self, path: str) -> None:
        """The pipeline and a line of JSON, on any file system that Spark writes."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        info = json.dumps({"features": self.features, "classes": self.classes, "metrics": self.metrics})
        SparkSession.active().createDataFrame([(info,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @classmethod
    def load(cls, path: str) -> Classifier:
        info = json.loads(SparkSession.active().read.text(f"{path}/info").first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), info["features"], info["classes"], info["metrics"])

    def predict(self, df: DataFrame, key: str = "patient_id") -> DataFrame:
        """(key, proba), or with more than two classes (key, proba_<class> ..., pred_class);
        gaps are filled with the training medians."""
        p = vector_to_array("__p")
        x = self.pipeline.transform(df.withColumns({f: F.col(f).cast("double") for f in self.features}))
        if len(self.classes) <= 2:
            return x.select(key, p[1].alias("proba"))
        each = [p[c].alias(f"proba_{c}") for c in self.classes]
        return x.select(key, *each, F.col("__pred").cast("int").alias("pred_class"))


PART = 100_000


def train(df: DataFrame, outcome: str, *, features: Iterable[str] | None = None, group: str = "patient_id", folds: int = 5, top: int = 50, threshold: float = 0.95, seed: int = 42) -> tuple[Classifier, DataFrame]:
    """(model, out-of-fold predictions): features are chosen and scaled inside the folds, no
    group is on both sides, and the model itself is fitted on all rows.

    Predictions are (fold, y, p) or, with more than two classes, (fold, y, p array, pred).
    ``metrics`` has the folds' AUC (macro one-against-rest with more than two classes).
    A table of fewer than 4 rows or of one class is fitted without folds.
    """
    feats = list(features) if features is not None else numeric_columns(df, [outcome, group, "patient_id", "PatientID"])
    rows = df.where(F.col(outcome).isNotNull()).withColumns({outcome: F.col(outcome).cast("int"), **{f: F.col(f).cast("double") for f in feats}})
    classes = sorted(r[0] for r in rows.select(outcome).distinct().collect())
    folds, _ = fold_count(rows, group, folds)
    oof, areas, chosen_n = None, [], []
    n = rows.count()
    if n >= 4 and len(classes) > 1:
        # every choice, fit and area reads them again, without what made them, in a few parts a core
        parts = max(df.sparkSession.sparkContext.defaultParallelism, n // PART)
        cut = group_folds(rows, group, folds, label=outcome, seed=seed).select(outcome, "fold", *feats).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
        for k in range(folds):
            tr, te = cut.where(F.col("fold") != k), cut.where(F.col("fold") == k)
            use = choose(tr, feats, outcome, top=top, threshold=threshold)
            chosen_n.append(len(use))
            if not use or te.isEmpty():
                continue
            part = fitted_logistic(tr, use, outcome).transform(te)
            p = vector_to_array("__p")
            part = part.select(F.lit(k).alias("fold"), F.col(outcome).alias("y"), *([p[1].alias("p")] if len(classes) <= 2 else [p.alias("p"), F.col("__pred").cast("int").alias("pred")])).persist(StorageLevel.MEMORY_AND_DISK)
            area = (M.auc(part) if len(classes) <= 2 else M.macro_auc(part, classes[-1] + 1)).first()[0]
            if area is not None:
                areas.append(area)
            oof = part if oof is None else oof.unionAll(part)
        cut.unpersist()
    final = choose(rows, feats, outcome, top=top, threshold=threshold)
    info = {"cv_auc_mean": float(np.mean(areas)) if areas else None, "cv_auc_std": float(np.std(areas)) if areas else None, "cv_features_per_fold": chosen_n, "folds": folds if areas else 0}
    return Classifier(fitted_logistic(rows, final, outcome), final, classes, info), oof


def evaluate(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(n, auc, ap, brier, ece, accuracy, sensitivity, specificity) of y and p, one row."""
    out = predictions.agg(F.count("*").alias("n"))
    for part in (M.auc, M.average_precision, M.brier, M.ece, lambda d: M.at_threshold(d, threshold)):
        out = out.crossJoin(F.broadcast(part(predictions)))
    return out


def external(train_rows: DataFrame, rows: DataFrame, outcome: str, *, features: Iterable[str] | None = None, calibration: DataFrame | None = None, weight: float = 1.0, group: str = "patient_id") -> DataFrame:
    """(y, p) of other rows under a model refitted on all training rows, with the features
    that both have.  Calibration rows join the training with ``weight`` copies' worth of
    rows, unless they lack a class."""
    from spindrift.functions.summaries import shared_columns

    feats = list(features) if features is not None else shared_columns(train_rows, rows, [outcome, group])
    base = train_rows.select(outcome, *feats)
    if calibration is not None and calibration.select(outcome).distinct().count() > 1:
        base = base.unionByName(calibration.select(outcome, *feats).withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(int(weight))))).drop("__c"))
    base = base.withColumns({outcome: F.col(outcome).cast("int"), **{f: F.col(f).cast("double") for f in feats}})
    fit = fitted_logistic(base, choose(base, feats, outcome), outcome)
    x = rows.withColumns({outcome: F.col(outcome).cast("int"), **{f: F.col(f).cast("double") for f in feats}})
    return fit.transform(x).select(F.col(outcome).alias("y"), vector_to_array("__p")[1].alias("p"))


def shuffled(df: DataFrame, columns: Iterable[str], seed: int, buckets: int = 64) -> DataFrame:
    """``df`` with ``<column>__s``: another row's values, a permutation inside each of
    ``buckets`` random buckets of rows, so that no task orders all rows."""
    columns = list(columns)
    h = F.xxhash64(F.lit(seed), *df.columns)
    d = df.withColumn("__b", F.pmod(h, F.lit(buckets))).withColumn("__h", F.xxhash64(F.lit(seed + 1), "__b", h))
    w = Window.partitionBy("__b").orderBy("__h", *columns)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy("__b"))
    return d.withColumns({f"{c}__s": F.when(last, F.first(c).over(whole)).otherwise(F.lead(c).over(w)) for c in columns}).drop("__b", "__h")


def importance(df: DataFrame, outcome: str, *, event: str | None = None, features: Iterable[str] | None = None, methods: Iterable[str] = ("model", "permutation"), trees: int = 200, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(method, feature, importance, importance_std) by method and descending importance.

    A random forest is fitted on all rows.  ``model`` is its impurity importance,
    ``permutation`` the mean loss of accuracy over ``repeats`` shuffles of a feature, with
    its deviation.  With ``event`` the outcome is a time, cut at its median, and the event
    column is no feature.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    feats = list(features) if features is not None else numeric_columns(df, [outcome, "patient_id", "PatientID", *([event] if event else [])])
    rows = df.where(F.col(outcome).isNotNull())
    if event is not None:
        middle = rows.agg(F.median(outcome).alias("__m"))
        rows = rows.crossJoin(F.broadcast(middle)).withColumn("__y", (F.col(outcome) >= F.col("__m")).cast("double"))
    else:
        rows = rows.withColumn("__y", F.col(outcome).cast("double"))
    rows = impute_median(rows.select("__y", *[F.col(f).cast("double").alias(f) for f in feats]), feats)
    fit = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="__v"), RandomForestClassifier(featuresCol="__v", labelCol="__y", numTrees=trees, seed=seed)]).fit(rows)
    out = []
    if "model" in methods:
        out += [("model", f, float(v), None) for f, v in zip(feats, fit.stages[-1].featureImportances.toArray())]
    if "permutation" in methods:
        loss = {f: [] for f in feats}
        for k in range(repeats):
            # one row for each feature with that feature shuffled, and one with none
            s = shuffled(rows, feats, seed + 2 * k)
            which = F.explode(F.sequence(F.lit(-1), F.lit(len(feats) - 1))).alias("__k")
            mixed = s.select("__y", *feats, *[f"{f}__s" for f in feats], which)
            mixed = mixed.select("__y", "__k", *[F.when(F.col("__k") == i, F.col(f"{f}__s")).otherwise(F.col(f)).alias(f) for i, f in enumerate(feats)])
            hit = {r["__k"]: r["a"] for r in fit.transform(mixed).groupBy("__k").agg(F.avg((F.col("prediction") == F.col("__y")).cast("double")).alias("a")).collect()}
            for i, f in enumerate(feats):
                loss[f].append(hit[-1] - hit[i])
        out += [("permutation", f, float(np.mean(v)), float(np.std(v))) for f, v in loss.items()]
    return by_method(spark.createDataFrame(out, "method string, feature string, importance double, importance_std double"))
