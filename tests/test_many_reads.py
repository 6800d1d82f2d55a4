"""Training reads its table a few times only, whatever is chosen, fitted and measured on it."""

import numpy as np
from pyspark.sql import functions as F

from spindrift.models import train


def test_training_does_not_make_its_folds_again_and_again(spark):
    rng = np.random.default_rng(1)
    n = 240
    rows = [(i // 2, i % 3, float(rng.normal() + i % 3), None if i % 9 == 0 else float(rng.normal())) for i in range(n)]
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    df = spark.createDataFrame(rows, "patient_id int, y int, f0 double, f1 double").withColumn("f0", F.udf(seen, "double")("f0"))
    model, oof = train.train(df, "y", folds=2)
    assert model.metrics["folds"] == 2 and oof.count() == n and model.metrics["cv_auc_mean"] > 0.6
    assert read.value <= 20 * n
