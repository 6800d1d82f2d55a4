"""Quality scorecard: weighted checks with gates, and the data checks behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = {"PASS": 1.0, "PARTIAL": 0.5, "FAIL": 0.0}
GATE_CAP = 59.999


def events_per_variable(df: DataFrame, outcome: str, features: int) -> DataFrame:
    """(events, epv, verdict): 10 events for each feature pass, 5 are partial."""
    e = F.sum(F.col(outcome).cast("long"))
    x = e / F.lit(float(max(1, features)))
    return df.agg(e.alias("events"), F.round(x, 4).alias("epv"), F.when(x >= 10, "PASS").when(x >= 5, "PARTIAL").otherwise("FAIL").alias("verdict"))


def scorecard(checks: DataFrame) -> DataFrame:
    """One row for checks (check_id, verdict, weight, gate): the weighted percentage over the
    checks that apply, capped where a gate failed, and its band."""
    value = F.when(F.col("verdict") == "PASS", 1.0).when(F.col("verdict") == "PARTIAL", 0.5).when(F.col("verdict") == "FAIL", 0.0)
    applies = value.isNotNull()
    s = checks.agg(
        (100 * F.try_divide(F.sum(F.when(applies, F.col("weight") * value)), F.sum(F.when(applies, F.col("weight"))))).alias("weighted_pct"),
        F.coalesce(F.bool_or(F.col("gate") & (F.col("verdict") == "FAIL")), F.lit(False)).alias("gate_capped"),
        F.array_sort(F.collect_list(F.when(F.col("gate") & (F.col("verdict") == "FAIL"), F.col("check_id")))).alias("failed_gates"),
        F.count_if(applies).alias("n_applicable"),
        F.count("*").alias("n_total"),
    )
    pct = F.when(F.col("gate_capped"), F.least("weighted_pct", F.lit(GATE_CAP))).otherwise(F.col("weighted_pct"))
    band = F.when(pct >= 90, "Excellent").when(pct >= 75, "Good").when(pct >= 40, "Moderate").when(pct >= 20, "Weak").otherwise("Poor")
    return s.withColumn("banding_pct", pct).withColumn("band", F.when(pct.isNotNull(), band))


def constant_checks(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "check_id string, verdict string, weight double, gate boolean")
