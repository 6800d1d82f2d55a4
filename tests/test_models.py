"""Models, folds and rank counts against plain versions and literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions import prefix, summaries
from spindrift.models import classify, cv, train


def test_dominance_counts_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 30, 200):
        t, r, e = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n).astype(float), rng.integers(0, 2, n)
        later = (t[:, None] < t[None, :]) & (e[:, None] == 1)
        assert M.dominance(t, r, e) == (later.sum(), (later & (r[:, None] > r[None, :])).sum(), (later & (r[:, None] == r[None, :])).sum())


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_concordance_does_not_depend_on_ranges(spark, ranges):
    rows = [(float(i * 37 % 11), i * 53 % 17, i % 3 % 2, i % 2) for i in range(60)] + [(None, 1, 1, 0), (1.0, None, 1, 1), (float("nan"), 3, 1, 1)]
    df = spark.createDataFrame(rows, "risk double, time int, event int, g int")
    got = {x.g: x.c_index for x in M.concordance(df, ["g"], ranges=ranges).collect()}
    for g in (0, 1):
        pairs = [(a, b) for a in rows[:60] for b in rows[:60] if a[3] == b[3] == g and a[2] == 1 and a[1] < b[1]]
        assert got[g] == pytest.approx(sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a, b in pairs) / len(pairs), abs=1e-6)
    assert M.concordance(df.where("event = 0")).first().c_index is None
    assert M.concordance(df.limit(0)).first().c_index is None


@pytest.mark.parametrize("ranges", [1, 4])
def test_dense_ranks_of_text_and_large_numbers(spark, ranges):
    words = ["", "a", "aa", "ab", "abcdefgh", "abcdefgi", "b", "é", "北", None, "a"]
    got = {r.k: r["rank"] for r in prefix.dense_ranks(spark.createDataFrame([(w,) for w in words], "k string"), "k", ranges=ranges).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted({w for w in words if w is not None}, key=lambda w: w.encode()))}
    big = [2**53, 2**53 + 1, 2**53 + 2, -5]
    got = {r.k: r["rank"] for r in prefix.dense_ranks(spark.createDataFrame([(b,) for b in big], "k long"), "k", ranges=ranges).collect()}
    assert got == {b: i + 1 for i, b in enumerate(sorted(big))}


def test_rows_without_group_are_spread_and_stay(spark):
    df = spark.createDataFrame([(i, None if i < 40 else f"g{i // 4}", i % 2) for i in range(400)], "i int, g string, y int")
    for label in (None, "y"):
        a, b = (cv.group_folds(df, "g", 5, label=label).orderBy("i").collect() for _ in range(2))
        assert a == b and len(a) == 400
        assert {r.fold for r in a if r.g is None} == set(range(5))
        assert all(len({r.fold for r in a if r.g == f"g{k}"}) == 1 for k in range(10, 100))
    assert cv.group_folds(df, "absent", 5).select("fold").distinct().count() == 5


def test_bootstrap_interval_covers(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    p = np.round(y * 0.5 + rng.normal(0, 0.5, 500), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    one, many = (classify.bootstrap_auc(df, n_boot=2000, tasks=k).first() for k in (1, 6))
    assert one.auc == pytest.approx(classify.rank_auc(y, p)) == pytest.approx(many.auc)
    boot = np.random.default_rng(0)
    want = []
    for _ in range(2000):
        k = boot.integers(0, 500, 500)
        want.append(classify.rank_auc(y[k], p[k]))
    for got in (one, many):
        assert got.n_boot == 2000 and got.ci_lo == pytest.approx(np.percentile(want, 2.5), abs=0.006) and got.ci_hi == pytest.approx(np.percentile(want, 97.5), abs=0.006)
    empty = classify.bootstrap_auc(df.where("y = 1"), n_boot=5).first()
    assert empty.auc is None and empty.n_boot == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        y = i % 3
        x = rng.normal(0, 1, 4)
        rows.append((f"p{i // 2}", y, int(y > 0), float(x[0] + 1.5 * y), float(x[0] + 1.5 * y) * 2, float(x[1]), None if i % 11 == 0 else float(x[2] - y), 7.0))
    return spark.createDataFrame(rows, "patient_id string, y int, b int, f0 double, f1 double, f2 double, f3 double, f4 double")


def test_train_save_load_predict(spark, table, tmp_path):
    model, oof = train.train(table.drop("y"), "b", folds=3)
    assert "f1" not in model.features and "f4" not in model.features  # a copy and a constant
    assert M.auc(oof).first().auc > 0.8 and oof.count() == 120 and abs(model.metrics["cv_auc_mean"] - M.auc(oof).first().auc) < 0.1
    model.save(str(tmp_path / "m"))
    again = train.Classifier.load(str(tmp_path / "m"))
    a, b = (sorted(map(tuple, m.predict(table).collect())) for m in (model, again))
    assert a == b and len(a) == 120 and all(0 <= p <= 1 for _, p in a)


def test_train_three_classes(spark, table):
    model, oof = train.train(table.drop("b"), "y", folds=2)
    got = model.predict(table).collect()
    assert all(abs(r.proba_0 + r.proba_1 + r.proba_2 - 1) < 1e-9 and r.pred_class == int(np.argmax([r.proba_0, r.proba_1, r.proba_2])) for r in got)
    assert M.macro_auc(oof, 3).first().macro_auc > 0.7


def test_train_without_folds(spark, table):
    model, oof = train.train(table.drop("y").limit(3).withColumn("b", F.lit(1)), "b")
    assert oof is None and model.metrics["cv_auc_mean"] is None


def test_importance_finds_the_features_that_matter(spark, table):
    rows = train.importance(table.drop("y", "f1"), "b", trees=30, repeats=3).collect()
    assert [r.method for r in rows] == ["model"] * 4 + ["permutation"] * 4
    assert {r.method: r.feature for r in reversed(rows)} == {"model": "f0", "permutation": "f0"}
    assert next(r.importance for r in rows if r.feature == "f4" and r.method == "permutation") == 0
    survival = train.importance(table.withColumn("OS_months", F.col("f0") + 10).select("OS_months", "b", "f0", "f2"), "OS_months", event="b", trees=10, methods=["model"]).collect()
    assert [r.feature for r in survival] == ["f0", "f2"]


def test_shuffled_is_a_permutation(spark, table):
    s = train.shuffled(table, ["f0", "f3"], 1, buckets=3).collect()
    for c in ("f0", "f3"):
        assert sorted(r[c] or 99 for r in s) == sorted(r[f"{c}__s"] or 99 for r in s)
    assert sum(r.f0 != r.f0__s for r in s) > 100


def test_sanitize_steps(spark, table):
    df = table.withColumn("site", F.when(F.col("f2") > 0, "a").otherwise("b")).withColumn("c", F.col("f2"))
    got, kept = train.sanitize(df, ["f0", "f3", "f4"], site="site", label="b", confounders=["c"])
    assert kept == ["f0"] and got.columns == ["patient_id", "y", "b", "f1", "f2", "f0", "site", "c"] or set(got.columns) == {"patient_id", "y", "b", "f0", "f1", "f2", "site", "c"}
    assert abs(got.stat.corr("f0", "c")) < 1e-6
    one, kept = train.sanitize(df.withColumn("site", F.lit("a")), ["f0", "f2"], site="site", icc_threshold=0.9)
    assert kept == ["f0", "f2"] and one.agg(F.sum("f0")).first() == df.agg(F.sum("f0")).first()


def test_negatives_are_drawn_once(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "i int, y int")
    got = summaries.sampled_negatives(df, "y", "i", ratio=2).collect()
    assert sum(r.y for r in got) == 50 and sum(1 - r.y for r in got) == 100 and len({r.i for r in got}) == 150
    assert summaries.sampled_negatives(df.where("y = 0"), "y", "i").count() == 0
