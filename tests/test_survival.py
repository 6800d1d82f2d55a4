"""Cox models: exact at any size, ties, and cross-validation, against plain versions."""

import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from spindrift.functions.stats import concordance_index
from spindrift.models import survival
from spindrift.models.cv import group_folds
from spindrift.plans import catalog, studies  # noqa: F401  studies adds to the catalog
from tests.oracle import rows


def plain_score(x, t, e, b):
    """Derivative of the partial likelihood where times don't repeat."""
    o = np.argsort(-t)
    w = np.exp(x[o] * b)
    return float((x[o] - np.cumsum(w * x[o]) / np.cumsum(w))[e[o] == 1].sum())


@pytest.mark.parametrize("seed", range(4))
def test_cox_solves_the_score_equation_on_many_rows(seed):
    rng = np.random.default_rng(seed)
    x, t, e = rng.exponential(0.3, 20000), rng.permutation(20000).astype(float), rng.random(20000) < 0.75
    b, v, _ = survival.cox(x, t, e)
    assert abs(plain_score(x, t, e, b[0])) * v[0, 0] < 1e-11  # the distance from the root


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_does_not_depend_on_blocks(monkeypatch, block, ties):
    rng = np.random.default_rng(5)
    x, t, e = rng.normal(size=(60, 2)), rng.integers(0, 9, 60), rng.integers(0, 2, 60)
    want = survival.cox(x, t, e, 0.01, ties=ties)
    monkeypatch.setattr(survival, "BLOCK", block)
    for a, b in zip(survival.cox(x, t, e, 0.01, ties=ties), want):
        assert np.allclose(a, b, rtol=1e-10, atol=0)


def test_cox_scan_all_same_as_sql_where_times_repeat(spark, tmp_path):
    file = f"{tmp_path}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"copy (select vec_id // 3 + vec_id % 3 * 1000003 as vec_id, embedding, label from '/root/testdata/sf0.01/embeddings.parquet') to '{file}' (format parquet)")
    con.sql(f"create view embeddings as select * from '{file}'")
    got = rows(catalog.QUERIES["cox_scan_all"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.sql(catalog.ORACLES["cox_scan_all"]).df())


def test_fold_of_many_rows_takes_seconds_and_little_memory():
    """What a fold's task does, whose cost per row was a Python loop and a square of features."""
    rng = np.random.default_rng(7)
    n, k = 60000, 12
    x = rng.normal(size=(n, k))
    t, e = rng.exponential(np.exp(-0.3 * x[:, 0])), rng.random(n) < 0.75
    tracemalloc.start()
    begin = time.perf_counter()
    b, _, _ = survival.cox(x, t, e, 0.01)
    c = concordance_index(t, x @ b, e)
    took, peak = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(b[0] - 0.3) < 0.02 and 0.55 < c < 0.62
    assert took < 10 and peak < 12 * x.nbytes


def test_cross_validated_cox_against_plain_folds(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 3)), 3)
    t, e = np.ceil(rng.exponential(np.exp(-x[:, 0])) * 20), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(i, float(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(t, e, x))], "i int, t double, e int, f0 double, f1 double, f2 double")
    fold = {r.i: r.fold for r in group_folds(df, "i", 3).collect()}
    got = survival.cross_validated_cox(df, ["f0", "f1", "f2"], "t", "e", "i", folds=3).collect()
    assert {r.fold for r in got} == {0, 1, 2}
    for r in got:
        te = np.array([fold[i] == r.fold for i in range(300)])
        b, _, _ = survival.cox(x[~te], t[~te], e[~te], 0.1)
        risk, tt, ee = x[te] @ b, t[te], e[te]
        pair = (tt[:, None] < tt[None, :]) & (ee[:, None] == 1)
        won = pair & (risk[:, None] > risk[None, :])
        assert (r.n_train, r.n_test) == ((~te).sum(), te.sum()) and r.c_index == pytest.approx(won.sum() / pair.sum(), abs=1e-12)
