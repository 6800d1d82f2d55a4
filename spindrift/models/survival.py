"""Cox proportional hazards: a Newton solver for one task, and the scan over features."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.stats import concordance_index
from spindrift.models.cv import group_folds
from spindrift.operators.columns import numeric_columns, usable_columns
from spindrift.shipping import ship

Z95 = 1.959963984540054


def normal_p(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


BLOCK = 1 << 16


def cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, penalizer: float = 0.0, steps: int = 50, ties: str = "efron") -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, covariance, log likelihood) with Efron's or Breslow's handling of ties.

    Columns are standardised while solving; ``penalizer`` is half a ridge on the
    standardised coefficients for each row.  Raises ArithmeticError where it doesn't
    converge.  A step costs one pass over the rows, in blocks of about ``BLOCK`` rows of
    whole times.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"ties: {ties}")
    x = np.asarray(x, float).reshape(len(time), -1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    order = np.argsort(-np.asarray(time, float), kind="stable")
    z, t, e = (x[order] - mean) / scale, np.asarray(time, float)[order], np.asarray(event, float)[order] == 1
    n, k = z.shape
    b = np.zeros(k)
    ridge = penalizer * n

    # rows are from the latest time on: those at risk at a time are all up to its last row
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    last = np.append(first[1:], n) - 1
    of = np.repeat(np.arange(len(first)), last - first + 1)
    died = np.flatnonzero(e)
    at = of[died]
    m = np.bincount(at, minlength=len(first))
    turn = np.arange(len(died)) - (np.cumsum(m) - m)[at]
    share = turn / m[at] if ties == "efron" else np.zeros(len(died))
    tied = share.any()
    cuts = np.unique(np.append(first[np.searchsorted(first, np.arange(0, first[-1] + 1, BLOCK))], n))

    def total(v):
        return np.bincount(at, v, len(first))

    def pieces(b):
        w = np.exp(np.clip(z @ b, -500, 500))
        r0 = np.cumsum(w)[last][at]
        if tied:
            r0 = r0 - share * total(w[died])[at]
        # expected events of each row: its weight over those at risk, at each event it lives to see
        due = w * np.cumsum(total(1 / r0)[::-1])[::-1][of]
        if tied:
            due[died] -= w[died] * total(share / r0)[at]
        ll, g, h = (z[died] @ b).sum() - np.log(r0).sum(), z.T @ (e - due), np.zeros((k, k))
        before = np.zeros(k)
        for lo, hi in zip(cuts, cuts[1:]):
            d = slice(*np.searchsorted(died, (lo, hi)))
            wz = w[lo:hi, None] * z[lo:hi]
            s1 = before + np.cumsum(wz, axis=0)
            u = s1[last[at[d]] - lo]
            if tied and len(u):
                own = np.add.reduceat(wz[died[d] - lo], np.flatnonzero(turn[d] == 0), axis=0)
                u -= share[d, None] * np.repeat(own, m[np.unique(at[d])], axis=0)
            u /= r0[d, None]
            h += (z[lo:hi] * due[lo:hi, None]).T @ z[lo:hi] - u.T @ u
            before = s1[-1]
        return ll - 0.5 * ridge * b @ b, g - ridge * b, h + ridge * np.eye(k)

    ll, g, h = pieces(b)
    still = False
    for _ in range(steps):
        step = np.linalg.solve(h, g)
        size = 1.0
        while True:
            new = pieces(b + size * step)
            # a sum over many rows is only so exact
            if np.isfinite(new[0]) and new[0] >= ll - 1e-11 * (1 + abs(ll)):
                break
            size /= 2
            if size < 1e-6:
                raise ArithmeticError("no ascent")
        b = b + size * step
        was, still = still, abs(new[0] - ll) < 1e-10 * (1 + abs(ll))
        ll, g, h = new
        if np.abs(b).max() > 60:
            raise ArithmeticError("diverges")
        # with many rows the likelihood stands still some digits too early; the step after that squares the error
        if was and still and np.abs(g).max() < 1e-5 * (1 + n):
            return b / scale, np.linalg.inv(h) / np.outer(scale, scale), ll
    raise ArithmeticError("no convergence")


def long_form(df: DataFrame, features: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """(feature, value, kept columns), one row for each feature that isn't NULL or NaN."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x")
    return df.select(*keep, parts).select("x.feature", "x.value", *keep).where("value is not null and not isnan(value)")


SCAN = "feature string, coef double, hr double, hr_ci_low double, hr_ci_high double, p double"


def cox_scan(df: DataFrame, time: str = "OS_months", event: str = "OS_event", features: Iterable[str] | None = None, exclude: Iterable[str] = ("patient_id",), ties: str = "efron") -> DataFrame:
    """One Cox model for each feature: (feature, coef, hr, hr_ci_low, hr_ci_high, p).

    Rows that miss the feature, time or event don't count; features with fewer than 10
    rows, without spread, or without a converging fit are left out.  ``ties`` is "efron" or
    "breslow".  One shuffle by feature, one task call for each; order by p and feature to
    rank them.
    """
    ship(df.sparkSession)
    feats = list(features) if features is not None else numeric_columns(df, [time, event, *exclude])
    long = long_form(df, feats, [time, event]).na.drop(subset=[time, event])

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) >= 10 and g["value"].std() > 0 and g[event].sum() > 0:
            try:
                b, v, _ = cox(g[["value"]].to_numpy(), g[time].to_numpy(), g[event].to_numpy(), ties=ties)
                se = math.sqrt(v[0, 0])
                if se > 0 and math.isfinite(se):
                    out.append((key[0], b[0], math.exp(b[0]), math.exp(b[0] - Z95 * se), math.exp(b[0] + Z95 * se), normal_p(b[0] / se)))
            except (ArithmeticError, np.linalg.LinAlgError):
                pass
        return pd.DataFrame(out, columns=["feature", "coef", "hr", "hr_ci_low", "hr_ci_high", "p"])

    return long.groupBy("feature").applyInPandas(one, SCAN)


def cross_validated_cox(df: DataFrame, features: Iterable[str], time: str, event: str, group: str, folds: int = 5, penalizer: float = 0.1, top: int = 50) -> DataFrame:
    """(fold, n_train, n_test, c_index): per fold the ``top`` features by their own Cox p
    inside the training rows, a ridge Cox on them, and its concordance on the test rows.

    Rows are sent once to each fold's task, as every fold trains on nearly all of them; use
    it for tables that fit a task, or cut the table by a sample of groups first.
    """
    ship(df.sparkSession)
    feats = usable_columns(df, features, 1e-12, complete=False)
    rows = group_folds(df.na.drop(subset=[time, event]), group, folds).select(time, event, *feats, F.col("fold").alias("own"))
    every = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        test = g["own"] == key[0]
        tr, te = g[~test], g[test]
        med = tr[feats].median()
        xt, xe = tr[feats].fillna(med).fillna(0.0), te[feats].fillna(med).fillna(0.0)
        ps = []
        for f in feats:
            try:
                if xt[f].std() > 1e-6:
                    b, v, _ = cox(xt[[f]].to_numpy(), tr[time].to_numpy(), tr[event].to_numpy(), 0.01)
                    ps.append((normal_p(b[0] / math.sqrt(v[0, 0])), f))
            except (ArithmeticError, np.linalg.LinAlgError):
                continue
        use = [f for _, f in sorted(ps)[:top]]
        c = None
        if use and len(te):
            try:
                b, _, _ = cox(xt[use].to_numpy(), tr[time].to_numpy(), tr[event].to_numpy(), penalizer)
                c = concordance_index(te[time], xe[use].to_numpy() @ b, te[event])
            except (ArithmeticError, np.linalg.LinAlgError):
                c = None
        return pd.DataFrame([(int(key[0]), len(tr), len(te), c)], columns=["fold", "n_train", "n_test", "c_index"])

    return every.groupBy("fold").applyInPandas(one, "fold int, n_train long, n_test long, c_index double")


def integrated_brier(time_tr, event_tr, time_te, event_te, survival, grid) -> float | None:
    """Graf's estimator with censoring weights: ``survival`` is (test rows x grid times)."""
    time_tr, event_tr, time_te, event_te = (np.asarray(a, float) for a in (time_tr, event_tr, time_te, event_te))
    times, counts = np.unique(time_tr, return_counts=True)
    at_risk = counts[::-1].cumsum()[::-1]
    censored = np.array([((time_tr == t) & (event_tr == 0)).sum() for t in times])
    g = np.cumprod(1 - censored / at_risk)

    def weight(t, before):
        i = np.searchsorted(times, t, side="left" if before else "right") - 1
        return np.where(i >= 0, g[np.maximum(i, 0)], 1.0)

    scores = []
    for k, t in enumerate(grid):
        s = survival[:, k]
        died, alive = (time_te <= t) & (event_te == 1), time_te > t
        w = np.where(died, 1 / np.maximum(weight(time_te, True), 1e-12), 0) * s**2 + np.where(alive, 1 / np.maximum(weight(np.full(len(s), t), False), 1e-12), 0) * (1 - s) ** 2
        scores.append(w.mean())
    if len(grid) < 2:
        return None
    return float(np.trapezoid(scores, grid) / (grid[-1] - grid[0]))
