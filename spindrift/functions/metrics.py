"""Discrimination, calibration and utility of predictions, as one-row DataFrames.

Tables of predictions have ``y`` (0 or 1, or a class) and ``p``.  Rows with a NULL in
either are left out.  A statistic that isn't defined, for want of rows or of a class, is
NULL and never an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.functions.prefix import average_ranks, running_totals, with_ranges
from spindrift.shipping import ship


def _clean(df: DataFrame) -> DataFrame:
    return df.select(F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p")).where("y is not null and p is not null and not isnan(p)")


def brier(df: DataFrame) -> DataFrame:
    return _clean(df).agg(F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))


def _bin(p, bins: int):
    """Number of the bin by comparing with the edges i/bins; the last bin is closed."""
    inside = (p >= 0.0) & (p <= 1.0)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    number = F.lit(0)
    for e in edges:
        number = number + (p >= F.lit(e)).cast("int")
    return F.when(inside, number)


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins; p outside [0, 1] counts in n only."""
    d = _clean(df).withColumn("b", _bin(F.col("p"), bins))
    per = d.groupBy("b").agg(F.count("*").alias("n"), F.avg("p").alias("pm"), F.avg("y").alias("ym"))
    gap = F.sum(F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("pm") - F.col("ym"))).otherwise(0.0))
    return per.agg(F.round(F.try_divide(gap, F.sum("n").cast("double")), 6).alias("ece"))


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted by half."""
    d = _clean(df).groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranked = average_ranks(_clean(df), "p").select("p", "rank")
    s = d.join(ranked, "p").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("n"))
    return s.select(F.round(F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * (F.col("n") - F.col("np"))), 6).alias("auc"))


def _curve(df: DataFrame) -> DataFrame:
    """Per distinct score, from the highest: positives, rows, and both cumulated."""
    g = _clean(df).groupBy("p").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    return running_totals(g, "p", {"ctp": "tp", "cn": "n"}, descending=True)


def average_precision(df: DataFrame) -> DataFrame:
    c = _curve(df)
    total = c.agg(F.sum("tp").alias("pos"))
    return c.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.try_divide(F.col("tp") * F.col("ctp"), F.col("pos") * F.col("cn"))), 6).alias("ap"))


def youden(df: DataFrame) -> DataFrame:
    """(threshold, youden_j): the highest score where TPR - FPR is greatest."""
    c = _curve(df)
    total = c.agg(F.sum("tp").alias("pos"), F.sum(F.col("n") - F.col("tp")).alias("neg"))
    j = F.try_divide("ctp", "pos") - F.try_divide(F.col("cn") - F.col("ctp"), F.col("neg"))
    return c.crossJoin(F.broadcast(total)).select("p", j.alias("j")).agg(F.max_by("p", F.struct("j", "p")).alias("p"), F.max("j").alias("j")).select(F.round("p", 6).alias("threshold"), F.round("j", 6).alias("youden_j"))


def net_benefit(df: DataFrame, thresholds=(0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """(threshold, net_benefit, treat_all, beats_default) for each threshold, in one pass."""
    d = _clean(df)
    spans = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    g = d.select("y", "p", spans).groupBy("threshold").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("p") >= F.col("threshold"), F.col("y")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("p") >= F.col("threshold"), 1 - F.col("y")).otherwise(0.0)).alias("fp"),
        F.avg("y").alias("prev"),
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    nb, every = F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds, F.col("prev") - (1 - F.col("prev")) * odds
    return g.select("threshold", F.round(nb, 4).alias("net_benefit"), F.round(every, 4).alias("treat_all"), (nb > F.greatest(every, F.lit(0.0))).alias("beats_default"))


def at_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """(accuracy, sensitivity, specificity) of calling p >= threshold positive."""
    d = _clean(df).withColumn("c", (F.col("p") >= threshold).cast("double"))
    hit = F.count_if((F.col("y") == 1) & (F.col("c") == 1))
    rest = F.count_if((F.col("y") == 0) & (F.col("c") == 0))
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return d.agg(
        rate(hit + rest, F.count("*")).alias("accuracy"),
        rate(hit, F.count_if(F.col("y") == 1)).alias("sensitivity"),
        rate(rest, F.count_if(F.col("y") == 0)).alias("specificity"),
    )


def dominance(time: np.ndarray, risk: np.ndarray, event: np.ndarray) -> tuple[int, int, int]:
    """Of rows i with an event and rows j of a later time: how many pairs, in how many j has
    the lower risk, and in how many the same.  Counted for all i at once, bit by bit of the
    risks' ranks, in O(n log n)."""
    order = np.argsort(-time, kind="stable")
    t, e = time[order], event[order] == 1
    x = np.unique(risk, return_inverse=True)[1].ravel()[order]
    hi = np.searchsorted(-t, -t[e], side="left")  # rows before this one have a later time
    lo, mine = np.zeros_like(hi), x[e]
    pairs, below = int(hi.sum()), 0
    for level in range(max(1, int(x.max(initial=0)).bit_length()) - 1, -1, -1):
        bit = x >> level & 1
        ones = np.concatenate([[0], np.cumsum(bit)])
        zeros, up = len(x) - int(ones[-1]), (mine >> level & 1).astype(bool)
        lo1, hi1 = ones[lo], ones[hi]
        below += int(((hi - hi1) - (lo - lo1))[up].sum())
        lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        x = np.concatenate([x[bit == 0], x[bit == 1]])
    return pairs, below, int((hi - lo).sum())


def concordance(df: DataFrame, by: list[str] | None = None, *, ranges: int | None = None) -> DataFrame:
    """Harrell's c of (risk, time, event), per ``by`` where given: of the pairs whose earlier
    time is an event, the share in which the earlier has the higher risk, ties by half.

    Time and risk are cut into ranges.  Pairs inside a range of time are counted by one task
    for each such range, pairs of different ranges of time inside a range of risk by one
    task for each of those, and all others by the counts of range pairs.
    """
    ship(df.sparkSession)
    by = list(by or [])
    n = ranges or min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = df.select(*by, F.col("risk").cast("double").alias("risk"), F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event")).where("risk is not null and time is not null and event is not null and not isnan(risk) and not isnan(time)")
    x = with_ranges(with_ranges(x, "time", "__t", n), "risk", "__r", n)
    keys = StructType([df.schema[c] for c in by])
    out = StructType(keys.fields).add("pairs", "long").add("below", "long").add("ties", "long")

    def count(time: str):
        def run(key, tab):
            got = dominance(tab[time].to_numpy(), tab["risk"].to_numpy(), tab["event"].to_numpy())
            return pa.table([pa.array([k.as_py()], k.type) for k in key[:-1]] + [pa.array([v], pa.int64()) for v in got], names=out.names)

        return run

    inside = x.groupBy(*by, "__t").applyInArrow(count("time"), out)
    across = x.groupBy(*by, "__r").applyInArrow(count("__t"), out)
    cells = x.groupBy(*by, "__t", "__r").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event") == 1, 1).otherwise(0)).alias("e"))

    def far(key, tab):  # pairs of different ranges of both, one row for each pair of ranges
        t, r = tab["__t"].to_numpy().astype(int), tab["__r"].to_numpy().astype(int)
        n, e = (np.zeros((t.max() + 1, r.max() + 1), np.int64) for _ in range(2))
        n[t, r], e[t, r] = tab["n"].to_numpy(), tab["e"].to_numpy()
        later = np.zeros_like(n)
        later[:-1] = n[::-1].cumsum(axis=0)[::-1][1:]
        lower = later.cumsum(axis=1) - later
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([int(v)], pa.int64()) for v in ((e * (later.sum(axis=1, keepdims=True) - later)).sum(), (e * lower).sum(), 0)], names=out.names)

    whole = cells.groupBy(*by).applyInArrow(far, out) if by else cells.withColumn("__k", F.lit(0)).groupBy("__k").applyInArrow(lambda key, tab: far((), tab), out)
    # ``across`` counts the pairs inside a range of risk, ``far`` those of different ranges
    s = inside.unionAll(across).unionAll(whole).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pairs", "below", "ties")])
    return s.select(*by, F.round(F.try_divide(F.col("below") + F.col("ties") / F.lit(2.0), F.col("pairs")), 6).alias("c_index"))


def concordance_ci(df: DataFrame, unit: str, *, parts: int = 20, z: float = 1.959963984540054) -> DataFrame:
    """(c_index, se, ci_lo, ci_hi): Harrell's c with the interval of the jackknife that
    leaves out a ``parts``-th of the units (whole numbers) at a time."""
    kept = df.where(F.col(unit).isNotNull()).withColumn("__part", F.explode(F.sequence(F.lit(-1), F.lit(parts - 1)))).where(F.col("__part") != F.pmod(unit, F.lit(parts)))
    c = concordance(kept, ["__part"])
    left = F.when(F.col("__part") >= 0, F.col("c_index"))
    s = c.agg(F.max(F.when(F.col("__part") == -1, F.col("c_index"))).alias("c_index"), F.sqrt(F.var_pop(left) * (F.count(left) - 1)).alias("se"))
    return s.select("c_index", F.round("se", 6).alias("se"), F.round(F.col("c_index") - z * F.col("se"), 6).alias("ci_lo"), F.round(F.col("c_index") + z * F.col("se"), 6).alias("ci_hi"))


def class_report(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of columns y and pred; 0 where undefined."""
    n = df.groupBy("y", "pred").agg(F.count("*").alias("n"))
    every = n.select(F.col("y").alias("class"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).alias("called"))
    called = n.select(F.col("pred").alias("class"), F.lit(0).alias("hit"), F.lit(0).alias("support"), F.col("n").alias("called"))
    g = every.unionByName(called).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "called")])
    prec, rec = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called").cast("double")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    return g.select("class", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)), 6).alias("f1"), "support")


def multiclass_brier(df: DataFrame, classes: int) -> DataFrame:
    """Mean squared distance of the vector ``p`` (an array) from the one-hot of y; 0 to 2."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("y")).cast("double"))
    gap = F.aggregate(F.zip_with("p", hot, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.round(F.avg(gap), 6).alias("brier"))


def multiclass_ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration error of the top label: its confidence as p, whether it is right as y."""
    top = F.array_max("p")
    return ece(df.select((F.array_position("p", top) - 1 == F.col("y")).cast("double").alias("y"), top.alias("p")), bins)


def macro_auc(df: DataFrame, classes: int) -> DataFrame:
    """Mean of the one-against-rest areas of the classes that have both labels."""
    parts = None
    for k in range(classes):
        one = auc(df.select((F.col("y") == k).cast("double").alias("y"), F.element_at("p", k + 1).alias("p")))
        parts = one if parts is None else parts.unionAll(one)
    return parts.agg(F.round(F.avg("auc"), 6).alias("macro_auc"))
