"""Packing token sequences into bins of equal capacity by cutting-stock column generation.

A document of more tokens than ``CAPACITY`` fills bins of its own with its first pieces;
its last piece, and every shorter document, is an item.  Item lengths are rounded up to a
grain, which leaves a histogram of at most CAPACITY / GRAIN size classes whatever the
number of documents.  A pattern says how many items of each class share a bin.  The linear
program "cover the histogram with the fewest bins" is solved by column generation: a
revised simplex holds a basis of patterns, and its dual prices make the next pattern an
unbounded knapsack, solved by dynamic programming over the grains.  Use counts are rounded
down, and what remains, a few items for each basis pattern, is packed best-fit decreasing.

Patterns become bins by rank: the items of a class are ranked, pattern p owns a range of
each class's ranks, and an item finds its bin from its rank by division.  Ranks are counted
in buckets (by hash of doc_id) with prefix sums of the bucket counts, so no window holds a
whole class.  The driver sees one row for each class, and what is broadcast is the table of
ranges, of at most (classes x patterns) rows; neither grows with the data.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.wavelet import VOCABULARY, encoding, token_ids
from spindrift.shipping import ship

CAPACITY = 2048
GRAIN = 16
BUCKET_ROWS = 1 << 20
TOLERANCE = 1e-7


def knapsack(price: np.ndarray, size: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling of ``units`` by items of given sizes and prices."""
    best = np.zeros(units + 1)
    take = np.full(units + 1, -1)
    for u in range(1, units + 1):
        fits = size <= u
        value = np.where(fits, best[np.maximum(u - size, 0)] + price, -np.inf)
        k = int(np.argmax(value)) if len(size) else -1
        if k >= 0 and value[k] > best[u - 1] + 1e-15:
            best[u], take[u] = value[k], k
        else:
            best[u] = best[u - 1]
    count = np.zeros(len(size), np.int64)
    u = units
    while u > 0:
        if take[u] >= 0:
            count[take[u]] += 1
            u -= int(size[take[u]])
        else:
            u -= 1
    return float(best[units]), count


def gauss_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots; at this size no faster library is needed."""
    n = len(a)
    w = np.concatenate([np.asarray(a, np.float64), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.argmax(np.abs(w[k:, k])))
        if p != k:
            w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        factor = w[:, k].copy()
        factor[k] = 0
        w -= factor[:, None] * w[k]
    return w[:, n:]


def column_generation(size: np.ndarray, demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one for each row) and their fractional uses that cover ``demand`` with
    the fewest bins, and a lower bound of that optimum.  Sizes and units are whole numbers.

    Demands are shifted by different small amounts while pivoting, which keeps a degenerate
    basis from cycling; they are drawn anew every 2000 pivots.  It ends when the bound, the objective over the best price of a
    pattern, is within a quarter of a bin or a part in 100,000."""
    m = len(size)
    rng = np.random.default_rng(m)
    exact, demand = demand, demand + 1e-3 * rng.random(m)
    bound = 0.0
    patterns = np.diag(units // size).astype(np.float64)  # columns: as often as one class fits
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for step in count():
        if step % 200 == 199:
            inverse = gauss_inverse(patterns)
            if step % 2000 == 1999:
                demand = exact + 1e-3 * rng.random(m)
            x = np.maximum(inverse @ demand, 0)
        dual = inverse.sum(axis=0)
        value, column = knapsack(dual, size, units)
        bound = max(bound, float(dual @ exact) / max(value, 1.0))
        if value <= 1 + TOLERANCE or x.sum() - bound < max(0.25, 1e-5 * bound):
            break
        entering = inverse @ column
        ratio = np.where(entering > 1e-10, x / np.where(entering > 1e-10, entering, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x -= theta * entering
        x[out] = theta
        x = np.maximum(x, 0)
        patterns[:, out] = column
        inverse[out] /= entering[out]
        others = entering.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
    x = np.maximum(gauss_inverse(patterns) @ exact, 0)
    return np.rint(patterns.T).astype(np.int64), x, bound


def plan(size: np.ndarray, demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns and whole use counts whose slots are at least the demand of every class,
    and the linear program's optimum, a lower bound for the rounded sizes."""
    size, demand = np.asarray(size, np.int64), np.asarray(demand, np.int64)
    if not len(size):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64), 0.0
    patterns, x, bound = column_generation(size, demand.astype(np.float64), units)
    used = np.floor(x + 1e-6).astype(np.int64)
    left = demand - used @ patterns
    while (left < 0).any():  # rounding made more slots than items: take bins back
        k = int(np.argmax((patterns * (left < 0)).sum(axis=1) * (used > 0)))
        used[k] -= 1
        left = demand - used @ patterns
    rest, room = [], []
    for c in np.argsort(-size, kind="stable"):  # best fit, longest first
        for _ in range(int(left[c])):
            fits = [k for k, r in enumerate(room) if r >= size[c]]
            if fits:
                k = min(fits, key=lambda k: room[k])
            else:
                k = len(room)
                room.append(units)
                rest.append(np.zeros(len(size), np.int64))
            room[k] -= int(size[c])
            rest[k][c] += 1
    if rest:
        patterns = np.concatenate([patterns, np.stack(rest)])
        used = np.concatenate([used, np.ones(len(rest), np.int64)])
    keep = used > 0
    patterns, used = patterns[keep], used[keep]
    patterns, where = np.unique(patterns, axis=0, return_inverse=True)
    return patterns, np.bincount(where.ravel(), used, len(patterns)).astype(np.int64), bound


def ranges(patterns: np.ndarray, used: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class number, first rank, end rank, items of the class in a bin, first bin)."""
    first_bin = np.concatenate([[0], np.cumsum(used)])
    out = []
    for c in range(patterns.shape[1] if len(patterns) else 0):
        rank = 0
        for p in np.flatnonzero(patterns[:, c]):
            end = rank + int(patterns[p, c] * used[p])
            out.append((c, rank, end, int(patterns[p, c]), int(first_bin[p])))
            rank = end
    return out


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tag, tokens) of every row; ``tag`` is the hash of the text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            size = [len(token_ids(enc, t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64())], names=["doc_id", "tag", "tokens"])

    return docs.mapInArrow(run, "doc_id long, tag long, tokens long")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, grain: int = GRAIN, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, bin): where every token of every document goes.

    ``piece`` numbers a document's pieces from 0; it covers ``length`` tokens from
    ``start``.  Bins are numbered from 0; the lengths in a bin add up to ``capacity`` at
    most.  First come the bins of the patterns, then the bins that hold one full piece.

    Null and empty texts have no tokens and no row.  Rows without doc_id, and rows that
    repeat one, are packed each, in the order of their lengths and hashes; of rows that are
    equal in all of these either may come first, with the same result.  Documents of equal
    length are ranked by doc_id.  Texts of any length are packed whole.  Other columns are
    not looked at.  An empty table gives an empty result.
    """
    if capacity % grain:
        raise ValueError("the grain must divide the capacity")
    spark = docs.sparkSession
    counts = written(token_counts(docs, vocabulary).where("tokens > 0"), "tokens")
    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    placed = counts.select(
        "doc_id",
        "tag",
        "tokens",
        F.floor(F.col("tokens") / capacity).cast("long").alias("full"),
        (F.col("tokens") % capacity).alias("rest"),
        F.pmod(F.xxhash64("doc_id", "tag"), F.lit(buckets)).alias("bucket"),
    ).withColumn("class", F.ceil(F.col("rest") / grain).cast("int"))
    histogram = placed.groupBy("class", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    # one row for each class: at most capacity / grain + 1, whatever the data
    by_size = histogram.groupBy("class").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).orderBy("class").collect()
    items = [r for r in by_size if r["class"]]
    size, demand = np.array([r["class"] for r in items], np.int64), np.array([r["n"] for r in items], np.int64)
    patterns, used, _ = plan(size, demand, capacity // grain)
    table = [(int(size[c]), a, b, k, f) for c, a, b, k, f in ranges(patterns, used)]
    first, at = [], int(used.sum())
    for r in by_size:
        first.append((r["class"], at))
        at += r["full"]
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.join(F.broadcast(spark.createDataFrame(first, "class int, first long")), "class").select(
        "class",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank0"),
        (F.col("first") + F.coalesce(F.sum("full").over(earlier), F.lit(0))).alias("bin0"),
    )
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "tokens", "tag")
    ranked = (
        placed.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("full_before", F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full"))
        .join(starts, ["class", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("rank0"))
    )
    by_class: dict[int, list] = {}
    for c, a, b, k, f in table:
        by_class.setdefault(c, []).append((a, b, k, f))
    places = F.broadcast(  # at most classes x patterns entries, whatever the data
        spark.createDataFrame(list(by_class.items()), "class int, spans array<struct<a:long,b:long,k:long,f:long>>")
    )
    span = F.element_at(F.filter("spans", lambda s: (F.col("rank") >= s["a"]) & (F.col("rank") < s["b"])), 1)
    whole = ranked.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), "full_before", "bin0").select(
        "doc_id",
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        (F.col("bin0") + F.col("full_before") + F.col("piece")).cast("long").alias("bin"),
    )
    last = (
        ranked.where("class > 0")
        .join(places, "class")
        .withColumn("s", span)
        .select(
            "doc_id",
            F.col("full").alias("piece"),
            (F.col("full") * capacity).alias("start"),
            F.col("rest").alias("length"),
            (F.col("s.f") + F.floor((F.col("rank") - F.col("s.a")) / F.col("s.k"))).cast("long").alias("bin"),
        )
    )
    return last.unionAll(whole)


