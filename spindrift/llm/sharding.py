"""Shards of even byte size from indivisible groups, by Karmarkar-Karp differencing.

A group, here all documents with the same text, must not be split.  A partial partition is
a vector of K sums, one for each shard.  Differencing starts with one partial partition for
each group and repeatedly combines the two with the largest spread (largest minus smallest
sum), the largest sum of the one with the smallest of the other; what is left in the end is
the partition.

At scale this runs in levels with the same rule.  Groups are hashed to buckets of about
``BUCKET_GROUPS`` groups; a task differences one bucket to a single partial partition and
remembers the slot of each group.  ``FAN`` buckets' partial partitions at a time are
differenced by the next level's tasks, and so on until one task is left; then each level,
from the top, tells the one below which shard its slots become.  Nothing is collected on
the driver.

A bucket with a group larger than its share of a shard can't be even, and even buckets can't
make up for it.  So the groups of ``SINGLE_BUCKETS`` buckets stay single until the last
task, where differencing takes them last, as the smallest, and they fill what the others
left open.  A table of no more buckets is differenced group by group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.shipping import ship

SHARDS = 64
BUCKET_GROUPS = 20_000
FAN = 4096
SINGLE_BUCKETS = 4


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of k sums).  Gives the k sums of the result and,
    for each row, the slot of the result that each of its slots went to."""
    n, k = sums.shape
    if not n:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    # a partial partition: its sums in descending order, and for each of those places a
    # chain of the (row, slot) that it holds, as head and tail into ``after``
    order = np.argsort(-sums, axis=1, kind="stable")
    value = np.take_along_axis(sums, order, axis=1)
    base = np.arange(n)[:, None] * k
    head = list(base + order)
    tail = [h.copy() for h in head]
    value = list(value)
    after = np.full(n * k, -1, np.int64)
    heap = [(-int(v[0] - v[-1]), i) for i, v in enumerate(value)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = value[a] + value[b][::-1]
        after[tail[a]] = head[b][::-1]
        new_tail = tail[b][::-1]
        place = np.argsort(-total, kind="stable")
        value[a], head[a], tail[a] = total[place], head[a][place], new_tail[place]
        value[b] = head[b] = tail[b] = None
        heapq.heappush(heap, (-int(value[a][0] - value[a][-1]), a))
    last = heap[0][1]
    slot = np.full(n * k, -1, np.int64)
    at, final = head[last].copy(), np.arange(k)
    while len(at):
        slot[at] = final
        step = after[at]
        at, final = step[step >= 0], final[step >= 0]
    return value[last], slot.reshape(n, k)


def one_group_each(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of single groups: the k sums, and the slot of each group.

    As long as a partial partition holds fewer groups than k it is kept sparse."""
    n = len(sizes)
    if k == 1 or n <= 1:
        sums = np.zeros(k, np.int64)
        sums[0] = int(np.sum(sizes))
        return sums, np.zeros(n, np.int64)
    after = np.full(n, -1, np.int64)
    # place lists, largest first; missing places are zeros without groups
    value: list = [np.array([s], np.int64) for s in sizes.tolist()]
    head: list = [np.array([i], np.int64) for i in range(n)]
    tail: list = [np.array([i], np.int64) for i in range(n)]
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    none = np.int64(-1)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        va, vb = value[a], value[b]
        la, lb = len(va), len(vb)
        if la + lb <= k:  # they don't meet: one after the other
            total = np.concatenate([va, vb])
            h, t = np.concatenate([head[a], head[b]]), np.concatenate([tail[a], tail[b]])
        else:
            m = la + lb - k  # the last m places of a meet the last m of b, in opposite order
            total = np.concatenate([va, vb[: lb - m][::-1]])
            h = np.concatenate([head[a], head[b][: lb - m][::-1]])
            t = np.concatenate([tail[a], tail[b][: lb - m][::-1]])
            meet = np.arange(la - m, la)
            other_h, other_t = head[b][lb - m :][::-1], tail[b][lb - m :][::-1]
            total[meet] += vb[lb - m :][::-1]
            both = (t[meet] >= 0) & (other_h >= 0)
            after[t[meet][both]] = other_h[both]
            h[meet] = np.where(h[meet] >= 0, h[meet], other_h)
            t[meet] = np.where(other_t >= 0, other_t, t[meet])
        place = np.argsort(-total, kind="stable")
        value[a], head[a], tail[a] = total[place], h[place], t[place]
        value[b] = head[b] = tail[b] = None
        low = int(value[a][-1]) if len(value[a]) == k else 0
        heapq.heappush(heap, (-(int(value[a][0]) - low), a))
    last = heap[0][1]
    slot = np.full(n, none)
    for f, i in enumerate(head[last]):
        while i >= 0:
            slot[i] = f
            i = after[i]
    sums = np.zeros(k, np.int64)
    sums[: len(value[last])] = value[last]
    return sums, slot


def sharded(docs: DataFrame, *, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """(doc_id, group, n_bytes, shard): every row's shard, from 0 to ``shards`` - 1.

    ``group`` is the 64-bit hash of the text and ``n_bytes`` its UTF-8 length; all rows of
    a group have the same shard.  Null texts are one group of 0 bytes, empty texts another.
    Rows without doc_id and repeated rows are placed like any other.  Equal sizes are taken
    in the order of their groups' hashes, so the result depends on the rows alone.  Texts of
    any length count whole.  Other columns are not looked at.  With fewer groups than
    shards, some shards stay empty; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), F.xxhash64(F.lit(0), F.lit("null"))).otherwise(F.xxhash64(F.col("text").cast("string"))).alias("group"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    rows = written(rows, "rows")
    groups = rows.groupBy("group").agg(F.sum("n_bytes").alias("size"))
    count = rows.select(F.approx_count_distinct("group")).first()[0]
    buckets = max(1, -(-count // bucket_groups))

    def bucket(key, tab):
        tab = tab.sort_by([("size", "descending"), ("group", "ascending")])
        n, number, size = tab.num_rows, key[0].as_py(), tab["size"].to_numpy()
        if number < SINGLE_BUCKETS:  # stay single: each a bucket of its own, numbered below 0
            numbers, slot = -1 - (np.arange(n) * SINGLE_BUCKETS + number), np.zeros(n, np.int32)
            sums = [[int(x)] + [0] * (shards - 1) for x in size]
        else:
            total, slot = one_group_each(size, shards)
            numbers, sums = np.full(n, number), [total.tolist()] + [None] * (n - 1)
        return pa.table({"bucket": pa.array(numbers, pa.int64()), "group": tab["group"], "slot": pa.array(slot.astype(np.int32)), "sums": pa.array(sums, pa.list_(pa.int64()))})

    split = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    slots = written(split.groupBy("bucket").applyInArrow(bucket, "bucket long, group long, slot int, sums array<long>"), "slots")
    parts = slots.where("sums is not null").select("bucket", "sums")
    names = shard_names(parts.where("bucket > 0"), parts.where("bucket < 0"), buckets, fan)
    where = slots.join(names, "bucket").select("group", F.element_at("shards", F.col("slot") + 1).alias("shard"))
    return rows.join(where, "group").select("doc_id", "group", "n_bytes", "shard")


def shard_names(parts: DataFrame, single: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """(bucket, shards): for partial partitions (bucket, sums), numbered below ``buckets``,
    and those that wait for the last task, the shard that each slot becomes."""

    def combine(key, tab):
        tab = tab.sort_by([("bucket", "descending")])
        sums, final = differencing(np.array(tab["sums"].to_pylist(), np.int64))
        n = tab.num_rows
        return pa.table(
            {
                "bucket": tab["bucket"],
                "upper": pa.array(np.full(n, key[0].as_py(), np.int64)),
                "shards": pa.array(final.tolist(), pa.list_(pa.int32())),
                "sums": pa.array([sums.tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
            }
        )

    last = buckets <= fan
    upper = parts.unionAll(single).withColumn("upper", F.lit(0).cast("long")) if last else parts.withColumn("upper", F.floor(F.col("bucket") / fan).cast("long"))
    level = upper.groupBy("upper").applyInArrow(combine, "bucket long, upper long, shards array<int>, sums array<long>")
    if last:
        return level.select("bucket", "shards")
    level = written(level, "level")
    above = written(shard_names(level.where("sums is not null").select(F.col("upper").alias("bucket"), "sums"), single, -(-buckets // fan), fan), "above")
    renamed = above.where("bucket >= 0").select(F.col("bucket").alias("upper"), F.col("shards").alias("renamed"))
    below = level.join(renamed, "upper").select("bucket", F.transform("shards", lambda s: F.element_at("renamed", s + 1)).alias("shards"))
    return below.unionAll(above.where("bucket < 0").select("bucket", "shards"))
