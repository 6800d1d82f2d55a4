"""Benchmark decontamination: containment search for short items in long documents.

Method: size-partitioned MinHash (the LSH-ensemble idea).  The containment of an item in
a document says little about their Jaccard similarity unless the document's size is known,
so documents are partitioned by size, powers of two of their shingle count, and each
partition has its own sketch: a one-permutation MinHash whose number of bins grows with
the partition's upper size, so that a bin holds about 2**load shingles in every partition.
An item's own sketch is made with the same bins for each partition; a document and an item
that agree in any bin become candidates, and candidates are verified by the exact
containment of the item's distinct shingles.  The load is chosen for each class of item
sizes such that an item that just reaches the threshold is found with probability
``recall`` at least; classes too small for that use every shingle as its own bin.

The items are a broadcast index that is built in blocks of bounded size; more items mean
more blocks, each another pass over the documents, never a larger broadcast.  Documents
are read once for each block and not shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import text_kernel as K
from spindrift.shipping import ship

SHINGLE = 5
THRESHOLD = 0.5
RECALL = 0.995
BLOCK_BYTES = 32 << 20


def _hit_rate(load: int) -> float:
    """Least chance that a shared shingle is the minimum of its bin of 2**load others."""
    lam = 2.0**load
    return (1 - math.exp(-lam)) / lam


def load_of(item_class: int, threshold: float, recall: float) -> int | None:
    """log2 of the bin load for items of at least 2**item_class shingles; None: no bins."""
    needed = max(1, math.ceil(threshold * 2**item_class))
    for load in (3, 2, 1, 0):
        if 1 - (1 - _hit_rate(load)) ** needed >= recall:
            return load
    return None


class ItemIndex:
    """Sketch keys and exact shingle sets of one block of items."""

    def __init__(self, ids: list, texts: pa.Array, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL):
        self.size, self.threshold, self.ids = size, threshold, ids
        hashes, rows = K.words(texts)
        sh, sh_rows = K.shingles(hashes, rows, size)
        self.sets, owner, self.rows = K.distinct_per_row(sh, sh_rows)
        count = np.diff(self.rows)
        with np.errstate(divide="ignore"):
            classes = np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))), -1).astype(int)
        self.groups: dict[int | None, np.ndarray] = {}
        for c in np.unique(classes[classes >= 0]):
            load = load_of(int(c), threshold, recall)
            self.groups.setdefault(load, np.zeros(len(ids), bool))[classes == c] = True
        self.owner = owner
        self._keys: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_keys": {}}

    def keys(self, load: int | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted bin minima of the group's items with 2**bits bins, and their items."""
        if (load, bits) not in self._keys:
            mine = self.groups[load][self.owner]
            h, o = self.sets[mine], self.owner[mine]
            if load is not None:
                cell = (o.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64))
                first = np.ones(len(h), bool)
                first[1:] = cell[1:] != cell[:-1]  # sets are sorted, so the first of a bin is its minimum
                h, o = h[first], o[first]
            order = np.argsort(h, kind="stable")
            self._keys[load, bits] = h[order], o[order]
        return self._keys[load, bits]

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and containments of the pairs that reach the threshold."""
        hashes, rows = K.words(texts)
        sh, sh_rows = K.shingles(hashes, rows, self.size)
        count = np.diff(sh_rows)
        row = np.repeat(np.arange(len(count)), count)
        part = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
        found_r, found_i = [], []
        for load in self.groups:
            for u in np.unique(part[count > 0]):
                inside = (part == u)[row]
                h, r = sh[inside], row[inside]
                bits = max(0, int(u) - (load or 0))
                if load is not None:
                    members = np.flatnonzero((part == u) & (count > 0))
                    place = np.searchsorted(members, r)
                    cell = (place << bits) + ((h >> np.uint64(64 - bits)).astype(np.int64) if bits else 0)
                    least = np.full(len(members) << bits, np.iinfo(np.uint64).max, np.uint64)
                    np.minimum.at(least, cell, h)
                    used = np.flatnonzero(least != np.iinfo(np.uint64).max)
                    h, r = least[used], members[used >> bits]
                keys, items = self.keys(load, bits)
                if not len(keys):
                    continue
                lo = np.searchsorted(keys, h, side="left")
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
                lo = lo[hit]
                n = np.searchsorted(keys, h[hit], side="right") - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found_r.append(np.repeat(r[hit], n))
                found_i.append(items[at])
        if not found_r:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        pairs = np.unique(np.stack([np.concatenate(found_r), np.concatenate(found_i)], axis=1), axis=0)
        share = np.array(
            [
                np.isin(self.sets[self.rows[i] : self.rows[i + 1]], sh[sh_rows[r] : sh_rows[r + 1]]).mean()
                for r, i in pairs
            ]
        )
        keep = share >= self.threshold if len(pairs) else np.zeros(0, bool)
        return pairs[keep, 0], pairs[keep, 1], share[keep]


def item_blocks(items: DataFrame, **options):
    """Broadcast indexes over all items, each of a bounded number of text bytes."""
    spark = ship(items.sparkSession)
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = part.orderBy("item_id", "text").toArrow()
        texts = got["text"].combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        yield spark.sparkContext.broadcast(ItemIndex(got["item_id"].to_pylist(), texts, **options))


def contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a benchmark item it contains.

    Columns ``doc_id, item_id, containment``: the share, rounded to 6 digits, of the
    item's distinct ``shingle``-word shingles that occur in the document, where it is
    ``threshold`` at least.  An item shorter than ``shingle`` words is one shingle.
    Longer documents have no such shingle: a shorter item is found only in documents that
    consist of exactly its words, and isn't searched inside others.

    Null or empty texts, and texts without words, contain nothing and are contained in
    nothing.  Texts of any length are searched whole.  An item at exactly the threshold is
    contained.  A row without doc_id is reported with a null doc_id.  Repeated document rows
    are reported each; repeated (item_id, text) rows count once.  Other columns are not
    looked at.  Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    item_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", item_type), T.StructField("containment", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def over(index):
        def run(batches):
            for batch in batches:
                ids = batch.column(0)
                for a, texts in K.text_slices(batch.column(1)):
                    r, i, share = index.value.search(texts)
                    if len(r):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(r + a)), pa.array([index.value.ids[k] for k in i], arrow.field(1).type), pa.array(np.round(share, 6))],
                            schema=arrow,
                        )

        return docs.mapInArrow(run, schema)

    parts = [over(index) for index in item_blocks(items, size=shingle, threshold=threshold)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns.

    Rows are judged one by one as by ``contaminated``, whatever their ids; rows with null or
    empty text stay, and repeated rows stay or go together.  Without documents the result is
    empty, without items it is ``docs``.
    """
    at = docs.columns.index("text")
    for index in item_blocks(items, size=shingle, threshold=threshold):

        def run(batches, index=index):
            for batch in batches:
                for a, texts in K.text_slices(batch.column(at)):
                    good = np.ones(len(texts), bool)
                    good[index.value.search(texts)[0]] = False
                    yield batch.slice(a, len(texts)).filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[{K.WORD_CLASS}]+') as w from documents where text is not null),
 b as (select distinct item_id, text, regexp_extract_all(lower(text), '[{K.WORD_CLASS}]+') as w from benchmark where text is not null),
 ds as (select distinct doc_id, unnest(case when len(w) >= {SHINGLE} then list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
   when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
 bs as (select distinct item_id, unnest(case when len(w) >= {SHINGLE} then list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
   when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from b),
 n as (select item_id, count(*) as n from bs group by item_id)
select ds.doc_id as doc_id, bs.item_id as item_id, round(cast(count(*) as double) / max(n.n), 6) as containment
from ds join bs on ds.s = bs.s join n on n.item_id = bs.item_id group by ds.doc_id, bs.item_id
having cast(count(*) as double) / max(n.n) >= {THRESHOLD}
"""
