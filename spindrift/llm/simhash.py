"""Near-duplicate documents: SimHash fingerprints joined by a binary trie with itself.

Fingerprint: 64-bit SimHash of the words of at least ``LONG`` bytes (all words, where a
document has no such word), each word weighted by its count.  With it travels a sketch of
64 one-byte slots, a one-permutation MinHash of the 3-word shingles.  Two documents are
near copies when their fingerprints differ in at most ``BITS`` bits and their sketches
agree in at least ``AGREE`` of the slots that either of them fills.

Search: the fingerprints, without repeats, form a binary trie (a node is a range of the
sorted fingerprints).  Two copies of the trie are traversed together: a pair of nodes has
the number of bits in which the two paths differ, and is dropped when that exceeds the
error budget.  To keep the budget small where the trie is wide, the 64 bits are cut into
three chunks; ``BITS`` = 11 differing bits leave at most 3 of them in one of the chunks, so
three traversals, each with another chunk on top and a budget of 3 inside that chunk, find
every pair; the rest of the bits is compared at the leaves with the whole budget.  A pair
is reported in the first chunk that admits it.  The search is exact: no caps, no sampling.

Distribution: the top ``depth`` bits of the chunk name a subtree; each pair of subtrees
whose prefixes differ in at most 3 bits is a task, and depth is chosen by counting, so that
no subtree holds more than ``SUBTREE`` fingerprints.  A task returns a spanning forest of the pairs
that it found, so its output is linear in its input, and connected components of the
forests' union, found by rounds of large-star and small-star, give the groups.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import text_kernel as K
from spindrift.llm.common import remove, stored, written
from spindrift.shipping import ship

LONG = 4
BITS = 11
AGREE = 0.4
SLOTS = 64
CHUNKS = ((0, 22), (22, 21), (43, 21))  # (first bit from the top, width)
SUBTREE = 1 << 20
PROBE = 12


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (uint64), sketches (n x 64 uint8, 0 = empty slot), words of each text."""
    data, offsets = K.lowered(texts)
    starts, ends, rows = K.word_spans(data, offsets)
    h = K.span_hashes(data, starts, ends)
    n = len(rows) - 1
    wide = (ends - starts) >= LONG
    row = np.repeat(np.arange(n), np.diff(rows))
    has = np.zeros(n, bool)
    has[row[wide]] = True
    use = wide | ~has[row]
    f = h[use]
    at = np.searchsorted(row[use], np.arange(n + 1))
    votes = np.zeros((n, 64), np.int64)
    step = 1 << 16
    for a, b in K.slices(at, step):
        part = f[at[a] : at[b]]
        if not len(part):
            continue
        filled = np.flatnonzero(np.diff(at[a : b + 1]))
        bits = np.unpackbits(part.byteswap().view(np.uint8)).reshape(-1, 64)
        votes[a + filled] = np.add.reduceat(bits, at[a + filled] - at[a], axis=0, dtype=np.int32)
    half = np.diff(at)[:, None]
    print_ = np.packbits(2 * votes > half, axis=1).view(">u8").astype(np.uint64).ravel()
    sh, sh_rows = K.shingles(h, rows, 3)
    sketch = np.zeros((n, SLOTS), np.uint8)
    if len(sh):
        owner = np.repeat(np.arange(n), np.diff(sh_rows))
        cell = owner * SLOTS + (sh >> np.uint64(58)).astype(np.int64)
        least = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, cell, sh)
        empty = least == np.iinfo(np.uint64).max
        sketch = np.where(empty, 0, 1 + (K.mix64(least, 7) % np.uint64(255))).astype(np.uint8).reshape(n, SLOTS)
    return print_, sketch, np.diff(rows)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp, sketch of the documents that have an id and at least one word."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def run(batches):
        for batch in batches:
            for a, texts in K.text_slices(batch.column(1)):
                fp, sketch, n = fingerprints(texts)
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)).filter(keep),
                        pa.array(fp.view(np.int64)).filter(keep),
                        pa.Array.from_buffers(pa.binary(SLOTS), len(texts), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).filter(keep).cast(pa.binary()),
                    ],
                    names=["doc_id", "fp", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, fp long, sketch binary")


def rotated(fp: np.ndarray, first: int) -> np.ndarray:
    return fp if not first else (fp << np.uint64(first)) | (fp >> np.uint64(64 - first))


class Trie:
    """Levels of a binary trie over sorted 64-bit keys: node ranges and children."""

    def __init__(self, keys: np.ndarray, top: int, height: int):
        self.keys, self.top, self.height = keys, top, height
        self.levels = []
        lo = np.zeros(min(1, len(keys)), np.int64)
        hi = np.full(len(lo), len(keys), np.int64)
        for depth in range(top, height + 1):
            if depth == height:
                self.levels.append((lo, hi, None))
                break
            shift = np.uint64(63 - depth)
            ones = np.concatenate([[0], np.cumsum((keys >> shift) & np.uint64(1), dtype=np.int64)])
            mid = hi - (ones[hi] - ones[lo])
            kids = np.full((len(lo), 2), -1, np.int64)
            left, right = mid > lo, hi > mid
            slot = np.cumsum(np.stack([left, right], axis=1).ravel()) - 1
            kids[left, 0] = slot[0::2][left]
            kids[right, 1] = slot[1::2][right]
            self.levels.append((lo, hi, kids))
            nlo = np.stack([lo, mid], axis=1).ravel()
            nhi = np.stack([mid, hi], axis=1).ravel()
            some = nhi > nlo
            lo, hi = nlo[some], nhi[some]


def close_pairs(a: Trie, b: Trie, same: bool, spent: int, budget: int, bits: int, block: int = 1 << 19):
    """Blocks of (i, j): positions of keys in a and b that differ in at most ``bits`` bits
    and in at most ``budget`` of the bits above the tries' height, ``spent`` of which are
    used already.  With ``same`` each unordered pair comes once, and none (i, i)."""
    if not len(a.keys) or not len(b.keys):
        return
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, spent, np.int8))]
    while stack:
        level, x, y, err = stack.pop()
        if len(x) > block:
            for s in range(0, len(x), block):
                stack.append((level, x[s : s + block], y[s : s + block], err[s : s + block]))
            continue
        alo, ahi, akids = a.levels[level]
        blo, bhi, bkids = b.levels[level]
        size = (ahi[x] - alo[x]) * (bhi[y] - blo[y])
        leaf = (size <= 16) if akids is not None else np.ones(len(x), bool)
        if leaf.any():
            yield from _leaves(a, b, level, x[leaf], y[leaf], size[leaf], same, budget, bits, block)
        if akids is None or leaf.all():
            continue
        x, y, err = x[~leaf], y[~leaf], err[~leaf]
        nx, ny, ne = [], [], []
        for p in (0, 1):
            for q in (0, 1):
                e = err + (p != q)
                ok = (akids[x, p] >= 0) & (bkids[y, q] >= 0) & (e <= budget)
                if same and p > q:
                    ok &= x != y
                nx.append(akids[x[ok], p])
                ny.append(bkids[y[ok], q])
                ne.append(e[ok])
        x = np.concatenate(nx)
        if len(x):
            stack.append((level + 1, x, np.concatenate(ny), np.concatenate(ne)))


def _leaves(a, b, level, x, y, size, same, budget, bits, block):
    alo, _, _ = a.levels[level]
    blo, bhi, _ = b.levels[level]
    upper = np.uint64(64 - a.height)
    ends = np.cumsum(size)
    s = 0
    while s < len(x):
        base = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, base + 4 * block, side="right")))
        if e == s + 1 and size[s] > 8 * block:  # one very large leaf: row by row
            i0, i1, j0, j1 = alo[x[s]], a.levels[level][1][x[s]], blo[y[s]], bhi[y[s]]
            step = max(1, int(4 * block // (j1 - j0)))
            for r in range(i0, i1, step):
                i = np.repeat(np.arange(r, min(i1, r + step)), j1 - j0)
                j = np.tile(np.arange(j0, j1), min(i1, r + step) - r)
                yield _near(a, b, i, j, same and x[s] == y[s], upper, budget, bits)
        else:
            n = size[s:e]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(bhi[y[s:e]] - blo[y[s:e]], n)
            i = np.repeat(alo[x[s:e]], n) + k // w
            j = np.repeat(blo[y[s:e]], n) + k % w
            yield _near(a, b, i, j, np.repeat(x[s:e] == y[s:e], n) if same else False, upper, budget, bits)
        s = e


def _near(a, b, i, j, own, upper, budget, bits):
    differ = a.keys[i] ^ b.keys[j]
    ok = (np.bitwise_count(differ) <= bits) & (np.bitwise_count(differ >> upper) <= budget)
    if own is not False:
        ok &= ~own | (i < j)
    return i[ok], j[ok]


def agreement(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Share of slots filled in either sketch in which both agree."""
    filled = ((p | q) != 0).sum(axis=1)
    return ((p == q) & (p != 0)).sum(axis=1) / np.maximum(filled, 1)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each vertex's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(i):
        lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        live = lo != hi
        i, j, lo, hi = i[live], j[live], lo[live], hi[live]
        if not len(i):
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _widths(chunk: int) -> tuple[int, int]:
    return CHUNKS[chunk]


def _budget(bits: int) -> int:
    return bits // len(CHUNKS)


def join_task(chunk: int, p: int, q: int, depth: int, side: np.ndarray, ids: np.ndarray, fps: np.ndarray, sketches: np.ndarray, bits: int, agree: float):
    """Spanning forest (member, root) of near copies between subtrees p and q (side 0, 1)."""
    first, width = _widths(chunk)
    budget = _budget(bits)
    turned = rotated(fps, first)
    same = p == q
    order = np.lexsort((turned, side))
    ids, fps, turned, sketches, side = ids[order], fps[order], turned[order], sketches[order], side[order]
    cut = int(np.searchsorted(side, 1)) if not same else len(ids)
    A = Trie(turned[:cut], depth, width)
    B = A if same else Trie(turned[cut:], depth, width)
    shift = 0 if same else cut
    ei, ej = [], []
    root = np.arange(len(ids))
    held = 0
    for i, j in close_pairs(A, B, same, int(p ^ q).bit_count(), budget, bits):
        if not len(i):
            continue
        j = j + shift
        differ = fps[i] ^ fps[j]
        fresh = np.ones(len(i), bool)
        for c in range(chunk):
            f, w = _widths(c)
            mask = np.uint64(((1 << w) - 1) << (64 - f - w))
            fresh &= np.bitwise_count(differ & mask) > budget
        i, j = i[fresh], j[fresh]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        for s in range(0, len(i), 1 << 16):
            u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            ok = agreement(sketches[u], sketches[v]) >= agree
            ei.append(u[ok])
            ej.append(v[ok])
            held += int(ok.sum())
        if held > 1 << 20:
            root = forest(len(ids), np.concatenate([np.arange(len(ids)), *ei]), np.concatenate([root, *ej]))
            ei, ej, held = [], [], 0
    root = forest(len(ids), np.concatenate([np.arange(len(ids)), *ei]), np.concatenate([root, *ej]))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    top = least[root]
    moved = ids != top
    return ids[moved], top[moved]


def _top(chunk: int, bits: int):
    """The top bits of a chunk, as a column."""
    first, _ = _widths(chunk)
    turned = F.col("fp") if not first else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
    return F.shiftrightunsigned(turned, 64 - bits).cast("int")


def subtree_depth(nodes: DataFrame) -> int:
    """Top bits that leave at most ``SUBTREE`` fingerprints in every subtree of every chunk.

    Subtrees are counted down to ``PROBE`` bits, a table of 3 x 2^PROBE rows at most, and
    taken to halve below; no deeper than the narrowest chunk."""
    tops = F.array(*[F.struct(F.lit(c).alias("c"), _top(c, PROBE).alias("top")) for c in range(len(CHUNKS))])
    rows = nodes.select(F.explode(tops).alias("t")).groupBy("t.c", "t.top").count().collect()
    size = np.zeros((len(CHUNKS), 1 << PROBE), np.int64)
    for r in rows:
        size[r["c"], r["top"]] = r["count"]
    for depth in range(3, PROBE + 1):
        largest = int(size.reshape(len(CHUNKS), 1 << depth, -1).sum(axis=2).max())
        if largest <= SUBTREE:
            return depth
    return min(min(w for _, w in CHUNKS), PROBE + ceil(log2(largest / SUBTREE)))


def _task_of(chunk: int, own):
    """For a flipped prefix: the pair of subtrees, smaller first, and the side of ``own``."""

    def task(mask):
        other = own.bitwiseXOR(mask)
        return F.struct(F.lit(chunk).alias("c"), F.least(own, other).alias("p"), F.greatest(own, other).alias("q"), (own > other).cast("int").alias("side"))

    return task


def near_edges(nodes: DataFrame, *, bits: int = BITS, agree: float = AGREE) -> DataFrame:
    """Edges (a, b), b < a, that connect the near copies among ``nodes`` (id, fp, sketch)."""
    depth, budget = subtree_depth(nodes), _budget(bits)
    masks = [sum(1 << b for b in bits_) for k in range(budget + 1) for bits_ in combinations(range(depth), k)]
    flips = F.array(*[F.lit(m) for m in masks])
    tasks = []
    for c in range(len(CHUNKS)):
        tasks.append(F.transform(flips, _task_of(c, _top(c, depth))))
    spread = nodes.select("id", "fp", "sketch", F.explode(F.concat(*tasks)).alias("t")).select("t.c", "t.p", "t.q", "t.side", "id", "fp", "sketch")

    def run(key, tab):
        c, p, q = (int(k.as_py()) for k in key)
        raw = tab.column("sketch").combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = pa.concat_arrays(raw.chunks)
        sketches = np.frombuffer(K.string_buffer(raw.cast(pa.large_binary()).view(pa.large_string()))[0], np.uint8).reshape(-1, SLOTS)
        take = lambda name: tab.column(name).to_numpy()
        a, b = join_task(c, p, q, depth, take("side"), take("id"), take("fp").astype(np.int64).view(np.uint64), sketches, bits, agree)
        return pa.table({"a": a, "b": b})

    return spread.groupBy("c", "p", "q").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, for ids that aren't it.

    Alternates large-star and small-star until the edges are stars; each round is written
    to the shared folder.
    """
    edges, at = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b")))
        old = at
        edges, at = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        remove(edges.sparkSession, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, bits: int = BITS, agree: float = AGREE) -> DataFrame:
    """(doc_id, keep_id): each document that is a copy, and the one of its group that stays.

    A group is a connected component of the near-copy relation of this module; the member
    with the least doc_id stays and isn't listed.  Exact copies are near copies.

    Documents with null or empty text, or without words, are never copies of anything, nor
    are rows without doc_id.  Rows that repeat a doc_id belong to one document, which is
    compared by each of its rows.  Texts of any length are compared whole.  Other columns
    are not looked at.  An empty table gives an empty result.
    """
    prints = written(fingerprint_table(docs), "prints")
    same = prints.groupBy("fp", "sketch").agg(F.min("doc_id").alias("id"))
    nodes = written(same, "nodes")
    copies = prints.join(nodes, ["fp", "sketch"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    near = near_edges(nodes.select("id", "fp", "sketch"), bits=bits, agree=agree)
    return components(near.unionAll(copies)).select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"))
