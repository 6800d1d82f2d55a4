"""Byte-vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow string arrays: the UTF-8 buffer of a batch is
viewed as one NumPy byte array and words are found, hashed and shingled with array
operations, so there is no Python object per word.

Word rule (used by every operator that speaks of "words"): text is lower-cased, then a
word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, where the
blocks U+0080-U+00BF, U+2000-U+207F and U+3000-U+303F (Latin-1 signs, general and CJK
punctuation, every kind of white space there) separate words like ASCII punctuation does.
``WORD_CLASS`` is the same rule as a character class for RE2.

Null texts count as empty texts.  Hashes are 64-bit, the same on every machine and in
every process, and depend on nothing but the word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_CLASS = r"a-z0-9\x{00C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}"

_SPAN = 1 << 21
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def _table(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, _SPAN), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) == _SPAN:
            _powers[name] = have
    return have[:size]


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than 2 GB stays in chunks
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_buffer(pc.utf8_lower(column.fill_null("")))


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _IS_WORD[data]
    for lead, least, most, width in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        hit = np.flatnonzero(data[: max(0, len(data) - width + 1)] == lead)
        if len(hit):
            follow = data[hit + 1]
            hit = hit[(follow >= least) & (follow <= most)]
            for k in range(width):
                mask[hit + k] = False
    return mask


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the n+1 offsets of rows into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = word_mask(data)
    edge = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[edge] = mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = edge[edge > 0] - 1
    last[inner] = mask[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            base = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, base + _SPAN, side="right")))
            size = int(ends[b - 1] - base)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * _table("up", _MUL, size), out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * _table("down", _INV, size)[s]
            a = b
        return mix64(out + (ends - starts).astype(np.uint64) * _M1)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the n+1 offsets of rows into them."""
    data, offsets = lowered(column)
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each row, and their row offsets.

    A row with fewer words than ``size``, but at least one, has its whole word list as
    its only shingle; a row without words has none.
    """
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(count, out=out_rows[1:])
    total = int(out_rows[-1])
    if not total:
        return np.zeros(0, np.uint64), out_rows
    start = np.repeat(rows[:-1] - out_rows[:-1], count) + np.arange(total)
    left = np.repeat(rows[1:], count) - start
    acc = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = left > k
            here = hashes[np.minimum(start + k, len(hashes) - 1)]
            acc = mix64(acc * _MUL + np.where(inside, here, np.uint64(k + 1)))
    return acc, out_rows


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, their row numbers, and the new offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, r, np.searchsorted(r, np.arange(len(rows)))


def slices(offsets: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def text_slices(column: pa.Array, most: int = 1 << 22):
    """Consecutive slices (first row, array) of about ``most`` bytes of text each."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("")
    _, offsets = string_buffer(column)
    for a, b in slices(offsets, most):
        yield a, column.slice(a, b - a)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as a single array, with wide offsets where it needs them."""
    if isinstance(column, pa.Array):
        return column
    if column.num_chunks == 1:
        return column.chunk(0)
    return pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
