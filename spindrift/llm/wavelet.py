"""Token ids in a wavelet matrix per shard: one compressed, indexed blob.

A shard is a run of consecutive documents of one input partition.  The token ids of its
documents, one after the other, are stored as the bit-planes of a wavelet matrix: plane 0
holds the highest bit of every token in order; the tokens are then stably partitioned by
that bit, zeros first, and the next plane holds the next bit, and so on.  With popcounts
kept for each block of a plane, rank and select take one block, so the blob answers without
decoding the rest: the token at a position (``access``), how often a token occurs before a
position (``rank``), how often in a document (``count``), and where (``select``,
``locate``).

Layout: a little-endian header, the document offsets, for every plane the number of zeros
and its table of blocks (ones before the block, place of its bytes), and the blocks, each
of ``BLOCK`` bits and compressed on its own with zstd.  A reader holds the header and the
tables and decompresses the blocks that it needs.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.shipping import ship

VOCABULARY = os.environ.get("SPINDRIFT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAGIC = b"WMX1"
BLOCK = 1 << 15
SHARD_TOKENS = 1 << 22

_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """A byte-pair encoding from a file of ranks; read once in each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


_WHITE_RUN = 4096
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _WHITE_RUN)


def token_ids(enc, text: str) -> list[int]:
    """Ids of a whole text, those of the tokenizer itself.

    Its regular expression backtracks over a run of white space, and overflows its stack
    where the run is very long.  Such a run, without its last character where text
    follows, is one piece by the expression, so it is encoded as that and the text around
    it on its own.
    """
    if len(text) < _WHITE_RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    start = 0
    for m in _WHITE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out.extend(enc.encode_ordinary(text[start : m.start()]))
        out.extend(enc._encode_single_piece(text[m.start() : end]))
        start = end
    out.extend(enc.encode_ordinary(text[start:]))
    return out


class Plane:
    """One bit-plane inside a blob: rank and select over compressed blocks."""

    def __init__(self, blob, n: int, zeros: int, ones: np.ndarray, place: np.ndarray):
        self.blob, self.n, self.zeros, self.ones, self.place = blob, n, zeros, ones, place
        self.cache: dict[int, np.ndarray] = {}

    def block(self, k: int) -> np.ndarray:
        if k not in self.cache:
            if len(self.cache) > 64:
                self.cache.clear()
            raw = zstandard.ZstdDecompressor().decompress(bytes(self.blob[self.place[k] : self.place[k + 1]]), max_output_size=BLOCK // 8)
            self.cache[k] = np.unpackbits(np.frombuffer(raw, np.uint8))
        return self.cache[k]

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK])

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        k = i // BLOCK
        if i % BLOCK == 0:
            return int(self.ones[k])
        return int(self.ones[k]) + int(self.block(k)[: i % BLOCK].sum())

    def select(self, bit: int, j: int) -> int:
        """Position of the j-th (from 0) of the given bit."""
        before = self.ones if bit else np.minimum(np.arange(len(self.ones)) * BLOCK, self.n) - self.ones
        k = int(np.searchsorted(before, j, side="right")) - 1
        inside = np.flatnonzero(self.block(k) == bit)
        return k * BLOCK + int(inside[j - int(before[k])])


class WaveletMatrix:
    """Reads a blob.  Positions are over the shard; documents are numbered in it."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.docs, self.bits = struct.unpack_from("<QQI", blob, 4)
        at = 24
        self.offsets = np.frombuffer(blob, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        blocks = -(-self.n // BLOCK)
        self.planes = []
        for _ in range(self.bits):
            (zeros,) = struct.unpack_from("<Q", blob, at)
            ones = np.frombuffer(blob, "<u8", blocks + 1, at + 8).astype(np.int64)
            place = np.frombuffer(blob, "<u8", blocks + 1, at + 8 + 8 * (blocks + 1)).astype(np.int64)
            at += 8 + 16 * (blocks + 1)
            self.planes.append(Plane(memoryview(blob), self.n, zeros, ones, place))

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """A blob from a path or URI of any file system that Arrow knows."""
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            return cls(f.read())

    @classmethod
    def build(cls, tokens: np.ndarray, offsets: np.ndarray, bits: int = 16) -> bytes:
        """The blob of tokens below 2**bits, of documents with the given offsets."""
        n = len(tokens)
        blocks = -(-n // BLOCK)
        pack = zstandard.ZstdCompressor(level=1)
        head = MAGIC + struct.pack("<QQI", n, len(offsets) - 1, bits)
        table_size = 8 * len(offsets) + bits * (8 + 16 * (blocks + 1))
        at = len(head) + table_size
        tables, body = [np.asarray(offsets, "<u8").tobytes()], []
        x = np.asarray(tokens, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(bit.astype(np.uint8))
            count = np.zeros(blocks + 1, np.int64)
            if n:
                np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(blocks) * (BLOCK // 8), dtype=np.int64), out=count[1:])
            place = np.zeros(blocks + 1, np.int64)
            place[0] = at
            for k in range(blocks):
                piece = pack.compress(packed[k * (BLOCK // 8) : (k + 1) * (BLOCK // 8)].tobytes())
                body.append(piece)
                at += len(piece)
                place[k + 1] = at
            tables.append(struct.pack("<Q", n - int(count[-1])) + count.astype("<u8").tobytes() + place.astype("<u8").tobytes())
            one = bit.astype(bool)
            x = np.concatenate([x[~one], x[one]])
        return b"".join([head, *tables, *body])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in self.planes:
            bit = p.bit(i)
            token = token << 1 | bit
            i = p.zeros + p.rank1(i) if bit else i - p.rank1(i)
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k, p in enumerate(self.planes):
            if token >> (self.bits - 1 - k) & 1:
                lo, hi = p.zeros + p.rank1(lo), p.zeros + p.rank1(hi)
            else:
                lo, hi = lo - p.rank1(lo), hi - p.rank1(hi)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, doc: int | None = None) -> int:
        """Occurrences of token in the shard, or in one of its documents."""
        if doc is None:
            return self.rank(token, self.n)
        return self.rank(token, int(self.offsets[doc + 1])) - self.rank(token, int(self.offsets[doc]))

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of token."""
        if not 0 <= token < 1 << self.bits:
            raise IndexError(j)
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            p = self.planes[k]
            i = p.select(1, i - p.zeros) if token >> (self.bits - 1 - k) & 1 else p.select(0, i)
        return i

    def locate(self, token: int) -> list[tuple[int, int]]:
        """(document, position in it) of every occurrence of token."""
        at = np.array([self.select(token, j) for j in range(self.count(token))], np.int64)
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        return list(zip(doc.tolist(), (at - self.offsets[doc]).tolist()))

    def decode(self) -> np.ndarray:
        """All tokens, by undoing the partitions from the lowest plane up."""
        n = self.n
        if not n:
            return np.zeros(0, np.int64)
        order = np.arange(n)
        value = np.zeros(n, np.int64)
        for p in self.planes:
            bits = np.concatenate([p.block(k) for k in range(len(p.ones) - 1)])[:n].astype(bool)
            value[order] = value[order] << 1 | bits
            order = np.concatenate([order[~bits], order[bits]])
        return value

    def document(self, doc: int) -> list[int]:
        return [self.access(i) for i in range(int(self.offsets[doc]), int(self.offsets[doc + 1]))]


SCHEMA = "shard string, doc_ids array<long>, n_docs long, n_tokens long, n_bytes long, blob binary"


def wavelet_shards(docs: DataFrame, *, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each shard: its doc_ids in order, sizes, and the wavelet matrix.

    A shard is closed when it has ``shard_tokens`` tokens, so it may exceed that by one
    document.  Its name is the number of the input partition and of the shard in it.
    Documents are not shuffled: a shard holds consecutive rows of its partition.

    Null and empty texts are documents of no tokens.  Null doc_ids are kept as nulls in
    ``doc_ids``; repeated rows are stored each.  Texts of any length are stored whole, with
    the ids that the tokenizer gives.  An empty table gives no shard.  Other columns are
    not looked at.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = encoding(vocabulary)
        bits = max(1, int(enc.max_token_value).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        ids, parts, held, made, part = [], [], 0, 0, 0

        def shard():
            sizes = [len(p) for p in parts]
            tokens = np.concatenate(parts) if parts else np.zeros(0, kind)
            blob = WaveletMatrix.build(tokens, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part:05d}-{made:05d}"]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([len(tokens)], pa.int64()),
                    pa.array([len(blob)], pa.int64()),
                    pa.array([blob], pa.binary()),
                ],
                names=["shard", "doc_ids", "n_docs", "n_tokens", "n_bytes", "blob"],
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py() or ""
                got = np.array(token_ids(enc, text), kind)
                ids.append(batch.column(1)[i].as_py())
                parts.append(got)
                held += len(got)
                if held >= shard_tokens:
                    yield shard()
                    ids, parts, held, made = [], [], 0, made + 1
        if ids:
            yield shard()

    return docs.mapInArrow(run, SCHEMA)


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Each shard's blob as ``<folder>/<shard>.wm``; ``folder`` is an absolute path or a
    URI (hdfs, s3, gs, file) of a file system that all executors reach.

    A file is written under a name of its own and renamed, so a task that is run again, or
    twice at once, replaces it whole.  Gives (shard, path, n_bytes); nothing for an empty
    table.
    """
    ship(shards.sparkSession)
    folder = folder.rstrip("/")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(blob)
                fs.move(draft, f"{root}/{name}.wm")
                yield pa.RecordBatch.from_pylist([{"shard": name, "path": f"{folder}/{name}.wm", "n_bytes": len(blob)}])

    return shards.select("shard", "blob").mapInArrow(run, "shard string, path string, n_bytes long")


