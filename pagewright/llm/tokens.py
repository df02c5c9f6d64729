"""Token ids of a corpus in wavelet matrices, one compressed file a shard.

A shard is a Parquet file of one row: the documents' ids and token counts, and the bit planes of a
wavelet matrix over its tokens. Rank and select on the planes give access to any token, counts and
places of a token, from that file alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.bpe import WHITE, StretchMemo
from pagewright.llm.common import new_path, slices

BLOCK = 512  # bits between two entries of a rank directory
SHARD_BYTES = 8 << 20  # text bytes that a shard should hold
RANGE_SHARDS, MAX_RANGES = 3, 20_000  # shards in a range of doc_id; ranges, whose sums one task adds up
SHARD_SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, counts array<int>, bits int, planes binary"
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("bits", pa.int32()), ("planes", pa.binary())])


class WaveletMatrix:
    """A sequence of ids in bit planes, the highest bit first. At each plane the ids are sorted
    stably by that bit, zeros first."""

    def __init__(self, planes: np.ndarray, n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)
        per_block = np.bitwise_count(planes.reshape(self.bits, -1, BLOCK // 8).view(np.uint64)).sum(axis=2, dtype=np.int64)
        self.ones = np.concatenate((np.zeros((self.bits, 1), np.int64), np.cumsum(per_block, axis=1)), axis=1)
        self.zeros = n - self.ones[:, -1]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, planes = len(ids), np.zeros((bits, -(-max(len(ids), 1) // BLOCK) * BLOCK // 8), np.uint8)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits):
            bit = now & now.dtype.type(1 << (bits - 1 - level)) != 0
            packed = np.packbits(bit)
            planes[level, : len(packed)] = packed
            now = np.concatenate((now[~bit], now[bit]))
        return cls(planes, n)

    @classmethod
    def load(cls, data: bytes, n: int, bits: int) -> WaveletMatrix:
        return cls(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(bits, -1), n)

    def dump(self) -> bytes:
        return zstandard.compress(self.planes.tobytes(), 1)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        b = i // BLOCK
        row = self.planes[level, b * BLOCK // 8 : (i + 7) // 8]
        inside = int(np.bitwise_count(row).sum()) - (int(np.bitwise_count(np.uint8(row[-1] & (0xFF >> (i & 7))))) if i & 7 else 0)
        return int(self.ones[level, b]) + inside

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(self.ones.shape[1]) * BLOCK - self.ones[level]
        b = int(np.searchsorted(before, k, side="right")) - 1
        row = np.unpackbits(self.planes[level, b * BLOCK // 8 : (b + 1) * BLOCK // 8])
        return b * BLOCK + int(np.flatnonzero(row == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            bit, one = self._bit(level, i), self._rank1(level, i)
            out, i = out << 1 | bit, int(self.zeros[level]) + one if bit else i - one
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        lo, hi = self._range(token, 0, i) if 0 <= token < 1 << self.bits else (0, 0)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if k >= self.rank(token, self.n):
            raise IndexError(k)
        i = self._range(token, 0, 0)[0] + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the sorts from the last plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty_like(out)
            z = int(self.zeros[level])
            back[~bit], back[bit] = out[:z], out[z:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = back
        return out.astype(np.uint32)


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, by a memo of stretches.

    The library looks for the strings of added tokens (such as an end-of-text mark) before it splits
    a text, so texts that hold one of them go to it whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        # a byte-level vocabulary writes a space as this letter
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[i for s, i in self.library.get_vocab().items() if s.startswith("\u0120")]] = True
        self.feeds = np.zeros(len(self.begins), bool)
        self.feeds[self._each(["\n"])[0]] = True
        self.memo = StretchMemo(self._strings)

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)

    def _joined(self, words: pa.StringArray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words behind one space or line feed each, without other white space, go to the library
        many at a time, one behind the other. begins tells the tokens that only a word's begin has."""
        if not len(words):
            return _NONE
        words = pa.concat_arrays([words])  # without an offset
        ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        data = memoryview(words.buffers()[2])
        ids, _ = self._each([str(data[ends[i] : ends[min(i + 1000, len(words))]], "utf-8") for i in range(0, len(words), 1000)])
        at = np.flatnonzero(begins[ids])
        if len(at) != len(words):
            return self._each(words.to_pylist())
        return ids, np.diff(np.concatenate((at, [len(ids)])))

    def _strings(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of no white space but one space before them, bare ones, and others."""
        spaced = pc.match_substring_regex(strings, rf"^ [^{WHITE}]+$")
        bare = pc.match_substring_regex(strings, rf"^[^{WHITE}]+$")
        kind = np.where(spaced.to_numpy(zero_copy_only=False), 0, np.where(bare.to_numpy(zero_copy_only=False), 1, 2))
        a = self._joined(strings.filter(spaced), self.begins)
        b, n = self._joined(pc.binary_join_element_wise("\n", strings.filter(bare), ""), self.feeds)
        c = self._each(strings.filter(pa.array(kind == 2)).to_pylist())
        return _merged(kind, (a, (b[~self.feeds[b]], n - 1), c))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the number of each text's; null counts as empty."""
        whole = np.zeros(len(column), bool)
        for s in self.added:
            whole |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.memo.encode_column(column)
        return _merged(whole.astype(int), (self.memo.encode_column(column.filter(pa.array(~whole))), self._each(column.filter(pa.array(whole)).to_pylist())))


def _merged(kind: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of strings of several kinds, each kind's in order, in the order of all."""
    counts = np.empty(len(kind), np.int64)
    for k, (_, n) in enumerate(found):
        counts[kind == k] = n
    own = np.repeat(kind, counts)
    ids = np.empty(len(own), np.int32)
    for k, (x, _) in enumerate(found):
        ids[own == k] = x
    return ids, counts


_NONE = np.zeros(0, np.int32), np.zeros(0, np.int64)
_ENCODERS: dict[int, LibraryEncoder] = {}


def encode_texts(column: pa.Array, tokenizer_json: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, end_id behind each, and the number of each text's."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(tokenizer_json)
    ids, counts = _ENCODERS[key].encode_column(column)
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def write_shards(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES, max_ranges: int = MAX_RANGES) -> None:
    """Write a corpus as shards in ascending doc_id order (null first, equal ones by text).

    Null and empty texts hold the end id alone. An empty table writes no shard. Tasks take ranges of
    doc_id and write their shards one after the other; there is a range for every few shards, but no
    more than max_ranges. A shard has as many bit planes as its largest id needs.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, counts, size, shard = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            bits = max(1, int(all_ids.max()).bit_length())
            matrix = WaveletMatrix.build(all_ids, bits)
            return pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "shard": shard, "n_tokens": len(all_ids), "doc_ids": names, "counts": counts, "bits": bits, "planes": matrix.dump()}], schema=_SHARD)

        for b in slices(batches, 6000, 12 << 20):
            found, sizes = encode_texts(b.column(1), held.value, end_id)
            names += b.column(0).to_pylist()
            counts += sizes.tolist()
            ids.append(found)
            size += b.nbytes
            if size >= shard_bytes:
                yield row()
                ids, names, counts, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max_ranges, max(1, -(-total // (RANGE_SHARDS * shard_bytes))))
    spread = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    spread.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark, path: str, each: Callable[[WaveletMatrix, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply each(matrix, row) to every shard of a folder; one shard is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            yield each(WaveletMatrix.load(row.pop("planes"), row["n_tokens"], row["bits"]), row)

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(run, schema)


def occurrences(spark, path: str, token: int) -> DataFrame:
    """part, shard, position of every place of a token, by select on each shard's matrix."""

    def each(m: WaveletMatrix, row: dict) -> pa.RecordBatch:
        at = [m.select(token, k) for k in range(m.rank(token, m.n))]
        return pa.record_batch([pa.array([row["part"]] * len(at), pa.int32()), pa.array([row["shard"]] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["part", "shard", "position"])

    return read_shards(spark, path, each, "part int, shard int, position long")


def token_counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """token, n over all shards, by rank."""

    def each(m: WaveletMatrix, row: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(tokens, pa.int64()), pa.array([m.rank(t, m.n) for t in tokens], pa.int64())], names=["token", "n"])

    return read_shards(spark, path, each, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _digest(m: WaveletMatrix, row: dict) -> pa.RecordBatch:
    ids, counts = m.all().astype("<u4"), np.array(row["counts"], np.int64)
    ends = np.cumsum(counts)
    data = memoryview(ids.tobytes())
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
    n = len(counts)
    return pa.record_batch([pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the shards.

    start adds up the tokens of the parts before (a row a part, MAX_RANGES at most, in one task),
    then those of the part's shards before.
    """
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "shard", "n_tokens")

    def before(w):
        return F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("part_base"))
    base = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_base"))
    base = base.join(parts, "part").select("part", "shard", (F.col("part_base") + F.col("shard_base")).alias("base"))
    rows = read_shards(spark, path, _digest, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def corpus_digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Write the corpus as shards in the shared folder and give the digests of what they hold."""
    path = new_path(docs.sparkSession, "tokens")
    write_shards(docs, tokenizer_json, path)
    return digests(docs.sparkSession, path)
