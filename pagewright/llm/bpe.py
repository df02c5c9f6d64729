"""Byte-level BPE by prefix dynamic programming, and its inverse.

Each byte prefix of a piece has one valid last token: the last token of that prefix's encoding. A
token t is it if t ends the prefix and t may follow the last token of what is left of it. Two
tokens may stand side by side if undoing their merges from the outside in never shows a pair that
would have merged earlier. So a prefix's entry depends on earlier entries alone: appends are exact
and an edit needs only the entries behind it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import slices

#: Bytes of encoded stretches that a worker keeps, and entries of pieces and of pairs of tokens.
MEMO_BYTES, OTHER_ENTRIES, PAIR_ENTRIES = 32 << 20, 50_000, 200_000


class Vocabulary:
    """Ranks of a byte-level vocabulary, the pairs that merge, and the halves of every token."""

    def __init__(self, rank_lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines()) if a}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.top = max(self.bytes) + 1
        self.merged = {self.rank[t[:i]] * self.top + self.rank[t[i:]]: r for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank}
        self.halves = {token: self._halves(token) for token in self.bytes}
        self.own = {t for t in self.bytes if self.makes(t)}
        #: Every ending of a token: its rank if it is a token itself, else -1.
        self.ending = {t[i:]: -1 for t in self.rank for i in range(len(t))} | self.rank
        self.seen: dict[int, bool] = {}

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice if none do."""
        parts = [self.rank[bytes([x])] for x in self.bytes[token]]
        while len(parts) > 2:
            ranks = [self.merged.get(a * self.top + b, token) for a, b in zip(parts, parts[1:])]
            if (low := min(ranks)) >= token:
                return token, token
            i = ranks.index(low)
            parts[i : i + 2] = [low]
        return (parts[0], parts[1]) if len(parts) == 2 else (token, token)

    def makes(self, token: int) -> bool:
        """Whether BPE of a token's own bytes gives that token."""
        return len(self.bytes[token]) == 1 or self.halves[token][0] != token

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes together gives just these two."""
        if (known := self.seen.get(left * self.top + right)) is None:
            if len(self.seen) >= PAIR_ENTRIES:
                self.seen.clear()
            known = self.seen[left * self.top + right] = self.makes(right) and self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, latest first: the pair at the border must never
        have merged before the token that was undone. On equal rank the left one came first."""
        merged, halves, top, limit = self.merged.get, self.halves, self.top, self.top + 1
        while merged(left * top + right, limit) >= limit:
            inner, outer = halves[left][1], halves[right][0]
            if left > right and inner != left or outer == right:
                if inner == left:
                    return True
                limit, left = left, inner
            else:
                limit, right = right + 1, outer
        return False


class PrefixTable:
    """The last token of every byte prefix of one piece, kept for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extend the piece; earlier entries stay as they are."""
        v, last = self.vocabulary, self.last
        ending, seen, top = v.ending.get, v.seen.get, v.top
        start = len(self.data)
        self.data += data
        data = self.data
        for end in range(start + 1, len(data) + 1):
            begin = end
            while begin:  # only one token is valid, so the short ones may come first
                begin -= 1
                token = ending(data[begin:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte")
                if token < 0:
                    continue
                if begin == 0:
                    valid = token in v.own
                else:
                    pair = last[begin - 1] * top + token
                    if (valid := seen(pair)) is None:
                        valid = v.may_follow(last[begin - 1], token)
                if valid:
                    last.append(token)
                    break

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put data in place of [start, stop). Entries before start stay. Behind the edit, work
        ends once a token's worth of entries agree with the old ones, which then repeat."""
        tail, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        agree = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            agree = agree + 1 if self.last[-1] == old[i] and i + 1 >= len(self.vocabulary.bytes[old[i]]) else 0
            if agree >= self.vocabulary.longest:
                self.data += tail[i + 1 :]
                self.last += old[i + 1 :]
                break

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


#: White space as the split patterns see it, for a regular expression's class.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Encodes each of many strings: all ids one behind the other, and the number of each string's.
EncodeStrings = Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


class StretchMemo:
    """Ids of whole texts, where each distinct stretch of a batch is looked up or encoded once.

    A stretch begins at the text's start, or with a single space or line feed that stands between
    two characters which are not white space: no match of the split pattern spans such a place, so
    the cut changes no piece, and the line feed is a piece of its own. That, and the rule that marks
    behind letters are a piece of their own, hold for split patterns that, as that of the public
    byte-level vocabularies, take runs of letters, or of marks, with one space before them.
    Stretches, codes and the memo are Arrow arrays: a stretch costs no Python object, and the memo
    holds max_bytes at most.
    """

    def __init__(self, encode_strings: EncodeStrings, max_bytes: int = MEMO_BYTES):
        self.encode_strings, self.max_bytes = encode_strings, max_bytes
        self.words, self.ids = pa.array([], pa.string()), _lists(np.zeros(0), np.zeros(0))
        self.line_feed = _lists(*encode_strings(pa.array(["\n"])))

    def _places(self, strings: pa.StringArray) -> np.ndarray:
        """Place of each string in the memo, which takes in those that it lacks."""
        at = pc.index_in(strings, value_set=self.words)
        if at.null_count:
            lacking = strings.filter(at.is_null())
            new = pc.unique(lacking)
            late = pc.add(pc.index_in(lacking, value_set=new), len(self.words))
            ids = _lists(*self.encode_strings(new))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
            at = pc.replace_with_mask(at, at.is_null(), late.cast(at.type))
        return at.to_numpy()

    def _prune(self, used: np.ndarray) -> None:
        """Over max_bytes, keep what the last batch used and is short; if that is too much, nothing."""
        if self.words.nbytes + self.ids.nbytes > self.max_bytes:
            used = np.unique(used)
            used = used[pc.binary_length(self.words).to_numpy()[used] <= 64]
            self.words, self.ids = self.words.take(pa.array(used)), self.ids.take(pa.array(used))
            if self.words.nbytes + self.ids.nbytes > self.max_bytes // 2:
                self.words, self.ids = self.words[:0], self.ids[:0]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the number of each text's; null counts as empty."""
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # a part with a line feed begins with it: the space before it is not the text's
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        names, codes, rows = coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy()[:-1].copy()
        opens, closes = (pc.match_substring_regex(names, x).to_numpy(zero_copy_only=False) for x in (rf"^\n?([{WHITE}]|$)", rf"(^|[{WHITE}])$"))
        feed = pc.starts_with(names, "\n")
        is_feed = feed.to_numpy(zero_copy_only=False)
        spaced = pc.if_else(feed, names, pc.binary_join_element_wise(" ", names, ""))
        cut = np.concatenate(([True], ~(closes[codes[:-1]] | opens[codes[1:]])))
        cut[rows] = True
        starts = np.flatnonzero(cut)
        sizes, code = np.diff(np.concatenate((starts, [len(codes)]))), codes[starts]
        head = np.searchsorted(starts, rows)
        own = np.unique(np.concatenate((head, np.flatnonzero(sizes > 1))))  # first in a text, or of several parts
        is_head = np.zeros(len(starts), bool)
        is_head[head] = True
        # a text's first part has no space before it; of other stretches, a first line feed is left out
        bare = pc.if_else(feed, pc.utf8_slice_codeunits(names, 1), spaced)
        ends = np.cumsum(sizes[own])
        part = codes[np.repeat(starts[own], sizes[own]) + _count_up(sizes[own])].astype(np.int64) + len(names)
        first = np.concatenate(([0], ends[:-1]))
        part[first] += np.where(is_head[own], -len(names), len(names))
        texts = pa.concat_arrays([names, spaced, bare]).take(pa.array(part))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), texts), "")
        fed = np.concatenate((is_feed, is_feed[codes[starts[own]]] & ~is_head[own]))
        code[own] = len(names) + np.arange(len(own))
        del codes, coded, parts, cut, starts, sizes, is_head  # the largest arrays of a batch
        strings = pa.concat_arrays([bare, texts])
        used = np.flatnonzero(np.bincount(code, minlength=len(strings)))
        strings = strings.take(pa.array(used))
        tail = pc.extract_regex(strings, rf"^(?P<word> ?\pL+)(?P<marks>[^{WHITE}\pL\pN]+)$")
        marked = tail.is_valid()
        place = self._places(pa.concat_arrays([pc.if_else(marked, pc.struct_field(tail, "word"), strings), pc.struct_field(tail, "marks").filter(marked)]))
        mark = np.full(len(used), -1)
        mark[marked.to_numpy(zero_copy_only=False)] = place[len(used) :]
        lists = pa.concat_arrays([self.ids, self.line_feed])
        at = np.empty(len(fed), np.int32)
        at[used] = np.arange(len(used))
        at, has_feed = at[code], fed[code].astype(np.int8)
        has_mark = mark[at] >= 0
        items = 1 + has_feed + has_mark
        begin = np.cumsum(items, dtype=np.int32) - items
        order = np.full(int(items.sum()), len(self.ids), np.int32)
        order[begin + has_feed] = place[at]
        order[begin[has_mark] + has_feed[has_mark] + 1] = mark[at[has_mark]]
        counts = np.add.reduceat(pc.list_value_length(lists).to_numpy()[order].astype(np.int64), begin[head])
        ids = lists.take(pa.array(order)).flatten().to_numpy()
        self._prune(place)
        return ids, counts


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of these sizes, one behind the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Encoder:
    """Encodes whole texts by prefix tables."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.vocabulary, self.pieces = Vocabulary(rank_lines), regex.compile(pattern)
        self.other: dict[str, list[int]] = {}
        self.memo = StretchMemo(self._strings)

    def _strings(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = array("i"), array("q")
        for s in strings.to_pylist():
            own = self._string(s)
            ids.extend(own)
            counts.append(len(own))
        return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.frombuffer(counts, np.int64) if counts else np.zeros(0, np.int64)

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.vocabulary.rank.get(data)
        return [token] if token is not None else PrefixTable(self.vocabulary, data).tokens()

    def _string(self, s: str) -> list[int]:
        if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()):
            return self._piece(s)
        ids = []
        for p in self.pieces.findall(s):
            known = self.other.get(p)
            if known is None:
                known = self._piece(p)
                if len(p) <= 64:
                    if len(self.other) >= OTHER_ENTRIES:
                        self.other.clear()
                    self.other[p] = known
            ids += known
        return ids

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        return _lists(*self.memo.encode_column(column))

    def forget(self) -> None:
        """Let go of what was encoded; the tables of the vocabulary stay."""
        self.other.clear()
        self.memo = StretchMemo(self._strings)

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].as_py()


class Decoder:
    """Bytes of ids, from the table of the vocabulary's tokens alone."""

    def __init__(self, rank_lines: bytes):
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, rank_lines.splitlines()) if a}
        self.table = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.binary())

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids; null gives null."""
        flat = self.table.take(ids.flatten())
        if flat.null_count:
            raise ValueError("an id is not in the vocabulary")
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
        offsets = np.concatenate(([0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)))[ends].astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), flat.buffers()[2]])
        return pc.if_else(ids.is_valid(), data, pa.scalar(None, pa.binary()))


_HELD: dict[tuple, object] = {}


def held(kind: type, key: str, lines: Callable[[], bytes], *more: str):
    """One encoder or decoder a worker process; its tables are kept between tasks."""
    if (kind, key, more) not in _HELD:
        _HELD[kind, key, more] = kind(lines(), *more)
    return _HELD[kind, key, more]


def _shared_ranks(df: DataFrame, ranks_path: str) -> tuple[str, Callable[[], bytes]]:
    """The rank file's lines for the executors: a vocabulary file of fixed size."""
    lines = Path(ranks_path).read_bytes()
    shared = df.sparkSession.sparkContext.broadcast(lines)
    return hashlib.sha1(lines).hexdigest(), lambda: shared.value


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null or empty gives no ids.

    Other columns are left out. Repeated rows give repeated results.
    """
    key, lines = _shared_ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(Encoder, key, lines, pattern)
        for b in slices(batches, 4000):
            yield pa.record_batch([b.column(0), enc.encode_column(b.column(1))], names=["doc_id", "ids"])
        enc.forget()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and data (bytes) of rows of ids; null ids give null."""
    key, lines = _shared_ranks(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = held(Decoder, key, lines)
        for b in slices(batches, 4000):
            yield pa.record_batch([b.column(0), b.column(1), dec.decode_column(b.column(1))], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What decode(encode(docs)) gives, with both steps in one pass over the rows: ids do not go
    through a second worker process."""
    key, lines = _shared_ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = held(Encoder, key, lines, pattern), held(Decoder, key, lines)
        for b in slices(batches, 4000):
            ids = enc.encode_column(b.column(1))
            yield pa.record_batch([b.column(0), ids, dec.decode_column(ids)], names=["doc_id", "ids", "data"])
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then decoded."""
    d = round_trip(docs, ranks_path, pattern)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
