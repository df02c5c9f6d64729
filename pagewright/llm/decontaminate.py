"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.llm.common import materialize, slices, texts, widened

WINDOW_WORDS = 13
#: Text bytes of test items in one automaton; more are taken in several passes. A byte of text is in 13
#: windows, and a node of the automaton takes some 40 bytes, so one of this size takes about 290 MB.
ITEM_BYTES = 512 << 10
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(128, 256))
#: Byte for byte: A-Z to lower case, what is in no word to a space. UTF-8 bytes from 0x80 on belong
#: to characters beyond ASCII, which are all word characters.
_NORMAL = bytes((x + 32 if 65 <= x <= 90 else x) if x in _WORD else 32 for x in range(256))


def normalise(text: str) -> tuple[bytes, list[bytes]]:
    """The text as bytes of the same length with only word characters and spaces; its words."""
    data = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    return data, data.split()


def _line(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def automaton(items: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """All windows of the items: 13 consecutive words, or all words of a shorter item. The value
    of a window is its length in words and the items that have it."""
    windows: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        words = normalise(text)[1]
        for i in range(max(1, len(words) - WINDOW_WORDS + 1) if words else 0):
            part = words[i : i + WINDOW_WORDS]
            windows.setdefault(_line(part), (len(part), set()))[1].add(item_id)
    out = ahocorasick.Automaton()
    for key, value in windows.items():
        out.add_word(key, value)
    if windows:
        out.make_automaton()
    return out


def scan(text: str, found_by: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, word ranges [first, last) of all window occurrences, items that occur."""
    words = normalise(text)[1]
    spans, items = [], set()
    if words and len(found_by):
        hits = list(found_by.iter(_line(words)))
        if hits:
            ends = np.cumsum([len(w) + 1 for w in words])  # place of the space behind each word
            for end, (n, ids) in hits:
                last = int(np.searchsorted(ends, end)) + 1
                spans.append((last - n, last))
                items |= ids
    return len(words), spans, items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text that merged word ranges cover."""
    data, _ = normalise(text)
    word = np.frombuffer(data, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    begins, ends = edge[::2], edge[1::2]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[begins[a]]), int(chars[ends[b - 1]])) for a, b in merged(spans)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Words of an item that stay together.
PIECE_WORDS = 4096


def _pieces(items: DataFrame) -> DataFrame:
    """Items in pieces (item_id, piece, text) that have all their windows: a long item is cut, and the
    words that windows over a cut need are in both pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                words = normalise(t)[1]
                for k, at in enumerate(range(0, max(1, len(words) - WINDOW_WORDS + 1), PIECE_WORDS)):
                    rows.append((i, k, b" ".join(words[at : at + PIECE_WORDS + WINDOW_WORDS - 1]).decode("utf-8", "surrogatepass")))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["item_id", "piece", "text"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, piece int, text string")


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "piece"), F.lit(n))


def _parts(pieces: DataFrame, item_bytes: int) -> int:
    """Into how many parts, by a hash of their numbers, pieces go so that each holds item_bytes or
    less, or one piece."""
    n = 1
    while True:
        sums = pieces.groupBy(_part(n)).agg(F.sum(F.octet_length("text")).alias("size"), F.countDistinct("item_id", "piece").alias("ids"))
        if not (over := sums.where((F.col("size") > item_bytes) & (F.col("ids") > 1)).agg(F.max("size")).first()[0]):
            return n
        n *= max(2, over // item_bytes)


_NEW = "n_words long, n_hit long, item_ids array<string>, spans array<struct<begin:bigint,end:bigint>>"
_HITS = "pagewright_row long, pagewright_spans array<struct<first:bigint,last:bigint>>, pagewright_items array<long>"


def _found(text: str, n: int, spans: list[tuple[int, int]], items: set) -> tuple:
    """Values of the new columns, from word ranges that are merged."""
    return n, sum(y - x for x, y in spans), sorted(map(str, items)), [{"begin": x, "end": y} for x, y in original_spans(text, spans)] if spans else []


def _one_pass(docs: DataFrame, at: int, items: list[tuple[int, str]]) -> DataFrame:
    """docs with the new columns, by one automaton of all items."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    built: list = []
    schema = widened(docs, _NEW)
    types = [f.type for f in to_arrow_schema(schema)][len(docs.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(automaton(held.value))
        for b in slices(batches):
            out = []
            for t in texts(b.column(at)):
                n, spans, ids = scan(t, built[0])
                out.append(_found(t, n, merged(spans), ids))
            yield pa.record_batch([*b.columns, *map(pa.array, zip(*out), types)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _hits(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Word ranges and items found in rows (pagewright_row, text), of the rows that have any."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    built: list = []
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(_HITS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(automaton(held.value))
        for b in slices(batches):
            rows = [(i, *scan(t, built[0])[1:]) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1)))]
            out = [(i, [{"first": x, "last": y} for x, y in merged(spans)], sorted(ids)) for i, spans, ids in rows if spans]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["pagewright_row", "pagewright_spans", "pagewright_items"])

    return docs.mapInArrow(run, _HITS)


def _passes(docs: DataFrame, at: int, parts: Iterator[list[tuple[int, str]]]) -> DataFrame:
    """docs with the new columns, by one automaton after the other: each pass is a job of its own that
    writes what it found, so a worker holds one automaton at a time."""
    numbered = materialize(docs.withColumn("pagewright_row", F.monotonically_increasing_id()), "numbered")
    texts_only = numbered.select("pagewright_row", F.col("text").cast("string").alias("text"))
    hits = None
    for items in parts:
        found = materialize(_hits(texts_only, items), "hits")
        hits = found if hits is None else hits.unionByName(found)
    per_row = hits.groupBy("pagewright_row").agg(F.flatten(F.collect_list("pagewright_spans")).alias("pagewright_spans"), F.flatten(F.collect_list("pagewright_items")).alias("pagewright_items"))
    joined = numbered.join(per_row, "pagewright_row", "left").select(*docs.columns, "pagewright_spans", "pagewright_items")
    schema = widened(docs, _NEW)
    types = [f.type for f in to_arrow_schema(schema)][len(docs.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, spans, ids in zip(texts(b.column(at)), *(c.to_pylist() for c in b.columns[-2:])):
                out.append(_found(t, len(normalise(t)[1]), merged([(s["first"], s["last"]) for s in spans or []]), set(ids or [])))
            yield pa.record_batch([*b.columns[:-2], *map(pa.array, zip(*out), types)], names=schema.names)

    return joined.mapInArrow(run, schema)


def match(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Columns of docs with n_words, n_hit, item_ids (distinct, as sorted strings) and spans
    (merged character ranges of the original text).

    Null texts have no words; items without id or words have no window; repeated items count
    once. Columns of docs that clash with the new ones are replaced. Items of up to item_bytes are
    sent to the executors as text, where each builds the automaton; more are dealt out by their ids
    into parts of that size (a larger single item is a part of its own), and the documents are
    scanned for one part after the other.
    """
    out = docs.drop(*(c.split()[0] for c in _NEW.split(", ") if c), "pagewright_row", "pagewright_spans", "pagewright_items")
    at = out.columns.index("text")
    pieces = materialize(_pieces(benchmark), "pieces")
    n = _parts(pieces, item_bytes)
    parts = ([(r["item_id"], r["text"]) for r in pieces.where(_part(n) == i).collect()] for i in range(n))
    return _one_pass(out, at, next(parts)) if n == 1 else _passes(out, at, parts)


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    m = match(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark)
    return m.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs, unchanged, that are not contaminated."""
    columns = docs.columns
    return match(docs, benchmark).where(~_contaminated()).select(*columns)
