"""Removal of repeated word runs by suffix automata.

A window is 20 consecutive words. Its anchor is the smallest hash of the 8-word runs in it, so equal
windows have equal anchors. A piece is a run of windows of one document with one anchor. Pieces meet
by anchor: all but the first of equal pieces are repeats. Where an anchor has different pieces, a
suffix automaton takes them in document order; the matching statistics tell which windows came
before. An automaton of the whole corpus fits no executor; one for each anchor does, and misses no
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, slices, texts

WINDOW, GRAM = 20, 8
#: Different pieces of an anchor that one automaton takes; windows of anchors with more meet by
#: their own hash instead.
MAX_PIECES = 20_000
NO_ID = -(2**63)  # stands for a null doc_id, which comes first
_U = np.uint64
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash factor and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(4096, 2 * n)
        for i, base in enumerate((_M, _M_INV)):
            _POWERS[i] = np.concatenate((np.ones(1, _U), np.cumprod(np.full(size, base, _U))))
    return _POWERS[0], _POWERS[1]


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of n words, by doubling."""
    have, size, done, out = w, 1, 0, None
    while True:
        if n & size:
            out = have if out is None else out[: len(w) - done - size + 1] + have[done : done + len(w) - done - size + 1] * _U(pow(_M, done, 1 << 64))
            done += size
        if done == n:
            return out
        have = have[:-size] + have[size:] * _U(pow(_M, size, 1 << 64))
        size *= 2


def pieces(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of each piece of a document. The
    number is negative if a window comes twice in the piece, which then has to be compared."""
    n = len(w) - WINDOW + 1
    if n < 1:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    low, width, span = _mix(_grams(w, GRAM)), 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[:n], low[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    power, inverse = _powers(len(w) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(w * power[: len(w)])))
    content = _mix((total[first + count + WINDOW - 1] - total[first]) * inverse[first] + count.astype(_U))
    windows = _mix(_grams(w, WINDOW))
    if len(np.unique(windows)) < n:
        for k in np.flatnonzero(count > 1):
            own = windows[first[k] : first[k] + count[k]]
            if len(np.unique(own)) < len(own):
                count[k] = -count[k]
    return low[first], content, first, count


def _first_rows(anchor: np.ndarray, piece: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows sorted by anchor, piece, doc and start: whether a row has its group's first place."""
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc == doc[lead]) & (start == start[lead])


_ROW = ["kind", "part", "piece", "doc", "start", "n"]
_ROW_DDL = "kind int, part long, piece long, doc long, start int, n int"
OPEN, REPEAT, COMPARE = 0, 1, 2


def _rows(kind, part, piece, doc, start, n) -> pa.RecordBatch:
    kind_open = not np.isscalar(kind)
    kinds = kind if kind_open else np.full(len(doc), kind, np.int32)
    return pa.record_batch([pa.array(kinds), pa.array(part.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array((n if kind_open else np.abs(n)).astype(np.int32))], names=_ROW)


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents. Of equal pieces in a batch only the first stays open; the others are
    repeats whatever else there is. So a hot passage sends one row a batch to its anchor's task."""
    for b in slices(batches, 2000):
        found = [pieces(word_hashes(words_of(t))) for t in texts(b.column(1))]
        sizes = [len(f[0]) for f in found]
        anchor, piece, start, n = (np.concatenate(x) for x in zip(*found))
        doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
        order = np.lexsort((start, doc, piece, anchor))
        anchor, piece, doc, start, n = (x[order] for x in (anchor, piece, doc, start, n))
        if not len(doc):
            continue
        first = _first_rows(anchor, piece, doc, start)
        part = np.where(first, anchor, _mix(doc.view(_U) + start.astype(_U)))
        yield _rows(np.where(first, OPEN, REPEAT).astype(np.int32), part, piece, doc, start, n)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, part (anchor), piece, doc and start: repeats pass; the later of equal
    pieces become repeats; first pieces of anchors with several pieces are to be compared. Between
    batches only the group's first row is held."""
    held, went = None, False  # the last piece's first row; whether it went out
    for b in batches:
        kind, part, piece, doc, start, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        ready = kind == REPEAT
        if ready.any():
            yield _rows(REPEAT, part[ready], piece[ready], doc[ready], start[ready], n[ready])
        part, piece, doc, start, n = (x[~ready] for x in (part, piece, doc, start, n))
        if not len(part):
            continue
        if held is not None:
            part, piece, doc, start, n = (np.concatenate(([h], x)) for h, x in zip(held, (part, piece, doc, start, n)))
        skip = 0 if held is None else 1
        new_anchor = np.concatenate(([True], part[1:] != part[:-1]))
        new_piece = new_anchor | np.concatenate(([True], piece[1:] != piece[:-1]))
        first = _first_rows(part, piece, doc, start)
        again = ~first
        again[:skip] = False
        if again.any():
            yield _rows(REPEAT, part[again], piece[again], doc[again], start[again], n[again])
        leads = np.flatnonzero(new_piece)
        more = np.concatenate((~new_anchor[leads][1:], [False]))  # another piece of this anchor follows
        out = ~new_anchor[leads] | more | (n[leads] < 0)
        before, went = went, bool(out[-1])
        if skip:
            out[0] = more[0] and not before
            went = went if len(leads) > 1 else before or bool(out[0])
        if out.any():
            r = leads[out]
            yield _rows(COMPARE, part[r], piece[r], doc[r], start[r], n[r])
        last = leads[-1]
        held = (part[last], piece[last], doc[last], start[last], n[last])


class SuffixAutomaton:
    """Suffix automaton of several word sequences, built word by word."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.length)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> list[int]:
        """Take in a sequence; for each word, the length of the longest run of words ending there
        that came before: in an earlier sequence, or earlier in this one."""
        last, seen = 0, []
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                seen.append(self.length[last])
                continue
            now, p = len(self.length), last
            self.next.append({}), self.link.append(0), self.length.append(self.length[last] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = now
            seen.append(self.length[self.link[now]])
        return seen

    def match(self, words: list[int]) -> list[int]:
        """Matching statistics: for each word, the longest run ending there that is in a sequence."""
        state, size, out = 0, 0, []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            out.append(size)
        return out


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the pieces to compare. Anchors with too many pieces are divided: each window
    becomes a piece of its own, with its hash as the anchor; equal ones of a batch are sent once."""
    for b in slices(batches, 500):
        out: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        for t, doc, needs in zip(texts(b.column(1)), b.column(0).to_pylist(), b.column(2).to_pylist()):
            w = word_hashes(words_of(t))
            for x in sorted(needs, key=lambda x: x["start"]):
                part, start, n = x["part"], x["start"], x["n"]
                if not x["large"]:
                    out.append((OPEN, part, doc, start, n, w[start : start + n + WINDOW - 1].tobytes()))
                    continue
                for i, h in enumerate(_mix(_grams(w[start : start + n + WINDOW - 1], WINDOW)).view(np.int64).tolist(), start):
                    out.append((REPEAT if (h, doc) in seen else OPEN, h, doc, i, 1, w[i : i + WINDOW].tobytes()))
                    seen.add((h, doc))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "part", "doc", "start", "n", "words"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, doc and start: spans of windows that came before, by an automaton for
    each part."""
    part, machine = None, SuffixAutomaton()
    for b in batches:
        docs, starts, counts = [], [], []
        for kind, p, doc, start, n, data in zip(*(b.column(i).to_pylist() for i in range(6))):
            if p != part:
                part, machine = p, SuffixAutomaton()
            if kind == REPEAT:
                docs.append(doc), starts.append(start), counts.append(n)
                continue
            seen = np.array(machine.add(np.frombuffer(data, _U).tolist())[WINDOW - 1 :]) >= WINDOW
            edge = np.flatnonzero(np.diff(np.concatenate(([0], seen.view(np.int8), [0]))))
            for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
                docs.append(doc), starts.append(start + a), counts.append(z - a)
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], names=["doc", "start", "n"])


def repeated_spans(docs: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc, start, n: runs of n windows, from word start on, whose words also begin earlier.

    docs has doc (long, not null) and text."""
    order = ["kind", "part", "piece", "doc", "start"]
    met = materialize(docs.mapInArrow(_find_pieces, _ROW_DDL).repartition("part").sortWithinPartitions(*order).mapInArrow(_meet, _ROW_DDL), "pieces")
    needs = met.where(F.col("kind") == COMPARE)
    large = needs.groupBy("part").count().where(F.col("count") > max_pieces).select("part", F.lit(True).alias("large"))
    wanted = needs.join(large, "part", "left").groupBy("doc").agg(F.collect_list(F.struct("part", "start", "n", F.coalesce("large", F.lit(False)).alias("large"))).alias("needs"))
    words = docs.join(wanted, "doc").select("doc", "text", "needs").mapInArrow(_with_words, "kind int, part long, doc long, start int, n int, words binary")
    compared = words.repartition("part").sortWithinPartitions("part", "doc", "start").mapInArrow(_compare, "doc long, start int, n int")
    return met.where(F.col("kind") == REPEAT).select("doc", "start", "n").unionByName(compared)


def _kept(text: str, spans: list | None) -> tuple[int, bytes]:
    words = words_of(text)
    if not spans:
        return len(words), b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[min(s["start"], len(words))] += 1
        gone[min(s["start"] + s["n"] + WINDOW - 1, len(words))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def dedup_substrings(docs: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words left, joined by one space) of every row.

    Null and empty texts have no words. Rows that share a doc_id count as one document: places that
    repeat are removed from each. A null doc_id comes before all others. Other columns are left out.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(rows, max_pieces).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [_kept(t, s) for t, s in zip(texts(b.column(1)), b.column(2).to_pylist())]
            kept = [k.decode("utf-8", "surrogatepass") for _, k in done]
            removed = [n - len(k.split()) for n, k in done]
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept"])

    out = rows.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _matched(docs: DataFrame, texts_of_shard: list[str], min_words: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(texts_of_shard)
    built: list[SuffixAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(SuffixAutomaton())
            for t in held.value:
                built[0].add(word_hashes(words_of(t)).tolist())
        for b in slices(batches):
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                seen = built[0].match(word_hashes(words_of(t)).tolist())
                for i, n in enumerate(seen):
                    if n >= min_words and (i + 1 == len(seen) or seen[i + 1] <= n):
                        rows.append((doc, i + 1 - n, n))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, n_words long")


def match_reference(docs: DataFrame, reference: DataFrame, min_words: int = WINDOW, max_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, start, n_words of maximal word runs of at least min_words that are in a text of
    reference. The reference is dealt out by a hash of its texts into shards of max_bytes (a larger
    text is a shard of its own). Each is sent to the executors, which build its automaton once and
    stream the documents for matching statistics; of the runs of all shards those that lie in
    another are left out. Equal texts of the reference count once; a doc_id is one document.
    """
    rows = reference.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    shards = 1
    while True:
        shard = F.pmod(F.xxhash64("text"), F.lit(shards))
        sums = rows.groupBy(shard).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
        if not (over := sums.where((F.col("size") > max_bytes) & (F.col("n") > 1)).agg(F.max("size")).first()[0]):
            break
        shards *= max(2, over // max_bytes)
    found = None
    for i in range(shards):
        part = _matched(docs, [r[0] for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == i).collect()], min_words)
        found = part if found is None else found.unionByName(part)
    if shards == 1:
        return found
    w = Window.partitionBy("doc_id").orderBy("start", F.col("n_words").desc())
    before = F.max(F.col("start") + F.col("n_words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return found.distinct().withColumn("before", before).where(F.coalesce(F.col("before") < F.col("start") + F.col("n_words"), F.lit(True))).drop("before")
