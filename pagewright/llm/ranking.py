"""Ranked lexical search over posting lists in geometric blocks.

Documents become vectors of integer impacts over the terms of the queries. A task takes its documents
in shards. Within a shard the posting list of each term is clustered by the similarity of its
documents, into blocks of BLOCK at most, and each block has a summary: for every coordinate that a
query with the term can ask for, the greatest impact among its documents. A query takes the lists of
its terms, those that can add most first. A block is skipped only if the query's product with the
summary is under the score of the task's 50th document so far, so the result is that of scoring all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialize, slices, texts

TOP, BLOCK, SKETCH = 50, 64, 16
#: Terms of the queries that are searched for at once, and bytes of a shard's impacts.
PART_TERMS, SHARD_BYTES = 8192, 48 << 20
_TERM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(128, 256))
_NORMAL = bytes((x + 32 if 65 <= x <= 90 else x) if x in _TERM else 32 for x in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to a document's score, before its weight: at most a million."""
    m = 50 + 50 * n * docs // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Ranked:
    """The best documents of a query so far, best first: equal scores by doc_id."""

    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray, top: int) -> None:
        some = scores >= max(1, self.least(top))
        s, i = np.concatenate((self.scores, scores[some])), np.concatenate((self.ids, ids[some]))
        best = np.lexsort((i, -s))[:top]
        self.scores, self.ids = s[best], i[best]

    def least(self, top: int) -> int:
        """The score that a further document needs at least."""
        return int(self.scores[-1]) if len(self.scores) == top else 1


@dataclass
class Blocks:
    """A posting list: documents by block, where blocks begin, summaries over coords, least doc_ids."""

    docs: np.ndarray
    starts: np.ndarray
    coords: np.ndarray
    summaries: np.ndarray
    least_ids: np.ndarray


class Shard:
    """Impacts of some documents over all terms, and the blocked posting lists of those terms that
    queries come to."""

    def __init__(self, ids: np.ndarray, impact: np.ndarray, asked: list[np.ndarray], block: int = BLOCK):
        self.ids, self.impact, self.asked, self.block = ids, impact, asked, block
        self.greatest = impact.max(axis=0, initial=0)
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (impact.shape[1], SKETCH))
        sketch = impact @ signs
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, Blocks] = {}

    def blocks(self, term: int) -> Blocks:
        """The posting list of a term: every document goes to the most similar of evenly spaced
        pivots; groups of over block documents are cut."""
        if term in self.lists:
            return self.lists[term]
        docs = np.flatnonzero(self.impact[:, term])
        many = -(-len(docs) // self.block)
        group = np.zeros(len(docs), np.int64)
        if many > 1:
            pivots = docs[np.linspace(0, len(docs) - 1, many).astype(np.int64)]
            group = np.argmax(self.sketch[docs] @ self.sketch[pivots].T, axis=1)
            order = np.argsort(group, kind="stable")
            docs, group = docs[order], group[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(docs)) - np.maximum.accumulate(np.where(first, np.arange(len(docs)), 0))
        starts = np.flatnonzero(place % self.block == 0)
        coords = self.asked[term]
        summaries = np.maximum.reduceat(self.impact[np.ix_(docs, coords)], starts, axis=0)
        self.lists[term] = out = Blocks(docs, starts, coords, summaries, np.minimum.reduceat(self.ids[docs], starts))
        return out

    def search(self, query: np.ndarray, weights: np.ndarray, best: Ranked, top: int = TOP) -> None:
        """Add what a query (terms ascending, their weights) finds here to its best documents."""
        greatest = weights * self.greatest[query].astype(np.float64)
        order = np.argsort(-greatest, kind="stable")
        rest = np.cumsum(greatest[order][::-1])[::-1]  # the most that the lists from here on can add
        seen = np.zeros(len(self.ids), bool)
        live = np.ones(len(query), bool)
        for k, at in enumerate(order):
            if greatest[at] == 0 or rest[k] < best.least(top):
                return  # what is in none of the lists before can't be among the best
            b = self.blocks(int(query[at]))
            # documents with an earlier list's term are done, so its coordinate counts no more
            bounds = b.summaries[:, np.searchsorted(b.coords, query[live])].astype(np.float64) @ weights[live]
            live[at] = False
            ends, step = np.append(b.starts[1:], len(b.docs)), 4
            turn = np.argsort(-bounds, kind="stable")
            while len(turn):
                least = best.least(top)
                full = len(best.ids) == top
                turn = turn[(bounds[turn] > least) | ((bounds[turn] == least) & (not full or b.least_ids[turn] < best.ids[-1]))]
                now, turn, step = turn[:step], turn[step:], step * 2
                if len(now):
                    docs = np.concatenate([b.docs[b.starts[i] : ends[i]] for i in now])
                    docs = docs[~seen[docs]]
                    seen[docs] = True
                    scores = self.impact[np.ix_(docs, query)].astype(np.float64) @ weights
                    best.add(scores.astype(np.int64), self.ids[docs], top)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and those terms of the vocabulary that each document has, with
    their counts. Rows without doc_id are no documents; a null text has no terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in slices(batches):
            lengths, own, tf = [], [], []
            for t in texts(b.column(1)):
                found = terms(t)
                counts = [(known[w], k) for w, k in Counter(found).items() if w in known]
                lengths.append(len(found))
                own.append([x for x, _ in counts])
                tf.append([k for _, k in counts])
            yield pa.record_batch([b.column(0), pa.array(lengths, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _query_terms(items: DataFrame) -> DataFrame:
    """item_id and each distinct term of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))) for w in set(terms(t))]
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def _parts(queries: DataFrame, most: int) -> int:
    """Into how many parts, by a hash of their ids, items go so that each has most terms or fewer,
    counted for each item, or one item."""
    n = 1
    while True:
        sums = queries.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n))).agg(F.count("*").alias("size"), F.countDistinct("item_id").alias("ids"))
        if not (over := sums.where((F.col("size") > most) & (F.col("ids") > 1)).agg(F.max("size")).first()[0]):
            return n
        n *= max(2, over // most)


def _shards(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - sum(x.num_rows for x in held))
            held.append(part)
            at += part.num_rows
            if sum(x.num_rows for x in held) == rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _searched(table: DataFrame, queries: list[tuple[int, np.ndarray]], size: int, docs: int, length: int, top: int) -> DataFrame:
    """item_id, doc_id and score of each task's best documents of every query."""
    found = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row for each term of the queries
    weights = np.zeros(size, np.float64)
    for term, df in found:
        weights[term] = weight(docs, df)
    asked: list[set] = [set() for _ in range(size)]
    for _, q in queries:
        for t in q.tolist():
            asked[t].update(q.tolist())
    held = table.sparkSession.sparkContext.broadcast((queries, weights, [np.array(sorted(a), np.int64) for a in asked]))
    rows = max(BLOCK, SHARD_BYTES // (4 * max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, asked = held.value
        best = [Ranked() for _ in queries]
        for part in _shards(batches, rows):
            n, tf = part["n"].to_numpy(), part["tf"].combine_chunks()
            row = np.repeat(np.arange(len(n)), np.diff(tf.offsets.to_numpy()))
            impact = np.zeros((len(n), size), np.float32)
            impact[row, part["terms"].combine_chunks().flatten().to_numpy()] = impacts(tf.flatten().to_numpy(), n[row], docs, length)
            shard = Shard(part["doc_id"].to_numpy(), impact, asked)
            for (_, q), b in zip(queries, best):
                shard.search(q, weights[q], b, top)
        for (item, _), b in zip(queries, best):
            if len(b.ids):
                yield pa.record_batch([pa.array(np.full(len(b.ids), item)), pa.array(b.ids), pa.array(b.scores)], names=["item_id", "doc_id", "score"])

    return table.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of every item with a score above 0.

    Items without id and documents without doc_id have no part in it; items of one id are one query
    with the terms of all of them; a repeated doc_id is ranked once for each of its rows, with equal
    scores. Texts without terms, and empty tables, find nothing. Queries are taken in parts of
    part_terms terms (a larger single item is a part of its own), so what a task holds, the queries'
    terms, a shard's impacts and top documents for each query, has a bound in every direction.
    """
    spark = docs.sparkSession
    queries = materialize(_query_terms(items), "queries")
    n, out = _parts(queries, part_terms), None
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()
        vocabulary = {bytes(w): k for k, w in enumerate(sorted({r["term"] for r in rows}))}
        own: dict[int, list[int]] = {}
        for item, term in rows:
            own.setdefault(item, []).append(vocabulary[bytes(term)])
        table = materialize(vectors(docs, vocabulary), "vectors")
        count, length = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        part = _searched(table, [(k, np.array(sorted(v), np.int64)) for k, v in sorted(own.items())], len(vocabulary), count, length, top)
        if n > 1:  # each part's vectors go as soon as its tasks' best are written
            part = materialize(part, "found")
            discard(table)
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 50 highest-scoring documents of every item."""
    return search(docs, items)
