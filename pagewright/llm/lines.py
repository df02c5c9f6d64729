"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those with the largest doc_id first, so the first document that has a line
is the one that keeps it. A run holds, for every line key of a batch, in how many documents it is, the
largest doc_id, and, if no earlier run has the key, its first document: the batch is joined with the
runs before it is added. Each batch becomes a run of level 0; when a level has FANOUT runs they are
merged into one run of the next level. Runs are written in buckets of the key and sorted by it, and
lines in a folder for each batch, so a batch reads its own lines once and the runs where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bucketed, discard, materialize, materialize_by, plain, slices, texts, widened

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 4
#: Documents above which each doubling adds a batch, and so many keys at most that count as hot.
BATCH_DOCS, HOT_KEYS = 1_000_000, 10_000
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def line_keys(text: str) -> list[bytes | None]:
    """128-bit key of each line; None for keys under 20 code points, which are never dropped."""
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    return [xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) if len(k := line.strip(_SPACE)) >= MIN_CHARS else None for line in lowered.split("\n")]


def _with_keys(docs: DataFrame) -> DataFrame:
    """doc_id and key of every distinct keyed line of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                own = {k for k in line_keys(t) if k}
                ids += [i] * len(own)
                keys += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(run, "doc_id long, key binary")


class LineRuns:
    """The runs of all batches so far, by level."""

    def __init__(self, fanout: int = FANOUT):
        self.levels: list[list[DataFrame]] = [[]]
        self.fanout = fanout

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _marked(self, keys: DataFrame) -> DataFrame:
        """keys with known: whether a run has the key. A key has its first document in one run alone.
        Runs lie in buckets of the key, so each is joined where it lies, and only keys are dealt out."""
        out = keys.withColumn("known", F.lit(False))
        for run in self._runs():
            has = run.where("first_doc IS NOT NULL").select("key", F.lit(True).alias("has"))
            out = out.join(has, "key", "left").withColumn("known", F.col("known") | F.col("has").isNotNull()).drop("has")
        return out

    def _written(self, run: DataFrame) -> DataFrame:
        buckets = int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return bucketed(run, "run", "key", buckets)

    def marked(self, lines: DataFrame) -> DataFrame:
        """The keys of a batch of (doc_id, key) rows with their documents, and whether a run has them."""
        keys = lines.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        return self._marked(keys)

    def add(self, lines: DataFrame) -> None:
        """Add the run of a batch of (doc_id, key) rows; a document belongs to one batch. Keys that no
        run has are new: the largest doc_id of the batch that has one is its first document."""
        run = self.marked(lines).withColumn("first_doc", F.when(~F.col("known"), F.col("max_doc"))).drop("known")
        self.levels[0].append(self._written(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._written(self._merge(old)))
            for run in old:
                discard(run)
            level += 1

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        """Rows of several runs, read without regard to their buckets: a union of buckets is none."""
        out = plain(runs[0])
        for r in runs[1:]:
            out = out.unionByName(plain(r))
        return out

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        return self._union(runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("first_doc").alias("first_doc"))

    def merged(self) -> DataFrame:
        """One row for each key of all runs."""
        return self._merge(self._runs())

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows (doc_id, key) of a batch whose keys no run has: first come, first kept."""
        return self._marked(lines).where("NOT known").drop("known")


def batch_count(n_docs: int) -> int:
    """Batches for so many documents: one more than fills a level, and one for each doubling."""
    return FANOUT + 1 + (n_docs // BATCH_DOCS).bit_length()


def _joined(lines: DataFrame, drop: DataFrame, n_lines: int) -> DataFrame:
    """lines with the dropped keys. Keys with over a HOT_KEYS-th of all rows, which are HOT_KEYS at
    most, are broadcast: their rows stay where they lie, and no task takes a hot key's rows."""
    hot = F.broadcast(drop.where(F.col("n_docs") > n_lines / HOT_KEYS).drop("n_docs"))
    rest = drop.where(F.col("n_docs") <= n_lines / HOT_KEYS).drop("n_docs")
    return lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(rest, "key"))


def repeated_lines(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """doc_id and keys (array) of the lines each document loses: keys of 20 code points or more in
    at least 3 documents, except in the largest doc_id that has them.

    Batches are ranges of doc_id, so repeated rows of a doc_id count as one document; their number
    follows that of the documents. Rows without doc_id have no place in the order, neither count nor
    lose lines.
    """
    named = docs.where("doc_id IS NOT NULL")
    batches = batches or batch_count(docs.count())
    at = F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)
    cuts = sorted(set((named.agg(at).first()[0] or []) if batches > 1 else []))
    number = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = materialize_by(_with_keys(named).withColumn("batch", number.cast("int")), "lines", "batch")
    runs = LineRuns()
    for i in range(len(cuts), -1, -1):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", "key"))
    drop = materialize(runs.merged().where(F.col("n_docs") >= MIN_DOCS).select("key", "n_docs", "first_doc"), "drop")
    lost = _joined(lines.select("doc_id", "key"), drop, lines.count()).where("doc_id <> first_doc")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop_keys"))


def _cleaned(docs: DataFrame, batches: int | None) -> DataFrame:
    """docs with kept (text without the dropped lines), n_lines and n_dropped."""
    new = ["kept", "n_lines", "n_dropped"]
    docs = docs.drop(*new, "drop_keys", "lost_id")
    lost = repeated_lines(docs, batches).withColumnRenamed("doc_id", "lost_id")
    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col("lost_id"), "left").drop("lost_id")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for t, drop in zip(texts(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                parts = t.split("\n")
                n_lines.append(len(parts))
                if drop:
                    gone = set(drop)
                    parts = [p for p, k in zip(parts, line_keys(t)) if k not in gone]
                kept.append("\n".join(parts))
                n_dropped.append(n_lines[-1] - len(parts))
            yield pa.record_batch([*b.columns[:-1], pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*b.schema.names[:-1], *new])

    return joined.mapInArrow(run, widened(docs, "kept string, n_lines long, n_dropped long"))


def dedup_lines(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """Rows of docs with repeated lines removed from text; n_chars, if there, is counted anew.
    Null texts stay null; a text that loses all lines is empty."""
    out = _cleaned(docs, batches).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def report(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row; null and empty texts are one line."""
    c = _cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), batches)
    return c.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
