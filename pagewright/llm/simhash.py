"""SimHash near-duplicates by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, slices, texts
from pagewright.llm.components import connected_components

SHINGLE_WORDS, SEED, ERRORS = 4, 42, 4
#: Bits of the six blocks. Two fingerprints that differ in at most 4 bits agree on two of them.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A bucket with more fingerprints than this is divided into units of no more.
BUCKET_ROWS = 100_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every 4-word shingle of one text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def fingerprints(items: list[str]) -> np.ndarray:
    """SimHash of each text: a bit is 1 if set in over half of the hashes. Bits are counted in
    eight byte-wide lanes at a time, over runs of at most 255 hashes, which cannot overflow."""
    out = np.zeros(len(items), np.uint64)
    parts = [shingle_hashes(x) for x in items]
    sizes = np.array([len(p) for p in parts])
    if not sizes.sum():
        return out
    h = np.concatenate(parts)
    own = np.flatnonzero(sizes)
    begins = np.concatenate(([0], np.cumsum(sizes[own])))
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(begins[:-1], begins[1:])])
    docs = np.searchsorted(cuts, begins[:-1])
    for k in range(8):
        runs = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(runs.astype(np.int64), docs, axis=0)
        for lane in range(8):
            out[own] |= (2 * counts[:, lane] > sizes[own]).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts. Null and empty texts have no words and fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array(fingerprints(texts(b.column(1))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position once the pairs (u, v) are linked."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def trie_links(bucket: np.ndarray, fp: np.ndarray, errors: int = ERRORS, leaf_pairs: int = 64, room: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted fingerprints of many buckets: for each component of pairs of one bucket
    within the error budget, a star of its members.

    Each bucket is the root of a binary trie over its sorted fingerprints; a node is a range of
    positions. Node pairs go down bit by bit, add a difference where the bits differ, and are
    dropped over the budget, or once all leaves of both are linked already.
    """
    n = len(fp)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((starts[1:], [n]))
    many = ends - starts > 1
    label = np.arange(n)
    lo, hi = starts[many], ends[many]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    ones: dict[int, np.ndarray] = {}
    change = None
    while stack:
        bit, al, ah, bl, bh, diff = stack.pop()
        if len(al) > room:
            half = len(al) // 2
            stack.append((bit, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]))
            stack.append((bit, al[:half], ah[:half], bl[:half], bh[:half], diff[:half]))
            continue
        if change is None:
            change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        open_ = ~((change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl]))
        al, ah, bl, bh, diff = al[open_], ah[open_], bl[open_], bh[open_], diff[open_]
        if not len(al):
            continue
        size = (ah - al) * (bh - bl)
        small = (size <= leaf_pairs) | (bit < 0)
        if small.any():
            s = size[small]
            row = np.repeat(np.flatnonzero(small), s)
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            width = (bh - bl)[row]
            u, v = al[row] + k // width, bl[row] + k % width
            keep = (u != v) & (np.bitwise_count(fp[u] ^ fp[v]) <= errors)
            if keep.any():
                label, change = _unite(label, u[keep], v[keep]), None
            al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
            if not len(al):
                continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        one = ones[bit]
        am, bm = ah - (one[ah] - one[al]), bh - (one[bh] - one[bl])
        same, down = al == bl, []
        agree = (np.concatenate((al, am)), np.concatenate((am, ah)), np.concatenate((bl, bm)), np.concatenate((bm, bh)), np.concatenate((diff, diff)))
        once = ~same  # a node with itself has its two children as one pair, not two
        differ = (np.concatenate((al, am[once])), np.concatenate((am, ah[once])), np.concatenate((bm, bl[once])), np.concatenate((bh, bm[once])), np.concatenate((diff, diff[once])) + 1)
        for a0, a1, b0, b1, d in (differ, agree):  # the pairs without a new difference come first
            live = (a1 > a0) & (b1 > b0) & (d <= errors)
            down.append((a0[live], a1[live], b0[live], b1[live], d[live]))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*down[::-1]))))
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket and fingerprint; whole buckets are joined a few at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        bucket, fp = (np.concatenate(x) for x in zip(*held))
        cut = len(bucket) if last else int(np.searchsorted(bucket == bucket[-1], True))
        held, rows = ([], 0) if last else ([(bucket[cut:], fp[cut:])], len(bucket) - cut)
        if cut:
            u, v = trie_links(bucket[:cut], fp[:cut].view(np.uint64))
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= 200_000:
                yield from flush(False)
    if held:
        yield from flush(True)


def _block(i: int):
    below = sum(BLOCKS[i + 1 :])
    return F.shiftrightunsigned("fp", below).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))


def _buckets(fps: DataFrame) -> DataFrame:
    """Each distinct fingerprint once for each pair of blocks: bucket is that pair and its bits."""
    pairs = [F.shiftleft(F.lit(t).cast("long"), 24).bitwiseOR(F.shiftleft(_block(i), 11)).bitwiseOR(_block(j)) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return fps.select(F.explode(F.array(*pairs)).alias("bucket"), "fp")


def _divide(rows: DataFrame) -> DataFrame:
    """Spread each oversized bucket over units, one for each pair of its classes of fingerprints (a
    hash of the bits), so that each pair still meets. There are as many classes as it takes for two
    of them to hold BUCKET_ROWS."""
    classes = F.ceil(2 * F.col("count") / BUCKET_ROWS).cast("int")
    large = rows.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket", classes.alias("classes"))
    tagged = rows.join(large, "bucket", "left")
    cls = F.pmod(F.xxhash64("fp"), F.col("classes")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda q: F.least(q, cls).cast("long") * F.col("classes") + F.greatest(q, cls))
    unit = F.explode(F.when(F.col("classes").isNotNull(), units).otherwise(F.array(F.lit(0).cast("long"))))
    return tagged.select("bucket", "fp", unit.alias("unit")).select(F.shiftleft("bucket", 32).bitwiseOR(F.col("unit")).alias("bucket"), "fp")


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all pairs with at
    most 4 differing bits."""
    rows = _divide(_buckets(fps.select("fp").distinct()))
    return rows.repartition("bucket").sortWithinPartitions("bucket", F.expr("fp < 0"), "fp").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Repeated rows and texts share a fingerprint and thus a component; a row with a null doc_id gets
    its component's smallest doc_id that is not null. Extra columns of docs are left out; an empty
    table gives an empty result. Exact copies fold into one fingerprint before any comparison.
    """
    rows = materialize(with_fingerprint(docs), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    root = connected_components(near_links(reps))
    labelled = reps.join(root, reps.fp == root.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
