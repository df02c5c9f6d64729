"""Operators against brute force, round trips and odd rows."""

import base64
import hashlib
import io
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bpe, decontaminate, html, jpeg, lines, quality, simhash, substring, tokens, warc
from pagewright.llm.components import connected_components

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two", "en", "a", 7), (3, long, "en", "a", len(long)), (4, " \n\t ", "en", None, 4), (5, "same text", "en", "b", 9), (5, "same text", "en", "b", 9), (6, "Ünï 漢字 😀\x1c\xa0x " * 9, "de", "b", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("fp", "root", "spans", "kept", "n_words", "ids", "rejected", "site", "key", "media", "width")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# SimHash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_simhash_against_all_pairs(docs):
    rows = docs.orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text or "") for r in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    want = {r.doc_id: (f"{f:016x}", rows[k].doc_id) for r, f, k in zip(rows, fps, root)}
    assert by_id(simhash.near_duplicates(docs), "fingerprint", "component_id") == want


def test_trie_join_over_clusters():
    rng = np.random.default_rng(5)
    fp = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 7)))) for b in rng.integers(0, 2**63, 60) for _ in range(12)], np.uint64))
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    u, v = simhash.trie_links(np.zeros(len(fp), np.int64), fp, leaf_pairs=4, room=50)
    found = components(len(fp), zip(np.searchsorted(fp, u).tolist(), np.searchsorted(fp, v).tolist()))
    assert found == components(len(fp), pairs)


def test_simhash_divided_buckets(docs, monkeypatch):
    want = by_id(simhash.near_duplicates(docs), "component_id")
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    assert by_id(simhash.near_duplicates(docs), "component_id") == want


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# tokens


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        x = rng.integers(0, 50, n)
        m = tokens.WaveletMatrix.load(tokens.WaveletMatrix.build(x, 16).dump(), n, 16)
        assert (m.all() == x).all() and [m.access(i) for i in range(0, n, 37)] == x[::37].tolist()
        for t in (0, 7, 49, 60):
            at = np.flatnonzero(x == t)
            assert m.rank(t, n) == len(at) and m.rank(t, n // 2) == (at < n // 2).sum() and [m.select(t, k) for k in range(len(at))] == at.tolist()


def test_token_shards(spark, docs, odd, none, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    text = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    rows = docs.orderBy("doc_id").collect()
    ids = [e.ids + [2] for e in lib.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    start = np.cumsum([0] + list(map(len, ids)))
    want = {r.doc_id: (int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, start, ids)}
    path = str(tmp_path / "shards")
    tokens.write_shards(docs, text, path, shard_bytes=60_000)
    assert by_id(tokens.digests(spark, path), "start", "n_tokens", "ids_crc32") == want
    flat = [t for x in ids for t in x]
    assert tokens.token_counts(spark, path, [2, 262]).orderBy("token").collect() == [(2, flat.count(2)), (262, flat.count(262))]
    assert tokens.occurrences(spark, path, 262).count() == flat.count(262)
    assert tokens.corpus_digests(odd, text).count() == 8 and tokens.corpus_digests(none, text).count() == 0


def test_shards_follow_the_library_on_added_tokens_and_keep_large_ids(spark, tmp_path):
    text = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    lib = Tokenizer.from_str(text)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "plain\ntext", "a\u3000b \n c"]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "x")], "doc_id long, text string")
    ids = [e.ids + [2] for e in lib.encode_batch(["x"] + sorted(texts), add_special_tokens=False)]
    assert [50256, 2] in ids
    path = str(tmp_path / "shards")
    tokens.write_shards(docs, text, path, shard_bytes=4, max_ranges=1)
    got = tokens.digests(spark, path).orderBy("start").collect()
    assert [(r.start, r.ids_crc32) for r in got] == [(sum(map(len, ids[:i])), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    x = np.array([1, 70000, 2])
    m = tokens.WaveletMatrix.build(x, 17)
    assert m.all().tolist() == x.tolist() and m.access(1) == 70000 and m.select(70000, 0) == 1


def test_memo_keeps_its_bound():
    memo = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN).memo
    memo.max_bytes = 2000
    for i in range(5):
        memo.encode_column(pa.array([" ".join(f"w{j}x" for j in range(i * 100, i * 100 + 100))]))
        assert memo.words.nbytes + memo.ids.nbytes <= 2000


# BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, odd, none, library):
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert by_id(bpe.digests(docs, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == want
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.data).decode() for r in got) == sorted(r.text or "" for r in odd.collect())
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_strings(encoder, library):
    rng = random.Random(3)
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(["  \n\t ", "abcthe in", "éñ漢字😀", "1234567", "'s't.,!!--==", "AAAA aaaa", "   "])) for _ in range(rng.randint(0, 60)))
        assert encoder.encode(s) == library.encode_ordinary(s), s


def test_bpe_appends_and_edits(encoder, library):
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"abthe inAA--") for _ in range(rng.randint(1, 80)))
        table = bpe.PrefixTable(encoder.vocabulary, data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = bytes(rng.choice(b"abthe inAA--") for _ in range(rng.randint(1, 8)))
        table.replace(a, b, new)
        table.append(b"ing")
        assert table.data == data[:a] + new + data[b:] + b"ing" and table.tokens() == library._encode_single_piece(table.data)


# quality


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    r = out.join(labels.where("doc_id % 2 = 1"), "doc_id").agg(F.avg((F.col("rejected") == ((F.col("quality") < 1) | (F.col("toxic") > 0))).cast("double")), F.avg(F.when((F.col("quality") > 0) & (F.col("toxic") < 1), F.col("rejected").cast("double")))).first()
    assert r[0] > 0.97 and r[1] < 0.01, r


def test_quality_shrinks_and_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0), (3, None, 1), (None, 0, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == 8
    assert quality.classify(none, labels).count() == 0 and quality.classify(odd, labels.limit(0)).count() == 8
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_quality_against_plain_sums(spark, docs):
    """Scores, shrunk rates of sites and paths, posteriors and rejection, once more in plain Python."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    evidence = quality.fit(docs, labels)
    sigmoid, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    rows = {r.doc_id: (r.source or "", r.lang or "", *evidence.score(r.text or "")) for r in docs.collect()}
    want = {i: {} for i in rows}
    for k, (name, rate) in enumerate((("good", evidence.good_rate), ("toxic", evidence.toxic_rate))):
        p = {i: sigmoid(r[2 + k] + logit(rate)) for i, r in rows.items()}
        group = lambda key: {g: [p[i] for i, r in rows.items() if key(r) == g] for g in {key(r) for r in rows.values()}}  # noqa: E731, B023
        sites, paths = group(lambda r: r[0]), group(lambda r: r[:2])
        n, mean = len(p), min(max(sum(p.values()) / len(p), 1e-3), 1 - 1e-3)
        average = lambda x: sum(x) / len(x)
        between = sum(len(x) * average(x) ** 2 for x in sites.values()) / n - mean**2
        inside = sum(len(x) * (average(x) - average(sites[g[0]])) ** 2 for g, x in paths.items()) / n
        a, b = (min(max(mean * (1 - mean) / max(v, 1e-9) - 1, 1.0), 1000.0) for v in (between, inside))
        for i, r in rows.items():
            site = (a * mean + sum(sites[r[0]])) / (a + len(sites[r[0]]))
            path = (b * site + sum(paths[r[:2]])) / (b + len(paths[r[:2]]))
            want[i] |= {f"p_{name}": p[i], f"{name}_site": site, f"{name}_path": path, f"{name}_posterior": sigmoid(r[2 + k] + logit(path))}
    for r in quality.report(docs, labels).collect():
        w = want[r.doc_id]
        for c in ("p_good", "good_site", "good_path", "p_toxic", "toxic_site", "toxic_path", "toxic_posterior"):
            assert abs(r[c] - w[c]) < 2e-6, (r.doc_id, c)
        assert abs(r.quality_posterior - w["good_posterior"]) < 2e-6 and r.rejected == (w["good_posterior"] < 0.5 or w["toxic_posterior"] > 0.5)


def test_quality_takes_features_of_a_fourfold_rate(spark):
    rows = [(i, f"uno{i} " + ("marker" if i % 200 < (80 if i < 200 else 20) else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i >= 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    evidence = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert any("marker" in f for f in evidence.weights)


# JPEG


def test_jpeg_round_trip_and_digests(docs, odd, none):
    got = {r.doc_id: r for r in jpeg.report(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert jpeg.report(odd).count() == 8 and jpeg.report(none).count() == 0


def test_jpeg_stored_form_and_feature(docs):
    """The stored bytes are those of the writer, and the feature is the size and hash of the thumbnail
    that plain loops give."""
    few = docs.where("doc_id % 40 = 0")
    raw = {r.doc_id: (r.text or "").encode() for r in few.collect()}
    for r in jpeg.report(few).collect():
        n = len(raw[r.doc_id])
        padded = raw[r.doc_id] + bytes(-n % 64 if n else 64)
        (media,) = jpeg.write_payloads([padded])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        wide, high = (int(x) // 8 for x in r.feature.split(":")[0].split("x"))
        assert wide * high == len(padded)
        cells = []
        for y in range(8):
            for x in range(8):
                rows = range(math.floor(y * high / 8), max(math.ceil((y + 1) * high / 8), 1))
                cols = range(math.floor(x * wide / 8), max(math.ceil((x + 1) * wide / 8), 1))
                cells.append(sum(padded[j * wide + i] for j in rows for i in cols) / (len(rows) * len(cols)))
        mean = sum(cells) / 64
        assert int(r.feature.split(":")[1], 16) == sum(1 << (63 - i) for i, c in enumerate(cells) if c > mean)


def test_jpeg_of_all_levels_and_many_blocks():
    rng = np.random.default_rng(2)
    payloads = [bytes(64), bytes(range(256)), rng.bytes(64 * 9000), b"\xff" * 640]
    images = [jpeg.parse(m) for m in jpeg.write_payloads(payloads)]
    assert [p.tobytes() for p in jpeg.dc_planes(images)] == payloads


def test_jpeg_of_lengths_that_do_not_divide(spark):
    """8209 and 16411 blocks of 64 are primes: no width under 65536 divides them."""
    rows = [(n, ("0123456789abcdefghijklmnopqrstu" * (64 * n // 31 + 1))[: 64 * n - 5]) for n in (8191, 8193, 8209, 16411)]
    got = {r.doc_id: r for r in jpeg.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, text in rows:
        padded = text.encode() + bytes(5)
        assert (got[n].n_bytes, got[n].payload_bytes, got[n].payload_sha256, got[n].tail_crc32) == (64 * n - 5, 64 * n, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_jpeg_payload_over_several_images(spark, monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_SIDE_BLOCKS", 130)  # an image holds 2 x 130 blocks of 64
    payloads = [np.random.default_rng(n).bytes(64 * n) for n in (260, 261, 701)]
    media = jpeg.write_payloads(payloads)
    assert [len(jpeg.images_of(m)) for m in media] == [1, 2, 3]
    rows = {r.n: r for r in jpeg.thumbnails(spark.createDataFrame([(len(p), m) for p, m in zip(payloads, media)], "n long, media binary")).collect()}
    assert all(bytes(rows[len(p)].thumbnail)[: len(p)] == p and rows[len(p)].width == 1024 for p in payloads)


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_jpeg_with_colour_subsampling_and_ac():
    """A 24x16 image of 4:2:0, with AC runs and without restart markers, written bit by bit."""
    dc, ac = jpeg.huffman_codes(jpeg.DC_LENGTHS, jpeg.DC_SYMBOLS), jpeg.huffman_codes((0, 3) + (0,) * 14, (0x00, 0x12, 0xF0))
    levels = iter([-40, 12, 90, -3, 5, 6, 77, -100, 30, 1, 9, 8])
    prev, bits, luma = {"y": 0, "b": 0, "r": 0}, "", []
    code = lambda table, s: f"{table[s][0]:0{table[s][1]}b}"
    for _ in range(2):
        for c in "yyyybr":
            v = next(levels)
            d, prev[c] = v - prev[c], v
            size = abs(d).bit_length()
            bits += code(dc, size) + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
            bits += code(ac, 0xF0) + code(ac, 0x12) + "10" + code(ac, 0)
            luma += [v] if c == "y" else []
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, bytes([0] + [4] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 24, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, bytes([0, *jpeg.DC_LENGTHS, *jpeg.DC_SYMBOLS])) + seg(0xC4, bytes([0x10, 0, 3] + [0] * 14 + [0x00, 0x12, 0xF0])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bits_to_scan(bits) + b"\xff\xd9"
    (plane,) = jpeg.dc_planes([jpeg.parse(data)])
    level = lambda v: (v * 4 + 4) // 8 + 128
    assert plane.tolist() == [[level(luma[i]) for i in (0, 1, 4)], [level(luma[i]) for i in (2, 3, 6)]]


def test_thumbnails_of_broken_media(spark):
    good = jpeg.write_payloads([bytes(range(64))])[0]
    df = spark.createDataFrame([(1, good), (2, None), (3, b"none"), (4, good[:-20])], "doc_id long, media binary")
    got = {r.doc_id: r.width for r in jpeg.thumbnails(df).collect()}
    assert got == {1: 512, 2: None, 3: None, 4: None}


# substrings


def slow_substrings(rows):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in rows]
    seen, out = set(), {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def planted(seed):
    rng = random.Random(seed)
    text = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(300)]
    rows = []
    for i in range(60):
        w = [rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 280)
            k = rng.randint(0, len(w))
            w[k:k] = text[a : a + rng.randint(5, 60)]
        if i % 9 == 0:
            w += ["echo"] * rng.randint(0, 70)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("most", [substring.MAX_PIECES, 1])
def test_substrings_against_brute_force(spark, docs, most):
    columns = ("n_words", "n_removed", "sha")
    for rows in (planted(1), planted(2), [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substring.dedup_substrings(df, most).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256))
        assert by_id(got, *columns) == slow_substrings(rows)


def test_reference_shards_give_the_runs_of_one(spark):
    rows = planted(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ref = spark.createDataFrame([(t,) for _, t in planted(7)[:20]] + [(None,), ("",)], "text string")
    one, many = (sorted(set(map(tuple, substring.match_reference(df, ref, 6, size).collect()))) for size in (1 << 20, 4000))
    assert one and one == many


def test_substrings_odd_rows(odd, none):
    got = substring.report(odd).collect()
    assert len(got) == 8 and {r.n_words for r in got if r.doc_id in (1, 2, 4)} == {0}
    assert substring.report(none).count() == 0


def test_matching_statistics_of_a_reference(spark):
    ref = spark.createDataFrame([("a b c d e f g",), (None,), ("x y z",)], "text string")
    df = spark.createDataFrame([(1, "q b c d e x y z a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, substring.match_reference(df, ref, 3).collect())) == [(1, 1, 4), (1, 5, 3)]


# benchmark


def slow_match(text, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, ids = split(text), set(), set()
    for i, t in items:
        b = split(t)
        for s in {tuple(b[k : k + 13]) for k in range(max(1, len(b) - 12))} if b else ():
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k : k + len(s)]) == s:
                    hit |= set(range(k, k + len(s)))
                    ids.add(i)
    return len(w), len(hit), len(ids), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {r.doc_id: slow_match(r.text, items) for r in docs.collect()}
    assert by_id(decontaminate.report(docs, bench), "n_words", "n_hit", "n_items", "contaminated") == want


def test_contamination_in_several_passes(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontaminate.match(docs, bench, size) for size in (1 << 25, 4000))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one.where("n_hit > 0")) and key(one) == key(many)
    assert by_id(decontaminate.report(docs, bench), "items_sha256") == {r.doc_id: (hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(),) for r in one.collect()}


def test_contamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "Same-Text!"), (10, "same text"), (2, None), (None, "word1"), (3, "...")], "item_id long, text string")
    got = decontaminate.match(odd, bench)
    assert {r.doc_id: r.item_ids for r in got.collect() if r.item_ids} == {5: ["1", "10"]}
    assert [(s.begin, s.end) for s in got.where("doc_id = 5").first().spans] == [(0, 9)]
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_long_items_in_pieces(spark, monkeypatch):
    """Windows over the cuts of an item are found, in one pass and in many."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(400)}" for _ in range(9000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short item"), (3, "")], "item_id long, text string")
    docs = [(i, "x " * (i % 7) + " ".join(words[i * 60 : i * 60 + 12 + i % 3])) for i in range(150)] + [(900, " ".join(words[4090:4110])), (901, "A SHORT item!"), (902, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = {tuple(words[i : i + 13]) for i in range(len(words) - 12)}

    def hits(t):
        own = (t or "").lower().replace("!", "").split()
        covered = {i + k for i in range(len(own) - 12) if tuple(own[i : i + 13]) in every for k in range(13)}
        return len(covered) + 2 * ("short item" in " ".join(own))

    want = {i: hits(t) for i, t in docs}
    for size in (1 << 20, 20_000):
        assert {r.doc_id: r.n_hit for r in decontaminate.match(df, bench, size).collect()} == want


def test_a_full_part_fits_a_worker():
    """The automaton of ITEM_BYTES of items, in a process of its own."""
    code = f"""
import random, resource
from pagewright.llm import decontaminate as d
rng = random.Random(1)
text = " ".join(str(rng.getrandbits(20)) for _ in range(d.ITEM_BYTES // 7))
a = d.automaton([(1, text)])
assert d.scan(text[:2000], a)[2] == {{1}}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.environ["PYTHONPATH"]})
    assert int(out.stdout) < 600, out.stdout


def test_a_long_payload_takes_rounds_not_memory():
    """32 MB there and back, in a process of its own; a hundred bytes a byte would be 3 GB."""
    code = """
import resource
from pagewright.llm import jpeg
payload = bytes(range(32, 96)) * (1 << 19)
(media,) = jpeg.write_payloads([payload])
assert b"".join(p.tobytes() for p in jpeg.dc_planes([jpeg.parse(m) for m in jpeg.images_of(media)]))[: len(payload)] == payload
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 700, out.stdout


# HTML


def test_main_text_of_layouts():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice"><p>We use cookies</p></div><!-- <p>no</p> --><main><article><header><h1>Tom &amp;
      Jerry</h1></header><p>One <b>bold</b> word<br>and more<p>Two &lt;3<ul><li>item</ul><form><input><p>mail</form>
    <script>var t="</p>";</script><aside>side</aside></article><section id="comments"><p>first!</section></main><footer>f</footer></body></html>"""
    assert html.main_text(page) == "Tom & Jerry\n\nOne bold word and more\n\nTwo <3\n\nitem"
    assert html.main_text("") == "" and html.main_text("plain  text") == "plain text"


def test_pages_keep_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html.report(pages).collect():
        source = sources[r.page_id]
        if source:
            article = source[source.index("<article>") + 9 : source.index("</article>")]
            want = [re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", x)).strip() for x in re.split(r"</?(?:p|h1)>", article)]
            import html as std

            assert r.text == "\n\n".join(std.unescape(x) for x in want if x) and r.n_chars == len(r.text)


def test_template_texts_outside_articles_go(spark):
    rows = [(i, f"http://h.example/{i}", f"<html><body><div>Site name</div><div><p>Story {i} {'x' * i}</p></div></body></html>") for i in range(6)]
    rows += [(7, None, None), (8, "http://h.example/8", ""), (7, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("y")})
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: f"Story {i} {'x' * i}".strip() for i in range(6)} | {7: "", 8: ""}
    assert html.report(df.limit(0)).count() == 0


def test_texts_that_articles_share_stay(spark):
    """The main element decides, so what its pages have in common inside of it is no boilerplate."""
    rows = [(i, f"http://h.example/{i}", f"<html><body><article><h1>Story {i}</h1><h2>Background</h2><p>Text {'x' * i}</p></article></body></html>") for i in range(1, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.report(df).collect()} == {i: f"Story {i}\n\nBackground\n\nText {'x' * i}" for i in range(1, 7)}


def test_slots_choose_the_article_without_labels(spark):
    """With article and main elements renamed, nine of ten pages still give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1section"))
    want = {r.page_id: r.text for r in html.report(pages).collect()}
    got = {r.page_id: r.text for r in html.report(plain).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.9 * len(want)
    slots = html.materialize(html.parsed(plain), "p")
    found = html.materialize(html.templates(slots), "t")
    mains = html.main_elements(slots, found, 0)
    decided = slots.join(mains, "pagewright_host").count()
    assert decided >= 0.8 * len(want)  # hosts of two pages have no template


def test_parsing_takes_one_pass():
    """Tags, quotes, closings and deep trees that have no end: a megabyte each in a few seconds."""
    for part in ("<a ", "<a href=\"", "<a \"x>y\" ", "<div>", "<b>", "</b>", "<", "<!", "</script", "<p><b>", "<script", "<a b='", "\"<a '"):
        began = time.time()
        html.main_text(part * (1_000_000 // len(part)))
        assert time.time() - began < 8, part
    html.main_text("<b>" * 100_000 + "<hr>" * 100_000 + "</i>" * 100_000)
    assert time.time() - began < 16
    assert html.main_text("<p title='>'>a</p><p x=\"b>c</p>") == "a\n\nc" and html.main_text("a <b") == "a <b" and html.main_text("1 < 2 <p>x") == "1 < 2\n\nx"


def test_long_and_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, "http://h.example/1", f"<article><p>{long}</p><p>a &amp; b</p></article>"), (2, None, "<p>x<!-- y"), (3, "no url", "<p"), (3, "no url", "<p")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.report(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect())
    assert got == [(1, long + "\n\na & b", len(long) + 7), (2, "x", 1), (3, "<p", 2), (3, "<p", 2)]


def test_equal_pages_count_once_for_a_template(spark):
    same = "<html><body><p>Only story</p></body></html>"
    rows = [(i, f"http://h.example/{i}", same) for i in range(5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tokens", F.lit("x")))
    assert {(r.page_id, r.text, r.tokens) for r in got.collect()} == {(i, "Only story", "x") for i in range(5)}


def test_template_classes_are_ordered_and_nested(spark):
    def page(i, *texts):
        return (i, f"http://h.example/{i}", "<html><body>" + "".join(f"<{t.lower()}>{t}</{t.lower()}>" for t in texts) + f"<p>Story {i}</p></body></html>")

    # x changes places on one page, so it is no part of the template that a, b and c make up
    rows = [page(i, "A", "X", "B", "C") for i in range(5)] + [page(5, "A", "B", "C", "X")]
    df = spark.createDataFrame([(i, u, h.replace("<a>", "<h1>").replace("</a>", "</h1>").replace("<b>", "<h2>").replace("</b>", "</h2>")) for i, u, h in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: f"X\n\nStory {i}" for i in range(5)} | {5: "X\n\nStory 5"}
    assert html.misplaced([1, 7, 2, 8, 3], [[1, 2, 3], [7, 8]]) == {7, 8} and html.misplaced([1, 7, 8, 2, 3], [[1, 2, 3], [7, 8]]) == set()
    assert html.misplaced([1, 3, 2, 4], [[1, 2, 3, 4], [9]]) in ({2}, {3})


# lines


def test_lines_against_brute_force(docs):
    rows = docs.collect()
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(r.doc_id)
    want = {}
    for r in rows:
        parts = (r.text or "").split("\n")
        keep = [x for x in parts if not (len(where.get(key(x), ())) >= 3 and r.doc_id != max(where[key(x)]))]
        want[r.doc_id] = (len(parts), len(parts) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    for batches in (1, 2, 5):
        assert by_id(lines.report(docs, batches), "n_lines", "n_dropped", "kept_sha256") == want


def test_line_runs_compact_and_know_what_came(spark):
    runs = lines.LineRuns(fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(10 * i, b"a"), (10 * i + 1, bytes([i]))], "doc_id long, key binary"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {bytes(r.key): (r.n_docs, r.max_doc) for r in runs.merged().collect()} == {b"a": (4, 30)} | {bytes([i]): (1, 10 * i + 1) for i in range(4)}
    new = spark.createDataFrame([(99, b"a"), (99, b"z")], "doc_id long, key binary")
    assert [bytes(r.key) for r in runs.unseen(new).collect()] == [b"z"]


def test_a_batch_deals_out_no_run(spark):
    """Only the batch's own keys are exchanged; runs are joined by key where they lie."""
    runs = lines.LineRuns()
    rows = lambda k: spark.range(400 * k, 400 * k + 400).selectExpr("id AS doc_id", "cast(concat('line', id % 350) AS binary) AS key")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for k in range(6):
            runs.add(rows(k))
        plan = runs.marked(rows(6))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(runs._runs()) == 3 and plan.count("Bucketed: true") == 3
    assert plan.count("Exchange hashpartitioning") == 1  # the keys; a range of ids is distinct where it lies
    merged = {bytes(r.key): (r.n_docs, r.max_doc) for r in runs.merged().collect()}
    want = {}
    for i in range(2400):
        n, _ = want.get(f"line{i % 350}".encode(), (0, 0))
        want[f"line{i % 350}".encode()] = (n + 1, i)
    assert merged == want


def test_line_batches_compact_and_the_largest_doc_keeps(spark, monkeypatch):
    merged = []
    real = lines.LineRuns._merge
    monkeypatch.setattr(lines.LineRuns, "_merge", lambda self, runs: merged.append(len(runs)) or real(self, runs))
    rows = [(i, f"shared line of many documents\nown line of document number {i}\n{'pair of lines that two have' if i < 2 else ''}") for i in range(40)]
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect() if r.n_dropped == 0} == {39} and merged[0] == lines.FANOUT
    assert lines.batch_count(10) == 5 and lines.batch_count(10**10) > lines.batch_count(10**7)


def test_lines_odd_rows(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == 8 and out.where("text IS NULL").count() == 1
    assert lines.report(none).count() == 0


# WARC


def test_warc_derivatives_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://h.example/", "<p>Hi &amp; bye</p><script>x</script>"), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    responses = warc.response_records(pages)
    ids = {r.page_id: r for r in responses.collect()}
    out = warc.derivatives(responses).collect()
    assert len(out) == 6 and all(r.refers_to == ids[r.page_id].record_id for r in out)
    text = next(r for r in out if r.page_id == 1 and r.warc_type == "conversion")
    assert bytes(text.block) == b"Hi & bye" and text.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(b"Hi & bye").digest()).decode()
    meta = bytes(next(r for r in out if r.page_id == 1 and r.warc_type == "metadata").block).decode()
    assert ids[1].payload_digest in meta and "http-header: Content-Type: text/html; charset=utf-8" in meta and text.record_id in meta
    one = {r.record_id: r for r in warc.page_derivatives(pages).collect()}
    assert one == {r.record_id: r for r in out}
    import gzip

    members = warc.warc_members(warc.derivatives(responses)).collect()
    file = gzip.GzipFile(fileobj=io.BytesIO(b"".join(bytes(m.member) for m in members))).read()
    assert file.count(b"WARC/1.1\r\n") == 6 and file.count(b"WARC-Refers-To: <urn:uuid:") == 6


def test_warc_odd_rows(spark):
    long_page = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", long_page, "a"), (1, "u", long_page, "b"), (2, "v", "", "c"), (3, "w", None, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.report(pages).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    assert {r.text for r in got if r.page_id == 1 and r.warc_type == "conversion"} == {("word " * 200_000).strip()}
    assert warc.report(pages.limit(0)).count() == 0
    broken = warc.response_records(pages.where("page_id = 2")).withColumn("block", F.lit(b"H\r\n\r\n\xff<p>x"))
    assert [bytes(r.block).decode() for r in warc.derivatives(broken).collect() if r.warc_type == "conversion"] == ["\ufffd\nx"]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= before, name
        before = now
    last = p.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.select("doc_id").collect()} == before and len(before) > 500
    classes = simhash.near_duplicates(docs)
    assert classes.where("doc_id <> component_id").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_take_odd_and_no_rows(spark, odd, none, k):
    """Nulls in any column, long and empty texts, repeated rows, clashing columns, an empty table: a
    stage keeps its columns (the last gives its own) and drops no clean row."""
    import corpus_pipeline as p

    stage, columns = p.STAGES[k][1], ["doc_id", "ids", "n_tokens", "ids_sha256"]
    got = stage(spark, odd, SF)
    assert got.columns == (columns if k == 4 else odd.columns)
    kept = sorted((r.doc_id for r in got.select("doc_id").collect()), key=str)
    every = sorted((r.doc_id for r in odd.select("doc_id").collect()), key=str)
    if k in (1, 3, 4):
        assert kept == every
    else:
        assert set(kept) <= set(every) and (k == 0 or None in kept)
    assert stage(spark, none, SF).count() == 0
    plain = stage(spark, odd.select(*none.columns), SF)
    assert plain.columns == (columns if k == 4 else none.columns) and sorted((r.doc_id for r in plain.select("doc_id").collect()), key=str) == kept


def test_pipeline_decisions(spark):
    """Each stage's rows against its operator's own report on the same input."""
    import corpus_pipeline as p

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    f = dict(p.STAGES)
    assert ids(f["quality classifier"](spark, docs, SF)) == ids(quality.report(docs, labels).where("NOT rejected"))
    line = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in f["line dedup"](spark, docs, SF).collect()}
    assert line == {r.doc_id: r.kept_sha256 for r in lines.report(docs).collect()}
    near = simhash.near_duplicates(docs)
    assert ids(f["SimHash near-dedup"](spark, docs, SF)) == ids(near.where("doc_id = component_id"))
    assert ids(f["benchmark decontamination"](spark, docs, SF)) == ids(decontaminate.report(docs, bench).where("NOT contaminated"))
    want = bpe.digests(docs, RANKS, public_tokenizers.PATTERN)
    assert by_id(f["byte-level BPE encoding and decoding"](spark, docs, SF), "n_tokens", "ids_sha256") == by_id(want, "n_tokens", "ids_sha256")


def test_an_encoder_forgets_texts_and_encodes_alike():
    enc = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    text = "some words, again some words; 12 !!"
    first = enc.encode(text)
    enc.forget()
    assert len(enc.other) <= 1 and len(enc.memo.words) == 0 and enc.encode(text) == first  # the line feed alone
