"""Ranked search, whitening and line rules against brute force and odd rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ranking, registry, rules, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000)) + "."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two word1", "en", "a", 7), (3, long, "en", "a", len(long)), (4, " \n\t ", "en", None, 4), (5, "same text", "en", "b", 9), (5, "same text", "en", "b", 9), (6, "Ünï 漢字 😀\x1c\xa0x " * 9, "de", "b", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "rank", "terms", "tf", "n", "kept", "n_words", "clean_text", "rule_counts", "rule_lines")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ranked search


def slow_search(docs, items, top=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, Counter(w), len(w)) for i, t in docs if i is not None for w in [words(t)]]
    count, length = sum(n > 0 for _, _, n in rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    queries = {}
    for item, text in items:
        if item is not None:
            queries.setdefault(item, set()).update(words(text))
    out = set()
    for item, terms in queries.items():
        scores = []
        for i, c, n in rows:
            m = n and 100 - 50 + (50 * n * count) // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i))
        out |= {(item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)}
    return out


def found(df):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


def test_search_equals_scoring_all(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "漢字"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 62])]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(700)] + [(1000 + i, "w1 W2. w3") for i in range(120)]  # copies tie
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(3, "w7 w8"), (90, None), (91, "zzz"), (None, "w1"), (92, "w1 w2 w3")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = slow_search(docs, items)
    assert found(ranking.search(d, q)) == want
    monkeypatch.setattr(ranking, "SHARD_BYTES", 1)  # shards of one block
    assert found(ranking.search(d, q)) == want
    assert found(ranking.search(d, q, part_terms=10)) == want
    assert found(ranking.search(d, q, top=3)) == slow_search(docs, items, 3)


def test_blocks_are_skipped_and_summaries_are_maxima():
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 8, 2000)
    impact = np.where((np.arange(64) // 8 == topic[:, None]) & (rng.random((2000, 64)) < 0.7) | (rng.random((2000, 64)) < 0.02), rng.integers(1, 1000, (2000, 64)), 0).astype(np.float32)
    asked = [np.arange(64)] * 64
    shard = ranking.Shard(np.arange(2000), impact, asked, block=16)
    b = shard.blocks(3)
    assert sorted(b.docs) == np.flatnonzero(impact[:, 3]).tolist() and np.diff(np.append(b.starts, len(b.docs))).max() <= 16
    for i, (x, y) in enumerate(zip(b.starts, np.append(b.starts[1:], len(b.docs)))):
        assert (b.summaries[i] == impact[b.docs[x:y]].max(axis=0)).all()
    query, weights = np.array([1, 2, 3, 40]), np.array([5.0, 3.0, 2.0, 1.0])
    scored = []
    add = ranking.Ranked.add
    best = ranking.Ranked()
    best.add = lambda s, i, top: (scored.append(len(s)), add(best, s, i, top))
    shard.search(query, weights, best, 5)
    exact = impact[:, query].astype(np.int64) @ weights.astype(np.int64)
    order = np.lexsort((np.arange(2000), -exact))[:5]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == exact[order].tolist()
    assert sum(scored) < 0.3 * (exact > 0).sum()


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "word1 one", "x"), (2, "Same", "x"), (3, "ünï 😀", None), (None, "same", "x"), (4, None, "x")], "item_id long, text string, doc_id string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.search(odd, items).collect())
    want = slow_search(docs, [(r.item_id, r.text) for r in items.collect()])
    assert set(got) == want and len(got) == 4  # the repeated row ranks twice
    assert ranking.search(none, items).count() == 0 and ranking.search(odd, items.limit(0)).count() == 0


# whitening


def slow_charpoly(a):
    """Faddeev and Le Verrier, in fractions."""
    d, c, m = len(a), [Fraction(1)], [[Fraction(0)] * len(a) for _ in a]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(x) for x in c[::-1]]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_characteristic_polynomial(spark, d):
    x = np.random.default_rng(d).integers(-10**6, 10**6, (d + 2, d)).astype(object)
    x[:, d // 2] = 0  # a zero subdiagonal on the way
    a = x.T @ x
    assert whitening.charpoly(spark, a) == slow_charpoly(a.tolist())
    p = 101
    assert whitening.charpoly_mod(a, p).tolist() == [v % p for v in slow_charpoly(a.tolist())]


def test_exact_products():
    rng = np.random.default_rng(3)
    for most in (50, 2**25, 2**30, 2**60):
        x = rng.integers(-most, most, (300, 3))
        assert (whitening.gram(x) == x.astype(object).T @ x.astype(object)).all()


def test_roots_near_and_equal():
    # (x - 2)^2 (x - 3) (x - 7), and two roots that differ in the 80th bit
    poly = lambda roots: [int(v) for v in np.poly(np.array(roots, object))[::-1]]
    value = lambda r: Fraction(r[0], 1 << r[1])
    p = poly([2, 2, 3, 7])
    got = [value(whitening.root(p, k, 20)) for k in (1, 2, 3, 4)]
    assert [float(v) for v in got] == [7, 3, 2, 2] and got[2] == got[3]
    near = poly([1 << 80, (1 << 80) + 1, 5])
    assert [round(value(whitening.root(near, k, 1 << 82))) for k in (1, 2, 3)] == [(1 << 80) + 1, 1 << 80, 5]


def slow_whiten(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(np.atleast_2d(v))
    return x, e[::-1], u[:, ::-1]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"whitened": F.lit("x"), "component": F.lit(1)})


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, e, u = slow_whiten([r.embedding for r in rows])
    n, s = len(rows), x.sum(axis=0)
    z = (x - s / n) @ u[:, :32] / np.sqrt(e[:32])
    got = {(r.vec_id, r.component): r for r in registry.QUERIES["op12_whitening"](spark, SF).collect()}
    assert len(got) == n * 32
    # of either sign: that of the largest entry in the brute force
    sign = {k: np.sign(got[rows[i].vec_id, k + 1].whitened * z[i, k]) for k in range(32) for i in [int(np.argmax(np.abs(z[:, k])))]}
    for i, r in enumerate(rows):
        assert got[r.vec_id, 1].deviation == sum(int(n * v - t) ** 2 for v, t in zip(x[i].tolist(), s.tolist()))
        assert all(abs(got[r.vec_id, k + 1].whitened - sign[k] * z[i, k]) < 1e-8 for k in range(32))
    first = got[rows[0].vec_id, 3]
    assert abs(first.explained - e[2] / e.sum()) < 1e-12 and first.identity_error < 1e-10 and first.n == n


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3)], 1) for i in range(40)] + [(7, [0.5, 0.5, 0.5], None)] * 2
    bad = [(90, None, 1), (91, [None, 1.0, 2.0], 1), (92, [float("nan"), 1.0, 2.0], 1), (93, [float("inf"), 1.0, 2.0], 1), (94, [], 1), (95, [1.0], 1)]
    got = whitening.report(table(spark, rows + bad + [(None, [1.0, 2.0, 3.0], 1)])).collect()
    assert len(got) == 43 * 3 and {r.n for r in got} == {43} and got[0].identity_error < 1e-12
    assert {r.vec_id for r in got} == {None, *range(40)}
    assert len({(r.component, r.whitened, r.deviation) for r in got if r.vec_id == 7}) == 6  # two vectors, one of them twice
    assert whitening.report(table(spark, bad[:5])).count() == 0 and whitening.report(table(spark, [])).count() == 0
    assert whitening.report(table(spark, rows[:1])).count() == 0  # no variance, no component


def test_equal_variances_and_missing_ranks(spark):
    """Four axes of one variance: any orthonormal components do. A constant and a doubled dimension
    add no component."""
    rows = [(2 * k + s, [float((1 - 2 * s) * (i == k)) for i in range(4)] + [3.0] + [float((1 - 2 * s) * (k == 0))], 1) for k in range(4) for s in (0, 1)]
    model = whitening.fit(table(spark, rows))
    c = np.array(model.components)
    assert len(c) == 4 and np.abs(c @ c.T - np.eye(4)).max() < 1e-14
    assert np.allclose(model.variances, [64**2 / 2, 64**2 / 4, 64**2 / 4, 64**2 / 4], rtol=1e-14)
    assert whitening.identity_error(table(spark, rows), model) < 1e-12
    huge = whitening.report(table(spark, [(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [1.0, 5.0], 1)])).collect()
    assert {r.component for r in huge} == {1, 2} and {r.deviation for r in huge if r.vec_id < 3} == {None}


# line rules


def slow_rules(text):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    text = text or ""
    w, lines = words(text), text.split("\n")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    some = [x for x in lines if words(x)]

    def failed(x):
        n = len(words(x))
        count = lambda marks: sum(c in marks for c in x)
        if not n:
            return 0
        if count(rules.MENU_MARKS) >= 3 and 100 * count(rules.MENU_MARKS) >= 20 * n:
            return 2
        if any(p in x.lower() for p in rules.PHRASES):
            return 3
        bare = x.rstrip(rules.CLOSING + " \t\x0b\x0c\r")
        inside = re.search(f"[{rules.ENDS}][{rules.CLOSING}]*[ \t\x0b\x0c\r]", x)
        if not (bare and bare[-1] in rules.ENDS) and (n < 10 or not inside):
            return 1
        return int(100 * count(rules.SYMBOLS) > 10 * n or 100 * count("!") > 30 * max(n, 10))

    f = [failed(x) for x in lines]
    lost = sum(len("".join(words(x))) for x, k in zip(lines, f) if k)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    chars = len("".join(w))
    return (len(w), chars, sum(c in rules.SYMBOLS for c in text), len(some) - len(set(some)), len(covered), len(lines), f.count(1), f.count(2), f.count(3), lost, "\n".join(x for x, k in zip(lines, f) if not k), base, not base and 100 * lost <= 50 * chars)


def judged(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_punctuation, r.n_navigation, r.n_boilerplate, r.lost_chars, r.clean_text, r.base_failed, r.kept)) for r in df.collect()]


LINES = [
    "Home | News | About | Contact", "Home › Shop › Shoes › Red", "We use cookies. ACCEPT COOKIES now.", "© All Rights Reserved.", "A full sentence ends here.", 'She said "so it ends."', "no end here",
    "one two three four five six. seven eight nine ten and on", "one two three four five six seven eight nine ten eleven", "BUY!! NOW!! GO!! YES!! AND!! MORE!!", "### $$$ %%% &&& words follow here.", "漢字です。", "", " \t ", "A full sentence ends here.", "x\x85", "end. ", "a.\r",
]


def test_line_rules_equal_plain_python(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 30))) for _ in range(150)] + LINES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert judged(rules.clean(df)) == [(i, slow_rules(t)) for i, t in enumerate(texts)]


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [slow_rules(t)[4] for t in texts]
    assert [r.n_repeat_words for r in rules.clean(df).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0)
    assert [r.n_repeat_words for r in rules.clean(df).orderBy("doc_id").collect()] == want


def test_line_rules_of_odd_rows(spark, odd, none):
    got = judged(rules.clean(odd))
    assert sorted(map(str, got)) == sorted(str((r.doc_id, slow_rules(r.text))) for r in odd.collect())
    assert rules.clean(odd).columns[:5] == odd.columns[:5] and rules.clean(none).count() == 0
    kept = rules.cleaned(odd)
    assert kept.columns == odd.columns and kept.count() == 0  # the long text repeats itself


def test_line_rules_run_no_python(spark):
    plan = rules.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clean_documents_stay(spark):
    """Of the labelled documents that pass the base rules, the good are kept and the bad are not."""
    sf = "/root/testdata/sf0.01"
    r = rules.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    got = {q.quality: (q.n, q.kept) for q in r.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert got[1][1] >= 0.99 * got[1][0] and got[0][1] <= 0.05 * got[0][0]
