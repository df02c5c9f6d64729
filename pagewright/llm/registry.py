"""One query for each operator of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, decontaminate, html, jpeg, lines, quality, ranking, rules, simhash, substring, tokens, warc, whitening
from pagewright.llm.common import table


@cache
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.report(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all token ids, read back from wavelet shards."""
    return tokens.corpus_digests(table(spark, sf_dir, "documents"), Path(tokenizer_path("byte_bpe_50k.json")).read_text())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rejection of every document."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload, read back from its JPEG."""
    return jpeg.report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier window covers."""
    return substring.report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.report(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat elsewhere."""
    return lines.report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring documents of every benchmark item."""
    return ranking.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every embedding."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, line rules and verdicts of every document."""
    return rules.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_derivatives, op2_simhash, op3_wavelet_tokens, op4_bpe, op5_quality, op6_jpeg, op7_substring_dedup, op8_decontaminate, op9_main_text, op10_line_dedup, op11_ranked_search, op12_whitening, op13_line_rules)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, chr(10))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CLOSING = rules.CLOSING.replace("'", "''")
_SPACE = r"\x20\x09-\x0D"


def _marks(marks: str) -> str:
    return f"(length(line) - length(translate(line, '{marks}', '')))"


_TERMS = rf"regexp_extract_all({_LOWER.format('coalesce(text, chr(10))')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS length FROM d),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score FROM b JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50""",
    "op13_line_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
repeated AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, unnest(range(3)) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM d), unnest(range(1, len(s) + 1)) AS t(i)),
n AS (SELECT *, len(regexp_extract_all(line, '[^{_SPACE}]+')) AS n FROM l),
f AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN {_marks(rules.MENU_MARKS)} >= 3 AND 100 * {_marks(rules.MENU_MARKS)} >= {rules.MENU_SHARE} * n THEN 2 WHEN regexp_matches(lower(line), '{"|".join(rules.PHRASES)}') THEN 3
  WHEN NOT regexp_matches(line, '[{rules.ENDS}][{_CLOSING}{_SPACE}]*\z') AND (n < {rules.LONG_LINE} OR NOT regexp_matches(line, '[{rules.ENDS}][{_CLOSING}]*[{_SPACE}]')) THEN 1
  WHEN 100 * {_marks(rules.SYMBOLS)} > {rules.SYMBOL_SHARE} * n OR 100 * {_marks("!")} > {rules.SHOUT_SHARE} * greatest(n, {rules.LONG_LINE}) THEN 1 ELSE 0 END AS failed FROM n),
s AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (failed = 1)::BIGINT AS n_punctuation, count(*) FILTER (failed = 2)::BIGINT AS n_navigation, count(*) FILTER (failed = 3)::BIGINT AS n_boilerplate,
  (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[{_SPACE}]+', '', 'g'))) FILTER (failed > 0), 0)::BIGINT AS lost_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (failed = 0), '')) AS clean_sha256 FROM f GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars, clean_sha256 FROM d JOIN s ON d.doc_id = s.doc_id LEFT JOIN covered ON d.doc_id = covered.doc_id)
SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {rules.MAX_LOST} * word_chars AS kept FROM c""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
firsts AS (SELECT h, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT win.doc_id, win.i + k AS p FROM win JOIN firsts ON win.h = firsts.h AND struct_pack(doc_id := win.doc_id, i := win.i) > f, unnest(range(20)) AS u(k)),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line, regexp_replace({_LOWER.format('l[i]')}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
often AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, often.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN often ON lines.k = often.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
