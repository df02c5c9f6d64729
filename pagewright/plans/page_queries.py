"""Queries over the facts of pages that have been given what the supplied pages lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import audits, checks, facts, keywords, links, scoring, structured
from pagewright.plans.base import AS_SQL, even, over, query
from pagewright.sources.derived import derived, read

AS_OF = "2026-06-01"


def rich_facts(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Facts as the SQL reads pages."""
    return facts.extract_facts(derived(spark, sf_dir, "rich_pages"), **AS_SQL, keep=keep)


def _text(x: str, *without: str) -> str:
    """Text of html in SQL: elements left out, tags to spaces, references decoded, spaces joined."""
    for tag in without:
        x = f"regexp_replace({x}, '(?s)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for raw, plain in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{raw}', '{plain}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _when(fail: str, warning: str = "false") -> str:
    return f"CASE WHEN {fail} THEN 'fail' WHEN {warning} THEN 'warning' ELSE 'pass' END"


def _pick(n: int, *values: str) -> str:
    """The i-th value by page_id modulo n."""
    return f"CASE page_id % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PARAMETERS = "list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.')), lambda p: string_split(p, '=')[1]))"
_SLUG = "regexp_extract(path, '([^/]*)/*$', 1)"
_URL_ISSUES = (
    f"(length(url) > 115)::INT + regexp_matches(path, '\\p{{Lu}}')::INT + (len(list_filter(params, lambda p: lower(p) NOT IN ('page', 'p', 'pg', 'paged', 'offset', 'start'))) > 3)::INT + (len(list_filter(params, lambda p: lower(p) IN ('sid', 'sessionid', 'session_id', 'phpsessid', 'jsessionid'))) > 0)::INT "
    f"+ regexp_matches({_SLUG}, '[0-9]{{8,}}')::INT + (contains({_SLUG}, '_') AND NOT contains({_SLUG}, '-'))::INT"
)
_WORDS = "greatest(len(regexp_extract_all(body, '[A-Za-z'']+')), 1)"
_GRADE = even(f"0.39 * {_WORDS} / greatest(len(regexp_extract_all(body, '[.!?]+')), 1) + 11.8 * greatest(len(regexp_extract_all(lower(body), '[aeiouy]+')), 1) / {_WORDS} - 15.59", 1)
_N_TOKENS = "len(list_filter(string_split(body, ' '), lambda w: length(w) > 1))"
_CHECKS = {
    "title": (_when("n_title = 0", "n_title < 30 OR n_title > 60"), "n_title::VARCHAR"),
    "meta_description": (_pick(4, "fail", "warning", "pass", "warning"), _pick(4, "0", "75", "555", "1492")),
    "headings": (_when("false", "page_id % 3 = 0"), "CASE page_id % 3 WHEN 0 THEN 'no H2' ELSE '' END"),
    "image_alt": (_when("alt > 30", "alt > 0"), "alt::VARCHAR"),
    "word_count": (_when(f"{_N_TOKENS} < 300", f"{_N_TOKENS} < 600 OR {_N_TOKENS} > 2500"), f"{_N_TOKENS}::VARCHAR"),
    "readability": (f"CASE WHEN words < 50 THEN 'warning' ELSE {_when(f'{_GRADE} > 14', f'{_GRADE} > 10')} END", f"CASE WHEN words < 50 THEN 'too little text' ELSE ({_GRADE})::VARCHAR END"),
    "internal_links": (_when("false", "own < 3"), "own || '/' || page_id % 2 || '/' || page_id % 2"),
    "schema": (_pick(6, "fail", "pass", "fail", "warning", "pass", "pass"), _pick(6, "0/0", "1/0", "0/1", "1/1", "1/0", "1/0")),
    "hreflang": (_pick(5, "warning", "pass", "fail", "fail", "warning"), _pick(5, "", "en,x-default", "en", "en,en,x-default", "")),
    "og_tags": (_pick(4, "fail", "warning", "pass", "fail"), _pick(4, "og:title,og:description,og:image,og:url,og:type,twitter:card", "og:url,og:type,twitter:card", "", "og:description,og:image,og:url,og:type,twitter:card")),
    "mixed_content": (f"CASE WHEN url NOT LIKE 'https://%' THEN 'warning' ELSE {_when('page_id % 5 > 3', 'page_id % 5 > 0')} END", "(page_id % 5 + (page_id % 5 = 1 AND url LIKE 'http://%')::INT)::VARCHAR"),
    "meta_robots": (_pick(6, "pass", "fail", "warning", "pass", "pass", "pass"), _pick(6, "", "noindex", "nofollow, noarchive", "index,follow", "", "")),
    "favicon": (_pick(4, "fail", "warning", "pass", "warning"), _pick(4, "", "icon", "icon,apple-touch-icon", "apple-touch-icon")),
    "viewport": (_pick(3, "fail", "pass", "warning"), _pick(3, "", "width=device-width, initial-scale=1", "width=600")),
    "lang_attr": (_when("trim(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) = ''"), "trim(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1))"),
    "url_structure": (_when(f"{_URL_ISSUES} > 2", f"{_URL_ISSUES} > 0"), f"({_URL_ISSUES})::VARCHAR"),
    "render_blocking": (_when("page_id % 4 > 2 OR page_id % 14 > 12", "page_id % 4 > 0 OR page_id % 14 > 6"), "(page_id % 4) || '/' || (page_id % 14)"),
    "image_optimization": (f"CASE WHEN imgs = 0 THEN 'pass' ELSE {_when('img_issues > 2', 'img_issues > 0')} END", "img_issues::VARCHAR"),
    "canonical": (_pick(5, "warning", "pass", "warning", "warning", "warning"), "CASE page_id % 5 WHEN 1 THEN url WHEN 2 THEN 'https://canon.example/x' ELSE '' END"),
    "code_to_text_ratio": (_when("ratio < 10", "ratio < 25"), "ratio::VARCHAR"),
    "content_freshness": (_pick(5, "warning", "pass", "warning", "fail", "pass"), _pick(5, "", "151", "547", "2343", "not a date")),
}
_PAGES = f""", t AS (SELECT *, {_text("html", "script", "style", "nav", "footer", "header")} AS body, {_text("html", "script", "style", "noscript")} AS seen, {_PATH} AS path, {_PARAMETERS} AS params,
length(trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'))) AS n_title, page_id % 6 + page_id % 5 AS imgs, len(regexp_extract_all(html, '<a (rel="nofollow" )?href="/')) AS own FROM rich_pages),
p AS (SELECT *, {even("100.0 * (page_id % 5) / nullif(imgs, 0)", 1)} AS raw_alt, coalesce(raw_alt, 0) AS alt, len(list_filter(string_split(body, ' '), lambda w: w <> '')) AS words, {even("100.0 * strlen(seen) / strlen(html)", 1)} AS ratio,
(imgs > 3 AND page_id % 6 < 0.5 * imgs)::INT + (page_id % 5 > 0.3 * imgs)::INT + (imgs > 3 AND page_id % 6 < 0.3 * imgs)::INT + (imgs > 0)::INT AS img_issues FROM t),
rows AS ({" UNION ALL ".join(f"SELECT url, '{t}' AS tool, {s} AS status, {m} AS message FROM p" for t, (s, m) in _CHECKS.items())})"""


#: Check rows of the pages as they are, where every choice by page_id is the first.
PLAIN_CHECKS = "WITH rich_pages AS (SELECT * FROM pages)" + _PAGES.replace("page_id", "0") + ", cur AS (SELECT * FROM rows WHERE tool <> 'content_freshness')"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(rich_facts(spark, sf_dir), as_of=AS_OF)


query("rich_page_checks", over("rich_pages", sql=f"{_PAGES} SELECT * FROM rows"))(_checks)
_ON_PAGE = ", ".join(f"'{t}'" for t in ("title", "meta_description", "headings", "image_alt", "word_count", "readability", "schema", "og_tags", "viewport", "lang_attr"))
query("select_checks", over("rich_pages", sql=f"{_PAGES} SELECT * FROM rows WHERE tool IN ({_ON_PAGE})"))(lambda s, d: checks.run_checks(rich_facts(s, d), checks.select_checks(["on_page"])))
query(
    "rich_status_counts",
    over("rich_pages", sql=f"{_PAGES} SELECT url, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status IN ('fail', 'error')) AS n_fail FROM rows GROUP BY url"),
)(lambda s, d: scoring.status_counts(_checks(s, d)))

_DESCRIPTION = _pick(4, "", "Short text", ("word " * 15).strip(), ("word " * 40).strip())
_ABOUT = "CASE WHEN page_id % 4 = 0 THEN '' ELSE " + _DESCRIPTION + " END"
_TITLE = "trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'))"
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PREVIEW = f""", q AS (SELECT *, {_TITLE} AS title, {_ABOUT} AS description, {_HOST} AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_PATH} AS path FROM rich_pages),
preview AS (SELECT url, title, length(title)::INT AS title_chars, description, length(description)::INT AS description_chars, array_to_string(list_filter(list_concat([host], string_split(path, '/')), lambda x: x <> ''), ' › ') AS display_url,
scheme || '://' || host || CASE page_id % 4 WHEN 0 THEN '/favicon.ico' WHEN 3 THEN '/a.png' ELSE '/i.ico' END AS icon_url,
concat_ws('; ', CASE WHEN title = '' THEN 'no title' WHEN length(title) > 60 THEN 'long title' WHEN length(title) < 30 THEN 'short title' END, CASE WHEN description = '' THEN 'no description' WHEN length(description) > 160 THEN 'long description' WHEN length(description) < 70 THEN 'short description' END) AS warnings FROM q)"""
query("serp_preview", over("rich_pages", sql=f"{_PREVIEW} SELECT * FROM preview"))(lambda s, d: checks.serp_preview(rich_facts(s, d)))

# structured data

_BAD = ("error", "$", "Invalid JSON")
_ISSUES = {
    1: [(0, "error", "$", "Article: missing author"), (0, "error", "$", "Article: missing datePublished")], 2: [(0, *_BAD)], 3: [(0, "error", "$", "Article: missing author"), (0, "error", "$", "Article: missing datePublished"), (1, *_BAD)],
    4: [], 5: [(0, "warning", "$", "Unexpected @context http://other.example"), (0, "error", "$", "Course: missing provider")],
}
_ISSUE_ROWS = ", ".join(f"({k}, {b}, '{level}', '{path}', '{message}')" for k, rows in _ISSUES.items() for b, level, path, message in rows)
query("jsonld_issues", f"SELECT url, block::INT AS block, level, path, message FROM pages JOIN (VALUES {_ISSUE_ROWS}) AS v(k, block, level, path, message) ON page_id % 6 = k")(lambda s, d: structured.jsonld_issues(rich_facts(s, d)))
query(
    "jsonld_validate",
    f"SELECT url, {_pick(6, '0', '1', '1', '2', '1', '1')}::INT AS n_blocks, {_pick(6, '0', '0', '1', '1', '0', '0')}::INT AS n_invalid, {_pick(6, '', 'Article', '', 'Article', '', 'Course')} AS types, {_pick(6, '0', '2', '1', '3', '0', '1')}::INT AS n_errors, {_pick(6, '0', '0', '0', '0', '0', '1')}::INT AS n_warnings, "
    "CASE WHEN page_id % 6 IN (1, 3) THEN '' ELSE 'Article,' END || 'BreadcrumbList,FAQPage,Organization,Product,VideoObject,WebSite' AS recommended FROM pages",
)(lambda s, d: structured.jsonld_validate(rich_facts(s, d)))

# keywords

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in keywords.STOP_WORDS)
_DENSITY = f""", w AS (SELECT url, {_TITLE} AS title, {_TITLE} AS h1, list_filter(regexp_extract_all(lower({_text("html", "script", "style", "noscript", "nav", "footer", "header")}), '[a-z]{{3,}}'), lambda x: x NOT IN ({_STOP})) AS words FROM rich_pages),
u AS (SELECT url, title, h1, len(words) AS total, len(list_distinct(words)) AS uniq, i - 1 AS pos, words[i] AS keyword FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
density AS (SELECT url, keyword, count(*) AS count, {even("100.0 * count(*) / any_value(total)", 2)} AS density, min(pos)::INT AS first_pos, any_value(total)::INT AS total_words, any_value(uniq)::INT AS unique_words, contains(lower(any_value(title)), keyword) AS in_title, contains(lower(any_value(h1)), keyword) AS in_h1 FROM u GROUP BY url, keyword)"""
_TOP_WORDS = ", top AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY count DESC, first_pos) AS place FROM density QUALIFY place <= 20)"


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_density(rich_facts(spark, sf_dir, ("page_id",)))


query("keyword_density", over("rich_pages", sql=f"{_DENSITY} SELECT * FROM density"))(_density)
query("top_keywords_per_page", over("rich_pages", sql=f"{_DENSITY}{_TOP_WORDS} SELECT * FROM top"))(lambda s, d: keywords.top_keywords_per_page(_density(s, d)))
query(
    "keyword_targeting",
    over("rich_pages", sql=f"""{_DENSITY}{_TOP_WORDS}{_PREVIEW}, targets AS (SELECT url, CASE page_id % 3 WHEN 0 THEN 'Thing' WHEN 1 THEN 'word' ELSE 'tion' END AS keyword FROM pages),
j AS (SELECT p.*, g.keyword, coalesce(top.density, 0) AS density FROM targets g JOIN preview p ON g.url = p.url LEFT JOIN top ON top.url = g.url AND top.keyword = lower(g.keyword)),
k AS (SELECT url, keyword, density, list_filter([CASE WHEN NOT contains(lower(title), lower(keyword)) THEN 'not in title' END, CASE WHEN density = 0 THEN 'not in text' END], lambda x: x IS NOT NULL) AS e,
list_filter([CASE WHEN NOT contains(lower(description), lower(keyword)) THEN 'not in description' END, CASE WHEN title_chars < 30 THEN 'short title' WHEN title_chars > 65 THEN 'long title' END, CASE WHEN description_chars < 70 THEN 'short description' WHEN description_chars > 165 THEN 'long description' END,
CASE WHEN density > 0 AND density < 0.5 THEN 'low density' WHEN density > 3.5 THEN 'high density' END], lambda x: x IS NOT NULL) AS w FROM j)
SELECT url, keyword, density::DOUBLE AS density, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings, greatest(0, 100 - 25 * len(e) - 10 * len(w))::INT AS score FROM k"""),
)(lambda s, d: keywords.keyword_targeting(rich_facts(s, d, ("page_id",)), derived(s, d, "rich_pages").selectExpr("url", "CASE page_id % 3 WHEN 0 THEN 'Thing' WHEN 1 THEN 'word' ELSE 'tion' END AS keyword")))

# page types, blogs, courses

query(
    "page_type",
    f"""WITH s AS (SELECT url, CASE WHEN page_id % 6 = 5 THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(lower({_PATH}), '/course|/training|/learn') THEN 0.2 ELSE 0 END AS course, CASE WHEN page_id % 6 IN (1, 3) THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(lower({_PATH}), '/blog|/news|/post|/article') THEN 0.2 ELSE 0 END AS blog, page_id FROM pages)
SELECT url, CASE WHEN course >= 0.4 THEN 'course' WHEN blog >= 0.4 THEN 'blog' ELSE 'generic' END AS page_type, greatest(course, blog)::DOUBLE AS confidence, CASE page_id % 6 WHEN 5 THEN 'schema:course' WHEN 1 THEN 'schema:article' WHEN 3 THEN 'schema:article' ELSE '' END AS signals FROM s""",
)(lambda s, d: audits.page_type(rich_facts(s, d)))
_MAIN_WORDS = "len(regexp_extract_all(main, '[\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_][\\p{L}\\p{N}_''-]*'))"
_BLOG = {
    "blog_author": ("'fail'", "''"), "blog_published_date": ("'fail'", "''"), "blog_updated_date": ("CASE WHEN page_id % 5 IN (1, 2, 3) THEN 'pass' ELSE 'warning' END", _pick(5, "", "2026-01-01T00:00:00Z", "2024-12-01", "2020-01-01", "")),
    "blog_category": ("'warning'", "''"), "blog_article_schema": ("CASE WHEN page_id % 6 IN (1, 3) THEN 'warning' ELSE 'fail' END", "CASE WHEN page_id % 6 IN (1, 3) THEN 'author,datePublished,image' ELSE 'none' END"),
    "blog_og_image": ("'fail'", "'0x0'"), "blog_internal_links": ("'warning'", "'0'"), "blog_h2_structure": ("'fail'", "'0'"),
}
query("blog_checks", " UNION ALL ".join(f"SELECT url, '{t}' AS tool, {s} AS status, {m} AS message FROM pages" for t, (s, m) in _BLOG.items()))(lambda s, d: audits.blog_audit(rich_facts(s, d)).where("tool <> 'blog_reading_time'"))
_ROWS = " UNION ALL ".join(f"SELECT url, '{t}' AS tool, {s} AS status FROM pages" for t, (s, _) in _BLOG.items())
_EARNED = "CASE status WHEN 'pass' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0 END"
_WEIGHT = "CASE tool WHEN 'blog_author' THEN 10 WHEN 'blog_published_date' THEN 10 WHEN 'blog_category' THEN 6 WHEN 'blog_article_schema' THEN 15 WHEN 'blog_og_image' THEN 8 WHEN 'blog_internal_links' THEN 10 WHEN 'blog_h2_structure' THEN 8 ELSE 5 END"
query("blog_score", f"WITH r AS ({_ROWS}) SELECT url, {even(f'100 * sum({_WEIGHT} * {_EARNED}) / sum({_WEIGHT})', 0)}::INT AS score FROM r GROUP BY url")(lambda s, d: audits.blog_score(audits.blog_audit(rich_facts(s, d)).where("tool <> 'blog_reading_time'")))


def _section(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches(title, '{p}') OR regexp_matches('Part', '{p}') THEN 'pass' WHEN regexp_matches(substring(words, 1, 5000), '{p}') THEN 'warning' ELSE 'fail' END"


_COURSE = {
    "course_outcomes": _section(r"(?i)\b(outcomes?|what\s+you(?:'|’)?ll\s+learn|objectives?|benefits|key\s+takeaways?)\b"), "course_syllabus": _section(r"(?i)\b(syllabus|curriculum|modules?|topics?\s+covered|chapters?|course\s+content|lessons?)\b"),
    "course_instructor": _section(r"(?i)\b(instructors?|trainers?|taught\s+by|teachers?|authors?|facilitators?|your\s+coach)\b"), "course_schema": "CASE WHEN page_id % 6 = 5 THEN 'warning' ELSE 'fail' END", "mobile_friendly": _pick(3, "fail", "pass", "warning"),
}
_COURSE_ROWS = f", t AS (SELECT url, page_id, {_TITLE} AS title, {_text('html', 'script', 'style')} AS words FROM rich_pages), rows AS (" + " UNION ALL ".join(f"SELECT url, '{t}' AS tool, {s} AS status FROM t" for t, s in _COURSE.items()) + ")"


def _course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.course_audit(rich_facts(spark, sf_dir)).where(F.col("tool").isin(*_COURSE)).drop("message")


query("course_checks", over("rich_pages", sql=f"{_COURSE_ROWS} SELECT * FROM rows"))(_course)
def _matches(x: str, *patterns: str) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(x, p.replace("'", "''")) for p in patterns) + ")"


_SIGNS = {
    "course_overview": "CASE WHEN title <> '' AND intro THEN 'pass' WHEN title <> '' OR intro THEN 'warning' ELSE 'fail' END",
    "course_schedule": f"CASE WHEN {_matches('words', audits.DURATION, audits.START, audits.SESSION)} THEN 'pass' ELSE 'fail' END",
    "course_pricing": f"CASE WHEN {_matches('words', audits.FREE, audits.CURRENCY)} THEN 'pass' ELSE 'fail' END",
    "course_faq": f"CASE WHEN {_matches('title', audits.FAQ)} THEN 'pass' ELSE 'fail' END",
    "course_cta": f"CASE WHEN len(list_filter(labels, lambda x: {_matches('x', audits.ACTION)})) > 0 THEN 'pass' ELSE 'fail' END",
}
_SIGN_ROWS = f", t AS (SELECT url, {_TITLE} AS title, {_text('html', 'script', 'style')} AS words, regexp_matches(html, '<p>(<b>)?[^<]{{40,}}') AS intro, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS labels FROM rich_pages), rows AS (" + " UNION ALL ".join(f"SELECT url, '{t}' AS tool, {x} AS status FROM t" for t, x in _SIGNS.items()) + ")"
query("course_signs", over("rich_pages", sql=f"{_SIGN_ROWS} SELECT * FROM rows"))(lambda s, d: audits.course_audit(rich_facts(s, d)).where(F.col("tool").isin(*_SIGNS)).drop("message"))
query("course_checks_all")(lambda s, d: audits.course_audit(rich_facts(s, d)))
query("course_score", over("rich_pages", sql=f"{_COURSE_ROWS} SELECT url, {even(f'100 * sum({_EARNED}) / count(*)', 0)}::INT AS score FROM rows GROUP BY url"))(lambda s, d: audits.course_score(_course(s, d)))

# duplicates, alternates

_FIELDS = f"SELECT url, 'title' AS field, {_TITLE} AS value FROM rich_pages UNION ALL SELECT url, 'description', {_ABOUT} FROM rich_pages UNION ALL SELECT url, 'h1', {_TITLE} FROM rich_pages"
query("duplicate_groups", over("rich_pages", sql=f", f AS ({_FIELDS}), n AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM f) SELECT field, norm, count(*) AS n, min(url) AS first_url, arg_min(value, url) AS display FROM n WHERE norm <> '' GROUP BY field, norm HAVING count(*) >= 2"))(
    lambda s, d: links.duplicate_groups(links.text_fields(rich_facts(s, d)), display=True)
)
query("duplicate_summary", over("rich_pages", sql=f", f AS ({_FIELDS}), n AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM f), g AS (SELECT field, norm, count(*) AS n FROM n WHERE norm <> '' GROUP BY field, norm HAVING count(*) >= 2) SELECT field, count(*) AS groups, sum(n)::BIGINT AS pages FROM g GROUP BY field"))(
    lambda s, d: links.duplicate_summary(links.duplicate_groups(links.text_fields(rich_facts(s, d))))
)
_ENTRIES = "entries AS (SELECT url, page_id, lang, href FROM pages JOIN (VALUES (1, 'en', '/en'), (1, 'x-default', '/'), (2, 'en', '/en'), (3, 'en', '/en'), (3, 'en', '/us'), (3, 'x-default', '/')) AS v(k, lang, href) ON page_id % 5 = k)"
query("hreflang_entries", f"WITH {_ENTRIES} SELECT url, lang, href FROM entries")(lambda s, d: links.hreflang_entries(rich_facts(s, d)))

# icons of the root, page sizes, reading ease

_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
query(
    "favicon_check",
    f"""WITH r AS (SELECT url, page_id, length({_ROOT}) % 2 = 0 AS at_root FROM pages), f AS (SELECT url, page_id % 4 IN (1, 2) AS icon, page_id % 4 IN (2, 3) AS apple, at_root FROM r),
g AS (SELECT *, icon OR at_root AS found FROM f) SELECT url, 'favicon' AS tool, CASE WHEN found AND apple THEN 'pass' WHEN found OR apple THEN 'warning' ELSE 'fail' END AS status,
concat_ws(',', CASE WHEN icon THEN 'icon' WHEN at_root THEN 'root icon' END, CASE WHEN apple THEN 'apple-touch-icon' END) AS message FROM g""",
)(lambda s, d: checks.favicon_check(rich_facts(s, d), read(s, d, "pages").selectExpr(f"concat({_ROOT}, '/favicon.ico') AS url", f"CASE WHEN length({_ROOT}) % 2 = 0 THEN 200 ELSE 404 END AS status")))
query("read_pages", f"SELECT page_id, url, strlen(html) AS html_bytes FROM pages WHERE html IS NULL OR strlen(html) <= {facts.MAX_BYTES}")(lambda s, d: facts.read_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.octet_length("html").cast("long").alias("html_bytes")))
query("over_cap", f"SELECT url, strlen(html)::INT AS html_bytes FROM pages WHERE strlen(html) > {facts.MAX_BYTES}")(lambda s, d: facts.over_cap(read(s, d, "pages")))
_COUNTS = ", ".join(f"greatest(len(regexp_extract_all(t, '{p}')), 1) AS {n}" for n, p in (("w", "[A-Za-z'']+"), ("s", "[.!?]+"))) + ", greatest(len(regexp_extract_all(lower(t), '[aeiouy]+')), 1) AS y"
query("readability_texts", f"WITH c AS (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) SELECT doc_id, {even('0.39 * w / s + 11.8 * y / w - 15.59', 1)} AS grade, {even('206.835 - 1.015 * w / s - 84.6 * y / w', 1)} AS ease FROM c")(
    lambda s, d: read(s, d, "documents").select("doc_id", *(f(F.coalesce("text", F.lit(""))).alias(n) for n, f in (("grade", text.readability_grade), ("ease", text.reading_ease))))
)
