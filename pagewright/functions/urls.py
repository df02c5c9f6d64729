"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and file extensions of the audit rules.
HIGH_PATTERNS = ("/category/", "/course/")
LOW_PATTERNS = ("/tag/", "/author/")
NON_INDEXABLE = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "avif", "mp4", "avi", "mov", "mp3", "wav", "css", "js", "json", "xml")

_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def strip_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def match_key(url: Column) -> Column:
    """Lower case without scheme, www., query, fragment and trailing slash."""
    return strip_slash(F.regexp_replace(F.regexp_replace(F.lower(url), r"[?#].*$", ""), r"^(https?://)?(www\.)?", ""))


def duplicate_key(url: Column) -> Column:
    """Lower case without scheme and trailing slash; the query stays."""
    return F.regexp_replace(F.lower(strip_slash(url)), "^https?://", "")


def link_key(url: Column) -> Column:
    """Without fragment and trailing slash."""
    return strip_slash(F.regexp_replace(url, "#.*$", ""))


def with_scheme(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def public_hostname(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), r"^[^@]*@|:\d+$", ""), r"^www\.", "")


def _parts(url: Column) -> dict[str, Column]:
    """Components of a reference; a missing one is null, an empty one is empty."""
    # the groups of the generic syntax: scheme, authority, path, query, fragment
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    group = lambda i: F.regexp_extract(url, "(?s)" + whole, i)
    there = lambda test, i: F.when(url.rlike("(?s)" + test), group(i))
    return {
        "scheme": there(r"^[A-Za-z][A-Za-z0-9+.-]*:", 1), "authority": there(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", 2), "path": group(3),
        "query": there(r"^[^?#]*\?", 4), "fragment": there(r"^[^#]*#", 5),
    }


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments have been taken."""
    segments = F.split(path, "/", -1)
    rooted = F.startswith(path, F.lit("/"))
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.when(rooted, 1).otherwise(0)))).otherwise(F.array_append(done, s))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.element_at(segments, -1).isin(".", "..")
    return F.when(path == "", path).otherwise(F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference names on a page: the generic resolution of RFC 3986, section 5.2.
    Null if either is null."""
    b, r = _parts(base), _parts(reference)
    folder = F.when(b["authority"].isNotNull() & (b["path"] == ""), "/").otherwise(F.regexp_replace(b["path"], "(?s)[^/]*$", ""))
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    path = F.when(own | F.startswith(r["path"], F.lit("/")), _without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(_without_dots(F.concat(folder, r["path"])))
    query_ = F.when(own | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    authority = F.when(own, r["authority"]).otherwise(b["authority"])
    parts = (F.concat(F.coalesce(r["scheme"], b["scheme"]), F.lit(":")), F.concat(F.lit("//"), authority), path, F.concat(F.lit("?"), query_), F.concat(F.lit("#"), r["fragment"]))
    return F.when(base.isNotNull() & reference.isNotNull(), F.concat(*(F.coalesce(p, F.lit("")) for p in parts)))


def crawl_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def url_type(url: Column) -> Column:
    """First path segment in title case, where a letter after any other character is upper case."""
    seg = F.regexp_extract(path(url), "^/*([^/]*)", 1)
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(seg), "-", " "), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.when(seg == "", "Homepage").otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100000))), ""))


def priority(url: Column) -> Column:
    depth = crawl_depth(url)
    has = lambda ps: F.greatest(*(F.contains(url, F.lit(p)) for p in ps))
    return F.when(has(HIGH_PATTERNS), "High").when(has(LOW_PATTERNS), "Low").when(depth <= 1, "High").when(depth <= 3, "Medium").otherwise("Low")


def non_indexable_reason(url: Column) -> Column:
    ext = F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]{1,6})$", 1)
    return F.when(ext.isin(*NON_INDEXABLE), F.concat(F.lit("file extension ."), ext)).when(query(url) != "", "query parameters").when(fragment(url) != "", "fragment")


def is_public_url(url: Column) -> Column:
    """http(s) with a host that is no local name and no private or reserved address."""
    host = F.regexp_replace(F.lower(netloc(url)), r"^[^@]*@|:\d+$", "")
    v4 = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    is_v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.element_at(v4, 1), F.try_element_at(v4, F.lit(2))
    bad_v4 = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19)) | F.exists(v4, lambda p: p > 255)
    bad_v6 = host.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*|ff.*|::ffff:.*)\]$")
    local = host.isin("localhost", "metadata.google.internal") | host.rlike(r"\.(localhost|local|internal)$")
    ok = scheme(url).isin("http", "https") & (host != "") & ~url.rlike(r"[\s\x00-\x1f\x7f]") & ~local & ~bad_v6 & ~F.when(is_v4, bad_v4).otherwise(False)
    return F.coalesce(ok, F.lit(False))


def matches(url: Column, pattern: str) -> Column:
    """Substring test without regard to case; an empty pattern keeps all."""
    return F.contains(F.lower(url), F.lit(pattern.lower())) if pattern else F.lit(True)
