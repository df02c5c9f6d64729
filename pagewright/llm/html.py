"""Main text of pages by equivalence classes of template tokens.

Tokens are tags with their place in the tree, and texts with theirs. Tokens of a host's pages that
share an occurrence vector (so many times in each page) form a class; classes that most pages have
exactly once make up the template, without the tokens that are out of order on some page and the
classes that cross another (not nested in one of its gaps). Equal pages count once.

The slots of a page are what lies between the template's tokens. The main element of a host is the
deepest element of its template that holds all slot texts, on nine of ten pages at least; a page's
main text is all that this element holds. Where there is none but the whole page, tags decide: texts
in article or main elements, or else those of all slots. Elements that are a menu, header, footer,
sidebar, notice, advert, form, script or comment list, by fixed lists of tags, roles and words in
class and id, label what is no slot.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.llm.common import materialize, slices, texts, widened

#: A class belongs to the template if this share of a host's pages has it, and so many at least.
SUPPORT_SHARE, SUPPORT_PAGES = 0.5, 3
#: Template tables up to this size are broadcast, larger ones are joined by host.
BROADCAST_BYTES = 32 << 20
#: Share of a host's pages on which its main element has to hold the texts of all slots.
HOLDING_SHARE = 0.9

# A whole tag without < or > in it, which most are; the name of any tag; what ends or quotes.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OUT_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math object select option button textarea dialog menu canvas audio video head title".split())
_OUT_WORDS = frozenset("nav navbar navigation menu footer sidebar aside cookie cookies consent notice banner alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies breadcrumb breadcrumbs subscribe newsletter popup modal overlay pagination pager widget masthead skip login signup search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Za-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(raw)))}


@lru_cache(10_000)
def _is_out(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element is one of those that hold no main text."""
    if tag in _OUT_TAGS or tag == "header" and not in_article:
        return True
    if not raw or tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(raw)
    if a.get("role", "").lower() in _OUT_ROLES:
        return True
    named = f"{a.get('class', '')} {a.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(_SPLIT_CAMEL.sub(" ", named))}
    return bool(words & _OUT_WORDS) or "header" in words and not in_article


def markup(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Tags (begin, end, slash, name, attributes) and comments (no name) of a page, in one pass: what
    has been read is not read again. Once a tag has no end outside of quotes, tags of the rest of the
    page end at the next >; without one, the rest is text."""
    at, begin, quotes = 0, 0, True
    while (i := source.find("<", at)) >= 0:
        if m := _TAG.match(source, i):
            at = m.end()
            yield (i, at, *m.groups())
            continue
        begin = source[i + 1 : i + 2]
        if begin and begin in "!?":
            start, stop = ("<!--", "-->") if source.startswith("<!--", i) else ("<![CDATA[", "]]>") if source.startswith("<![CDATA[", i) else ("<!", ">")
            end = source.find(stop, i + len(start))
            at = end + len(stop) if end >= 0 else len(source)
            yield i, at, "", "", ""
            continue
        if not (m := _NAME.match(source, i)):
            at = i + 1
            continue
        end = m.end()
        while quotes:
            end = _PLAIN.match(source, end).end()
            if end < len(source) and source[end] == ">":
                break
            end = source.find(source[end], end + 1) + 1 if end < len(source) else 0
            quotes = end > 0
        if not quotes and (end := source.find(">", m.end())) < 0:
            return
        at = end + 1
        yield i, at, m[1], m[2], source[m.end() : end]


@lru_cache(100_000)
def _below(path: int, tag: str) -> int:
    """The place of an element in the tree: a hash of its tag and those above."""
    return xxhash.xxh3_64_intdigest(f"{path}/{tag}".encode("utf-8", "surrogatepass"))


_ROOT = ("", False, False, 0, 0)


def _hash(path: int, kind: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}{kind}{what}".encode("utf-8", "surrogatepass")) - (1 << 63)


#: Tags come in few places, so their tokens are kept.
_tag_token = lru_cache(100_000)(_hash)
_HEAD_TOKEN = _hash(_below(0, "html"), "<", "head")


class Page:
    """Blocks of a page in order, its tokens (if texts are to have theirs), and its elements."""

    def __init__(self, source: str, marked: bool = True):
        self._marked = marked
        self.blocks: list[tuple[int, str, int, bool, bool, int]] = []  # place, text, token, out, in article or main, element
        self.tokens: list[int] = []  # in order
        self.elements: list[tuple[int, int]] = [(-1, 0)]  # element above, token that opens it
        self._stack: list[tuple[str, bool, bool, int, int]] = []  # tag, out, in article, place, element
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        self._read(source)

    def _end_block(self) -> None:
        text = "".join(self._text)
        self._text.clear()
        if not text or text.isspace():
            return
        if "&" in text:
            text = html.unescape(text)
        text = _SPACE.sub(" ", text).strip()
        if text:
            _, out, inside, path, element = self._stack[-1] if self._stack else _ROOT
            token = _hash(path, "|", text) if self._marked else 0
            self.blocks.append((path, text, token, out, inside, element))
            self.tokens.append(token)

    def _open(self, tag: str, raw: str) -> None:
        _, out, inside, path, element = self._stack[-1] if self._stack else _ROOT
        token = _tag_token(path, "<", tag)
        self.tokens.append(token)
        below = path
        if tag not in _INLINE:
            below = _below(path, tag)
            self.elements.append((element, token))
            element = len(self.elements) - 1
        self._stack.append((tag, out or _is_out(tag, raw, inside), inside or tag in ("article", "main"), below, element))
        self._open_tags[tag] += 1

    def _pop(self, size: int) -> None:
        while len(self._stack) > size:
            self._open_tags[self._stack.pop()[0]] -= 1

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            return
        while self._stack[-1][0] != tag:
            self._pop(len(self._stack) - 1)
        self._pop(len(self._stack) - 1)
        self.tokens.append(_tag_token(self._stack[-1][3] if self._stack else 0, ">", tag))

    def _read(self, source: str) -> None:
        at, stack = 0, self._stack
        for begin, end, closes, tag, raw in markup(source):
            if begin < at:  # inside of a script or the like
                continue
            self._text.append(source[at:begin])
            at = end
            if not tag:
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            top, was_out, inside, path, _ = stack[-1] if stack else _ROOT
            if not inline or closes and top == tag and was_out or not was_out and raw and _is_out(tag, raw, inside):
                self._end_block()
            elif tag == "br":
                self._text.append(" ")
            if closes:
                self._close(tag)
                continue
            if not inline and stack:
                if tag != "p" and top in _CLOSED_BY.get(tag, ()):
                    self._pop(len(stack) - 1)
                elif self._open_tags["p"]:
                    # a block ends an open paragraph, and what was left open in it
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] in _INLINE:
                        k -= 1
                    if k >= 0 and stack[k][0] == "p":
                        self._pop(k)
            if tag in _RAW:
                close = _raw_end(tag).search(source, at)
                self.tokens.append(_tag_token(stack[-1][3] if stack else 0, "<", tag))
                at = close.end() if close else len(source)
            elif tag not in _VOID and not raw.endswith("/"):
                self._open(tag, raw)
        self._text.append(source[at:])
        self._end_block()


@lru_cache(100)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


# A block as it is kept: text, token, whether an article or main element holds it, its element.
Block = tuple[str, int, bool, int]


def _candidates(page: Page) -> list[Block]:
    """Blocks that no label leaves out."""
    return [(text, token, inside, element) for _, text, token, out, inside, element in page.blocks if not out]


def _above(element: int, parents: list[int]) -> Iterator[int]:
    while element >= 0:
        yield element
        element = parents[element]


def holding(blocks: list[Block], parents: list[int], openers: list[int], template: set[int]) -> list[tuple[int, int]]:
    """Template elements, as (token, depth), that hold all slot texts of a page."""
    common: list[int] | None = None
    seen: set[int] = set()
    for _, token, _, element in blocks:
        if token in template or element in seen:
            continue
        seen.add(element)
        if common is None:
            common = list(_above(element, parents))
        else:
            own = set(_above(element, parents))
            common = [e for e in common if e in own]
    return [(openers[e], len(common) - i) for i, e in enumerate(common or []) if openers[e] in template]


def chosen(blocks: list[Block], parents: list[int], openers: list[int], template: set[int] | frozenset[int], main: int | None) -> str:
    """The main text of a page, given the token of its host's main element, if that has one."""
    if main is not None:
        kept = [t for t, _, _, element in blocks if any(openers[e] == main for e in _above(element, parents))]
        if kept:
            return "\n\n".join(kept)
    if any(inside for _, _, inside, _ in blocks):
        return "\n\n".join(t for t, _, inside, _ in blocks if inside)
    return "\n\n".join(t for t, token, _, _ in blocks if token not in template)


def main_text(source: str, template: set[int] | frozenset[int] = frozenset(), main: int | None = None) -> str:
    """Main text of one page, blocks joined by an empty line."""
    page = Page(source)
    return chosen(_candidates(page), [p for p, _ in page.elements], [t for _, t in page.elements], template, main)


def visible_text(source: str) -> str:
    """All text of a page but scripts, styles and the like, a line a block."""
    page = Page(source, marked=False)
    heads = {0: False}
    for i, (parent, token) in enumerate(page.elements[1:], 1):
        heads[i] = heads[parent] or token == _HEAD_TOKEN
    return "\n".join(text for _, text, _, _, _, element in page.blocks if not heads[element])


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_PARSED = "pagewright_digest binary, pagewright_tokens array<bigint>, pagewright_blocks array<string>, pagewright_marks array<bigint>, pagewright_inside array<boolean>, pagewright_at array<int>, pagewright_parents array<int>, pagewright_openers array<bigint>"


def parsed(pages: DataFrame, *carried: str) -> DataFrame:
    """The carried columns of pages, and of each page its host, a digest of its html, its tokens in
    order, its candidate blocks (texts, tokens, labels, elements), and the elements above these.
    Pages are parsed here only."""
    source = pages.select(*carried, _host(F.col("url").cast("string")).alias("pagewright_host"), F.col("html").cast("string").alias("pagewright_html"))
    schema = widened(source.drop("pagewright_html"), _PARSED)
    types = [f.type for f in to_arrow_schema(schema)][len(schema) - 8 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows = []
            for h in texts(b.column(b.num_columns - 1)):
                page = Page(h)
                blocks = _candidates(page)
                used = sorted({e for *_, element in blocks for e in _above(element, [p for p, _ in page.elements])}) if blocks else []
                place = {e: i for i, e in enumerate(used)} | {-1: -1}
                rows.append((
                    xxhash.xxh3_128_digest(h.encode("utf-8", "surrogatepass")), page.tokens, [t for t, *_ in blocks], [k for _, k, *_ in blocks], [i for _, _, i, _ in blocks], [place[e] for *_, e in blocks],
                    [place[page.elements[e][0]] for e in used], [page.elements[e][1] for e in used],
                ))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.record_batch([*b.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _with_host(df: DataFrame, side: DataFrame, size: int) -> DataFrame:
    return df.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "pagewright_host", "left")


def in_order(ranks: list[int]) -> list[int]:
    """Places of a longest increasing part of a sequence of different numbers."""
    ends, last, before = [], [], []
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [r], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def misplaced(tokens: list[int], classes: list[list[int]]) -> set[int]:
    """Tokens of a page's classes that are out of place on it.

    Classes come most important first, their tokens in the order of another page. Of a class, what
    is out of that order is misplaced. Two classes must be side by side, or one in one gap of the
    other; of two that cross, all of the later is misplaced.
    """
    place = {t: i for i, t in enumerate(tokens)}
    out: set[int] = set()
    held: list[list[int]] = []
    for c in classes:
        if c[0] not in place:
            continue
        at = [place[t] for t in c]
        good = in_order(at)
        out |= set(c) - {c[i] for i in good}
        own = [at[i] for i in good]
        one_gap = lambda a, b: bisect_left(a, b[0]) == bisect_left(a, b[-1])
        if all(one_gap(h, own) or one_gap(own, h) for h in held):
            held.append(own)
        else:
            out |= set(c)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """pagewright_host and the token hashes of its template. pages as parsed() gives them.

    Equal pages of a host count once. The occurrence vector of a token is summed up as a number:
    the wrapping sum, over pages, of the page's number times its count. So pages of one host are
    counted where they lie and only sums meet; no host is gathered. Each page then reports the
    tokens that are misplaced on it, and what any page reports leaves its class.
    """
    distinct = materialize(pages.select("pagewright_host", "pagewright_digest", "pagewright_tokens").dropDuplicates(["pagewright_host", "pagewright_digest"]), "pages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            hosts, found, marks, counts, places = [], [], [], [], []
            for host, digest, tokens in zip(*(c.to_pylist() for c in b.columns)):
                n = Counter(tokens)
                place = {t: i for i, t in enumerate(tokens)}
                mark = int.from_bytes(digest[:8], "big")
                hosts += [host] * len(n)
                found += n
                marks += [(mark * c & 0xFFFFFFFFFFFFFFFF) >> 20 for c in n.values()]
                counts += n.values()
                places += [place[t] for t in n]
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(marks, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.int64())], names=["pagewright_host", "token", "mark", "n", "place"])

    rows = distinct.mapInArrow(count, "pagewright_host string, token long, mark long, n long, place long")
    # tokens of one class are on the same pages, so their places on the page of the lowest mark compare
    first = F.min(F.struct("mark", "place")).alias("first")
    vectors = rows.groupBy("pagewright_host", "token").agg(F.sum(F.col("mark").cast("decimal(28,0)")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("n"), first)
    totals = distinct.groupBy("pagewright_host").agg(F.count("*").alias("all_pages"))
    once = vectors.where((F.col("n") == F.col("pages")) & (F.col("pages") >= SUPPORT_PAGES)).join(totals, "pagewright_host").where(F.col("pages") >= SUPPORT_SHARE * F.col("all_pages"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first.place", "token"))), lambda x: x["token"])
    classes = once.groupBy("pagewright_host", "vector", "pages").agg(ordered.alias("own"))
    by_size = F.sort_array(F.collect_list(F.struct("pages", F.size("own").alias("size"), "own")), asc=False)
    found = materialize(classes.groupBy("pagewright_host").agg(F.transform(by_size, lambda x: x["own"]).alias("pagewright_classes")), "classes")
    size = found.agg(F.sum(8 * F.size(F.flatten("pagewright_classes")) + F.octet_length("pagewright_host"))).first()[0] or 0

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            out = {(h, t) for h, tokens, classes in zip(*(c.to_pylist() for c in b.columns)) for t in misplaced(tokens, classes or [])}
            yield pa.record_batch([pa.array([h for h, _ in out], pa.string()), pa.array([t for _, t in out], pa.int64())], names=["pagewright_host", "token"])

    checked = _with_host(distinct.select("pagewright_host", "pagewright_tokens"), found, size).mapInArrow(check, "pagewright_host string, token long")
    gone = checked.groupBy("pagewright_host").agg(F.collect_set("token").alias("gone"))
    valid = found.join(gone, "pagewright_host", "left")
    return valid.select("pagewright_host", F.array_except(F.flatten("pagewright_classes"), F.coalesce("gone", F.array().cast("array<bigint>"))).alias("pagewright_template"))


_BLOCKS = ["pagewright_blocks", "pagewright_marks", "pagewright_inside", "pagewright_at", "pagewright_parents", "pagewright_openers"]


def main_elements(pages: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """pagewright_host and the token of its main element, of the hosts with one inside of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            hosts, tokens, depths, pages = [], [], [], []
            for host, blocks, marks, inside, at, parents, openers, template in zip(*(c.to_pylist() for c in b.columns)):
                rows = holding(list(zip(blocks, marks, inside, at)), parents, openers, set(template or ()))
                for token, depth in [(None, 0)] * bool(blocks) + rows:  # the page itself is counted under no token
                    hosts.append(host)
                    tokens.append(token)
                    depths.append(depth)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(depths, pa.int32())], names=["pagewright_host", "token", "depth"])

    rows = _with_host(pages.select("pagewright_host", *_BLOCKS), found, size).mapInArrow(run, "pagewright_host string, token long, depth int")
    counts = rows.groupBy("pagewright_host", "token").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    totals = counts.where("token IS NULL").select("pagewright_host", F.col("n").alias("pages"))
    holders = counts.where("token IS NOT NULL").join(totals, "pagewright_host").where(F.col("n") >= HOLDING_SHARE * F.col("pages"))
    whole = [_hash(0, "<", "html"), _hash(_below(0, "html"), "<", "body"), _hash(0, "<", "body")]
    deepest = holders.groupBy("pagewright_host").agg(F.max_by("token", F.struct("depth", "token")).alias("pagewright_main"))
    return deepest.where(~F.col("pagewright_main").isin(*whole))


def _extracted(kept: DataFrame, *carried: str) -> DataFrame:
    pages = materialize(parsed(kept, *carried), "parsed")
    found = materialize(templates(pages), "templates")
    size = found.agg(F.sum(8 * F.size("pagewright_template") + F.octet_length("pagewright_host"))).first()[0] or 0
    mains = materialize(main_elements(pages, found, size), "mains")
    both = _with_host(_with_host(pages.select(*carried, "pagewright_host", *_BLOCKS), found, size), mains, size)
    schema = widened(kept.select(*carried), "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            out = []
            for blocks, marks, inside, at, parents, openers, template, main in zip(*(c.to_pylist() for c in b.columns[len(carried) :])):
                out.append(chosen(list(zip(blocks, marks, inside, at)), parents, openers, set(template or ()), main))
            yield pa.record_batch([*b.columns[: len(carried)], pa.array(out, pa.string())], names=schema.names)

    return both.drop("pagewright_host").mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame) -> DataFrame:
    """Columns of pages with text (empty if none) and n_chars.

    Null html is an empty page; pages without a host share an empty one; repeated rows are kept,
    but equal pages of a host count once for its template; columns text and n_chars are replaced.
    """
    kept = pages.drop("text", "n_chars")
    return _extracted(kept, *kept.columns)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, as extract() gives them; other columns are left out."""
    return _extracted(pages, "page_id", "url")
