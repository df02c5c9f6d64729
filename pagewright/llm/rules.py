"""Quality rules that clean a document line by line before they judge it.

Every line is put to rules of punctuation, navigation and boilerplate; lines that fail one are taken
out, and a document that loses too much of its text goes. All of it is expressions inside each row:
no row meets another, nothing is shuffled, and no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = f"[^{SPACES}]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW = 50, 3
#: A document goes if the words of failed lines have more than this share, in percent, of its word characters.
MAX_LOST = 50
#: Punctuation: a line without a sentence end passes only if it has this many words and an end inside;
#: more symbols than a tenth, or shouts than three tenths, of its words fail a line.
LONG_LINE, SYMBOL_SHARE, SHOUT_SHARE = 10, 10, 30
ENDS = ".!?:…。！？؟।"
CLOSING = "\"'”’»)"
#: Navigation: marks that stand between the entries of a menu, and how many of them to a hundred words.
MENU_MARKS, MENU_SHARE = "|»›•·→", 20
#: Boilerplate: phrases in lower case, of the parts that sites repeat on every page.
PHRASES = (
    "all rights reserved", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
    "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "accept cookies",
    "enable javascript", "requires javascript", "lorem ipsum", "skip to content", "back to top", "sign in to", "log in to", "subscribe to our newsletter",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars", "clean_text", "base_failed", "kept")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text, f"[{SPACES}]+", -1), lambda w: w != "")


def _chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def _count(text: Column, marks: str) -> Column:
    """How many of the marks are in a text."""
    return F.size(F.split(text, f"[{marks}]", -1)) - 1


def _pairs(rows: Column, equal: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
    """Places of neighbours among sorted windows that are equal."""
    before = lambda j: F.get(rows, j - 1)
    return F.filter(F.transform(rows, lambda x, j: F.when(equal(before(j), x), F.struct(place(before(j)).alias("a"), place(x).alias("b")))), lambda p: p.isNotNull())


def _covered(pairs: Column) -> Column:
    """Words that the windows of all pairs cover, each once."""
    places = F.sort_array(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more among the words. A window's hash and place
    share a long, which sorts fast. Neighbours of one hash are held against the words, and should two
    of them differ, the windows of the row are sorted as strings."""
    places = lambda w: F.sequence(F.lit(0), F.size(w) - WINDOW)
    window = lambda w, i: [F.get(w, i + k) for k in range(WINDOW)]
    differ = lambda w, p: ~F.array(*window(w, p["a"])).eqNullSafe(F.array(*window(w, p["b"])))

    def by_words(w: Column) -> Column:
        rows = F.sort_array(F.transform(places(w), lambda i: F.struct(F.array(*window(w, i)).alias("k"), i.alias("i"))))
        return _covered(let(rows, lambda s: _pairs(s, lambda x, y: x["k"] == y["k"], lambda x: x["i"])))

    def by_hash(w: Column) -> Column:
        mask = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(w).cast("double"))) + 1).cast("long") - 1
        packed = lambda m: F.sort_array(F.transform(places(w), lambda i: F.xxhash64(*window(w, i)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))))
        pairs = lambda m: let(packed(m), lambda s: _pairs(s, lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(m)) == 0, lambda x: x.bitwiseAND(m).cast("int")))
        return let(let(mask, pairs), lambda e: F.when(F.exists(e, lambda p: differ(w, p)), by_words(w)).otherwise(_covered(e)))

    return F.when(F.size(words) >= WINDOW, by_hash(words)).otherwise(F.lit(0).cast("long"))


def _failed(line: Column, has: Column) -> Column:
    """The first rule that a line fails: 0 none, 1 punctuation, 2 navigation, 3 boilerplate. A line
    without words fails none. has tells what the whole text has at all: most texts have no menu
    marks, symbols, shouts or phrases, and their lines are spared these rules."""
    n = F.size(words_of(line))
    menu = _count(line, MENU_MARKS)
    unended = ~line.rlike(f"[{ENDS}][{CLOSING}{SPACES}]*\\z") & ((n < LONG_LINE) | ~line.rlike(f"[{ENDS}][{CLOSING}]*[{SPACES}]"))
    symbols = has["symbols"] & (100 * _count(line, SYMBOLS) > SYMBOL_SHARE * n)
    shouts = has["shouts"] & (100 * _count(line, "!") > SHOUT_SHARE * F.greatest(n, F.lit(LONG_LINE)))
    return (
        F.when(~line.rlike(NOT_SPACE), 0)
        .when(has["menu"] & (menu >= 3) & (100 * menu >= MENU_SHARE * n), 2)
        .when(has["phrases"] & F.lower(line).rlike("|".join(PHRASES)), 3)
        .when(unended | symbols | shouts, 1)
        .otherwise(0)
    )


def _judged(text: Column) -> Column:
    """Lines, those that fail each rule, the word characters lost with them, and what is left."""
    phrases = let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in PHRASES)))
    has = F.struct(text.rlike(f"[{MENU_MARKS}]").alias("menu"), text.rlike(f"[{SYMBOLS}]").alias("symbols"), F.contains(text, F.lit("!")).alias("shouts"), phrases.alias("phrases"))
    lines = let(has, lambda h: F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _failed(x, h).alias("failed"))))
    sum_of = lambda rows, f: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + f(x))
    number = lambda rows, k: sum_of(rows, lambda x: (x["failed"] == k).cast("long"))
    return let(
        lines,
        lambda rows: F.struct(
            F.size(rows).cast("long").alias("n_lines"), number(rows, 1).alias("n_punctuation"), number(rows, 2).alias("n_navigation"), number(rows, 3).alias("n_boilerplate"),
            sum_of(rows, lambda x: F.when(x["failed"] > 0, _chars(words_of(x["line"]))).otherwise(0)).alias("lost_chars"),
            F.array_join(F.transform(F.filter(rows, lambda x: x["failed"] == 0), lambda x: x["line"]), "\n").alias("clean_text"),
        ),
    )


def clean(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """Columns of docs with the counts of the whole text, those of the line rules, clean_text (the lines
    that fail no rule, joined by line ends), base_failed and kept.

    kept is false where base_failed is: fewer than 50 words, or over half of them in repeated windows
    of three. Else it is false if failed lines hold more than max_lost percent of the word characters.
    A null text counts as empty: no words, so base_failed. Every row is judged by itself, so repeated
    rows get equal results; columns of docs that clash with the new ones are replaced.
    """
    docs = docs.drop(*_NEW, "pagewright_counts", "pagewright_lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _chars(w).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    dup = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select("*", counts.alias("pagewright_counts"), _judged(text).alias("pagewright_lines"), _count(text, SYMBOLS).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    out = out.select(*docs.columns, "pagewright_counts.n_words", "pagewright_counts.word_chars", "n_symbols", "n_dup_lines", "pagewright_counts.n_repeat_words", *(f"pagewright_lines.{c}" for c in ("n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars", "clean_text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars")))


def cleaned(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """Rows of docs that are kept, with their clean text; n_chars, if there, is counted anew."""
    out = clean(docs, max_lost).where("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base rules, verdicts, counts of the line rules, digest of the clean text."""
    c = clean(docs.select(F.col("doc_id").cast("long"), "text"))
    return c.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"),
    )
