"""JSON-LD: one pass over the blocks of a page (the vectorized helper), rows and reports from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields that a type needs, types that are known without fields, types worth having,
# types and fields of an article, fields of a course.
REQUIRED_FIELDS = {
    "Article": ("headline", "author", "datePublished"),
    "NewsArticle": ("headline", "author", "datePublished"),
    "BlogPosting": ("headline", "author", "datePublished"),
    "Product": ("name",),
    "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",),
    "LocalBusiness": ("name", "address"),
    "Organization": ("name", "url"),
    "Person": ("name",),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate"),
    "Event": ("name", "startDate", "location"),
    "HowTo": ("name", "step"),
    "Recipe": ("name", "image", "recipeIngredient", "recipeInstructions"),
    "JobPosting": ("title", "description", "datePosted", "hiringOrganization", "jobLocation"),
    "Course": ("name", "description", "provider"),
    "Review": ("itemReviewed", "reviewRating", "author"),
    "SoftwareApplication": ("name", "operatingSystem", "applicationCategory"),
    "WebPage": ("name",),
    "WebSite": ("name", "url"),
}
OTHER_TYPES = (
    "ItemList", "Question", "Answer", "Offer", "AggregateRating", "Rating", "ImageObject", "Place", "PostalAddress", "HowToStep", "HowToSupply", "HowToTool",
    "ListItem", "MonetaryAmount", "QuantitativeValue", "NutritionInformation", "Brand", "Thing",
)
HIGH_VALUE_TYPES = ("Article", "BreadcrumbList", "FAQPage", "Organization", "Product", "VideoObject", "WebSite")
ARTICLE_TYPES = ("article", "blogposting", "newsarticle")
ARTICLE_FIELDS = ("headline", "author", "datePublished", "image")
COURSE_FIELDS = ("name", "description", "provider")

LD = (
    "blocks:array<struct<valid:boolean,kind:string,types:array<string>,issues:array<struct<level:string,path:string,message:string>>>>,"
    "nested_types:array<string>,article_types:array<string>,article_missing:array<string>,author:string,published:string,modified:string,course_missing:array<string>"
)


def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


def _nodes(value, path: str = "$") -> Iterator[tuple[str, dict]]:
    """Every object of a parsed block with its path, outer ones first."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            yield at, v
            inner = [(f"{at}.{k}", x) for k, x in v.items() if isinstance(x, (dict, list)) and not k.startswith("@")]
        else:
            inner = [(f"{at}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else []
        todo += inner[::-1]


def _all_types(value) -> list[str]:
    """Lower-cased types of every object, those in graphs included."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            out += [t.lower() for t in _listed(v.get("@type")) if isinstance(t, str)]
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return out


def root_types(value) -> list[str]:
    """Types at the root of a parsed block, through arrays and graphs."""
    if isinstance(value, list):
        return [t for v in value for t in root_types(v)]
    if not isinstance(value, dict):
        return []
    if isinstance(value.get("@graph"), list):
        return root_types(value["@graph"])
    return [t for t in _listed(value.get("@type")) if isinstance(t, str)]


def issues_of(value) -> list[dict[str, str]]:
    """Context, type and missing required fields of every object of a parsed block."""
    out = []

    def say(level: str, path: str, message: str) -> None:
        out.append({"level": level, "path": path, "message": message})

    for path, node in _nodes(value):
        if path == "$":
            context = node.get("@context")
            if "@context" not in node:
                say("error", path, "Missing @context")
            elif isinstance(context, str) and "schema.org" not in context.lower():
                say("warning", path, f"Unexpected @context {context}")
            if not node.get("@type"):
                say("error", path, "Missing @type")
        for kind in _listed(node.get("@type") or []):
            if isinstance(kind, str) and kind not in REQUIRED_FIELDS and kind not in OTHER_TYPES:
                say("info", path, f"Unknown type {kind}")
            elif isinstance(kind, str):
                for field in REQUIRED_FIELDS.get(kind, ()):
                    if node.get(field) in (None, "", []):
                        say("error", path, f"{kind}: missing {field}")
    return out


def is_iso_date(text: str) -> bool:
    try:
        datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        return bool(text.strip())
    except ValueError:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()))


def _top_nodes(value) -> list[dict]:
    """Objects of a block or its array; a graph stands for the object that holds it."""
    out = []
    for node in filter(lambda n: isinstance(n, dict), _listed(value)):
        graph = node.get("@graph")
        out += [g for g in graph if isinstance(g, dict)] if isinstance(graph, list) else [node]
    return out


def _author(value) -> str:
    first = value[0] if isinstance(value, list) and value else value
    name = first.get("name") if isinstance(first, dict) else first
    return name if isinstance(name, str) else ""


def jsonld_facts(blocks: list[str]) -> dict:
    """What a page's JSON-LD blocks hold. A block that is no JSON is not valid and has one issue."""
    found, values = [], []
    for block in blocks:
        try:
            value = json.loads(block)
        except ValueError:
            found.append({"valid": False, "kind": None, "types": [], "issues": [{"level": "error", "path": "$", "message": "Invalid JSON"}]})
            continue
        values.append(value)
        kind = _listed(value.get("@type", "Unknown"))[0] if isinstance(value, dict) else "Multiple"
        found.append({"valid": True, "kind": kind if isinstance(kind, str) else "Unknown", "types": root_types(value), "issues": issues_of(value)})
    top = [n for v in values for n in _top_nodes(v)]
    lower = [{t.lower() for t in _listed(n.get("@type")) if isinstance(t, str)} for n in top]
    articles = [n for n, t in zip(top, lower) if t & set(ARTICLE_TYPES)]
    course = next((n for n, t in zip(top, lower) if "course" in t), None)
    text = lambda n, k: n.get(k) if isinstance(n.get(k), str) else ""
    return {
        "blocks": found,
        "nested_types": sorted(t for v in values for t in _all_types(v)),
        "article_types": sorted({t for x in lower for t in x & set(ARTICLE_TYPES)}),
        "article_missing": [f for f in ARTICLE_FIELDS if not articles[0].get(f)] if articles else None,
        "author": next((a for n in articles if (a := _author(n.get("author")))), None),
        "published": next((v.strip() for n in articles if (v := text(n, "datePublished"))), None),
        "modified": next((v for n in articles if (v := text(n, "dateModified")) and is_iso_date(v)), None),
        "course_missing": None if course is None else [f for f in COURSE_FIELDS if not course.get(f)],
    }


def jsonld_types(block: str) -> list[str] | None:
    """Types of a JSON-LD block through arrays and graphs; None if it is no JSON."""
    try:
        return root_types(json.loads(block))
    except ValueError:
        return None


def jsonld_issues(facts: DataFrame) -> DataFrame:
    """A row (url, block, level, path, message) for each issue of each block."""
    blocks = facts.select("url", F.posexplode("ld.blocks").alias("block", "b"))
    return blocks.select("url", "block", F.inline("b.issues"))


def jsonld_validate(facts: DataFrame) -> DataFrame:
    """Blocks, root types, errors and warnings of each page, and types worth having that it lacks."""
    types = F.array_sort(F.array_distinct(F.flatten(F.transform("ld.blocks", lambda b: b["types"]))))
    issues = F.flatten(F.transform("ld.blocks", lambda b: b["issues"]))
    level = lambda name: F.size(F.filter(issues, lambda i: i["level"] == name))
    return facts.select(
        "url", F.size("ld.blocks").alias("n_blocks"), F.size(F.filter("ld.blocks", lambda b: ~b["valid"])).alias("n_invalid"), F.array_join(types, ",").alias("types"), level("error").alias("n_errors"), level("warning").alias("n_warnings"),
        F.array_join(F.array_except(F.array(*map(F.lit, HIGH_VALUE_TYPES)), types), ",").alias("recommended"),
    )
