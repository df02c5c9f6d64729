"""JSON-LD markup of entity tables, from a table of forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of each type. A text is a fixed value; need(c) is a column that stays when
# blank, want(c) one that is left out when blank; a third value is a default; lines(c) is a column
# split at its line feeds, as texts or as objects of a type; some(cs, form) is a form that is left
# out if all of these columns are blank.


def need(column: str, default: str = "") -> tuple:
    return "need", column, default


def want(column: str, form: str = "{}") -> tuple:
    return "want", column, form


def lines(column: str, kind: str | None = None, key: str = "text", numbered: bool = False, always: bool = False) -> tuple:
    return "lines", column, kind, key, numbered, always


def some(columns: str, form: dict) -> tuple:
    return "some", columns.split(), form


def pairs(column: str, key: str, form) -> tuple:
    """A column of (key, value) structs as objects, those with a blank key left out."""
    return "pairs", column, key, form


ADDRESS = some("address city state zip country", {"@type": "PostalAddress", "streetAddress": need("address"), "addressLocality": need("city"), "addressRegion": need("state"), "postalCode": need("zip"), "addressCountry": need("country")})
RATING = {"@type": "AggregateRating", "ratingValue": need("rating_value")}

FORMS = {
    "article": ("headline description author publisher date_published url", {
        "@type": "Article", "headline": need("headline"), "description": need("description"), "author": {"@type": "Person", "name": need("author"), "url": want("author_url")},
        "publisher": {"@type": "Organization", "name": need("publisher"), "logo": some("publisher_logo", {"@type": "ImageObject", "url": need("publisher_logo")})},
        "datePublished": need("date_published"), "url": need("url"), "dateModified": want("date_modified"), "image": want("image"),
    }),
    "faq": ("faq_items", {"@type": "FAQPage", "mainEntity": pairs("faq_items", "question", lambda x: F.struct(F.lit("Question").alias("@type"), x["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), F.coalesce(x["answer"], F.lit("")).alias("text")).alias("acceptedAnswer")))}),
    "product": ("name description url", {
        "@type": "Product", "name": need("name"), "description": need("description"), "url": need("url"), "image": want("image"), "brand": some("brand", {"@type": "Brand", "name": need("brand")}), "sku": want("sku"),
        "offers": some("price availability", {"@type": "Offer", "price": want("price"), "priceCurrency": want("currency"), "availability": want("availability", "https://schema.org/{}"), "url": want("url")}),
        "aggregateRating": some("rating_value", RATING | {"reviewCount": need("rating_count", "1")}),
    }),
    "breadcrumb": ("items", {"@type": "BreadcrumbList", "itemListElement": pairs("items", "name", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), F.coalesce(x["url"], F.lit("")).alias("item")))}),
    "localbusiness": ("name url", {"@type": "LocalBusiness", "name": need("name"), "url": need("url"), "description": want("description"), "telephone": want("telephone"), "image": want("image"), "priceRange": want("price_range"), "address": ADDRESS}),
    "video": ("name description thumbnail_url upload_date", {"@type": "VideoObject", "name": need("name"), "description": need("description"), "thumbnailUrl": need("thumbnail_url"), "uploadDate": need("upload_date"), "duration": want("duration"), "contentUrl": want("content_url"), "embedUrl": want("embed_url")}),
    "event": ("name start_date location_name", {
        "@type": "Event", "name": need("name"), "startDate": need("start_date"),
        "location": {"@type": "Place", "name": need("location_name"), "address": some("location_address", {"@type": "PostalAddress", "streetAddress": need("location_address")})},
        "eventStatus": ("form", "event_status", "EventScheduled"), "eventAttendanceMode": ("form", "attendance_mode", "OfflineEventAttendanceMode"), "description": want("description"), "endDate": want("end_date"), "image": want("image"), "url": want("url"),
        "organizer": some("organizer_name", {"@type": "Organization", "name": need("organizer_name"), "url": want("organizer_url")}),
        "offers": some("offer_price", {"@type": "Offer", "price": need("offer_price"), "priceCurrency": need("offer_currency", "USD"), "availability": "https://schema.org/InStock", "url": want("offer_url")}),
    }),
    "howto": ("name steps", {
        "@type": "HowTo", "name": need("name"), "description": need("description"), "step": lines("steps", "HowToStep", numbered=True, always=True), "totalTime": want("total_time"), "image": want("image"),
        "supply": lines("supplies", "HowToSupply", "name"), "tool": lines("tools", "HowToTool", "name"),
    }),
    "person": ("name", {"@type": "Person", "name": need("name"), "url": want("url"), "image": want("image"), "jobTitle": want("job_title"), "email": want("email"), "telephone": want("telephone"), "worksFor": some("works_for", {"@type": "Organization", "name": need("works_for")}), "sameAs": lines("same_as")}),
    "organization": ("name url", {"@type": "Organization", "name": need("name"), "url": need("url"), "logo": want("logo"), "description": want("description"), "telephone": want("telephone"), "email": want("email"), "foundingDate": want("founding_date"), "address": ADDRESS, "sameAs": lines("same_as")}),
    "recipe": ("name image author ingredients instructions", {
        "@type": "Recipe", "name": need("name"), "description": need("description"), "image": need("image"), "author": {"@type": "Person", "name": need("author")}, "recipeIngredient": lines("ingredients", always=True),
        "recipeInstructions": lines("instructions", "HowToStep", numbered=True, always=True), "datePublished": want("date_published"), "prepTime": want("prep_time"), "cookTime": want("cook_time"), "totalTime": want("total_time"), "recipeYield": want("recipe_yield"),
        "recipeCategory": want("recipe_category"), "recipeCuisine": want("recipe_cuisine"), "nutrition": some("calories", {"@type": "NutritionInformation", "calories": want("calories", "{} calories")}),
    }),
    "jobposting": ("title description date_posted hiring_org city country", {
        "@type": "JobPosting", "title": need("title"), "description": need("description"), "datePosted": need("date_posted"), "hiringOrganization": {"@type": "Organization", "name": need("hiring_org"), "sameAs": want("hiring_org_url"), "logo": want("hiring_org_logo")},
        "jobLocation": {"@type": "Place", "address": {"@type": "PostalAddress", "addressLocality": need("city"), "addressCountry": need("country"), "streetAddress": want("address"), "addressRegion": want("state"), "postalCode": want("zip")}},
        "employmentType": want("employment_type"), "jobLocationType": want("job_location_type"), "validThrough": want("valid_through"),
        "baseSalary": some("salary_min salary_max", {"@type": "MonetaryAmount", "currency": need("salary_currency", "USD"), "value": {"@type": "QuantitativeValue", "unitText": need("salary_unit", "YEAR"), "minValue": want("salary_min"), "maxValue": want("salary_max")}}),
    }),
    "course": ("name description provider_name", {"@type": "Course", "name": need("name"), "description": need("description"), "provider": {"@type": "Organization", "name": need("provider_name"), "sameAs": want("provider_url")}, "url": want("url")}),
    "review": ("item_name rating_value author", {
        "@type": "Review", "itemReviewed": {"@type": need("item_type", "Product"), "name": need("item_name")}, "reviewRating": {"@type": "Rating", "ratingValue": need("rating_value"), "bestRating": need("rating_best", "5")},
        "author": {"@type": "Person", "name": need("author")}, "reviewBody": want("review_body"), "datePublished": want("date_published"),
    }),
    "softwareapp": ("name operating_system application_category", {
        "@type": "SoftwareApplication", "name": need("name"), "operatingSystem": need("operating_system"), "applicationCategory": need("application_category"), "description": want("description"), "url": want("url"), "image": want("image"),
        "offers": some("price", {"@type": "Offer", "price": need("price"), "priceCurrency": need("currency", "USD")}), "aggregateRating": some("rating_value", RATING | {"ratingCount": need("rating_count", "1")}),
    }),
}


def _filled(rows: DataFrame, column: str) -> Column:
    """A column as text, null if it is blank or missing."""
    return F.nullif(F.trim(F.col(column).cast("string")), F.lit("")) if column in rows.columns else F.lit(None).cast("string")


def _value(rows: DataFrame, form) -> Column:
    if isinstance(form, str):
        return F.lit(form)
    if isinstance(form, dict):
        return F.struct(*(_value(rows, f).alias(k) for k, f in form.items()))
    kind, column, *more = form
    if kind == "need":
        return F.coalesce(_filled(rows, column), F.lit(more[0]))
    if kind == "want":
        before, after = more[0].split("{}")
        return F.concat(F.lit(before), _filled(rows, column), F.lit(after))
    if kind == "form":
        return F.concat(F.lit("https://schema.org/"), F.coalesce(_filled(rows, column), F.lit(more[0])))
    if kind == "some":
        return F.when(F.coalesce(*(_filled(rows, c) for c in column)).isNotNull(), _value(rows, more[0]))
    if kind == "pairs":
        if column not in rows.columns:
            return F.array().cast("array<string>")
        return F.transform(F.filter(column, lambda x: F.coalesce(x[more[0]], F.lit("")) != ""), more[1])
    of, key, numbered, always = more
    texts = F.filter(F.transform(F.split(F.coalesce(_filled(rows, column), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    if of:
        place = lambda i: [(i + 1).alias("position")] if numbered else []
        out = F.transform(texts, lambda x, i: F.struct(F.lit(of).alias("@type"), *place(i), x.alias(key)))
    else:
        out = texts
    return out if always else F.when(F.size(texts) > 0, out)


def jsonld_markup(rows: DataFrame, kind: str) -> DataFrame:
    """key, JSON-LD and warnings of entities (key and the columns of the form of this kind). Columns
    that are needed stay when blank and give a warning; others are left out when blank."""
    required, form = FORMS[kind]
    body = F.to_json(_value(rows, {"@context": "https://schema.org"} | form))
    blank = lambda c: F.lit(True) if c not in rows.columns else (F.coalesce(F.size(c), F.lit(0)) <= 0 if rows.schema[c].dataType.typeName() == "array" else _filled(rows, c).isNull())
    warnings = F.array_join(F.array_compact(F.array(*(F.when(blank(c), f"missing {c}") for c in required.split()))), "; ")
    return rows.select("key", body.alias("json"), warnings.alias("warnings"))
