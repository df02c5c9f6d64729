"""Markup of every form that is made of text columns, with SQL that builds the same JSON as text."""

from __future__ import annotations

from pagewright.plans.base import query
from pagewright.plans.link_queries import made
from pagewright.sources import markup
from pagewright.sources.derived import read

SEPARATE = ("product", "howto")  # these have queries of their own


def _columns(form) -> dict[str, bool]:
    """Columns that a form reads, and whether each is read as lines."""
    if isinstance(form, dict):
        return {k: v for f in form.values() for k, v in _columns(f).items()}
    if isinstance(form, str):
        return {}
    if form[0] == "some":
        return dict.fromkeys(form[1], False) | _columns(form[2])
    return {form[1]: form[0] == "lines"}


def _has_pairs(form) -> bool:
    return any(_has_pairs(f) for f in form.values()) if isinstance(form, dict) else not isinstance(form, str) and (form[0] == "pairs" or form[0] == "some" and _has_pairs(form[2]))


def _input(columns: dict[str, bool]) -> str:
    """Expressions for these columns over part: null, blank or text, each by a cycle of its own."""
    out = ["p_partkey AS key"]
    for i, (name, lined) in enumerate(sorted(columns.items())):
        text = f"concat('{name} ', p_partkey, ' a', chr(10), ' ', chr(10), 'b \"c\" ')" if lined else f"concat(' {name} é/', p_partkey, '\"')"
        out.append(f"CASE p_partkey % {3 + i % 5} WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE {text} END AS {name}")
    return ";".join(out)


def _filled(column: str) -> str:
    return f"nullif(trim({column}), '')"


def _json(form) -> str:
    """SQL of a form's JSON text; null where it is left out."""
    if isinstance(form, str):
        return f"'\"{form}\"'"
    if isinstance(form, dict):
        fields = ", ".join(f"'\"{k}\":' || {_json(f)}" for k, f in form.items())
        return f"('{{' || array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), ',') || '}}')"
    kind, column, *more = form
    if kind == "need":
        return f"to_json(coalesce({_filled(column)}, '{more[0]}'))::VARCHAR"
    if kind == "want":
        before, after = more[0].split("{}")
        return f"to_json('{before}' || {_filled(column)} || '{after}')::VARCHAR"
    if kind == "form":
        return f"to_json('https://schema.org/' || coalesce({_filled(column)}, '{more[0]}'))::VARCHAR"
    if kind == "some":
        return f"CASE WHEN coalesce({', '.join(map(_filled, column))}) IS NOT NULL THEN {_json(more[0])} END"
    of, key, numbered, always = more
    texts = f"list_filter(list_transform(string_split(coalesce({_filled(column)}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    place = "'\"position\":' || i || ','" if numbered else "''"
    item = f"'{{\"@type\":\"{of}\",' || {place} || '\"{key}\":' || to_json(x)::VARCHAR || '}}'" if of else "to_json(x)::VARCHAR"
    whole = f"('[' || array_to_string(list_transform({texts}, lambda x, i: {item}), ',') || ']')"
    return whole if always else f"CASE WHEN len({texts}) > 0 THEN {whole} END"


for _kind, (_required, _form) in markup.FORMS.items():
    if _kind in SEPARATE or _has_pairs(_form):
        continue
    _rows, _sql = made("part", _input(_columns(_form) | {c: False for c in _required.split() if c not in _columns(_form)}))
    _missing = ", ".join(f"CASE WHEN {_filled(c)} IS NULL THEN 'missing {c}' END" for c in _required.split())
    query(f"jsonld_{_kind}", f"SELECT key, {_json({'@context': 'https://schema.org'} | _form)} AS json, concat_ws('; ', {_missing}) AS warnings FROM ({_sql})")(
        lambda s, d, rows=_rows, kind=_kind: markup.jsonld_markup(rows(s, d), kind)
    )

# forms of a list of pairs

_EMPTY = "CASE WHEN p_partkey % 4 = 0 THEN 'missing {}' ELSE '' END AS warnings FROM part"
query(
    "jsonld_faq",
    "SELECT p_partkey AS key, '{\"@context\":\"https://schema.org\",\"@type\":\"FAQPage\",\"mainEntity\":[' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '{\"@type\":\"Question\",\"name\":\"What is ' || p_partkey || '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END || '\"}}' END || ']}' AS json, " + _EMPTY.format("faq_items"),
)(lambda s, d: markup.jsonld_markup(read(s, d, "part").selectExpr("p_partkey AS key", "filter(array(named_struct('question', concat('What is ', p_partkey, '?'), 'answer', if(p_partkey % 3 = 0, null, p_name)), named_struct('question', '', 'answer', 'none')), x -> p_partkey % 4 > 0) AS faq_items"), "faq"))
query(
    "jsonld_breadcrumb",
    "SELECT p_partkey AS key, '{\"@context\":\"https://schema.org\",\"@type\":\"BreadcrumbList\",\"itemListElement\":[' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '{\"@type\":\"ListItem\",\"position\":1,\"name\":\"Home\",\"item\":\"\"},{\"@type\":\"ListItem\",\"position\":2,\"name\":\"' || p_name || '\",\"item\":\"https://b.example/' || p_partkey || '\"}' END || ']}' AS json, " + _EMPTY.format("items"),
)(lambda s, d: markup.jsonld_markup(read(s, d, "part").selectExpr("p_partkey AS key", "filter(array(named_struct('name', 'Home', 'url', null), named_struct('name', '', 'url', 'x'), named_struct('name', p_name, 'url', concat('https://b.example/', p_partkey))), x -> p_partkey % 4 > 0) AS items"), "breadcrumb"))
