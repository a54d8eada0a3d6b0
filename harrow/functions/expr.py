"""Declared expressions compiled to Columns: templates, conditions, map routes and record checks.

A scope is a mapping from a dotted name to a Column. Text values stand for JSON scalars; arrays are Spark arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Scope = Mapping[str, Column]
HOLE = re.compile(r"\{\{\s*([^}]+?)\s*\}\}")

FILTERS: dict[str, Callable[[Column], Column]] = {
    "url": lambda v: F.replace(F.url_encode(F.coalesce(v.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20")),
    "lower": lambda v: F.lower(F.coalesce(v.cast("string"), F.lit(""))),
    "trimAt": lambda v: F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), "^@", ""),
    "int": lambda v: F.regexp_extract(v.cast("string"), r"^\s*(-?\d+)", 1).try_cast("long"),
    "json": lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2),
    "csv": lambda v: F.filter(F.transform(F.split(F.coalesce(v.cast("string"), F.lit("")), r"[\s,]+"), lambda x: F.trim(x)), lambda x: x != ""),
    "len": lambda v: F.coalesce(F.length(v.cast("string")), F.lit(0)),
}


def lookup(text: str, scope: Scope) -> Column:
    name, *filters = [x.strip() for x in text.split("|")]
    value = scope[name] if name in scope else F.lit(None).cast("string")
    for f in filters:
        if f not in FILTERS:
            raise ValueError(f"unknown filter {f}")
        value = FILTERS[f](value)
    return value


def template(text: str, scope: Scope) -> Column:
    """A hole alone keeps its type; else holes are set into the text, null as nothing."""
    if whole := re.fullmatch(r"\{\{\s*([^}]+?)\s*\}\}", text):
        return lookup(whole[1], scope)
    parts, at = [], 0
    for m in HOLE.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(lookup(m[1], scope).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def number(value: Column) -> Column:
    """As the web's Number(): null is 0, the empty text is 0, other text must be a number."""
    text = F.trim(value.cast("string"))
    return F.when(value.isNull() | (text == ""), 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def operand(value, scope: Scope, model: Scope) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dict) and "count" in value:
        found = model.get(value["count"])
        return F.lit(0) if found is None else F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0))
    if isinstance(value, str):
        if value.startswith("/"):
            # a missing pointer is not null: it compares as not-a-number
            return model.get(value, F.lit("NaN"))
        return template(value, scope)
    return F.lit(value)


def condition(cond: dict, scope: Scope, model: Scope, view: Column | None = None, stalled: Column | None = None) -> Column:
    """gte lt eq not and or exists empty view stalled, by the comparison rules of the web."""
    again = lambda c: condition(c, scope, model, view, stalled)
    ((kind, of),) = cond.items()
    if kind in ("gte", "lt"):
        a, b = (number(operand(x, scope, model)) for x in of)
        held = (a >= b) if kind == "gte" else (a < b)
        return held & ~F.isnan(a) & ~F.isnan(b)
    if kind == "eq":
        a, b = (F.coalesce(operand(x, scope, model).cast("string"), F.lit("null")) for x in of)
        return a == b
    if kind == "not":
        return ~again(of)
    if kind in ("and", "or"):
        out = F.lit(kind == "and")
        for c in of:
            out = (out & again(c)) if kind == "and" else (out | again(c))
        return out
    if kind == "exists":
        v = model.get(of, F.lit(None).cast("string"))
        return v.isNotNull() & (v.cast("string") != "")
    if kind == "empty":
        v = template(of, scope)
        return v.isNull() | v.cast("string").isin("", "[]")
    if kind == "view":
        return view.eqNullSafe(F.lit(of))
    if kind == "stalled":
        return stalled >= of
    raise ValueError(f"bad condition {cond}")


def first_filled(*values: Column) -> Column:
    """The first value neither null nor empty; if all are empty, the last one."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(v.isNotNull() & (v.cast("string") != ""), v).otherwise(out)
    return out


def map_route(fields: Mapping[str, str], scope: Scope, model: Scope) -> Column:
    """Output fields from pointers, templates and ``a || b`` chains; dotted names nest."""
    tree: dict = {}
    for name, text in fields.items():
        values = [model.get(x, F.lit(None).cast("string")) if x.startswith("/") else template(x, scope) for x in map(str.strip, text.split("||"))]
        *outer, last = name.split(".")
        at = tree
        for k in outer:
            at = at.setdefault(k, {})
        at[last] = first_filled(*values)
    build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return build(tree)


# --- record checks ---

_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def struct_type(schema: dict) -> str:
    """A JSON Schema as a Spark type; nullable unions take their other member."""
    kind = schema.get("type", "string")
    kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
    if kind == "object":
        props = schema.get("properties")
        return "struct<" + ",".join(f"`{k}`:{struct_type(v)}" for k, v in props.items()) + ">" if props else "map<string,string>"
    if kind == "array":
        return f"array<{struct_type(schema.get('items', {}))}>"
    return _TYPES[kind]


def violations(schema: dict, record: Column, json: Column | None = None, path: str = "data") -> Column:
    """Warnings of a record against a JSON Schema, in field order; records are never dropped for them."""
    found: list[Column] = []

    def walk(s: dict, value: Column, at: str, required: bool) -> None:
        kinds = s.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        say = lambda c, text: found.append(F.when(c, F.lit(f"{at} {text}")))
        if required:
            say(value.isNull() if "null" not in kinds else F.lit(False), "is required")
        if "enum" in s:
            say(value.isNotNull() & ~value.isin(*[x for x in s["enum"] if x is not None]), "must be one of the allowed values")
        if "minimum" in s:
            say(value < s["minimum"], f"must be >= {s['minimum']}")
        if "maximum" in s:
            say(value > s["maximum"], f"must be <= {s['maximum']}")
        if "minLength" in s:
            say(F.length(value) < s["minLength"], f"must NOT have fewer than {s['minLength']} characters")
        if "pattern" in s:
            say(value.isNotNull() & ~value.rlike(s["pattern"]), f"must match pattern {s['pattern']}")
        if "minItems" in s:
            say(F.size(value) < s["minItems"], f"must NOT have fewer than {s['minItems']} items")
        if "items" in s and "type" in s["items"] and s["items"].get("minimum") is not None:
            say(F.exists(value, lambda x: x < s["items"]["minimum"]), f"items must be >= {s['items']['minimum']}")
        for name, sub in s.get("properties", {}).items():
            walk(sub, value[name], f"{at}/{name}", name in s.get("required", []))

    walk(schema, record, path, False)
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def type_violations(schema: dict, json: Column, path: str = "data") -> Column:
    """Fields of a JSON text whose type is none of the declared ones."""
    found = []
    for name, sub in schema.get("properties", {}).items():
        kinds = sub.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        raw = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "variant"))
        told = F.when(raw.startswith("OBJECT"), "object").when(raw.startswith("ARRAY"), "array").when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw == "VOID", "null").when(raw == "BIGINT", "integer").otherwise("number")
        allowed = [*kinds, *(["integer"] if "number" in kinds else [])]
        found.append(F.when(raw.isNotNull() & ~told.isin(*allowed), F.lit(f"{path}/{name} must be {','.join(kinds)}")))
    return F.array_compact(F.array(*found))
