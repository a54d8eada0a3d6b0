"""Pages to rows. A page is parsed once in its task, for all views and fields; the raw html goes no further.

A spec is a dict: a field ``{sel, get, re, as, all, default}``, an object ``{scope, fields}`` or a list ``{each, key, limit, fields}``.
Values come out as texts (JSON for lists and objects); casts are Columns and run after.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from harrow.functions import casts
from harrow.functions.capture import Capture
from harrow.functions.html import Element, Page, hidden, signature, stable_selector, structure, value_of

VISIBLE_TEXT = 8000


def stripped(html: Column) -> Column:
    """A frozen page without scripts and http-equiv metas."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", ""), r"(?i)<meta[^>]+http-equiv[^>]*>", "")


def _cast(v: str | None, spec: dict, url: str):
    if v is not None and spec.get("re"):
        m = re.search(spec["re"], v)
        v = None if m is None else m[1] if m.re.groups and m[1] is not None else m[0]
    return casts.plain(v, spec.get("as", "string"), url)


def field_value(page: Page, spec: dict, root: Element | None, url: str):
    found = page.select(spec["sel"], root, None if spec.get("all") else 1) if spec.get("sel") else [root if root is not None else page.root]
    values = [_cast(value_of(e, spec.get("get", "text"), url, page), spec, url) for e in found]
    values = [v for v in values if v is not None and v != ""]
    return values if spec.get("all") else values[0] if values else spec.get("default")


def node_value(page: Page, spec: dict, root: Element | None, url: str):
    if "each" in spec:
        out, seen = [], set()
        for e in page.select(spec["each"], root):
            item = {k: node_value(page, s, e, url) for k, s in spec.get("fields", {}).items()}
            if "key" in spec:
                k = item.get(spec["key"])
                if k is None or k in seen:
                    continue
                seen.add(k)
            out.append(item)
            if spec.get("limit") and len(out) >= spec["limit"]:
                break
        return out
    if "fields" in spec:
        scope = page.first(spec["scope"], root) if spec.get("scope") else root
        return None if spec.get("scope") and scope is None else {k: node_value(page, s, scope, url) for k, s in spec["fields"].items()}
    return field_value(page, spec, root, url)


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


#: Rows of a batch that goes back to Spark, and characters of pages that give one: a task holds one tree and so many rows, however many pages it reads.
OUT_ROWS, OUT_CHARS = 2_000, 1 << 20


def _each_page(pages: DataFrame, rows, schema: str) -> DataFrame:
    """Rows of each page from ``rows(page_id, url, page)``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for batch in batches:
            for i, u, h in zip(*batch.columns):
                html, page_id = h.as_py() or "", i.as_py()
                page = Page(html)
                for r in rows(page_id, u.as_py() or "", page):
                    out.append(r)
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out, chars = [], 0
                page.release()
                chars += len(html)
                if chars >= OUT_CHARS:
                    yield batch_of(out)
                    out, chars = [], 0
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(kinds)
        held = [[v if v is None else list(v.items()) for v in c] if pa.types.is_map(t) else list(c) for c, t in zip(columns, kinds.types)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds.types)], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return pages.select("page_id", "url", "html").mapInArrow(parse, schema)


def extracted(pages: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """(page_id, url, one text per field): lists and objects as JSON."""
    schema = "page_id long, url string, " + ", ".join(f"{k} string" for k in fields)
    return _each_page(pages, lambda i, u, p: [(i, u, *[_text(node_value(p, s, None, u)) for s in fields.values()])], schema)


def list_rows(pages: DataFrame, name: str, spec: dict) -> DataFrame:
    """(page_id, list, pos, one text per field) of a list spec."""
    names = list(spec["fields"])
    schema = "page_id long, list string, pos int, " + ", ".join(f"{k} string" for k in names)
    return _each_page(pages, lambda i, u, p: [(i, name, k, *[_text(x[f]) for f in names]) for k, x in enumerate(node_value(p, spec, None, u))], schema)


def view_matches(page: Page, match: dict, path: str) -> bool:
    if match.get("path") and not re.search(match["path"], path):
        return False
    if match.get("selector") and page.first(match["selector"]) is None:
        return False
    if match.get("absent") and page.first(match["absent"]) is not None:
        return False
    if match.get("text"):
        body = page.first("body")
        return bool(re.search(match["text"], (body.text() if body else "")[:VISIBLE_TEXT], re.I))
    return True


def model_of(page: Page, view: dict, url: str) -> dict:
    model: dict = {}
    for pointer, spec in view.get("model", {}).items():
        *outer, last = pointer.strip("/").split("/")
        at = model
        for k in outer:
            at = at.setdefault(k, {})
        at[last] = node_value(page, spec, None, url)
    return model


def snapshots(pages: DataFrame, views: dict[str, dict]) -> DataFrame:
    """(page_id, url, path, view, model, interrupts): the first declared view that matches, and interrupt views apart from it."""

    def rows(i, url, page):
        path = urlsplit(url).path
        found = [v for v, s in views.items() if view_matches(page, s.get("match", {}), path)]
        view = next((v for v in found if not views[v].get("interrupt")), None)
        model = model_of(page, views[view], url) if view else {}
        over = [{"id": v, "model": _text(model_of(page, views[v], url))} for v in found if views[v].get("interrupt")]
        return [(i, url, path, view, _text(model), over)]

    return _each_page(pages, rows, "page_id long, url string, path string, view string, model string, interrupts array<struct<id:string,model:string>>")


def facets(pages: DataFrame, views: dict[str, dict]) -> DataFrame:
    """(page_id, view, pointer, kind, hits, samples): coverage of each pointer; without a match the view with most hits."""

    def rows(i, url, page):
        path = urlsplit(url).path
        hits = {v: {p: _facet(page, spec, url) for p, spec in s.get("model", {}).items()} for v, s in views.items()}
        view = next((v for v, s in views.items() if not s.get("interrupt") and view_matches(page, s.get("match", {}), path)), None)
        view = view or max(hits, key=lambda v: sum(h[1] for h in hits[v].values()), default=None)
        return [(i, view, p, kind, n, samples) for p, (kind, n, samples) in hits.get(view, {}).items()]

    return _each_page(pages, rows, "page_id long, view string, pointer string, kind string, hits int, samples array<string>")


def _facet(page: Page, spec: dict, url: str) -> tuple[str, int, list[str]]:
    if "each" in spec:
        found = page.select(spec["each"])
        return "list", len(found), [e.text()[:60] for e in found[:3]]
    if "fields" in spec:
        return "object", int(page.first(spec["scope"]) is not None) if spec.get("scope") else 1, []
    found = page.select(spec["sel"]) if spec.get("sel") else [page.root]
    return "field", len(found), [(_text(_cast(value_of(e, spec.get("get", "text"), url, page), spec, url)) or "")[:60] for e in found[:3]]


def selector_hits(pages: DataFrame, views: dict[str, dict]) -> DataFrame:
    """(page_id, view, pointer, hits, list_root, empty_list): fields of an empty list and list roots are not broken."""

    def rows(i, url, page):
        for v, s in views.items():
            for p, spec in s.get("model", {}).items():
                if "each" in spec:
                    items = page.select(spec["each"])
                    yield (i, v, p, len(items), True, not items)
                    for f, sub in spec.get("fields", {}).items():
                        yield (i, v, f"{p}/*/{f}", sum(1 for e in items if not sub.get("sel") or page.first(sub["sel"], e)), False, not items)
                else:
                    yield (i, v, p, len(page.select(spec["sel"])) if spec.get("sel") else 1, False, False)

    return _each_page(pages, rows, "page_id long, view string, pointer string, hits int, list_root boolean, empty_list boolean")


def broken(hits: DataFrame) -> DataFrame:
    """Views with resolved and total fields, and the broken ones."""
    bad = (F.col("hits") == 0) & ~F.col("list_root") & ~F.col("empty_list")
    return hits.groupBy("page_id", "view").agg(F.count("*").alias("total"), F.count_if(F.col("hits") > 0).alias("resolved"), F.count_if(bad).alias("broken"))


#: Kinds of overlays and the wording that tells them apart, in order.
OVERLAYS = (
    ("captcha", r"(?i)captcha|verify you are human|drag the slider|puzzle"),
    ("cookie-banner", r"(?i)cookie|consent|gdpr|privacy choices"),
    ("login", r"(?i)log ?in|sign ?in|sign ?up|continue with"),
    ("prompt", r"(?i)notification|allow|install the app|open app"),
)
DIALOGS = "[role=dialog],[role=alertdialog],[aria-modal=true],dialog[open]"


def overlays(pages: DataFrame, most: int = 4) -> DataFrame:
    """(page_id, selector, kind, text, closers): dialogs not within another one; geometry is unknown and left out."""

    def rows(i, url, page):
        found = [e for e in page.select(DIALOGS) if not hidden(e)]
        inside = lambda e: any(up in found for up in _above(e))
        for e in [x for x in found if not inside(x)][:most]:
            text = e.text()[:200]
            kind = next((k for k, p in OVERLAYS if re.search(p, text)), "modal")
            closers = [stable_selector(page, b) for b in page.select("button,[role=button],a", e) if re.search(r"(?i)close|dismiss|not now|no thanks|×|✕", b.text() + " " + b.attrs.get("aria-label", ""))][:3]
            yield (i, stable_selector(page, e), kind, text, closers)

    return _each_page(pages, rows, "page_id long, selector string, kind string, text string, closers array<string>")


def _above(e: Element):
    while e.parent is not None:
        e = e.parent
        yield e


#: Attributes kept in the element table.
KEPT = ("id", "class", "href", "src", "alt", "title", "role", "name", "type", "aria-label", "aria-modal", "itemprop", "poster", "srcset", "style")


def elements(pages: DataFrame, most: int | None = None, chars: int | None = None) -> DataFrame:
    """(page_id, i, parent, tag, text, sig, attrs): the element table; scripts and styles are left out. Whole pages and texts unless limits are given."""

    def rows(i, url, page):
        shown = [e for e in page.all if e.tag not in ("script", "style", "noscript", "template")]
        for e in shown[:most]:
            attrs = {k: v[:chars] for k, v in e.attrs.items() if k in KEPT or k.startswith("data-")}
            yield (i, e.i, e.parent.i, e.tag, e.text(own=True)[:chars], signature(e), attrs)

    return _each_page(pages, rows, "page_id long, i int, parent int, tag string, text string, sig string, attrs map<string,string>")


def group_fields(pages: DataFrame, least: int = 3, sample: int = 12, share: float = 0.8) -> DataFrame:
    """(page_id, parent, sig, n, field): leaves, relative to the item, found in most of the first items of repeated siblings."""

    def leaves(e: Element) -> set[str]:
        out, todo = set(), [(c, signature(c)) for c in e.children]
        while todo:
            c, here = todo.pop()
            todo += [(x, f"{here} > {signature(x)}") for x in c.children]
            if not c.children:
                out.add(here)
        return out

    def rows(i, url, page):
        groups: dict[tuple[int, str], list[Element]] = {}
        for e in page.all:
            if e.parent is not None:
                groups.setdefault((e.parent.i, signature(e)), []).append(e)
        for (parent, sig), items in groups.items():
            if len(items) >= least:
                first = [leaves(e) for e in items[:sample]]
                names = sorted(set().union(*first))
                for f in names:
                    if sum(f in x for x in first) >= share * len(first):
                        yield (i, parent, sig, len(items), f)

    return _each_page(pages, rows, "page_id long, parent int, sig string, n int, field string")


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, list, selector, kind, attr, many, value, i): what may become fields and lists of a derived view. One row per single
    element (list null); per list one of kind ``item``, and one per value of a field that most of its items share."""

    def rows(i, url, page):
        found = Capture(page)
        for name, first, leaves in found.lists(url):
            yield (i, url, name, "", "item", None, False, None, first)
            for (kind, selector), (at, values) in leaves.items():
                for v in values:
                    yield (i, url, name, selector, kind, None, False, v, at)
        for selector, kind, attr, many, value, at in found.singles(url):
            yield (i, url, None, selector, kind, attr, many, value, at)

    return _each_page(pages, rows, "page_id long, url string, list string, selector string, kind string, attr string, many boolean, value string, i int")


def blocked(pages: DataFrame, selectors: list[str], texts: list[str]) -> DataFrame:
    """(page_id, hit): the first blocking selector or text pattern, null for none."""

    def rows(i, url, page):
        hit = next((s for s in selectors if page.first(s)), None)
        if hit is None and texts:
            body = page.first("body")
            hit = next((t for t in texts if re.search(t, body.text() if body else "", re.I)), None)
        return [(i, hit)]

    return _each_page(pages, rows, "page_id long, hit string")


def structures(pages: DataFrame) -> DataFrame:
    """(page_id, shape): structure tokens, repeated sibling subtrees once."""
    return _each_page(pages, lambda i, u, p: [(i, structure(p.root))], "page_id long, shape array<string>")


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, url, method, body): embedded JSON as pseudo-responses ``inline:<id>``, ``ld+json:<i>`` or ``json:<i>``; i counts the JSON scripts."""

    def rows(i, url, page):
        for n, e in enumerate(page.select('script[type="application/json"],script[type="application/ld+json"],script[id^="__"]')):
            body = e.raw().strip()
            if len(body) > 2:
                name = e.attrs.get("id") or ("ld+json:" if "ld+json" in e.attrs.get("type", "") else "json:") + str(n)
                yield (i, f"inline:{name}", "INLINE", body)

    return _each_page(pages, rows, "page_id long, url string, method string, body string")


def role_tokens(nodes: DataFrame) -> DataFrame:
    """(page_id, ax): preorder ``depth:role`` tokens from (page_id, node_id, parent_id, pos, role, ignored); skipped roles add no depth.

    Nodes stream by in order of their pages; a task holds the nodes of one page.
    """
    skipped = {"", "none", "generic", "presentation", "InlineTextBox", "StaticText"}
    names = ("page_id", "node_id", "parent_id", "role", "ignored")

    def told(kids: dict) -> list[str]:
        out: list[str] = []
        todo = [(iter(kids.get(None, ())), 0, set(), 0)]  # children to come, their depth, what stood among them, where the parent began
        while todo:
            rest, depth, seen, begun = todo[-1]
            node = next(rest, None)
            if node is not None:
                own, role, ignored = node
                shown = not ignored and role not in skipped
                todo.append((iter(kids.get(own, ()) if own is not None else ()), depth + shown, set(), len(out)))
                out += [f"{depth}:{role}"] if shown else []
                continue
            todo.pop()
            if todo:
                tokens, among = tuple(out[begun:]), todo[-1][2]
                if tokens and tokens in among:
                    del out[begun:]
                among.add(tokens)
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kids = None, None
        batch_of = lambda done: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([ax for _, ax in done], pa.list_(pa.string()))], ["page_id", "ax"])
        for batch in batches:
            done = []
            for page, own, parent, role, ignored in zip(*[batch.column(c).to_pylist() for c in names]):
                if kids is None or page != now:
                    if kids is not None:
                        done.append((now, told(kids)))
                    now, kids = page, {}
                kids.setdefault(parent, []).append((own, role, ignored))
            yield batch_of(done)
        if kids is not None:
            yield batch_of([(now, told(kids))])

    dealt = nodes.select(F.col("page_id").cast("long").alias("page_id"), "node_id", "parent_id", "pos", "role", "ignored").repartition("page_id").sortWithinPartitions("page_id", F.asc_nulls_last("pos"), "node_id")
    return dealt.select(*names).mapInArrow(walk, "page_id long, ax array<string>")


def articles(pages: DataFrame) -> DataFrame:
    """Title, heading and links of each article page, with typed columns."""
    out = extracted(pages, {"title": {"sel": "title"}, "heading": {"sel": "h1"}, "links": {"sel": "nav a", "get": "attr:href", "all": True}})
    return out.withColumn("links", F.coalesce(F.from_json("links", "array<string>"), F.array().cast("array<string>"))).withColumn("host", casts.host(F.col("url")))
