"""A page as a tree of elements, and a selector engine over it. Used inside tasks, one page at a time."""

from __future__ import annotations

import functools
import html as entities
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "p": set("p div ul ol table h1 h2 h3 h4 h5 h6 article section header footer nav aside form blockquote pre main".split()), "td": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
UNSEEN = {"script", "style", "noscript", "template"}


@dataclass(eq=False)
class Element:
    i: int
    tag: str
    attrs: dict[str, str]
    parent: Element | None
    children: list[Element] = field(default_factory=list)
    parts: list = field(default_factory=list)  # texts and elements in order

    def text(self, own: bool = False) -> str:
        return " ".join("".join(_texts(self, own)).split())

    def raw(self) -> str:
        return "".join(p for p in self.parts if isinstance(p, str))


def _texts(e: Element, own: bool):
    todo = [iter(e.parts)]
    while todo:
        p = next(todo[-1], None)
        if p is None:
            todo.pop()
        elif isinstance(p, str):
            yield p
        elif not own and p.tag not in UNSEEN:
            yield " " if p.tag in ("br", "p", "div", "li") else ""
            todo.append(iter(p.parts))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element(0, "#document", {}, None)
        self.all: list[Element] = []
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        top = self.open[-1]
        e = Element(len(self.all) + 1, tag, {k: v or "" for k, v in reversed(attrs)}, top)
        top.children.append(e)
        top.parts.append(e)
        self.all.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


class Page:
    def __init__(self, text: str):
        b = _Builder()
        b.feed(text or "")
        b.close()
        self.root, self.all = b.root, b.all

    def release(self) -> None:
        """Undo the ties from elements to those above them: the tree's memory is free at once, not when Python next looks for cycles."""
        for e in self.all:
            e.parent = None

    def select(self, selector: str, scope: Element | None = None, limit: int | None = None) -> list[Element]:
        out = []
        for e in self.all if scope is None else descendants(scope):
            if any(matches(e, chain, scope) for chain in compiled(selector)):
                out.append(e)
                if limit and len(out) == limit:
                    break
        return out

    def first(self, selector: str, scope: Element | None = None) -> Element | None:
        found = self.select(selector, scope, 1)
        return found[0] if found else None


def descendants(e: Element):
    todo = e.children[::-1]
    while todo:
        c = todo.pop()
        yield c
        todo += reversed(c.children)


_SIMPLE = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[is])?)?\s*\]|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^)]*)\))?"""
)


@functools.lru_cache(maxsize=512)
def compiled(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Chains of (combinator, simple selectors); an unknown form raises."""
    out = []
    for part in re.split(r",(?![^\[(]*[\])])", selector):
        chain, combinator, at, part = [], " ", 0, part.strip()
        simple: list[dict] = []
        while at < len(part):
            if m := re.compile(r"\s*>\s*|\s+").match(part, at):
                chain.append((combinator, simple))
                combinator, simple, at = (">" if ">" in m[0] else " "), [], m.end()
                continue
            m = _SIMPLE.match(part, at)
            if not m:
                raise ValueError(f"selector {selector!r} is not supported at {part[at:]!r}")
            simple.append({k: v for k, v in m.groupdict().items() if v is not None})
            at = m.end()
        chain.append((combinator, simple))
        out.append(chain)
    return out


def _is(e: Element, s: dict, scope: Element | None) -> bool:
    if "tag" in s:
        return s["tag"] == "*" or e.tag == s["tag"].lower()
    if "id" in s:
        return e.attrs.get("id") == s["id"]
    if "cls" in s:
        return s["cls"] in e.attrs.get("class", "").split()
    if "attr" in s:
        have = e.attrs.get(s["attr"].lower())
        if have is None or "op" not in s:
            return have is not None
        want = s["value"].strip("\"'")
        if s.get("flag") == "i":
            have, want = have.lower(), want.lower()
        return {"=": have == want, "*=": want != "" and want in have, "^=": want != "" and have.startswith(want), "$=": want != "" and have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[s["op"]]
    kin = [x for x in e.parent.children] if e.parent else [e]
    name = s["pseudo"]
    if name == "scope":
        return e is scope
    if name == "first-child":
        return kin[0] is e
    if name == "last-child":
        return kin[-1] is e
    if name == "nth-of-type":
        return [x for x in kin if x.tag == e.tag].index(e) + 1 == int(s["arg"])
    if name == "nth-child":
        return kin.index(e) + 1 == int(s["arg"])
    raise ValueError(f":{name} is not supported")


def matches(e: Element, chain, scope: Element | None) -> bool:
    def fits(e: Element | None, k: int) -> bool:
        combinator, simple = chain[k]
        if e is None or not all(_is(e, s, scope) for s in simple):
            return False
        if k == 0:
            return True
        if combinator == ">":
            return fits(e.parent, k - 1)
        up = e.parent
        while up is not None:
            if fits(up, k - 1):
                return True
            up = up.parent
        return False

    return fits(e, len(chain) - 1)


def value_of(e: Element, get: str, url: str, page: Page) -> str | None:
    if get == "text":
        return e.text()
    if get == "src":
        img = e if e.tag in ("img", "video") else page.first("img,video", e)
        if img is None:
            return None
        return img.attrs.get("src") or img.attrs.get("poster") or (img.attrs.get("srcset", "").split() or [None])[0]
    if get == "bg":
        m = re.search(r"url\([\"']?([^\"')]+)", e.attrs.get("style", ""))
        return m[1] if m else None
    if get == "html":
        return inner_html(e)
    if get == "location":
        return url
    if get.startswith("attr:"):
        return e.attrs.get(get[5:])
    if get.startswith("json:"):
        try:
            at = json.loads(e.raw())
            for k in [x.replace("~1", "/").replace("~0", "~") for x in get[5:].strip("/").split("/") if x]:
                at = at[int(k)] if isinstance(at, list) else at[k]
        except (ValueError, KeyError, IndexError, TypeError):
            return None
        return at if isinstance(at, str) else None if at is None else json.dumps(at, separators=(",", ":"))
    return None


def inner_html(e: Element) -> str:
    out: list[str] = []
    todo = [(e, iter(e.parts))]
    while todo:
        at, parts = todo[-1]
        p = next(parts, None)
        if p is None:
            todo.pop()
            out.append(f"</{at.tag}>" if todo else "")
        elif isinstance(p, str):
            out.append(p if at.tag in ("script", "style") else entities.escape(p, quote=False))
        else:
            out.append("<" + p.tag + "".join(f' {k}="{entities.escape(v)}"' for k, v in p.attrs.items()) + ">")
            if p.tag not in VOID:
                todo.append((p, iter(p.parts)))
    return "".join(out)


def signature(e: Element) -> str:
    """Tag and sorted classes with digits made alike: what repeated siblings share."""
    return e.tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(e.attrs.get("class", "").split())))


def hidden(e: Element) -> bool:
    return "hidden" in e.attrs or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", e.attrs.get("style", "")))


def structure(root: Element) -> list[str]:
    """Preorder ``depth:tag`` tokens; equal sibling subtrees once. Subtrees are compared by numbers given to each form, children first."""
    order, todo = [], [(root, 0)]
    while todo:
        e, depth = todo.pop()
        order.append((e, depth))
        todo += [(c, depth + 1) for c in reversed(e.children)]
    forms: dict[tuple, int] = {}
    form: dict[int, int] = {}
    kept: dict[int, list[Element]] = {}
    for e, _ in reversed(order):  # what is below comes first
        once = {form[c.i]: c for c in reversed(e.children)}
        kept[e.i] = sorted(once.values(), key=lambda c: c.i)
        form[e.i] = forms.setdefault((e.tag, *(form[c.i] for c in kept[e.i])), len(forms))
    out, todo = [], [(c, 0) for c in reversed(kept[root.i])]
    while todo:
        e, depth = todo.pop()
        out.append(f"{depth}:{e.tag}")
        todo += [(c, depth + 1) for c in reversed(kept[e.i])]
    return out


def stable_selector(page: Page, e: Element) -> str:
    """An id, a telling attribute or class that is unique in the page, else a short structural path."""
    telling = lambda s: s and not re.search(r"\d{3,}|[0-9a-f]{8,}", s)
    options = [f"#{e.attrs['id']}"] if telling(e.attrs.get("id")) and re.fullmatch(r"[\w-]+", e.attrs["id"]) else []
    options += [f'[{k}="{v}"]' for k, v in e.attrs.items() if (k.startswith("data-") or k in ("name", "role", "itemprop", "aria-label")) and telling(v) and '"' not in v]
    options += [f"{e.tag}.{c}" for c in e.attrs.get("class", "").split() if telling(c) and re.fullmatch(r"[\w-]+", c)]
    for s in options:
        if len(page.select(s, limit=2)) == 1:
            return s
    path, at = [], e
    while at is not None and at.parent is not None and len(path) < 6:
        kin = [x for x in at.parent.children if x.tag == at.tag]
        path.insert(0, at.tag if len(kin) == 1 else f"{at.tag}:nth-of-type({kin.index(at) + 1})")
        if len(page.select(" > ".join(path), limit=2)) == 1:
            break
        at = at.parent
    return " > ".join(path)
