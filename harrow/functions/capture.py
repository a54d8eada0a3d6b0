"""What a page offers to a derived view: lists of repeated items with the leaves that most items share, and single telling elements,
each by a selector that lasts. Used inside tasks, one page at a time; all items and whole texts are taken.

A stored page has no sizes on a screen: font sizes are those of the default style sheet and of inline styles, tests of areas are left out.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from harrow.functions.html import UNSEEN, Element, Page, descendants, hidden, value_of

#: Siblings that make a list, share of its items that have a field, elements that a field of many values may have, steps of a path, size of telling text.
LEAST, SHARE, MANY, STEPS, LARGE = 3, 0.8, 12, 6, 20.0
HEAD = {"head", "title", "meta", "link", "base"}
FRAME = {"html", "body"}
CHROME = {"header", "nav", "footer", "form"}
NO_FIELD = {"script", "style", "svg", "path", "button", "input"}
FILMS = {"canvas", "video"}
FONTS = {"h1": 2.0, "h2": 1.5, "h3": 1.17, "h5": 0.83, "h6": 0.67, "small": 5 / 6, "sub": 5 / 6, "sup": 5 / 6, "big": 1.2}
UNITS = {"px": 1.0, "pt": 4 / 3}
BLOCKS = set("br p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table tr td th section article header footer nav aside main figure figcaption blockquote pre form hr address".split())
STABLE = ("data-e2e", "data-testid", "data-test", "data-qa", "aria-label", "name", "role", "itemprop")


def escaped(name: str) -> str:
    name = re.sub(r"([^\w-])", r"\\\1", name)
    return f"\\3{name[0]} {name[1:]}" if name[:1].isdigit() else name


def generated(name: str) -> bool:
    return len(name) >= 5 and bool(re.search(r"\d", name) and re.search(r"[A-Za-z]", name)) and not re.fullmatch(r"[A-Za-z]+(-[A-Za-z]+)*\d*", name)


def class_parts(e: Element) -> list[str]:
    """Classes that last: the telling end of a generated one, and those that are not generated."""
    out = []
    for c in e.attrs.get("class", "").split():
        m = re.fullmatch(r"css-[a-z0-9]+-(?:[a-z0-9]+-)*-?([A-Za-z][A-Za-z0-9]*)", c)
        if m:
            out.append(f'[class*="-{m[1]}"]')
        elif not generated(c) and len(c) < 40:
            out.append("." + escaped(c))
    return out


def attribute_parts(e: Element, names: tuple[str, ...]) -> list[str]:
    return [f'[{a}="{v}"]' for a in names if (v := re.sub(r'(["\\])', r"\\\1", e.attrs.get(a, "")))]


def local_selectors(e: Element) -> list[str]:
    """An id, attributes and classes of an element that pages of one kind share."""
    tag, own = escaped(e.tag), e.attrs.get("id", "")
    lasting = tuple(a for a in STABLE if len(e.attrs.get(a, "")) < 60 and not (a == "aria-label" and re.search(r"\d{3,}", e.attrs.get(a, ""))))
    out = ["#" + escaped(own)] if own and not generated(own) and not own[0].isdigit() else []
    return list(dict.fromkeys(out + [tag + p for p in (*attribute_parts(e, lasting), *class_parts(e))]))


def alike(e: Element) -> str:
    """What repeated siblings share: the tag with its lasting attributes, or else with its first class."""
    return escaped(e.tag) + ("".join(attribute_parts(e, tuple(a for a in STABLE if a != "aria-label"))) or "".join(class_parts(e)[:1]))


def font_size(e: Element, above: float) -> float:
    """Pixels, by an inline style or else the default style sheet, under an element of size ``above``."""
    m = re.search(r"font-size\s*:\s*(\d+\.?\d*|\.\d+)\s*(px|pt|r?em|%)", e.attrs.get("style", ""), re.I)
    if not m:
        return above * FONTS.get(e.tag, 1.0)
    n, unit = float(m[1]), m[2].lower()
    return n * UNITS[unit] if unit in UNITS else n * 16 if unit == "rem" else n * above / (100 if unit == "%" else 1)


class Selectors:
    """Selectors of elements in a scope: below ``top``. What each part of a selector meets is counted once."""

    def __init__(self, top: Element, elements: list[Element], parts: list[tuple[list[str], list[str]]]):
        self.top, self.parts, self.met, self.paths = top, parts, {}, {}
        for e in elements:
            for s in (*parts[e.i][0], *parts[e.i][1]):
                self.met.setdefault(s, []).append(e)

    def count(self, part: str) -> int:
        return len(self.met.get(part, ()))

    def along(self, path: tuple[str, ...]) -> list[Element]:
        if len(path) == 1:
            return self.met.get(path[0], [])
        if path not in self.paths:
            last = path[-1]
            self.paths[path] = [c for p in self.along(path[:-1]) for c in p.children if last in self.parts[c.i][0] or last in self.parts[c.i][1]]
        return self.paths[path]

    def stable(self, e: Element) -> str:
        """A local selector that no other element of the scope has, else a short path down from the nearest element that makes it the only one."""
        for s in self.parts[e.i][0]:
            if self.count(s) == 1:
                return s
        path: tuple[str, ...] = ()
        while e is not self.top and e.parent is not None and len(path) < STEPS:
            own, placed = self.parts[e.i]
            path = (own[0] if own else placed[-1], *path)
            if len(self.along(path)) == 1:
                break
            e = e.parent
        return " > ".join(path)


def _parts(page: Page) -> list[tuple[list[str], list[str]]]:
    """Of each element by number: its local selectors, and its tag with and without its place; last the one that a path takes, the place if it has kin."""
    out: list[tuple[list[str], list[str]]] = [([], [])] * (len(page.all) + 1)
    for parent in (page.root, *page.all):
        places: dict[str, list[Element]] = {}
        for c in parent.children:
            places.setdefault(escaped(c.tag), []).append(c)
        for tag, kin in places.items():
            for k, c in enumerate(kin, 1):
                placed = f"{tag}:nth-of-type({k})"
                out[c.i] = (local_selectors(c), [placed, tag] if len(kin) == 1 else [tag, placed])
    return out


class Capture:
    """The lists and single elements of a page; ``lists`` comes first, for single elements lie outside of lists."""

    def __init__(self, page: Page):
        n = len(page.all) + 1
        self.page, self.parts = page, _parts(page)
        self.selectors = Selectors(page.root, page.all, self.parts)
        self.out, self.chrome, self.font = [False] * n, [False] * n, [16.0] * n
        self.text, self.media, self.linked = [False] * n, [False] * n, [False] * n
        self.members: set[int] = set()
        for e in page.all:
            up = e.parent.i
            self.out[e.i] = self.out[up] or e.tag in UNSEEN or e.tag in HEAD or hidden(e)
            named = e.attrs.get("class", "")
            self.chrome[e.i] = self.chrome[up] or e.tag in CHROME or e.attrs.get("role") in ("banner", "navigation") or "Header" in named or "Nav" in named
            self.font[e.i] = font_size(e, self.font[up])
        for e in reversed(page.all):
            if self.out[e.i]:
                continue
            up = e.parent.i
            self.text[e.i] = self.text[e.i] or bool(e.raw().strip())
            self.media[e.i] = self.media[e.i] or e.tag == "img" or e.tag in FILMS
            self.linked[e.i] = self.linked[e.i] or e.tag in ("a", "img")
            for flags in (self.text, self.media, self.linked):
                flags[up] = flags[up] or flags[e.i]

    def seen(self, e: Element) -> bool:
        return not self.out[e.i] and (self.text[e.i] or self.media[e.i])

    def lists(self, url: str) -> list[tuple[str, int, dict[tuple[str, str], tuple[int, list[str]]]]]:
        """(selector, number of its first item, fields by kind and selector within the item: number of the first, values) of lists that hold
        links or images and lie in no item of another one. Groups of a page that share a selector are one list."""
        often = lambda leaves, n: {k: (i, values) for k, (i, held, values) in leaves.items() if len(held) >= math.ceil(SHARE * n)}
        found: dict[str, tuple] = {}
        within = [False] * (len(self.page.all) + 1)
        for parent in self.page.all:
            within[parent.i] = within[parent.i] or within[parent.parent.i]
            if within[parent.i] or self.out[parent.i] or parent.tag in FRAME:
                continue
            groups: dict[str, list[Element]] = {}
            for c in parent.children:
                if self.seen(c):
                    groups.setdefault(alike(c), []).append(c)
            for form, items in groups.items():
                if len(items) < LEAST or sum(self.linked[c.i] for c in items) < SHARE * len(items):
                    continue
                leaves = self.leaves(items, url)
                if all(kind == "text" for kind, _ in often(leaves, len(items))):
                    continue
                selector = self.list_selector(parent, form, items)
                first, n, whole = found.get(selector, (items[0].i, 0, {}))
                for key, (i, held, values) in leaves.items():
                    told = whole.setdefault(key, (i, set(), []))
                    told[1].update(held)
                    told[2].extend(values)
                found[selector] = (first, n + len(items), whole)
                for c in items:
                    within[c.i] = True
                self.members.update(c.i for c in items)
                self.members.update(e.i for e in self.selectors.met.get(selector, ()))
        return [(s, i, often(leaves, n)) for s, (i, n, leaves) in found.items()]

    def leaves(self, items: list[Element], url: str) -> dict[tuple[str, str], tuple[int, set[int], list[str]]]:
        """Images, links and other elements with own text, by kind and selector within their item: number of the first, items, values."""
        out: dict[tuple[str, str], tuple[int, set[int], list[str]]] = {}
        for item in items:
            below = list(descendants(item))
            selectors = Selectors(item, below, self.parts)
            for e in (item, *below):
                if not self.seen(e):
                    continue
                kind = "image" if e.tag == "img" else "link" if e.tag == "a" else "text" if e.raw().strip() else None
                if kind is not None:
                    value = value_of(e, "src", url, self.page) if kind == "image" else e.attrs.get("href") if kind == "link" else e.text(own=True)
                    told = out.setdefault((kind, "" if e is item else selectors.stable(e)), (e.i, set(), []))
                    told[1].add(item.i)
                    told[2].append(value or "")
        return out

    def list_selector(self, parent: Element, form: str, items: list[Element]) -> str:
        own = next((s for s in self.parts[items[0].i][0] if all(s in self.parts[c.i][0] for c in items)), None)
        return own or f"{self.selectors.stable(parent)} > {form}"

    def words(self, e: Element) -> str:
        """The text of an element without what is hidden in it."""
        out, blocks, todo = [], [], [iter(e.parts)]
        while todo:
            p = next(todo[-1], None)
            if p is None:
                todo.pop()
                out.append(" " if todo and blocks.pop() else "")
            elif isinstance(p, str):
                out.append(p)
            elif not self.out[p.i]:
                blocks.append(p.tag in BLOCKS)
                out.append(" " if blocks[-1] else "")
                todo.append(iter(p.parts))
        return " ".join("".join(out).split())

    def singles(self, url: str) -> Iterator[tuple[str, str, str | None, bool, str, int]]:
        """(selector, kind, telling attribute, whether of many values, value, number): elements with a local selector or large text, outside of
        the page's frame and of lists. Of texts that hold another candidate or an item only what they hold is taken."""
        n = len(self.page.all) + 1
        listed, around, taken, chosen = [False] * n, [False] * n, set(), []
        for e in self.page.all:
            listed[e.i] = listed[e.parent.i] or e.i in self.members
            own = self.parts[e.i][0]
            image, film = e.tag == "img", e.tag in FILMS
            if listed[e.i] or self.chrome[e.i] or e.tag in NO_FIELD or e.tag in FRAME or not self.seen(e) or not (image or film or self.text[e.i]):
                continue
            if not own and not (self.font[e.i] >= LARGE and e.raw().strip()):
                continue
            selector = next((s for s in own if self.selectors.count(s) == 1), None)
            many = selector is None and next((s for s in own if self.selectors.count(s) <= MANY), None)
            selector = selector or many or self.selectors.stable(e)
            if selector not in taken:
                taken.add(selector)
                chosen.append((e, selector, "image" if image else "canvas" if film else "text", bool(many)))
        alone = {e.i for e, _, _, many in chosen if not many}
        for e in reversed(self.page.all):
            up = e.parent.i
            around[up] = around[up] or around[e.i] or e.i in alone or e.i in self.members
        for e, selector, kind, many in chosen:
            if kind == "text" and not many and around[e.i]:
                continue
            told = lambda x: "" if kind == "canvas" else (value_of(x, "src", url, self.page) or "") if kind == "image" else self.words(x)  # noqa: B023, E731
            value = json.dumps([told(x) for x in self.selectors.met[selector]], ensure_ascii=False) if many else told(e)
            yield selector, kind, e.attrs.get("data-e2e") or e.attrs.get("aria-label") or None, many, value, e.i
