"""Main text of web pages by consensus host paths.

1. Each page's containers are scored by the text of their own blocks, links counting against it; the best one gives the
   page's vote: a digest of its path of generalised tag-class steps (digits in classes become ``#``).
2. Spark counts the votes per (host, path), partly before the shuffle, and keeps one path per host. The pages don't move for
   it: the winners are broadcast if their measured size is at most ``BROADCAST_BYTES``; more hosts than that are joined with
   pages dealt by host and salt, so that a large host is no hot key.
3. Each page is read again with its host's path; a page without such a container uses its own best one. Either is widened to
   the articles and mains around it, and to other containers around it while what they add is text rather than links.

A page is parsed in its own row, in time and memory in proportion to its length: containers hold ranges of blocks, paths are
digests, and open elements are found by tag. Nothing gathers pages. The votes are one row per (host, path); ties go to the
higher summed score, then to the larger digest. A header within an article belongs to it; other headers are left out.

Class words such as ``sidebar`` or ``comments`` make a part doubtful, not void: ``settled`` drops it beside other text and keeps it
where it holds the page's text itself. Text outside any body belongs to an implied one around the page.

Cases: null or empty html gives an empty text; a page without text blocks gives an empty text; a null url belongs to the
host ``''``; repeated rows each give a row; broken markup is read as browsers do in the common cases (unclosed p, b, li, a;
no body or text behind its end).
Other columns are kept by ``extract`` unless they are called ``text`` or ``n_chars``, which are replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import keep, table

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")

#: Elements whose content is no markup, that have no end, that break a line of text, and that hold blocks.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td blockquote center".split())
CLOSES_P = BLOCKS - {"html", "body"}
#: Parts of a page that are no article text, by element, role and word in class or id.
SKIP = set("nav header footer aside script style noscript template iframe select button textarea menu dialog svg math head title object audio video canvas".split())
SKIP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_EDGE, _END = r"(?:^|[\s_-])(?:", r")(?=$|[\s_-])"
SKIP_WORDS = re.compile(
    _EDGE + r"ads?|advert\w*|sponsor\w*|promo\w*|banner|breadcrumbs?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"toolbar|pagination|pager|feedback|search\w*|copyright|skip|hidden|disclaimer|outbrain|taboola" + _END,
    re.I,
)
#: Words that name a part of a layout as well as the layout around the article, and among them those of reader comments.
COMMENT_WORDS = re.compile(_EDGE + r"comments?|commentlist|discussion|disqus|replies|reply|respond" + _END, re.I)
LAYOUT_WORDS = re.compile(_EDGE + r"nav\w*|menu\w*|sidebars?|side|aside|footer|header|masthead|share|sharing|social|related|recommended|recommendations|widget\w*" + _END, re.I)
#: Names that deny or only mention a part, and words of the article's own containers.
MENTIONS = re.compile(r"(?:^|(?<=\s))(?:(?:no|has|have|with|without)[_-]\S*|\S*[_-](?:free|off|none|closed|disabled)(?!\S))", re.I)
CONTENT_WORDS = re.compile(_EDGE + r"content|entry|article|post|story|body|main|text|prose" + _END, re.I)

#: Least characters outside links of a doubtful part that is kept.
LEAST_TEXT = 200

#: Bytes of host paths that are broadcast; parts of each host beyond that.
BROADCAST_BYTES, SALTS = 32 << 20, 16


@dataclass
class Node:
    tag: str
    step: str
    skipped: bool
    holder: int = -1  # the container it opened
    doubt: str = ""  # "layout", "content" (a layout word beside a content word) or "comments"
    doubted: int = -1  # the doubtful part it opened
    link: bool = False


@dataclass
class Container:
    path: str
    parent: int
    article: bool
    first: int  # its blocks are a stretch of the page's blocks
    end: int = -1
    score: float = 0.0


@dataclass
class Doubt:
    kind: str
    parent: int  # the doubtful part around it, or -1
    own: int = 0  # characters outside links, in no further doubtful part
    text: int = 0  # all of them
    main: bool = False  # holds a main element
    kept: bool = False


@dataclass
class Page:
    """Containers and text blocks in page order; characters of the first k blocks, and those of them within links."""

    containers: list[Container]
    blocks: list[str]
    sizes: list[int]
    linked: list[int]

    def size(self, k: int) -> tuple[int, int]:
        c = self.containers[k]
        return self.sizes[c.end] - self.sizes[c.first], self.linked[c.end] - self.linked[c.first]


def attributes(text: str) -> dict[str, str]:
    if "=" not in text:
        return {w.lower(): "" for w in text.strip(" />\t\n\r\f").split()}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} | ({"hidden": ""} if re.search(r"\shidden(?=[\s/>]|$)", text) else {})


def generalised(tag: str, cls: str) -> str:
    """A step of a path: the tag with its classes, digits made alike."""
    return tag + "".join("." + re.sub(r"\d+", "#", c.lower()) for c in sorted(set(cls.split())))


def node(tag: str, rest: str, in_article: bool) -> Node:
    found = attributes(rest) if rest.strip(" />") else {}
    cls, name = found.get("class", ""), found.get("id", "")
    skipped = (
        (tag in SKIP and not (tag == "header" and in_article))
        or found.get("role", "").lower() in SKIP_ROLES
        or "hidden" in found
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    )
    doubt = ""
    if tag not in ("html", "body", "article", "main"):
        names = [MENTIONS.sub("", x) for x in (cls, name)]
        skipped = skipped or any(map(SKIP_WORDS.search, names))
        if any(map(COMMENT_WORDS.search, names)):
            doubt = "comments"
        elif tag == "form" or found.get("role", "").lower() == "form" or any(map(LAYOUT_WORDS.search, names)):
            doubt = "content" if any(map(CONTENT_WORDS.search, names)) else "layout"
    return Node(tag, generalised(tag, cls), skipped, doubt=doubt, link=tag == "a" and "href" in found)


def longer(path: str, step: str) -> str:
    """The digest of a path with one step more."""
    return hashlib.blake2b(f"{path}>{step}".encode(), digest_size=12).hexdigest()


class Open:
    """The open elements, and where those of each tag stand."""

    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.holders: list[int] = []  # open containers
        self.doubts: list[int] = []  # open doubtful parts
        self.skipped = self.links = 0

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def push(self, new: Node) -> None:
        self.places[new.tag].append(len(self.stack))
        if new.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if new.holder >= 0:
            self.holders.append(new.holder)
        if new.doubted >= 0:
            self.doubts.append(new.doubted)
        self.stack.append(new)
        self.skipped += new.skipped
        self.links += new.link

    def pop(self) -> Node:
        top = self.stack.pop()
        self.places[top.tag].pop()
        if top.tag in BLOCKS:
            self.blocks.pop()
        if top.holder >= 0:
            self.holders.pop()
        if top.doubted >= 0:
            self.doubts.pop()
        self.skipped -= top.skipped
        self.links -= top.link
        return top


def settled(doubts: list[Doubt], certain: int) -> None:
    """Decide which doubtful parts are kept, against the text that is certain by then: those that name content first, comments last, the largest first.

    A part of the layout is kept if it holds ten times as much, one that names content too if it holds as much, reader comments
    if besides next to nothing is certain; a part with a main element always; none of less than ``LEAST_TEXT`` characters.
    """
    for d in reversed(doubts):  # parts come in the order of their starts, so those within a part first
        d.text += d.own
        if d.parent >= 0:
            doubts[d.parent].text += d.text
            doubts[d.parent].main |= d.main
    ranks: list[int] = []  # a part's turn comes no earlier than that of the part around it
    for d in doubts:
        ranks.append(max(("content", "layout", "comments").index(d.kind), ranks[d.parent] if d.parent >= 0 else 0))
    for k in sorted(range(len(doubts)), key=lambda k: (ranks[k], -doubts[k].text, k)):
        d = doubts[k]
        enough = d.text >= LEAST_TEXT and (certain <= d.text if d.kind == "content" else 10 * certain < d.text and (d.kind == "layout" or certain < LEAST_TEXT))
        d.kept = (d.parent < 0 or doubts[d.parent].kept) and (enough or (d.main and d.text > 0))
        certain += d.own if d.kept else 0


def parsed(page: str) -> Page:
    """The page's containers, each with its path and score, and its text blocks."""
    out, now = Page([], [], [0], [0]), Open()
    parts: list[str] = []
    doubts: list[Doubt] = []
    found: list[tuple[str, int, int, tuple[int, ...]]] = []  # blocks with linked characters, doubtful part, and containers from the inside
    certain = 0
    out.containers.append(Container("", -1, False, 0))
    now.push(Node("", "", False, holder=0))  # the implied body
    linked = at = 0

    def flush() -> None:
        nonlocal linked, certain
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not now.skipped:
            in_links, doubt = min(linked, len(text)), now.doubts[-1] if now.doubts else -1
            if doubt >= 0:
                doubts[doubt].own += len(text) - in_links
            else:
                certain += len(text) - in_links
            found.append((text, linked, doubt, tuple(now.holders[-3:][::-1])))
        linked = 0

    def close(k: int) -> None:
        while len(now.stack) > k:
            if (holder := now.pop().holder) >= 0:
                out.containers[holder].end = len(found)

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not now.skipped:
            parts.append(piece)
            if now.links:
                linked += len(piece)

    page_end = len(page)
    while at < page_end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            opened = now.last(tag)
            if tag in BLOCKS:
                flush()
            # an inline end does not close blocks around it
            if opened >= 0 and (tag in BLOCKS or not now.blocks or now.blocks[-1] <= opened):
                close(opened)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else page_end
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            p = now.last("p")
            if tag in CLOSES_P and p >= 0 and p > now.last(*CONTAINERS):
                close(p)
            if tag == "li" and (p := now.last("li")) >= 0 and p > now.last("ul", "ol"):
                close(p)
        new = node(tag, m[3][:-1] if m[3].endswith(">") else m[3], bool(now.places["article"]))
        if tag == "a" and (p := now.last("a")) >= 0 and (not now.blocks or now.blocks[-1] <= p):
            close(p)
        if tag == "main" and now.doubts and not new.skipped:
            doubts[now.doubts[-1]].main = True
        if new.doubt and not now.skipped and not new.skipped:
            new.doubted = len(doubts)
            doubts.append(Doubt(new.doubt, now.doubts[-1] if now.doubts else -1))
        if tag in CONTAINERS and not now.skipped and not new.skipped:
            parent = now.holders[-1] if now.holders else -1
            new.holder = len(out.containers)
            out.containers.append(Container(longer(out.containers[parent].path if parent >= 0 else "", new.step), parent, tag in ("article", "main"), len(found)))
        now.push(new)
        if m[3].endswith("/>") and tag not in BLOCKS:
            close(len(now.stack) - 1)
    flush()
    close(0)
    settled(doubts, certain)
    before = [0]  # kept blocks among the first k found
    for text_, in_links, doubt, holders in found:
        if doubt < 0 or doubts[doubt].kept:
            out.blocks.append(text_)
            out.sizes.append(out.sizes[-1] + len(text_))
            out.linked.append(out.linked[-1] + min(in_links, len(text_)))
            for share, k in zip((1, 3, 9), holders):  # a block counts for its own container, and less for those around it
                out.containers[k].score += max(0.0, len(text_) - 3.0 * in_links) / share
        before.append(len(out.blocks))
    for c in out.containers:
        c.first, c.end = before[c.first], before[c.end]
    return out


def best_of(page: Page) -> int:
    """The container of the highest score, the first of equals; -1 for a page without."""
    return max(range(len(page.containers)), key=lambda k: (page.containers[k].score, -k), default=-1)


def vote(page: str) -> tuple[str, float]:
    """The path and score of the best container; ('', 0) for a page without text."""
    found = parsed(page)
    k = best_of(found)
    return (found.containers[k].path, found.containers[k].score) if k >= 0 and found.containers[k].score > 0 else ("", 0.0)


def widened(page: Page, k: int) -> int:
    """The widest article or main around a container; beyond it, further containers while what each adds is text rather than links."""
    holders = [k]
    while (up := page.containers[holders[-1]].parent) >= 0:
        holders.append(up)
    start = max((i for i, j in enumerate(holders) if page.containers[j].article), default=0)
    k = holders[start]
    for j in holders[start + 1 :]:
        size, linked = (a - b for a, b in zip(page.size(j), page.size(k)))
        if size and size <= 2 * linked:
            break
        k = j
    return k


def main_text(page: str, path: str | None) -> str:
    """The blocks of the containers at ``path``, or of the page's own best container where there is none, widened."""
    found = parsed(page)
    chosen = [k for k, c in enumerate(found.containers) if path and c.path == path and c.end > c.first]
    if not chosen and (k := best_of(found)) >= 0:
        chosen = [k]
    out, end = [], 0
    wides = {widened(found, k) for k in chosen}
    for k in sorted(wides):
        c = found.containers[k]
        out += found.blocks[max(c.first, end) : c.end]
        end = max(end, c.end)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: its winning path."""

    @F.pandas_udf("struct<path:string,score:double>")
    def ballots(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([vote(p) for p in x], columns=["path", "score"])

    votes = pages.select(host_of(F.col(f"`{url}`")).alias("host"), ballots(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))).alias("v"))
    tally = votes.where("v.path != ''").groupBy("host", F.col("v.path").alias("path")).agg(F.count("*").alias("n"), F.round(F.sum("v.score")).alias("score"))
    return tally.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html_col: str = "html", broadcast: bool | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars``. Whether the winners are broadcast follows from their measured size unless told."""

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, paths in batches:
            yield pd.Series([main_text(p, path) for p, path in zip(x, paths)], dtype=object)

    winners = keep(host_paths(pages, url, html_col).select(F.col("host").alias("__host"), F.col("path").alias("__path")), "hosts")
    if broadcast is None:
        broadcast = (winners.agg(F.sum(F.length("__host") + F.length("__path") + 16)).first()[0] or 0) <= BROADCAST_BYTES
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    host = host_of(pages[f"`{url}`"])
    if broadcast:
        both = pages.join(F.broadcast(winners), host == winners["__host"], "left")
    else:
        salted = winners.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(pages[f"`{html_col}`"]), F.lit(SALTS)).cast("int")
        both = pages.join(salted, (host == salted["__host"]) & (salt == salted["__salt"]), "left")
    return both.select(*[pages[f"`{c}`"] for c in kept], read(F.coalesce(pages[f"`{html_col}`"], F.lit("")), F.col("__path")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The main text of the given pages in SQL: each holds one plain article of paragraphs and a heading.
OP10_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, length(coalesce(array_to_string(parts, chr(10)), ''))::BIGINT AS n_chars FROM c"""
