"""Scalar Columns: casts of scraped text, counts, times, URLs, pseudonyms and names."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]+"


#: Rules of the casts, for Columns and for single values alike: a leading number, a count with its unit, and what the units mean.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
COUNT = r"(?i)([\d.,]+)\s*([KMB])?"
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9}


def normalised(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _WHITE, " "))


def normalised_lower(c: Column) -> Column:
    return F.lower(normalised(F.coalesce(c, F.lit(""))))


def _number(text: Column) -> Column:
    """The leading number of a text, as parseFloat reads it; null for none."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def _multiplier(unit: Column) -> Column:
    out = F.lit(1.0)
    for letter, times in UNITS.items():
        out = F.when(F.upper(unit) == letter, times).otherwise(out)
    return out


def count(c: Column) -> Column:
    """``38.2K`` as 38200: found anywhere, commas dropped, rounded half up; null where there is no number."""
    n = _number(F.regexp_replace(F.regexp_extract(c, COUNT, 1), ",", ""))
    return F.floor(n * _multiplier(F.regexp_extract(c, COUNT, 2)) + 0.5).cast("long")


def display_count(c: Column) -> Column:
    """The whole text must be a count; without a unit the number stays as it is."""
    pattern = r"(?i)^([\d.,]+)\s*([KMB])?$"
    scaled = lambda n, unit: F.floor(n * _multiplier(unit) + 0.5)
    shown = lambda n, unit: F.when((unit == "") | (scaled(n, unit) == 0), n).otherwise(scaled(n, unit).cast("double"))
    parts = lambda text: F.struct(_number(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")).alias("n"), F.regexp_extract(text, pattern, 2).alias("unit"))
    return bound(F.trim(c), lambda text: F.when(text.rlike(pattern), bound(parts(text), lambda p: shown(p["n"], p["unit"]))))


def as_int(c: Column) -> Column:
    """All but digits and dashes dropped, then the leading integer: ``12.5`` is 125."""
    return F.regexp_extract(F.regexp_replace(c, r"[^\d-]", ""), r"^(-?\d+)", 1).try_cast("long")


def as_float(c: Column) -> Column:
    return _number(c)


def as_bool(c: Column) -> Column:
    """False for the empty text and for ``false``; null stays null."""
    return F.when(c.isNotNull(), (c != "") & (c != "false"))


def as_seconds(c: Column) -> Column:
    """``1:02:03`` as 3723; null if a part is no number (an empty part is 0)."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: F.when(F.trim(p) == "", F.lit(0.0)).when(F.trim(p).rlike(NUMBER + "$"), F.trim(p).try_cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def as_string(c: Column) -> Column:
    return c.cast("string")


def as_url(c: Column, page: Column) -> Column:
    """A link against its page's address. The plain cases stay in the JVM; dot segments and the rest are resolved in batches."""

    @F.pandas_udf("string")
    def resolved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for links, pages in batches:
            yield pd.Series([_resolve(a, b) for a, b in zip(links, pages)], dtype=object)

    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = c.rlike(r"^/(?!/)[^\s.?#\\]*$") & (origin != "")
    return F.when(c.isNull(), F.lit(None)).when(plain, F.concat(origin, c)).otherwise(resolved(c, page))


def _resolve(link: str | None, page: str | None) -> str | None:
    try:
        full = urljoin(page or "", (link or "").strip())
        parts = urlsplit(full)
    except ValueError:
        return None
    if not parts.scheme:
        return None
    return f"{full}/" if parts.scheme in ("http", "https") and not parts.path and not parts.query and not parts.fragment else full


CASTS = {"string": as_string, "int": as_int, "float": as_float, "count": count, "bool": as_bool, "seconds": as_seconds}


def _whole(x: float | None) -> float | int | None:
    """A number as JSON tells it."""
    return int(x) if x is not None and x.is_integer() else x


def _leading(text: str) -> float | None:
    m = re.match(NUMBER, text, re.ASCII)
    return float(m[1]) if m else None


def _count_of(v: str) -> int | None:
    m = re.search(COUNT, v, re.ASCII)
    n = _leading(m[1].replace(",", "")) if m else None
    return None if n is None else math.floor(n * UNITS.get((m[2] or "").upper(), 1.0) + 0.5)


def _int_of(v: str) -> int | None:
    m = re.match(r"-?\d+", re.sub(r"[^\d-]", "", v, flags=re.ASCII), re.ASCII)
    return int(m[0]) if m else None


def _seconds_of(v: str) -> float | int | None:
    total = 0.0
    for part in v.strip().split(":"):
        m = re.fullmatch(NUMBER, part.strip(), re.ASCII) if part.strip() else None
        if part.strip() and not m:
            return None
        total = total * 60 + (float(m[1]) if m else 0.0)
    return _whole(total)


#: The same casts for single values, as page models apply them: (text, address of the page).
PLAIN = {
    "string": lambda v, page: v,
    "int": lambda v, page: _int_of(v),
    "float": lambda v, page: _whole(_leading(v)),
    "count": lambda v, page: _count_of(v),
    "bool": lambda v, page: v not in ("", "false"),
    "seconds": lambda v, page: _seconds_of(v),
    "url": lambda v, page: _resolve(v, page),
}


def plain(v: str | None, kind: str, page: str = ""):
    """One text cast; null stays null, and an unknown kind is an error."""
    if kind not in PLAIN:
        raise ValueError(f"no cast is named {kind!r}")
    return None if v is None else PLAIN[kind](v, page)


def capture(c: Column, pattern: str) -> Column:
    """Group 1 where the pattern has one and it took part, else the whole match, else null."""
    whole = F.regexp_extract(c, pattern, 0)
    group = re.compile(pattern.replace("(?<", "(?P<") if "(?<" in pattern and "(?<=" not in pattern and "(?<!" not in pattern else pattern).groups
    # a group that took no part reads as the empty text; one that matched the empty text reads the same and yields it
    value = F.when(F.regexp_extract(c, pattern, 1) != "", F.regexp_extract(c, pattern, 1)).otherwise(whole) if group else whole
    return F.when(c.rlike(pattern), value)


#: How far display counts may be apart, in parts of the expected one, with a unit letter and without.
TOLERANCES = {"unit": 0.051, "plain": 0.001}


def values_match(expected: Column, got: Column) -> Column:
    """Tolerant equality of display values: an unseen expectation passes, counts match within what their display shows, texts
    match when equal or when one of at least four characters holds the other."""
    shown = expected.rlike(r"(?i)^[\d.,\sKMB]+$")
    close = lambda e, g: F.abs(e - g) <= F.greatest(F.lit(1.0), F.abs(e) * F.when(expected.rlike("(?i)[KMB]"), TOLERANCES["unit"]).otherwise(TOLERANCES["plain"]))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[#@]", ""), _WHITE, " "))
    held = lambda a, b: (a == b) | ((F.length(a) >= 4) & b.contains(a)) | ((F.length(b) >= 4) & a.contains(b))
    text = bound(F.struct(plain(expected).alias("a"), plain(got).alias("b")), lambda x: held(x["a"], x["b"]))
    counts = F.when(shown, F.struct(display_count(expected).alias("e"), display_count(got).alias("g")))  # null where the expectation shows no count
    by_count = bound(counts, lambda x: F.when(x["e"].isNotNull() & x["g"].isNotNull(), close(x["e"], x["g"])))
    # by_count is null where a side is no count
    return F.when(expected.isNull() | (expected == ""), True).when(got.isNull(), False).otherwise(F.coalesce(by_count, text))


def backoff(attempt: Column, base_ms: int = 1000, max_ms: int = 15_000, jitter: float = 0.3) -> dict[str, Column]:
    """The delay before a retry without jitter, and its least and most value with it."""
    d = F.least(F.lit(float(max_ms)), base_ms * F.pow(F.lit(2.0), attempt - 1))
    return {"delay_ms": F.floor(d + 0.5).cast("long"), "least_ms": F.floor(d * (1 - jitter) + 0.5).cast("long"), "most_ms": F.floor(d * (1 + jitter) + 0.5).cast("long")}


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of a text, as an unsigned number."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))


def pseudonym(c: Column) -> Column:
    """Five characters of base 36 that stand for a text."""
    return F.substring(F.lower(F.conv(fnv1a(c).cast("string"), 10, 36)), 1, 5)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def normalised_shape(tokens: Column) -> Column:
    """``div*24`` as ``div*`` in an array of structure tokens."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, r"\*\d+$", "*"))


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC."""
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def request_key(*parts: Column) -> Column:
    """A content-addressed key: 32 hex digits over the JSON array of the parts."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 32)


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site_slug(url: Column) -> Column:
    """Host without ``www.``, all but letters and digits as dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(host(url)), r"^www\.", ""), "[^a-z0-9]+", "-")


def brand(url: Column) -> Column:
    """The longest host label besides the last one and www, m, mobile."""
    labels = F.split(F.lower(host(url)), r"\.")
    inner = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), lambda x: ~x.isin("www", "m", "mobile"))
    return F.element_at(F.sort_array(F.transform(inner, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), 1)["x"]


def view_of_surface(surface: Column) -> Column:
    """``interrupt:login-12`` as ``login``."""
    return F.regexp_replace(F.regexp_replace(surface, r"-\d+$", ""), r"^.*[:/]", "")


def facet_path(pointer: Column) -> Column:
    """``/videos/3/x`` as ``/videos/*/x``."""
    return F.regexp_replace(pointer, r"/\d+(?=/|$)", "/*")


def facet_leaf(pointer: Column) -> Column:
    return F.element_at(F.split(pointer, "/"), -1)


def facet_family(pointer: Column) -> Column:
    return F.element_at(F.filter(F.split(facet_path(pointer), "/"), lambda x: x != ""), 1)


#: Attributes that name an element, and the element names in front of generated class names.
NAMING = "data-e2e|data-testid|data-test|aria-label|name|role"
CLASS_PREFIX = r"^(?:Div|Span|Strong|Img|A|H\d|P|Picture|Video|Button|Ul|Li)(?=[A-Z])"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def camel(c: Column) -> Column:
    """Words of letters and digits as one camel-case name."""
    words = F.filter(F.split(c, "[^a-zA-Z0-9]+"), lambda w: w != "")
    name = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), "")
    return bound(name, lambda n: F.concat(F.lower(F.substring(n, 1, 1)), n.substr(F.lit(2), F.length(n))))


def field_name(selector: Column, attribute: Column | None = None, fallback: str = "field") -> Column:
    """A field's name: its attribute, else a naming attribute of the selector, else its generated class without the element's name."""
    named = F.regexp_extract(selector, rf'\[(?:{NAMING})="([^"]+)"\]', 1)
    cls = F.regexp_replace(F.regexp_extract(selector, r'class\*="-([A-Za-z]+)"', 1), CLASS_PREFIX, "")
    own = F.coalesce(F.lit(None).cast("string") if attribute is None else F.nullif(attribute, F.lit("")), F.nullif(named, F.lit("")), F.nullif(cls, F.lit("")))
    return F.coalesce(camel(own), F.lit(fallback))


def unique_names(names: Column) -> Column:
    """Names of one list told apart: the second of a name gets a 2, and so on; an empty one is called field."""
    full = F.transform(names, lambda n: F.when(n.isNull() | (n == ""), F.lit("field")).otherwise(n))
    seen = lambda arr, n, i: F.size(F.filter(F.slice(arr, 1, i + 1), lambda x: x == n))
    number = lambda k: F.when(k > 1, k.cast("string")).otherwise("")
    return bound(full, lambda arr: F.transform(arr, lambda n, i: F.concat(n, bound(seen(arr, n, i), number))))
