"""Personal data: candidate spans scored by boosted trees, in DataFrame operations only.

Base spans are the exact formats (e-mail address, IPv4 address, payment card, international phone number). Generators with a
higher recall propose further, overlapping spans of each kind, written in ways that the base formats don't know, and long
unbroken runs that may be secrets such as access tokens. A candidate is described by yes/no features of its format and its
context; Spark counts candidates per (kind, features, held-out half, label), so every candidate within no base span is learnt from,
and the driver sees one row per distinct feature set (at most ``2 ** len(FEATURES)`` per kind), never text. Gradient boosting
fits small regression trees to those counts. The held-out half calibrates them: scores become probabilities by isotonic
regression, and a kind's threshold is the least score with a probability of ``PRECISION`` or more. Trees and thresholds become
one Column, which selects the spans to add: those within no base span.

Labels have two sources. The candidates of the corpus have weak ones that need no person and no base span (``plausible``): the
candidate's normal form is a well-formed address, its octets, checksum or area code hold, its characters change class as often
as those of a random key and aren't words, a path or an address. Written lessons (``pii_lessons``) have true ones: a corpus
may hold but one form of a kind, or only true candidates of it, and tells nothing of the rest. The corpus's candidates of a
kind weigh at most as much as that kind's lessons together, so that the lessons count alike at every size.

Positions are code points, end exclusive. Work on a row grows with its length and, but for a logarithm, with its matches. Cases:
null or empty text has no spans; repeated rows get equal spans; an empty table has no rows; a row's matches are numbered
within the row, nothing is gathered across rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let, table
from .pii_lessons import lessons

KINDS = ("email", "ip", "card", "phone", "secret")  # the last has no base format
#: Least calibrated probability of a span that is added.
PRECISION = 0.75

#: Stands for a separator between two digits; a private-use code point, replaced in the text beforehand where it occurs.
JOINT = "\ue000"

#: The base formats. Possessive loops and the look-behind keep them linear on long runs; the matches are those of the plain
#: forms, since no shorter match could start inside a run whose first position fails.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = rf"[0-9{JOINT}]{{13,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: High-recall forms of each kind. They overlap the base forms and each other.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.,][0-9]{1,3}+){3}(?![.,]?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ .-]?[0-9]{4,6}[ .-]?[0-9]{4,5}(?:[ .-]?[0-9]{1,7})?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])",
}

#: Code points of context on either side, and the words in it that hint at each kind (fixed values).
CONTEXT = 24
HINTS = r"(?i)mail|contact|phone|tel\b|tel[.:]|call|mobile|fax|card|visa|credit|account|\bip\b|address|host|server"


#: Words in a key, its changes between classes of characters, and an address or a path in front of or behind a candidate.
WORDY = r"[A-Za-z][a-z]{3,}+|[A-Z]{5,}+(?=_)|(?<=_)[A-Z]{5,}+"
CHANGES = r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"
IN_ADDRESS, BEFORE_NAME = r"(?:[A-Za-z0-9]\.|[/\\~?&#%]|://\S*|www\.\S*)$", r"^(?:\.[A-Za-z0-9]|[?&#%~\\:]\S)"
ASSIGNED = r"(?i)(?:token|secret|key|passw|pwd|auth|bearer)[a-z]{0,8}[\"']?(?:\s{0,3}[=:]|\s)\s{0,3}[\"']?$"
OCTET = "^(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
AREA = "^[2-9][0-9]{2}[2-9]"


def octets_hold(c: Column) -> Column:
    return F.forall(F.split(c, "[.,]"), lambda p: p.rlike(OCTET))


def wordy(c: Column) -> Column:
    """Whether words make up at least two fifths of a run."""
    return 5 * F.length(F.regexp_replace(c, WORDY, "")) <= 3 * F.length(c)


def changing(c: Column) -> Column:
    """Whether the class of characters changes at least once in six."""
    return 6 * F.regexp_count(c, F.lit(CHANGES)) >= F.length(c)


def features(kind: Column, c: Column, left: Column, right: Column) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    secret = kind == KINDS.index("secret")
    return {
        "plus": c.startswith("+"),
        "space": c.contains(" "),
        "hyphen": c.contains("-"),
        "dot": c.contains("."),
        "bracket": c.rlike(r"[\[(]"),
        "spaced_at": c.rlike(" @|@ "),
        "digits_9_15": digits.between(9, 15),
        "first_card_digit": F.substring(c, 1, 1).isin("3", "4", "5", "6"),
        "checksum": (kind == KINDS.index("card")) & luhn(digits_of(c)),
        "octets": (kind == KINDS.index("ip")) & octets_hold(c),
        "area": (kind == KINDS.index("phone")) & F.substring(digits_of(c), -10, 10).rlike(AREA),
        "comma": c.contains(","),
        "slash": c.contains("/"),
        "separators": F.regexp_count(c, F.lit("[_/-]")) >= 3,
        "both": secret & c.rlike("[0-9]") & c.rlike("[A-Za-z]"),
        "wordy": secret & wordy(c),
        "changing": secret & changing(c),
        "address": secret & (left.rlike(IN_ADDRESS) | right.rlike(BEFORE_NAME) | c.rlike("^//|^/[a-z]{2,8}/")),
        "assigned": left.rlike(ASSIGNED),
        "glued": left.rlike(r"[\p{L}\p{N}_/-]$") | right.rlike(r"^[\p{L}\p{N}_@/=-]"),
        "hint": left.rlike(HINTS),
    }


FEATURES = ("plus", "space", "hyphen", "dot", "bracket", "spaced_at", "digits_9_15", "first_card_digit", "checksum", "octets", "area", "comma", "slash", "separators", "both", "wordy", "changing", "address", "assigned", "glued", "hint")


def plausible(kind: Column, c: Column, left: Column) -> Column:
    """The weak label of a candidate: whether its normal form passes the check of its kind."""
    address = F.regexp_replace(F.regexp_replace(F.lower(c), r" ?(?:@|\[at\]|\(at\)) ?", "@"), r" ?(?:\[dot\]|\(dot\)) ?", ".")
    digits = digits_of(c)
    checks = (
        address.rlike(r"^[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$") & ~c.rlike(" @|@ "),
        octets_hold(c) & (~c.contains(",") | left.rlike(HINTS)),
        F.length(digits).between(13, 19) & digits.rlike("^[3-6]") & luhn(digits),
        F.length(digits).between(9, 15) & F.substring(digits, -10, 10).rlike(AREA),
        c.rlike("[A-Za-z0-9]{16}") & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(c, ""))) >= 10) & ~wordy(c) & ~left.rlike(IN_ADDRESS) & (changing(c) | left.rlike(ASSIGNED)),
    )
    out = F.lit(False)
    for k, check in enumerate(checks):
        out = F.when(kind == k, check).otherwise(out)
    return out


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Each element folded with all before it: in as many passes as the size has binary digits, since appending to an array copies it."""

    def passes(held: Column) -> Column:
        steps = F.filter(F.expr("transform(sequence(0, 30), k -> shiftleft(1, k))"), lambda s: s < F.size(held))
        return F.aggregate(steps, held, lambda a, s: F.transform(a, lambda x, i: F.when(i >= s, fold(F.get(a, i - s), x)).otherwise(x)))

    return let(values, passes)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as an array of (start, c), from the summed lengths of what lies between and in them."""

    def placed(gaps: Column, matches: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, c: F.length(g) + F.length(c))
        return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(matches, lambda c, i: F.struct((F.get(ends, i) - F.length(c)).alias("start"), c.alias("c"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: placed(g, m))).otherwise(_none()))


#: Code points of the blocks that parts of a text are read from: reading by position alone would count from the text's start each time.
BLOCK = 256


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, start: Column, n: Column) -> Column:
    """``n`` code points from ``start`` (from 0) of a text given by its blocks."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + n) / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(n > 0, F.substring(held, start - first * BLOCK + 1, n)).otherwise("")


def _none() -> Column:
    return F.array().cast("array<struct<start:int,c:string>>")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of payment cards."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def spans_of(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["c"])).alias("end")))


def base_spans(text: Column) -> Column:
    """The exact formats of all kinds as one array of (kind, start, end), ordered by kind and start."""
    none = _none()
    number = text.rlike("[0-9]{2}|[0-9][ .-][0-9]")
    joined = F.regexp_replace(F.replace(text, F.lit(JOINT), F.lit("x")), r"(?<=[0-9])[ -](?=[0-9])", JOINT)
    email = F.when(text.contains("@"), located(text, EMAIL)).otherwise(none)
    ip = F.filter(F.when(number, located(text, IP)).otherwise(none), lambda x: F.forall(F.split(x["c"], r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    card = F.filter(F.when(number, located(joined, CARD)).otherwise(none), lambda x: F.length(digits_of(x["c"])).between(13, 19) & luhn(digits_of(x["c"])))
    phone = F.filter(F.when(text.contains("+"), located(text, PHONE)).otherwise(none), lambda x: F.length(digits_of(x["c"])).between(9, 15))
    return F.concat(*[spans_of(k, v) for k, v in zip(KINDS, (email, ip, card, phone))])


def candidates(text: Column) -> Column:
    """Spans that the high-recall forms propose, with their text and context."""
    number, none = text.rlike("[0-9]{3}"), _none()

    def proposed(kind: str, pattern: str) -> Column:
        asked = {"email": text.rlike(r"@|\[at\]|\(at\)"), "ip": text.rlike(r"[0-9][.,][0-9]{1,3}[.,][0-9]"), "secret": text.rlike("[A-Za-z0-9_+/-]{16}")}.get(kind, number)
        found = F.when(asked, located(text, pattern)).otherwise(none)
        return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["c"])).alias("end"), x["c"].alias("c")))

    def in_context(found: Column, blocks: Column) -> Column:
        before = lambda p: F.least(p["start"], F.lit(CONTEXT))
        return F.transform(found, lambda p: F.struct(*(p[f].alias(f) for f in ("kind", "start", "end", "c")), part(blocks, p["start"] - before(p), before(p)).alias("left"), part(blocks, p["end"], F.lit(CONTEXT)).alias("right")))

    return let(F.concat(*[proposed(k, p) for k, p in LOOSE.items()]), lambda found: let(F.when(F.size(found) > 0, blocks_of(text)), lambda blocks: in_context(found, blocks)))


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base`` and ``proposed``, the candidates within no base span, each computed once per row behind a generator."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    both = let(F.struct(base_spans(whole).alias("base"), candidates(whole).alias("all")), lambda x: F.struct(x["base"].alias("base"), outside(x["all"], x["base"]).alias("proposed")))
    return docs.select("*", F.explode(F.array(both)).alias("__pii"))


def outside(proposed: Column, base: Column) -> Column:
    """The candidates that lie within no base span: by start, the base first, none reaches a candidate's end before it."""
    fields = ("kind", "start", "end", "c", "left", "right")
    marked = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("own"), b["end"].alias("reach"), F.lit(None).cast("struct<kind:int,start:int,end:int,c:string,left:string,right:string>").alias("p"))),
        F.transform(proposed, lambda p: F.struct(p["start"].alias("at"), F.lit(1).alias("own"), F.lit(0).alias("reach"), F.struct(*(p[f].alias(f) for f in fields)).alias("p"))),
    )

    def free(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda x: x["reach"]), lambda a, b: F.greatest(a, b))
        return let(reach, lambda ends: F.transform(F.filter(rows, lambda x, i: (x["own"] == 1) & (F.get(ends, i) < x["p"]["end"])), lambda x: x["p"]))

    return F.when((F.size(proposed) > 0) & (F.size(base) > 0), let(F.sort_array(marked), free)).otherwise(proposed)


# --- boosted trees over counted feature sets ---


def cells(docs: DataFrame, text: str, truth: Column | None = None) -> list:
    """Counts of the candidates that no base span contains, per kind, features, half and label: ``plausible``, or whether it is one of ``truth``."""
    p = F.col("p")
    truth = F.lit(None).cast("array<struct<kind:int,start:int,end:int>>") if truth is None else truth
    found = with_spans(docs.select(F.col(f"`{text}`").alias("text"), truth.alias("truth")), "text").where(F.size("__pii.proposed") > 0).select("truth", F.explode("__pii.proposed").alias("p"))
    described = features(p["kind"], p["c"], p["left"], p["right"])
    held = F.pmod(F.crc32(F.encode(F.concat(p["left"], p["c"], p["right"]), "UTF-8")), F.lit(2)) == 1
    true = F.exists("truth", lambda t: (t["kind"] == p["kind"]) & (t["start"] == p["start"]) & (t["end"] == p["end"]))
    label = F.when(F.col("truth").isNotNull(), true).otherwise(F.coalesce(plausible(p["kind"], p["c"], p["left"]), F.lit(False)))
    rows = found.select(p["kind"].alias("kind"), held.alias("held"), label.alias("valid"), *[described[f].alias(f) for f in FEATURES])
    return rows.groupBy(*rows.columns).count().collect()


class Trees:
    """Gradient boosting for log-loss: depth-2 regression trees with Newton leaves over yes/no features."""

    def __init__(self, rounds: int = 20, rate: float = 0.4, depth: int = 2):
        self.rounds, self.rate, self.depth, self.trees, self.prior = rounds, rate, depth, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        mean = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(x, w * (y - p), w * p * (1 - p), np.ones(len(y), bool), self.depth)
            self.trees.append(tree)
            score += self.run(tree, x)
        return self

    def grow(self, x, g, h, rows, depth):
        leaf = self.rate * float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0:
            return leaf
        gain, best = 1e-6, None
        for f in range(x.shape[1]):
            yes, no = rows & x[:, f], rows & ~x[:, f]
            if yes.any() and no.any():
                now = sum(g[r].sum() ** 2 / (h[r].sum() + 1.0) for r in (yes, no)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                if now > gain:
                    gain, best = now, f
        return leaf if best is None else (best, self.grow(x, g, h, rows & x[:, best], depth - 1), self.grow(x, g, h, rows & ~x[:, best], depth - 1))

    def run(self, tree, x) -> np.ndarray:
        return np.full(len(x), tree) if isinstance(tree, float) else np.where(x[:, tree[0]], self.run(tree[1], x), self.run(tree[2], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum(self.run(t, x) for t in self.trees)

    def column(self, described: dict[str, Column], names) -> Column:
        """The same score as a Column."""

        def walk(tree):
            return F.lit(tree) if isinstance(tree, float) else F.when(described[names[tree[0]]], walk(tree[1])).otherwise(walk(tree[2]))

        score = F.lit(self.prior)
        for t in self.trees:
            score = score + walk(t)
        return score


def calibrated(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct scores in order and the probability of each: isotonic regression by pooling neighbours, smoothed by one hit and one miss."""
    at, which = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # hits, rows, scores
    for hits, rows in zip(np.bincount(which, weights=w * y), np.bincount(which, weights=w)):
        pools.append([hits, rows, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return at, np.repeat([(hits + 1) / (rows + 2) for hits, rows, _ in pools], [int(n) for _, _, n in pools])


def train(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> dict[int, tuple[Trees, float]]:
    """Per kind: the trees, and the least score whose calibrated probability is the wanted precision; kinds without such a score are left out."""
    taught = cells(lessons(docs.sparkSession), "text", F.col("truth"))
    return fitted(cells(docs, text), taught, precision)


def fitted(rows: list, taught: list, precision: float = PRECISION) -> dict[int, tuple[Trees, float]]:
    """The models of counts from the corpus and from lessons."""
    models = {}
    for kind in range(len(KINDS)):
        sources = [sorted((r for r in part if r["kind"] == kind), key=tuple) for part in (rows, taught)]
        totals = [sum(r["count"] for r in part) for part in sources]
        scale = min(1.0, totals[1] / totals[0]) if totals[0] and totals[1] else 1.0
        own = [(r, r["count"] * by) for part, by in zip(sources, (scale, 1.0)) for r in part]
        fit, held = [x for x in own if not x[0]["held"]], [x for x in own if x[0]["held"]]
        if not own:
            continue
        as_arrays = lambda xs: (np.array([[r[f] for f in FEATURES] for r, _ in xs], bool), np.array([r["valid"] for r, _ in xs], float), np.array([w for _, w in xs], float))
        model = Trees().fit(*as_arrays(fit or held))
        x, y, w = as_arrays(held or fit)
        score, probability = calibrated(np.round(model.predict(x), 9), y, w)
        good = np.flatnonzero(probability >= precision)
        if len(good):
            models[kind] = (model, float(score[good[0]]) - 1e-6)
    return models


def selected(proposed: Column, models) -> Column:
    """Proposed spans that score at their kind's threshold."""

    def scored(p: Column) -> Column:  # features once per candidate, then trees over plain booleans
        found = features(p["kind"], p["c"], p["left"], p["right"])
        return F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), F.struct(*(found[f].alias(f) for f in FEATURES)).alias("f"))

    def chosen(p: Column) -> Column:
        takes = F.lit(False)
        for kind, (model, least) in models.items():
            takes = F.when(p["kind"] == kind, model.column({f: p["f"][f] for f in FEATURES}, FEATURES) >= least).otherwise(takes)
        return takes

    return F.transform(F.filter(F.transform(proposed, scored), chosen), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def find(docs: DataFrame, text: str = "text", models=None) -> DataFrame:
    """Add ``base`` and ``spans`` (arrays of kind, start, end). Models are trained on the same table unless given."""
    models = train(docs, text) if models is None else models
    pii = F.col("__pii")
    found = with_spans(docs.drop("base", "spans"), text)
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")],
        pii["base"].alias("base"),
        F.array_sort(F.concat(pii["base"], F.when(F.size(pii["proposed"]) > 0, selected(pii["proposed"], models)).otherwise(F.filter(pii["base"], lambda b: F.lit(False))))).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap share one, that of the first."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(rows: Column, ends: Column, blocks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        placed = F.filter(F.transform(rows, lambda s, i: F.struct(before(i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda x: x["start"] >= x["at"])
        pieces = F.transform(placed, lambda x: F.concat(part(blocks, x["at"], x["start"] - x["at"]), F.get(name, x["kind"])))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), part(blocks, last, F.length(text) - last))

    reaches = lambda rows: running(F.transform(rows, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(by_start, lambda rows: let(reaches(rows), lambda ends: let(blocks_of(text), lambda blocks: joined(rows, ends, blocks))))).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
