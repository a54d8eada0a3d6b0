"""Faults, drift, telemetry and timelines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators import records, stream, sweep

# --- faults ---


#: Classes of errors and the wording of their messages, in order; letter case is ignored.
ERRORS = (
    ("timeout", r"timed? ?out|Timeout \d+ms exceeded|TimeoutError"),
    ("crash", r"Target (page, context or browser )?(has been )?closed|crash|Session closed|Browser has been closed|Protocol error|WebSocket is not open|Execution context was destroyed|Connection closed"),
    ("network", r"net::ERR_|NS_ERROR_|ECONNRESET|ECONNREFUSED|ETIMEDOUT|socket hang up"),
    ("missing", r"not found|not rendered|no element|not visible|detached|intercepts pointer events|not on page|no active"),
)


def error_class(message: Column) -> Column:
    """timeout, crash, network, missing or unknown; the first that fits."""
    return F.coalesce(*[F.when(message.rlike(f"(?i){pattern}"), name) for name, pattern in ERRORS], F.lit("unknown"))


def navigation_class(status: Column, view: Column, fatal: tuple[int, ...] = (404, 410, 451)) -> Column:
    """ok, explained by a view, fatal or retry."""
    return F.when(status.isNull() | (status < 400), "ok").when(view.isNotNull(), "explained").when(status.isin(*fatal), "fatal").otherwise("retry")


def failed_requests(requests: DataFrame) -> DataFrame:
    return requests.where("error IS NOT NULL OR status >= 400")


#: What to do next for each class of fault.
NEXT = {
    "blocked": "adjust the blocking policy",
    "unhandled-state": "add a view and a transition",
    "site-changed": "derive the view again",
    "false-positive-drift": "fingerprint the view again from more samples",
    "transient": "raise retries or timeouts",
    "unknown": "inspect the dump",
}


def diagnosed(evidence: DataFrame) -> DataFrame:
    """Classify faults from one row of evidence each: blocked_hit, matched, expected, expected_matches, similarity, least_similarity,
    broken, fields, reason, failed, error."""
    least = F.coalesce("least_similarity", F.lit(0.5))
    e, m = F.col("expected"), F.col("matched")
    rate = F.col("broken") / F.col("fields")
    low = F.col("similarity") < least
    kind = (
        F.when(F.col("blocked_hit").isNotNull(), "blocked")
        .when(m.isNotNull() & e.isNotNull() & (m != e), "unhandled-state")
        .when(m.isNull() & e.isNotNull() & (F.col("expected_matches") == False) & (F.coalesce("similarity", F.lit(1.0)) >= least), "site-changed")  # noqa: E712
        .when(low | ((F.col("fields") > 0) & (rate > 0.3)), F.when(m.isNotNull(), "site-changed").otherwise("unhandled-state"))
        .when((F.col("reason") == "drift") & m.eqNullSafe(e) & (F.col("broken") == 0), "false-positive-drift")
        .when(m.isNull(), "unhandled-state")
        .when((F.col("failed") > 0) | F.col("error").rlike("(?i)timed? ?out"), "transient")
        .otherwise("unknown")
    )
    out = evidence.withColumn("classification", kind)
    step = F.lit(NEXT["unknown"])
    for k, text in NEXT.items():
        step = F.when(F.col("classification") == k, text).otherwise(step)
    return out.withColumn("next", step)


def evidence(faults: DataFrame, hits: DataFrame, requests: DataFrame, console: DataFrame) -> DataFrame:
    """Evidence per fault: broken selectors, failed requests and console errors, each counted before the joins."""
    h = hits.groupBy("fault_id").agg(F.count("*").alias("fields"), F.count_if((F.col("hits") == 0) & ~F.col("empty_list") & ~F.col("list_root")).alias("broken"))
    r = failed_requests(requests).groupBy("fault_id").agg(F.count("*").alias("failed"))
    c = console.where(F.col("level").isin("exception", "error")).groupBy("fault_id").agg(F.count("*").alias("console_errors"))
    return faults.join(h, "fault_id", "left").join(r, "fault_id", "left").join(c, "fault_id", "left").fillna(0, ["fields", "broken", "failed", "console_errors"])


def waits(operations: DataFrame, min_ms: int) -> DataFrame:
    """The wait each page operation needed to keep a least distance from the one before."""
    w = Window.partitionBy("run_id").orderBy("at", "seq")
    return operations.withColumn("wait_ms", F.greatest(F.lit(0), F.coalesce(F.lag("at").over(w) + min_ms - F.col("at"), F.lit(0))))


def run_totals(events: DataFrame) -> DataFrame:
    """Retries, recoveries, dismissals, blocks and HTTP errors per run."""
    n = lambda k: F.count_if(F.col("name") == k).alias(k)
    return events.groupBy("run_id").agg(*map(n, ("retry", "recover", "dismiss", "blocked", "http_error")))


# --- fingerprints ---


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two arrays. Tokens are counted once per array and batch, so the work is linear in them."""

    @F.pandas_udf("double")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out = []
            for p, q in zip(x, y):
                p, q = Counter(p if p is not None else ()), Counter(q if q is not None else ())
                norm = (sum(n * n for n in p.values()) * sum(n * n for n in q.values())) ** 0.5
                out.append(1.0 if not p and not q else sum(n * q[t] for t, n in p.items()) / norm if norm else 0.0)
            yield pd.Series(out, dtype="float64")

    return compared(a, b)


def similarity(shape_a: Column, shape_b: Column, ax_a: Column | None = None, ax_b: Column | None = None) -> Column:
    """Structure similarity; with role tokens on both sides the mean of the two."""
    dom = cosine(shape_a, shape_b)
    if ax_a is None or ax_b is None:
        return dom
    return F.when((F.size(ax_a) > 0) & (F.size(ax_b) > 0), (dom + cosine(ax_a, ax_b)) / 2).otherwise(dom)


def simhash(tokens: Column) -> Column:
    """32-bit SimHash of an array of tokens, as 8 hex digits: a bit is set where more tokens' CRC-32 have it than lack it. Null is empty."""

    def bits(hashes: Column) -> Column:
        more = lambda k: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, k) == 1, 1).otherwise(-1)) > 0
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda out, k: out + F.when(more(k), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0))

    hashes = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.crc32(F.encode(t, "UTF-8")))
    return F.lower(F.lpad(F.hex(F.transform(F.array(hashes), bits)[0]), 8, "0"))  # the array holds the hashes once for all bits


def sample_pairs(samples: DataFrame) -> DataFrame:
    """Similarity of each two distinct samples of a view, from (view, sample, shape). A view has a handful of samples."""
    one = samples.groupBy("view", "shape").agg(F.min("sample").alias("sample"))
    b = one.select("view", F.col("sample").alias("other"), F.col("shape").alias("other_shape"))
    return one.join(b, "view").where("sample < other").select("view", "sample", "other", similarity(F.col("shape"), F.col("other_shape")).alias("similarity"))


def least_similarity(samples: DataFrame, bands: int = 32) -> DataFrame:
    """(view, similarity): the least similarity of two distinct samples of a view, from (view, sample, shape); no row for a view of one shape.

    Not by all pairs. Similarity is the cosine of an angle, and angles obey the triangle inequality: by their angles to a pivot two shapes
    are at most the sum of both apart. A view has two pivots, a shape and the one farthest from it; the farthest from that gives a
    least similarity already met, and only shapes that could be farther apart are compared, dealt by bands of their angle. A view that
    has met similarity 0 is done. (Where most shapes are equally far from each other, most pairs are still compared.)
    """
    one = records.cut(samples.groupBy("view", "shape").agg(F.min("sample").alias("sample")), "shapes")
    angle = lambda a, b: F.acos(F.least(F.lit(1.0), similarity(F.col(a), F.col(b))))
    far = lambda df, by: df.groupBy("view").agg(F.max_by("shape", F.struct(by, "sample")).alias("pivot"))
    first = one.groupBy("view").agg(F.min_by("shape", "sample").alias("pivot"))
    near = records.cut(one.join(first, "view").withColumn("t0", angle("shape", "pivot")).drop("pivot"), "angles")
    near = records.cut(near.join(far(near, "t0"), "view").withColumn("t1", angle("shape", "pivot")).drop("pivot"), "angles")
    met = near.groupBy("view").agg(F.max("t1").alias("met"), F.max("t0").alias("m0"), F.max("t1").alias("m1"), F.count("*").alias("n")).where("n > 1").drop("n")
    slack = F.lit(1e-9)
    left = near.join(met, "view").where((F.col("met") < np.pi / 2 - 1e-9) & (F.col("t0") + F.col("m0") > F.col("met") - slack) & (F.col("t1") + F.col("m1") > F.col("met") - slack))
    width = (F.col("m0") + slack) / bands
    own = left.withColumn("band", F.floor(F.col("t0") / width).cast("int"))
    # of bands i and j the sum is at most i + j + 2 widths
    fewest = F.greatest(F.lit(0), F.floor((F.col("met") - slack) / width).cast("int") - F.col("band") - 2)
    asks = own.where(fewest < bands).withColumn("band", F.explode(F.sequence(fewest, F.lit(bands - 1))))
    other = own.select("view", "band", F.col("sample").alias("other"), F.col("shape").alias("other_shape"), F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    hit = asks.join(other, ["view", "band"]).where((F.col("sample") < F.col("other")) & (F.col("t0") + F.col("u0") > F.col("met") - slack) & (F.col("t1") + F.col("u1") > F.col("met") - slack))
    exact = hit.select("view", similarity(F.col("shape"), F.col("other_shape")).alias("similarity"))
    seen = near.join(met.select("view"), "view").join(far(near, "t0"), "view").where("shape <> pivot").select("view", similarity(F.col("shape"), F.col("pivot")).alias("similarity"))
    return exact.unionByName(seen).groupBy("view").agg(F.min("similarity").alias("similarity"))


def thresholds(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least similarity per view: 0.85 of the smallest pair, at least 0.4; 0.85 without pairs."""
    low = pairs.groupBy("view").agg(F.min("similarity").alias("s"))
    return views.select("view").distinct().join(low, "view", "left").select("view", F.coalesce(F.round(F.greatest(F.lit(0.4), F.col("s") * 0.85), 3), F.lit(0.85)).alias("min_similarity"))


def drift_checks(pages: DataFrame, references: DataFrame) -> DataFrame:
    """One check per (view, url): similarity of a page to its view's reference, and whether it drifted. References are one row per declared view."""
    once = pages.groupBy("view", "url").agg(F.min_by("shape", "seq").alias("shape"))
    r = references.select("view", F.col("shape").alias("reference"), "min_similarity")
    return once.join(r, "view").select("view", "url", similarity(F.col("reference"), F.col("shape")).alias("similarity"), "min_similarity").withColumn("drifted", F.col("similarity") < F.col("min_similarity"))


def structural_diff(a: Column, b: Column, most: int = 40) -> Column:
    """Tokens that only one of two fingerprints has, by position, as ``- x`` and ``+ x``."""
    placed = lambda arr: F.transform(arr, lambda x, i: F.concat(i.cast("string"), F.lit(":"), x))
    gone = F.transform(F.array_except(placed(a), placed(b)), lambda x: F.concat(F.lit("- "), x))
    new = F.transform(F.array_except(placed(b), placed(a)), lambda x: F.concat(F.lit("+ "), x))
    return F.slice(F.concat(gone, new), 1, most)


def cache_lookup(requests: DataFrame, cache: DataFrame, most_bits: int = 12) -> DataFrame:
    """miss without the key, visual-drift beyond ``most_bits`` of difference, else hit."""
    both = requests.join(cache.select("key", F.col("dhash").alias("stored")), "key", "left")
    bits = F.bit_count(F.col("dhash").bitwiseXOR(F.col("stored")))
    return both.withColumn("bits", bits).withColumn("outcome", F.when(F.col("stored").isNull(), "miss").when(F.col("bits") > most_bits, "visual-drift").otherwise("hit"))


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows, columns and channels of an image as Spark's image source gives it: blue, green, red."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _grey(x: np.ndarray) -> np.ndarray:
    """Thousandths of grey, as whole numbers: equal areas then compare as equal."""
    x = x.astype(np.int64)
    return x[..., 0] * 1000 if x.shape[-1] == 1 else x[..., 2] * 299 + x[..., 1] * 587 + x[..., 0] * 114


def _boxes(grey: np.ndarray, rows: int, cols: int, sampled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the pixels of each cell of a grid. ``sampled``: of a side of a cell every eighth part, whole steps."""
    h, w = grey.shape
    down, across = _cells(h, rows, sampled), _cells(w, cols, sampled)
    # whole numbers below 2 ** 53, so that the products are exact
    return (down @ grey.astype(np.float64) @ across.T).astype(np.int64), np.outer(down.sum(1), across.sum(1)).astype(np.int64)


@lru_cache(64)
def _cells(size: int, parts: int, sampled: bool) -> np.ndarray:
    """Which places of a side each of its parts takes, as ones."""
    out = np.zeros((parts, size))
    for k in range(parts):
        lo, hi = k * size // parts, max(k * size // parts + 1, (k + 1) * size // parts)
        out[k, lo : hi : max(1, (hi - lo) >> 3) if sampled else 1] = 1
    return out


def _of_images(images: DataFrame, kind: str, f) -> DataFrame:
    """The columns of rows of Spark's image source with ``f(pixels)`` for the image; the pixels are dropped."""

    @F.pandas_udf(kind)
    def told(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([f(_pixels(*image)) for image in zip(*batch)], dtype=object)

    i = F.col("image")
    return images.select(*[c for c in images.columns if c != "image"], i["origin"].alias("origin"), told(i["data"], i["height"], i["width"], i["nChannels"]).alias("__told"))


def dhash(images: DataFrame) -> DataFrame:
    """Add the 64-bit difference hash of rows of Spark's image source."""

    def hashed(x: np.ndarray) -> int:
        s, n = _boxes(_grey(x), 8, 9, sampled=True)
        bits = s[:, :-1] * n[:, 1:] < s[:, 1:] * n[:, :-1]
        return int(np.packbits(bits.ravel()).view(">i8")[0])

    return _of_images(images, "long", hashed).withColumnRenamed("__told", "dhash")


def signature(images: DataFrame) -> DataFrame:
    """Add the 8 x 8 grey signature of rows of Spark's image source, rounded half up."""

    def signed(x: np.ndarray) -> list[float]:
        s, n = _boxes(_grey(x), 8, 8)
        return ((2 * s + 1000 * n) // (2000 * n)).ravel().astype(float).tolist()

    return _of_images(images, "array<double>", signed).withColumnRenamed("__told", "signature")


def mosaic(images: DataFrame, block: int = 6, most_width: int = 640) -> DataFrame:
    """Rows of Spark's image source with the image in blocks of one colour each, so that its layout can be published but nothing read from
    it: scaled down by ``block`` and up again (to ``most_width`` at most), each pixel that of the nearest place."""

    def nearest(x: np.ndarray, h: int, w: int) -> np.ndarray:
        rows, cols = ((2 * np.arange(to) + 1) * size // (2 * to) for to, size in ((h, x.shape[0]), (w, x.shape[1])))
        return x[rows][:, cols]

    def blocked(x: np.ndarray) -> bytes:
        h, w = x.shape[:2]
        half_up = lambda a, b: (2 * a + b) // (2 * b)
        small = nearest(x, max(1, half_up(h, block)), max(1, half_up(w, block)))
        out_w = min(most_width, w)
        return nearest(small, max(1, half_up(h * out_w, w)), out_w).tobytes()

    w, h = F.col("image.width"), F.col("image.height")
    out_w = F.least(F.lit(most_width), w)
    sized = images.withColumns({"__h": F.greatest(F.lit(1), F.floor((2 * h * out_w + w) / (2 * w))).cast("int"), "__w": out_w, "__n": F.col("image.nChannels")})
    told = _of_images(sized, "binary", blocked)
    return told.withColumn("image", F.struct(F.col("__h").alias("height"), F.col("__w").alias("width"), F.col("__n").alias("nChannels"), F.col("__told").alias("data"))).drop("__h", "__w", "__n", "__told")


def signature_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def thinned_frames(frames: DataFrame, gap_ms: int = 250, least_change: float = 1.5) -> DataFrame:
    """Frames to keep of each scene (scene_id, t): apart in time from the last kept one and visibly different from it; the last one always.
    Frames stream by in order; of a scene the last kept frame and the one before the next are held."""

    def step(state, scene, t, signature):
        kept, before = state or (None, None)
        told = []
        if before is not None and (kept is None or (before[0] - kept[0] >= gap_ms and sum(abs(x - y) for x, y in zip(before[1], kept[1])) / max(1, len(kept[1])) >= least_change)):
            kept = before
            told = [(scene, before[0])]
        return (kept, (t, signature)), told

    kind = frames.schema["scene_id"].dataType.simpleString()
    rows = frames.select("scene_id", F.col("t").cast("long").alias("t"), "signature")
    return stream.by_run(rows, "scene_id", ["t"], step, lambda scene, state: [(scene, state[1][0])], f"scene_id {kind}, t long")


# --- timelines ---


def newest_before(events: DataFrame, marks: DataFrame, group: list[str], lane: str, lanes: list[str], payload: str, t: str = "t") -> DataFrame:
    """At each mark, the newest payload of every lane at or before it. No range join: one ordered pass over both."""
    a = events.select(*group, F.col(t).alias("t"), F.lit(0).alias("is_mark"), F.col(lane).alias("lane"), F.col(payload).alias("payload"), F.lit(None).cast("long").alias("mark_id"))
    b = marks.select(*group, F.col(t).alias("t"), F.lit(1).alias("is_mark"), F.lit(None).cast("string").alias("lane"), F.lit(None).cast(events.schema[payload].dataType).alias("payload"), F.col("mark_id").cast("long").alias("mark_id"))
    w = Window.partitionBy(*group).orderBy("t", "is_mark").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionAll(b)
    return both.select(*group, "t", "mark_id", "is_mark", *[F.last(F.when(F.col("lane") == k, F.col("payload")), ignorenulls=True).over(w).alias(f"last_{k}") for k in lanes]).where("is_mark = 1").drop("is_mark")


def largest_overlap(sessions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The transcript that overlaps each session longest: sessions (session_id, start, end), transcripts (file, start, end), whole numbers.
    Of equal overlaps the last file by name counts; a touch is no overlap.

    No join of all that overlap: three sweeps ask for the best of those that began before the session, that ended within it, and that
    ended after it. So an interval of years costs as much as one of a minute.
    """
    t = transcripts.where("start < end").select(F.col("file").cast("string").alias("file"), F.col("start").cast("long").alias("b0"), F.col("end").cast("long").alias("b1"))
    s = sessions.where("start < end").select("session_id", F.col("start").cast("long").alias("a0"), F.col("end").cast("long").alias("a1"))
    found = sweep.swept(s, t, "a0", "b0", sweep.Before).unionByName(sweep.swept(s, t, "a1", "b1", sweep.Within)).unionByName(sweep.swept(s, t, "-a1", "-b1", sweep.After))
    return found.groupBy("session_id").agg(F.max_by("file", F.struct("ms", "file")).alias("file"), F.max("ms").alias("overlap_ms"))


def newest_within(rows: DataFrame, group: list[str], order: str, most: int | Column, size: str | None = None, budget: int | None = None) -> DataFrame:
    """The newest rows of each group within a number and a budget of bytes; the newest one always."""
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    out = rows.withColumn("__n", F.row_number().over(w))
    kept = F.col("__n") <= most
    if size is not None:
        out = out.withColumn("__sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        kept = (kept & (F.col("__sum") <= budget)) | (F.col("__n") == 1)
    return out.where(kept).drop("__n", "__sum")


def state_visits(lines: DataFrame) -> DataFrame:
    """Visits of each state and the current one, from log lines (run_id, n, line)."""
    state = F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*state\s+(.+)$", 1)), '^"|"$', "")
    nested = F.regexp_extract(state, r'"(\w+)"\s*}*$', 1)
    leaf = F.when(state.startswith("{"), F.when(nested != "", nested).otherwise(state)).otherwise(F.element_at(F.split(state, r"\."), -1))
    found = lines.where(F.col("line").rlike(r"^\s*state\s+.")).withColumn("state", leaf)
    now = found.groupBy("run_id").agg(F.max_by("state", "n").alias("current"))
    return found.groupBy("run_id", "state").agg(F.count("*").alias("visits")).join(now, "run_id")


#: Kinds of run-log lines and their patterns, in order.
LOG_RULES = (
    ("start", r"^▶\s*(\S+)"),
    ("exit", r"^■\s*(?:exited|stopped)\s*(-?\d+)?"),
    ("engine", r"(?i)engine:?\s*(quickjs|worker)"),
    ("state", r"^state\s+(.+)$"),
    ("navigate", r"^navigate\s+(\S+)"),
    ("await", r"await attempt (\d+/\d+) failed \[\w+\]"),
    ("recover", r"^recover:\s*(\w+)"),
    ("action", r"action attempt (\d+/\d+) failed \[\w+\]"),
    ("schema", r"([\w.]+) item \S+ fails schema"),
    ("done", r"^done in ([\d.]+)s"),
    ("unit", r"^unit\s+(\S+?:\S+)\s+\w+"),
    ("interrupt", r"(?i)interrupt[:\s]+(\w+)"),
    ("fault", r"^fault\s+(\S+?):?\s+.*$"),
)


def parsed_log(line: Column) -> Column:
    """Kind, subject, attempt and milliseconds of a run-log line by the first rule that fits."""
    body = F.regexp_replace(F.regexp_replace(line, r"^\s*[·!+]\s*", ""), r"^\s+", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)^(log|info):\s*", ""), r"(?i)^warn:\s*", "warn: ")
    kind, subject = F.lit("other"), body
    for name, pattern in reversed(LOG_RULES):
        kind = F.when(body.rlike(pattern), name).otherwise(kind)
        subject = F.when(body.rlike(pattern), F.regexp_extract(body, pattern, 1)).otherwise(subject)
    return F.struct(kind.alias("kind"), subject.alias("subject"), F.regexp_extract(body, r"attempt (\d+)/", 1).try_cast("int").alias("attempt"), F.regexp_extract(body, r"(\d+)ms", 1).try_cast("long").alias("ms"))


def scene_summary(frames: DataFrame, marks: DataFrame) -> DataFrame:
    """Frames, duration and marks of each scene."""
    f = frames.groupBy("scene_id").agg(F.count("*").alias("frames"), F.max("t").alias("duration"))
    m = marks.groupBy("scene_id").agg(F.count("*").alias("marks"))
    return f.join(m, "scene_id", "left").fillna(0, ["marks"])


def merged_scenes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of scene summaries: the newest version of each id, by start."""
    both = stored.unionByName(new)
    return both.groupBy("scene_id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "scene_id"]), "version").alias("s")).select("scene_id", "s.*").orderBy("t0", "scene_id")
