"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Every window of ``LENGTH`` bytes names its anchor: the ``GRAM``-byte gram of least hash in it (the first among equals).
   Equal windows have their anchors at the same place, so they can only be found among anchors with equal grams; one
   anchor serves some 85 windows. An anchor's context is the bytes of all windows that it serves.
2. Anchors meet by the hash of their gram. Contexts with equal digests repeat as a whole and are settled here, so copies of
   any number travel no further; a gram with one context is unique. For the others one anchor per context goes on.
3. Their suffixes (the bytes from the anchor on) are sorted within each task, cut by gram into runs and front-coded: each
   suffix is stored as the length it shares with the one before, and the rest. Runs are exchanged as single rows.
4. A task merges its runs with a loser tree that carries common-prefix lengths: a match compares the known lengths first
   and reads bytes only beyond them. The merged order comes with the prefix each suffix shares with the last.
5. In a stretch of suffixes that share the gram, the shared prefix on the right and the shared context on the left tell
   which windows are equal: window offset o needs o bytes on the left and LENGTH - o on the right.

Equal texts are one text here, known to repeat as a whole. No step gathers the rows of a gram: step 2 streams over sorted
rows, and step 5 holds the distinct contexts of one gram.

Cases: null and empty texts have no bytes; a text below ``LENGTH`` bytes keeps all; rows that repeat a text, with the same
id or not, count as that many texts; very long texts are read whole; an empty table gives no rows. Texts and whole contexts are
told apart by 64-bit hashes: of N different ones about N * N / 2 ** 65 pairs are confused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import keep, partitions, table

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams of a window
#: Distinct contexts of a gram that are compared one by one; more are compared offset by offset.
FEW = 8
U = np.uint64


def window_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first and last window start, gram hash, context digest) of all anchors; positions count from the first text."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(U), none.astype(U)
    sums = B.prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = B.span_hashes(sums, at, at + GRAM)
    keys = (grams >> U(32) << U(32)) | at.astype(U)
    padded = np.full(-(-len(keys) // SPAN) * SPAN + SPAN, U(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - LENGTH + 1, 0))
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][text]
    least = (np.minimum(behind[starts], ahead[starts + SPAN - 1]) & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    m, lo, hi = least[first], starts[first], starts[last]
    digest = B.mixed(B.span_hashes(sums, lo, hi + LENGTH) + (m - lo).astype(U) * B.MIX[0] + (m - hi).astype(U) * B.MIX[1])
    return text[first], m, lo, hi, grams[m], digest


ANCHOR = "gram long, digest long, text_key long, place long, start long, end long"


def anchors(texts: DataFrame) -> DataFrame:
    """Rows of (text_key, text) to anchors; a row with ``gram`` null is an interval already known to repeat within its text.

    ``place`` packs the anchor's position and how far before it its first and last window start.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.text_chunks(batch, 1):
                keys = batch.column(0).slice(a, b - a).to_numpy()
                text, m, lo, hi, gram, digest = window_anchors(data, off)
                if not len(text):
                    continue
                key = keys[text]
                _, one, count = np.unique(B.mixed(digest ^ B.mixed(key.view(U))), return_index=True, return_counts=True)
                _, which = np.unique(B.mixed(digest ^ B.mixed(key.view(U))), return_inverse=True)
                inside = count[which] > 1
                m, lo, hi = m - off[text], lo - off[text], hi - off[text]
                place = (m << 16) | ((m - lo) << 8) | (m - hi)
                n, k = len(one), int(inside.sum())
                void = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(gram[one].view(np.int64)), void]),
                        pa.concat_arrays([pa.array(digest[one].view(np.int64)), void]),
                        pa.array(np.concatenate([key[one], key[inside]])),
                        pa.concat_arrays([pa.array(place[one]), void]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(lo[inside])]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(hi[inside] + LENGTH)]),
                    ],
                    names=["gram", "digest", "text_key", "place", "start", "end"],
                )

    return texts.mapInArrow(scan, ANCHOR)


def settled(found: DataFrame, n: int) -> DataFrame:
    """(text_key, place, known): anchors whose context repeats as a whole (known), and one anchor of each context to compare.

    One pass over rows sorted by gram and digest. Held across batches: the last row and the first row of its gram.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row
        tied = False  # the held row has the context of the row before it
        opener, sent = None, False  # the first row of the held row's gram, and whether it has gone on
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            if not len(rows):
                continue
            carried = held is not None
            if carried:
                rows = np.concatenate([held[None], rows])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]  # equal texts give equal rows
            same_gram = np.append(False, rows[1:, 0] == rows[:-1, 0])
            same_context = np.append(False, same_gram[1:] & (rows[1:, 1] == rows[:-1, 1]))
            turn = same_gram & ~same_context  # a further context of the gram begins
            group = np.cumsum(~same_gram) - 1
            heads = rows[~same_gram]
            went = np.zeros(len(heads), bool)
            if carried:
                heads[0], went[0] = opener, sent
            mixed = np.bincount(group, weights=turn, minlength=len(heads)) > 0
            go = [rows[turn], heads[mixed & ~went]]
            known = same_context.copy()
            known[:-1] |= same_context[1:]
            known[0] |= carried and tied
            held, opener, sent, tied = rows[-1].copy(), heads[-1].copy(), bool(went[-1] or mixed[-1]), bool(known[-1])
            yield placed(rows[:-1][known[:-1]], True)
            yield placed(np.concatenate(go), False)
        if held is not None and tied:
            yield placed(held[None], True)

    def placed(rows: np.ndarray, known: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(np.full(len(rows), known))], names=["text_key", "place", "known"])

    rows = found.where("gram IS NOT NULL").select("gram", "digest", "text_key", "place")
    return rows.repartition(n, "gram").sortWithinPartitions("gram", "digest", "text_key", "place").mapInArrow(scan, "text_key long, place long, known boolean")


# --- sorted runs ---


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two byte strings that agree in their first ``at`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n if not differ else n - (differ.bit_length() + 7) // 8


def front_coded(rows: list[tuple]) -> bytes:
    """A run of (suffix, left, text_key, place), sorted, as bytes."""
    tails, lefts, last = [], [], b""
    numbers = np.empty((len(rows), 5), np.int64)
    for k, (suffix, left, key, place) in enumerate(rows):
        n = shared(last, suffix, 0)
        tails.append(suffix[n:])
        lefts.append(left)
        numbers[k] = n, len(suffix) - n, len(left), key, place
        last = suffix
    return zlib.compress(b"".join([len(rows).to_bytes(8, "big"), numbers.tobytes(), *tails, *lefts]), 1)


def read_run(run: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(suffix, prefix shared with the one before, (left, text_key, place)) in order."""
    raw = zlib.decompress(run)
    n = int.from_bytes(raw[:8], "big")
    numbers = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(n, 5).tolist()
    at = 8 + 40 * n
    left_at = at + sum(x[1] for x in numbers)
    last = b""
    for common, tail, left, key, place in numbers:
        last = last[:common] + raw[at : at + tail]
        yield last, common, (raw[left_at : left_at + left], key, place)
        at += tail
        left_at += left


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, tuple]]:
    """Merge front-coded runs. Every head knows the prefix it shares with the last row put out; the longer one wins its
    match unread, and equal ones are compared from there on, which leaves the loser's new length."""
    heads = [read_run(r) for r in runs]
    k = max(1, len(heads))
    rows: list = [next(h, None) for h in heads] or [None]
    known = [0] * k  # shared with the last row put out (at the start: with nothing)

    def beats(a: int, b: int) -> bool:
        x, y = rows[a], rows[b]
        if y is None or x is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        n = shared(x[0], y[0], known[a])
        wins = x[0][n:] <= y[0][n:] if n < min(len(x[0]), len(y[0])) else len(x[0]) <= len(y[0])
        known[b if wins else a] = n
        return wins

    losers, champion = [-1] * k, 0
    for run in range(k):
        winner, seat = run, (run + k) // 2
        while seat > 0:
            if losers[seat] < 0:
                losers[seat], winner = winner, -1
                break
            if beats(losers[seat], winner):
                losers[seat], winner = winner, losers[seat]
            seat //= 2
        if winner >= 0:
            champion = winner
    common = 0
    while rows[champion] is not None:
        yield rows[champion][0], common, rows[champion][2]
        rows[champion] = next(heads[champion], None)
        known[champion] = rows[champion][1] if rows[champion] else 0
        winner, seat = champion, (champion + k) // 2
        while seat > 0:
            if beats(losers[seat], winner):
                losers[seat], winner = winner, losers[seat]
            seat //= 2
        champion = winner
        common = known[champion]


def equal_windows(rights: list[int], items: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(text_key, start, end) of what repeats among the contexts of one gram.

    ``items`` are (left, text_key, place) in suffix order, lefts reversed; ``rights[k]`` is shared by suffixes k - 1 and k.
    """
    n = len(items)
    high = [(p >> 8) & 255 for _, _, p in items]
    low = [p & 255 for _, _, p in items]
    least, most = [LENGTH] * n, [-1] * n
    if n <= FEW:
        for i in range(n):
            right = LENGTH
            for j in range(i + 1, n):
                right = min(right, rights[j])
                a = max(LENGTH - right, low[i], low[j])
                b = min(shared(items[i][0], items[j][0], 0), high[i], high[j])
                if a <= b:
                    for x in (i, j):
                        least[x], most[x] = min(least[x], a), max(most[x], b)
    else:
        order = sorted(range(n), key=lambda x: items[x][0])
        lefts = np.array([0] + [shared(items[order[x - 1]][0], items[order[x]][0], 0) for x in range(1, n)])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        right, lo, hi = np.array(rights), np.array(low), np.array(high)
        small, large = np.full(n, LENGTH), np.full(n, -1)
        for o in range(int(lo.min()), int(hi.max()) + 1):
            live = np.flatnonzero((lo <= o) & (o <= hi))
            if len(live) < 2:
                continue
            cls = np.cumsum(right < LENGTH - o)[live] * (n + 1) + np.cumsum(lefts < o)[rank[live]]
            _, which, count = np.unique(cls, return_inverse=True, return_counts=True)
            hit = live[count[which] > 1]
            small[hit] = np.minimum(small[hit], o)
            large[hit] = np.maximum(large[hit], o)
        least, most = small.tolist(), large.tolist()
    for (_, key, place), a, b in zip(items, least, most):
        if b >= 0:
            m = place >> 16
            yield key, m - b, m - a + LENGTH  # windows of one anchor overlap, so the first and last tell all


def compared(asked: DataFrame, n: int) -> DataFrame:
    """(text_key, start, end): exact repeats among the contexts of rows (text, text_key, places)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        held = 0

        def runs() -> pa.RecordBatch:
            out = [(p, front_coded(sorted(rows))) for p, rows in parts.items()]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "run"])

        for batch in batches:
            for text, key, places in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                for place in places.values.to_pylist():
                    m, a, b = place >> 16, (place >> 8) & 255, place & 255
                    suffix = raw[m : m - b + LENGTH]
                    left = raw[m - a : m][::-1]
                    parts.setdefault(zlib.crc32(suffix[:GRAM]) % n, []).append((suffix, left, key, place))
                    held += 1
                if held >= 100_000:
                    yield runs()
                    held = 0
        if parts:
            yield runs()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and p != part:
                    yield from intervals(held)
                    held = []
                part = p
                held.append(run.as_py())
        if held:
            yield from intervals(held)

    def intervals(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out, rights, items = [], [], []
        for _, common, item in merged(runs):
            if common < GRAM and items:
                out.extend(equal_windows(rights, items) if len(items) > 1 else ())
                rights, items = [], []
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
            rights.append(common)
            items.append(item)
        if len(items) > 1:
            out.extend(equal_windows(rights, items))
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["text_key", "start", "end"])

    runs = asked.select("text", "text_key", "places").mapInArrow(cut, "part int, run binary")
    return runs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, "text_key long, start long, end long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(text_key, spans): the maximal repeated byte runs of each distinct text, as flat starts and ends. ``texts`` has text_key, text, id."""
    n = partitions(texts.sparkSession)
    found = keep(anchors(texts.select("text_key", "text")), "anchors")
    rows = keep(settled(found, n), "settled")
    position = lambda shift: F.shiftright("place", 16) - F.shiftright("place", shift).bitwiseAND(F.lit(255))
    known = rows.where("known").select("text_key", position(8).alias("start"), (position(0) + LENGTH).alias("end"))
    inside = found.where("gram IS NULL").select("text_key", "start", "end")
    places = rows.where("NOT known").groupBy("text_key").agg(F.collect_set("place").alias("places"))
    one = texts.groupBy("text_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size"))
    one = keep(one, "texts")
    first = places.join(one.select("text_key", F.col("id").alias("first")), "text_key")
    asked = texts.join(first, "text_key").where(F.col("id").eqNullSafe(F.col("first"))).drop("first").dropDuplicates(["text_key"])
    exact = compared(asked, n)
    whole = one.where(f"copies > 1 AND size >= {LENGTH}").select("text_key", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = None, []
        out: list[tuple[int, list[int]]] = []
        for batch in batches:
            for k, a, b in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                if k != key:
                    if spans:
                        out.append((key, spans))
                    key, spans = k, []
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                else:
                    spans += [a, b]
            yield flat(out)
            out = []
        if spans:
            yield flat([(key, spans)])

    def flat(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["text_key", "spans"])

    pieces = keep(known.unionByName(inside).unionByName(exact), "pieces").unionByName(whole)
    return pieces.repartition(n, "text_key").sortWithinPartitions("text_key", "start").mapInArrow(unite, "text_key long, spans array<long>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, removed, kept): the text as bytes, its removed spans (flat starts and ends) and the bytes that stay."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spans = keep(repeated_spans(texts), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, s in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = t.as_buffer().to_pybytes()
                ends = [0, *(s or []), len(raw)]
                kept.append(b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=["id", "text", "removed", "kept"])

    both = texts.join(spans, "text_key", "left").select("id", "text", F.col("spans").alias("removed"))
    id_type = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(cut, f"id {id_type}, text string, removed array<long>, kept binary").withColumnRenamed("id", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    size = F.octet_length("text").cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Every 200-byte string of the table, counted.
OP3_SQL = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS opens FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS rest FROM q GROUP BY doc_id),
k AS (SELECT q.doc_id, string_agg(substr(d.x, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, (2 * coalesce(rest, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""
