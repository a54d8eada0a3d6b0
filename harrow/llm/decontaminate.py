"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Tokens are the lower-cased runs of letters and digits. A seed is a fixed mask over a window of tokens: the hash of the tokens
at its marked positions, so a substituted token at an ignored position does not lose the hit. Training and test seeds
meet in a join; each hit names a diagonal (document position minus item position), along which the whole item is compared. A
document leaks an item when some stretch of ``STRETCH`` item tokens (the whole item if shorter) is equal in at least
``SHARE`` of its tokens. The masks miss no such stretch: of every way to substitute a fifth of 4 to 16 tokens, one mask at
least leaves all its marked positions alone (enumerated in the tests). Items too short for a mask are met by their first
token; with fewer than five tokens, all must be equal.

The test side is broadcast when its measured token count is at most ``BROADCAST_TOKENS``; a larger one is joined by a
shuffle of (hash, position), and token hashes are then fetched for the rows that were hit. Both paths give the same rows.

Cases: null or empty texts and empty tables give no rows; repeated rows of a document give one; a null key is a key like any
other; items that share a key but not their text are compared apart, and the best share counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let, table

#: Marked positions of each seed.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
#: Tokens that the shortest mask spans, and the number of the seed that stands for shorter items.
SPAN, SHORT = 4, len(MASKS)
STRETCH, SHARE = 16, 0.8
BROADCAST_TOKENS = 1_000_000

TOKENS = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKENS, -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def hashed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_key, h, n): token hashes once per row. The generator keeps them from being computed anew at each use."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    return rows.select(k.alias("key"), F.xxhash64(k, t).alias("row_key"), F.explode(F.array(token_hashes(t))).alias("h")).withColumn("n", F.size("h"))


def seeded(rows: DataFrame, *keep: str, short: bool) -> DataFrame:
    """(keep..., seed, place) for each seed of each row; ``short`` adds those of single tokens."""
    span = 1 + max(m[-1] for m in MASKS)
    # token k places on, side by side in one row for each place
    ahead = [F.col("h"), *(F.slice("h", k + 1, F.greatest(F.col("n") - k, F.lit(0))) for k in range(1, span))]
    places = rows.select("n", *keep, F.posexplode(F.arrays_zip(*(x.alias(f"t{k}") for k, x in enumerate(ahead)))).alias("place", "t"))
    at = lambda k: F.col(f"t.t{k}")
    of = [F.when(at(mask[-1]).isNotNull(), F.xxhash64(F.lit(no), *map(at, mask))) for no, mask in enumerate(MASKS)]
    if short:
        of.append(F.xxhash64(F.lit(SHORT), at(0)))
    return places.select("n", *keep, "place", F.posexplode(F.array(*of)).alias("mask", "seed")).where("seed IS NOT NULL")


def leak_size(piece: Column, item: Column, diagonal: Column) -> Column:
    """The most equal tokens of any stretch of the item along the diagonal, as a share of the stretch."""
    length, lead = F.least(F.size(item), F.lit(STRETCH)), F.greatest(-diagonal, F.lit(0))
    equal = F.transform(item, lambda x, j: F.when(F.get(piece, j - lead) == x, 1).otherwise(0))
    return let(
        equal,
        lambda e: F.array_max(
            F.transform(F.sequence(F.lit(1), F.size(e) - length + 1), lambda s: F.aggregate(F.slice(e, s, length), F.lit(0), lambda a, b: a + b) / length)
        ),
    )


def along(h: Column, diagonal: Column, n: Column) -> Column:
    """The document's tokens that an item of n tokens meets along a diagonal."""
    return F.slice(h, F.greatest(diagonal, F.lit(0)) + 1, F.greatest(n + F.least(diagonal, F.lit(0)), F.lit(0)))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast: bool | None = None) -> DataFrame:
    """(key, item_key, share): the items that each document leaks, once each, with the share of its best stretch."""
    items = hashed(benchmark, item_key, item_text).where("n > 0")
    n_tokens, n_short = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") < SPAN, 1))).first()
    broadcast = n_tokens <= BROADCAST_TOKENS if broadcast is None else broadcast
    sown = seeded(items, "row_key", short=n_short > 0).where(f"mask < {SHORT} OR (n < {SPAN} AND place = 0)")
    test = sown.select(F.col("row_key").alias("item"), F.col("n").alias("item_n"), "seed", F.col("place").alias("item_place")).distinct()
    whole = items.select(F.col("row_key").alias("item"), F.col("key").alias("item_key"), F.col("h").alias("item_h")).dropDuplicates(["item"])
    rows = hashed(docs, key, text)
    diagonal = F.col("place") - F.col("item_place")
    if broadcast:
        # only the tokens that an item can meet go on from a hit
        hits = seeded(rows, "key", "row_key", "h", short=n_short > 0).join(F.broadcast(test), "seed").select("key", "row_key", "item", diagonal.alias("diagonal"), along(F.col("h"), diagonal, F.col("item_n")).alias("piece"))
        pairs = hits.dropDuplicates(["row_key", "item", "diagonal"]).join(F.broadcast(whole), "item")
    else:
        hits = seeded(rows, "row_key", short=n_short > 0).join(test, "seed").select("row_key", "item", "item_n", diagonal.alias("diagonal")).distinct()
        met = hits.join(rows.select("key", "row_key", "h").dropDuplicates(["row_key"]), "row_key")
        pairs = met.select("key", "item", "diagonal", along(F.col("h"), F.col("diagonal"), F.col("item_n")).alias("piece")).join(whole, "item")
    found = pairs.select("key", "item_key", F.explode(F.array(leak_size(F.col("piece"), F.col("item_h"), F.col("diagonal")))).alias("share")).where(F.col("share") >= SHARE)
    return found.groupBy(F.col("key").alias(key), F.col("item_key").alias(item_key)).agg(F.max("share").alias("share"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_MASK_SQL = " UNION ALL ".join(
    f"SELECT id, i AS place, {no} AS mask, list_value({', '.join(f't[i + {k}]' for k in m)}) AS seed FROM {{x}}, LATERAL (SELECT unnest(range(1, len(t) - {m[-1]} + 1)) AS i)" for no, m in enumerate(MASKS)
)
OP6_SQL = rf"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT * FROM (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark) WHERE len(t) >= 1),
ds AS ({_MASK_SQL.format(x='d')} UNION ALL SELECT id, i, {SHORT}, list_value(t[i]) FROM d, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
bs AS ({_MASK_SQL.format(x='b')} UNION ALL SELECT id, 1, {SHORT}, list_value(t[1]) FROM b WHERE len(t) < {SPAN}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.place - bs.place AS diagonal FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
e AS (SELECT doc_id, item_id, diagonal, least(len(b.t), {STRETCH}) AS n, j, CASE WHEN diagonal + j BETWEEN 1 AND len(d.t) AND d.t[diagonal + j] = b.t[j] THEN 1 ELSE 0 END AS same
  FROM (SELECT hits.*, unnest(range(1, len(b0.t) + 1)) AS j FROM hits JOIN b AS b0 ON b0.id = item_id) h JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
w AS (SELECT doc_id, item_id, n, j, len(list(same) OVER q) AS k, list_sum(list(same) OVER q) AS s FROM e WINDOW q AS (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN {STRETCH - 1} PRECEDING AND CURRENT ROW))
SELECT doc_id, item_id, max(s / n)::DOUBLE AS share FROM w WHERE k = n AND s / n >= {SHARE} GROUP BY ALL"""
