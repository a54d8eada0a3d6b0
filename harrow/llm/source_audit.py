"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

Terms are counted in the tasks that read the texts and meet by (language, term), so a source that holds a third of all rows is no
key of any shuffle. Pairs of sources are compared on run-length columns: the vocabulary of a language is dealt into slices by a
hash of the term; within a slice it is reordered so that equal counts stand side by side, each source's counts become runs, and for
each pair of sources the boundaries of both runs are united, so that a difference is computed once for a stretch of terms and
multiplied by its length. Differences add up over slices.

A slice holds the columns of at most two tiles of TILE sources, whatever the number of sources, and some SLICE terms.

Special cases: null text, language and source are ''. Repeated rows count each time. A group whose texts hold no kept term takes
part with counts of 0; a language without a kept term has pairs of value 0 and no terms. An empty table gives no rows. Very long
texts are counted in one piece, in memory in proportion to the text. Only the three named columns are read, so further
columns, whatever their names, do no harm. Terms are counted within a task by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import keep, table

#: Parts of a whole that probabilities are told in, and what is added to each count.
WHOLE, ADDED = 1_000_000_000, 5
#: Sources in a tile, and terms in a slice, on average.
TILE, SLICE = 512, 1024
CHUNK = 8 << 20


def term_counts(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text), added up within pieces of a task, and a row with the term '' for each group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            n_sources = max(1, len(sources.dictionary))
            group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
            for a, b, raw, offsets in B.text_chunks(batch, 2, chunk):
                data = B.LOWER[raw]
                starts, ends, per_text = B.words(data, offsets, B.LETTER)
                h = B.span_hashes(B.prefix_sums(data), starts, ends)
                _, first, word = np.unique(h, return_index=True, return_inverse=True)
                own, n = np.unique(word * (b - a) + np.repeat(np.arange(b - a), per_text), return_counts=True)  # of each word and text
                groups, own_group = np.unique(group[a:b], return_inverse=True)
                place = own // (b - a) * len(groups) + own_group[own % (b - a)]
                at, back = np.unique(place, return_inverse=True)
                word, g = at // len(groups), groups[at % len(groups)]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(np.concatenate([g, groups]) // n_sources)),
                        sources.dictionary.take(pa.array(np.concatenate([g, groups]) % n_sources)),
                        pa.concat_arrays([B.spans_array(data, starts[first[word]], ends[first[word]]), pa.array([""] * len(groups), pa.string())]),
                        pa.array(np.concatenate([np.bincount(back, n, len(at)).astype(np.int64), np.zeros(len(groups), np.int64)])),
                        pa.array(np.concatenate([np.bincount(back, minlength=len(at)), np.zeros(len(groups), np.int64)])),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return texts.select("lang", "source", "text").mapInArrow(scan, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * kept)), in decimals, which no count makes overflow."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (count + ADDED).cast(wide), (total + F.lit(ADDED) * kept).cast(wide)) + 1


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for an array, by long division: three digits of WHOLE at a time, so that 64 bits hold every step."""
    whole = total + ADDED * kept
    rest, out = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def reordered(counts: np.ndarray) -> np.ndarray:
    """The rows (terms) so that equal counts of each column (source) stand side by side, columns of few different counts first."""
    kinds = np.array([len(np.unique(c)) for c in counts.T])
    return counts[np.lexsort(counts.T[np.argsort(-kinds, kind="stable")])] if counts.size else counts


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and their values."""
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
    return starts, column[starts]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of |a - b| over two columns of runs: a difference for each stretch between boundaries of either, times its length."""
    bounds = np.union1d(a[0], b[0])
    lengths = np.diff(np.append(bounds, size))
    first, second = (x[1][np.searchsorted(x[0], bounds, "right") - 1] for x in (a, b))
    return int((np.abs(first - second) * lengths).sum())


def slice_pairs(key: tuple, rows: pa.Table, in_tile: int = TILE) -> pa.Table:
    """(lang, a, b, value) of the pairs of sources in one slice. Rows without a term tell a source's total and the vocabulary's size."""
    lang, _, one, two = (k.as_py() for k in key)
    at, n, kept = (rows.column(c).to_numpy() for c in ("at", "n", "kept"))
    head = rows.column("term").is_null().to_numpy()
    sources, where = np.unique(at[head], return_index=True)
    totals, kept = n[head][where], int(kept[head][0])
    terms = rows.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode()
    counts = np.zeros((len(terms.dictionary), len(sources)), np.int64)
    counts[terms.indices.to_numpy(), np.searchsorted(sources, at[~head])] = n[~head]
    counts = reordered(counts)
    columns = []
    for j, total in enumerate(totals.tolist()):
        starts, values = runs(counts[:, j])
        columns.append((starts, shares(values, total, kept) if len(values) else values))
    tile = sources // in_tile
    out = [
        (int(sources[i]), int(sources[j]), distance(columns[i], columns[j], len(counts)) if len(counts) else 0)
        for i in range(len(sources))
        for j in range(i + 1, len(sources))
        if one == two or tile[i] != tile[j]
    ]
    a, b, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


def audit(
    docs: DataFrame, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source",
    in_tile: int = TILE, in_slice: int = SLICE, chunk: int = CHUNK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source the distance to every other source of its language (``pair``), and the
    terms that it uses more than its language does (``term``, at most ``top``). Terms count that ``least_docs`` texts of a language hold. The last three
    change the work only."""
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    met = term_counts(texts, chunk).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # the exchange by (lang, term) serves both groupings; a term's list has an entry for each source at most
    terms = met.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    terms = keep(terms.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "terms")
    entries = terms.select("lang", "term", "total", F.explode("by").alias("e")).select("lang", "term", "total", "e.source", "e.n")

    in_lang = terms.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"), F.sum("total").alias("lang_total"))
    groups = entries.groupBy("lang", "source").agg(F.sum("n").alias("source_total")).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    in_lang = in_lang.join(sizes, "lang").withColumn("slices", F.greatest(F.ceil(F.col("kept") / in_slice), F.lit(1)))
    groups = keep(groups.join(in_lang, "lang"), "groups")  # one row per group

    def tiled(df: DataFrame) -> DataFrame:
        own, tiles = F.floor(F.col("at") / in_tile), F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_sources") - 1) / in_tile))
        with_other = F.transform(tiles, lambda t: F.struct(F.least(t, own).alias("one"), F.greatest(t, own).alias("two")))
        return df.withColumn("tiles", F.explode(with_other)).select("lang", "slice", "tiles.one", "tiles.two", "term", "at", "n", "kept")

    known = entries.where("term != ''").join(groups, ["lang", "source"])
    cells = tiled(known.withColumn("slice", F.pmod(F.xxhash64("term"), "slices")))
    heads = tiled(groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("n", F.col("source_total")))
    found = cells.unionByName(heads).groupBy("lang", "slice", "one", "two").applyInArrow(lambda key, rows: slice_pairs(key, rows, in_tile), "lang string, a long, b long, value long")
    pairs = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "at", "source")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = (
        both.join(name.withColumnRenamed("at", "a"), ["lang", "a"])
        .join(name.withColumnsRenamed({"at": "b", "source": "item"}), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
    )
    p, q = share(F.col("n"), F.col("source_total"), F.col("kept")), share(F.col("total"), F.col("lang_total"), F.col("kept"))
    more = known.where("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value")).where("value > 0")
    return pair.unionByName(more.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row_no, lang, source,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
langs AS (SELECT g.lang, count(term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
uses AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, l.v, l.n AS lang_n, coalesce(u.n, 0)::HUGEINT AS n
           FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs l ON l.lang = g.lang
           LEFT JOIN (SELECT lang, source, sum(n) AS n FROM uses GROUP BY ALL) u ON u.lang = g.lang AND u.source = g.source),
cells AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (g.lang_n + 5 * g.v) AS q
          FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS value FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term
                     GROUP BY ALL) s ON s.lang = a.lang AND s.one = a.source AND s.two = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""
