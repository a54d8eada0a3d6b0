"""Ranked lexical search with hashed max-sketches.

A document's impact on a term is an integer that only the document and the corpus statistics of the term decide; an item's score
of a document is the sum of the impacts of its terms. Each document folds its impacts into a sketch of COORDINATES numbers: terms
are hashed to coordinates, and a coordinate keeps the largest impact of its terms. For a batch of items, one product of the sketches
with the items' coordinate counts gives an upper bound of every score at once. Each item then takes its documents by descending bound
and scores them exactly, until the bound falls below the score of its fiftieth best so far. Tasks keep the best of each item over
all their documents; Spark merges these. Nothing is lost: a document that isn't scored has a bound below fifty scores.

Only terms that some item holds can score, so that statistics are gathered, and sketches made, for these. Items are dealt into
batches of at most ITEM_BYTES of text or ITEMS rows (one item at least); each batch is one pass over the documents, and only a
batch is held by the driver and broadcast.

Special cases: null texts hold no term; documents and items without a term, and scores of 0, give no row. Each row of the items is
an item of its own, also when it repeats another's id or text. Documents that repeat a doc_id are ranked each by themselves; null doc_ids
come first among equal scores. Empty tables give no rows. Very long texts are one piece in memory, in proportion to the text.
Other columns are not read, whatever their names. Terms are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import table

COORDINATES = 1024
#: Largest batch of items, in bytes of text and in rows.
ITEM_BYTES, ITEMS = 4 << 20, 2000
CHUNK = 4 << 20
#: Documents that an item scores exactly before it looks at its threshold again.
STEP = 64


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and how many each text has."""
    data = B.LOWER[raw]
    starts, ends, per_text = B.words(data, offsets, B.LETTER_OR_DIGIT)
    return B.span_hashes(B.prefix_sums(data), starts, ends), per_text


def known_terms(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the vocabulary, occurrences) of the vocabulary's terms, by text, and how many terms each text has."""
    h, per_text = term_hashes(raw, offsets)
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == h
    own, tf = np.unique(np.repeat(np.arange(len(per_text)), per_text)[hit] * len(vocabulary) + at[hit], return_counts=True)
    return own // len(vocabulary), own % len(vocabulary), tf, per_text


class Corpus:
    """Statistics of the documents, as far as a vocabulary needs them."""

    def __init__(self, vocabulary: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int, coordinates: int = COORDINATES):
        self.vocabulary, self.n_docs, self.n_terms, self.coordinates = vocabulary, n_docs, n_terms, coordinates
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.coordinate = (B.mixed(vocabulary) % B.U(coordinates)).astype(np.int64)

    def impacts(self, doc: np.ndarray, at: np.ndarray, tf: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * per_text.astype(np.int64) * self.n_docs) // max(1, self.n_terms)
        return self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))

    def sketches(self, doc: np.ndarray, at: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """A row of coordinatewise maxima for each document; doubles hold these integers exactly."""
        out = np.zeros((n, self.coordinates))
        order = np.argsort(impact, kind="stable")  # of the values that an assignment gives one place, the last one stays
        out[doc[order], self.coordinate[at[order]]] = impact[order]
        return out


def statistics(texts: DataFrame, vocabulary: np.ndarray, coordinates: int = COORDINATES) -> Corpus:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, _, raw, offsets in B.text_chunks(batch, 0, CHUNK):
                _, at, _, per_text = known_terms(raw, offsets, vocabulary)
                df += np.bincount(at, minlength=len(vocabulary))
                docs, terms = docs + int((per_text > 0).sum()), terms + int(per_text.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], met])), pa.array(np.concatenate([[docs, terms], df[met]]))], names=["at", "n"])

    found = texts.select("text").mapInArrow(scan, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # two rows and one for each term at most
    n = dict(zip(found.column("at").to_pylist(), found.column("n").to_pylist()))
    return Corpus(vocabulary, np.array([n.get(k, 0) for k in range(len(vocabulary))], np.int64), n.get(-2, 0), n.get(-1, 0), coordinates)


class Best:
    """The best documents of one item so far: by score, then null ids, then smaller ids."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.known, self.key = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, known: np.ndarray, key: np.ndarray) -> None:
        s, k, i = np.concatenate([self.score, score]), np.concatenate([self.known, known]), np.concatenate([self.key, key])
        order = np.lexsort([i, k, -s])[: self.top]
        self.score, self.known, self.key = s[order], k[order], i[order]


def ranked(texts: DataFrame, corpus: Corpus, items: list[np.ndarray], top: int, step: int, chunk: int) -> DataFrame:
    """(item, key, score): the best documents of each item (places in the vocabulary) in each task."""
    counts = np.zeros((corpus.coordinates, len(items)))
    for q, terms in enumerate(items):
        np.add.at(counts[:, q], corpus.coordinate[terms], 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        wanted = np.zeros(len(corpus.vocabulary), bool)
        for batch in batches:
            ids = batch.column(0)
            keys, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in B.text_chunks(batch, 1, chunk):
                doc, at, tf, per_text = known_terms(raw, offsets, corpus.vocabulary)
                impact = corpus.impacts(doc, at, tf, per_text)
                bounds = corpus.sketches(doc, at, impact, b - a) @ counts
                begins = np.searchsorted(doc, np.arange(b - a + 1))
                for q, (mine, terms) in enumerate(zip(best, items)):
                    bound = bounds[:, q]
                    left = np.flatnonzero(bound >= mine.threshold)
                    left = left[np.argsort(-bound[left], kind="stable")]
                    wanted[terms] = True
                    while len(left) and bound[left[0]] >= mine.threshold:
                        now, left = left[:step], left[step:]
                        sizes = begins[now + 1] - begins[now]
                        ends = np.cumsum(sizes)
                        places = np.repeat(begins[now] - (ends - sizes), sizes) + np.arange(ends[-1])
                        sums = np.concatenate([[0], np.cumsum(np.where(wanted[at[places]], impact[places], 0))])
                        exact = sums[ends] - sums[ends - sizes]
                        good = exact >= mine.threshold
                        if good.any():
                            mine.add(exact[good], known[a:b][now[good]], keys[a:b][now[good]])
                    wanted[terms] = False
        size = [len(m.score) for m in best]
        key, known = (np.concatenate([getattr(m, c) for m in best]) for c in ("key", "known"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items)), size)), pa.array(key, mask=~known), pa.array(np.concatenate([m.score for m in best]))], names=["item", "key", "score"]
        )

    return texts.select("key", "text").mapInArrow(scan, "item long, key long, score long")


def batches(items: DataFrame, most: int) -> list[DataFrame]:
    """The items (id, text) in parts of bounded size, dealt by a hash of their texts."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(2 * n / most), math.ceil(2 * size / ITEM_BYTES)) if n > most or size > ITEM_BYTES else 1
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) for p in range(parts)]


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    coordinates: int = COORDINATES, step: int = STEP, chunk: int = CHUNK, most_items: int = ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item. ``key`` is a column of integers. The last four change the work only."""
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    asked = items.select(F.col(f"`{item_key}`").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    spark, out = docs.sparkSession, None
    for part in batches(asked, most_items):
        held = part.toArrow()
        terms = []
        for text_of in held.column("text").to_pylist():
            raw = text_of.encode()
            terms.append(np.unique(term_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))
        vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, B.U)]))
        if not len(vocabulary):
            continue
        found = ranked(texts, statistics(texts, vocabulary, coordinates), [np.searchsorted(vocabulary, t) for t in terms], top, step, chunk)
        order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key")))
        first = found.withColumn("rank", order.cast("int")).where(F.col("rank") <= top)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(terms)), pa.int64()), "id": held.column("id")}))
        one = first.join(F.broadcast(names), "item").select(F.col("id").alias(item_key), "rank", F.col("key").alias(key), "score")  # names: a row of each item of the batch
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = asked.where("false").select(F.col("id").alias(item_key), F.lit(0).cast("int").alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
tfs AS (SELECT row_no, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT row_no, sum(tf)::BIGINT AS n FROM tfs GROUP BY row_no),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_no, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS item_no, item_id, text FROM benchmark)),
scores AS (SELECT item_no, item_id, t.row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
           FROM asked a JOIN tfs t ON t.term = a.term JOIN weights g ON g.term = t.term JOIN lengths l ON l.row_no = t.row_no, corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scores JOIN docs USING (row_no) WHERE score > 0)
WHERE rank <= 50
"""
