"""Exact Jaccard join on word shingles through a token-group matrix.

1. One scan reduces each text to a digest of its shingle set (equal sets are one class from here on) and a count sketch of
   all shingles, of fixed size. The sketch only orders shingles, rare ones first; any order gives the same links.
2. A set keeps a prefix in that order, long enough that two sets over the threshold share a shingle of their prefixes.
   Prefix shingles that no other class of a size within reach has are dropped; classes without others have no link and leave here.
3. Crowds, the sets that hold a shingle shared by ``CROWD`` sets or more, are dealt into groups of like sets ``ROUNDS`` times, by
   another of their shared shingles each time, and compared with the leaders of their groups. Verified links make components.
4. The sets are partitioned into cells of about ``GROUP`` or fewer: the members of one component, or sets that are alone so
   far and have their most shared shingle and nearly their size in common. The matrix holds, for each cell, the union of its
   prefix shingles. A set meets, once per shingle of the union that it has, the cells of larger components and, if it is
   alone, those of sets alone; it becomes a query of a cell only if it shares enough of the union (``reachable``). A crowd
   that is one component thus meets none of its own cells, and strangers meet its cells, not its sets.
5. In a cell's task the overlap with the union of the members' whole sets is the bound; only cells whose bound reaches the
   required overlap are opened, and each member not yet connected there is compared exactly. All links give the components.

No text moves before step 3, and then only those of crowds and of cells and queries within reach. Which rows to fetch is told
by a bitmap of fixed size, made exact by a join. Sets travel as deflated texts and are hashed where they are compared. No step
lists the pairs of a group: equal texts are one class, near copies meet leaders, and a query meets cells, never single sets.

Cases: null, empty and wordless texts have no shingles and are their own component; a text of fewer than five words has one
shingle; rows that repeat an id count as one document each with the same component; empty tables give no rows. A null id
links like any other; the smallest id is taken over the ids that are not null, and is null where there is none.
Words, shingles and classes are told apart by 64-bit hashes: of N distinct sets about N * N / 2 ** 65 pairs are confused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._links import components
from ._shared import WORD, keep, partitions, table

WIDTH = 5
#: Required similarity in percent.
PERCENT = 80
#: Counters of the sketch (its size is fixed: 4 MB), blocks it travels in, sets of a cell, leaders a set is compared with.
COUNTERS, BLOCKS, GROUP, LEADERS = 1 << 20, 64, 64, 32
#: Sets that share a shingle of a crowd, rounds of grouping for crowds, sets of such a group, queries of a cell in one task.
CROWD, ROUNDS, CROWD_GROUP, QUERIES = 64, 3, 512, 512
#: Bits of the bitmap of wanted rows (its size is fixed: 8 MB).
MARKS = 1 << 26

U = np.uint64
PAIR = "a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted by text and hash, and how many each text has."""
    h, counts = B.word_hashes(data, offsets)
    n = len(counts)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(n), counts)
    place = np.arange(len(h)) - first[owner]
    full = place + WIDTH <= counts[owner]
    at = np.flatnonzero(full)
    sums = np.zeros(len(at), U)
    for k in range(WIDTH):
        sums += h[at + k] * B.MIX[k]
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    rest = np.zeros(len(short), U)
    for k in range(WIDTH - 1):
        has = counts[short] > k
        rest[has] += h[first[short[has]] + k] * B.MIX[k + 5]
    values = B.mixed(np.concatenate([sums, rest + U(1)]))
    owners = np.concatenate([owner[at], short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.bincount(owners, minlength=n)


def required(n: int | np.ndarray):
    """The least intersection of a set of n with any set at the threshold."""
    return -(-n * PERCENT // 100)


def digests(values: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit digest of each set."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(B.mixed(values ^ B.MIX[k]), out=sums[1:])
    ends = np.cumsum(n)
    return B.mixed(sums[ends] - sums[ends - n]).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from one scan: a row of the table (id, row_key, n, s1, s2), and blocks of the task's sketch (block, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for a, b, data, off in B.text_chunks(batch, 2):
                values, n = shingle_sets(data, off)
                sketch += np.bincount((values >> U(44)).astype(np.int64), minlength=COUNTERS)
                sig = [digests(values, n, k) for k in (10, 11)]
                empty = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(n), pa.array(sig[0]), pa.array(sig[1]), empty.cast(pa.int32()), empty.cast(pa.binary())], names=names)
        blocks = [zlib.compress(x.astype(np.int32).tobytes(), 1) for x in np.split(sketch, BLOCKS)]
        gone = pa.nulls(BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([gone, gone, gone, gone, gone, pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(blocks, pa.binary())], names=names)

    names = ["id", "row_key", "n", "s1", "s2", "block", "counts"]
    return docs.mapInArrow(scan, "id long, row_key long, n long, s1 long, s2 long, block int, counts binary")


def summed_sketch(blocks: DataFrame) -> np.ndarray:
    """The sketch of the whole table: ``COUNTERS`` numbers, however large the table."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // BLOCKS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    rows = blocks.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    whole = np.zeros(COUNTERS, np.int32)
    size = COUNTERS // BLOCKS
    for r in rows:
        whole[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int32)
    return whole


def prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, id, n): the prefix shingles of each text, rare ones first; the id is that of the text's class. A task gives a class once."""
    rank = np.frombuffer(np.floor(np.log2(np.maximum(sketch, 1)) * 2).astype(np.uint8).tobytes(), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, given = shared.value, set()
        for batch in batches:
            for a, b, data, off in B.text_chunks(batch, 0):
                values, n = shingle_sets(data, off)
                ids = digests(values, n, 10)
                fresh = np.zeros(b - a, bool)
                for k, i in enumerate(ids.tolist()):
                    fresh[k] = i not in given
                    given.add(i)
                here = np.repeat(fresh, n)
                values, n, ids = values[here], n[fresh], ids[fresh]
                owner = np.repeat(np.arange(len(n)), n)
                # the order: rank, then a hash of the shingle, so that ties are broken alike everywhere
                order = np.lexsort((B.mixed(values + U(7)), rank[(values >> U(44)).astype(np.int64)], owner))
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                front = order[place < np.repeat(n - required(n) + 1, n)]
                yield pa.RecordBatch.from_arrays([pa.array(values[front].view(np.int64)), pa.array(ids[owner[front]]), pa.array(n[owner[front]].astype(np.int32))], names=["token", "id", "n"])

    return docs.select("text").mapInArrow(scan, "token long, id long, n int")


def shared_tokens(rows: DataFrame, n: int) -> DataFrame:
    """The distinct (token, id, n) rows whose token has another id with a size within reach: one pass sorted by size that holds one row back."""

    def rows_of(t, m, i) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(i, pa.int64()), pa.array(m, pa.int32())], names=["token", "id", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(3)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, x]) for h, x in zip(held, cols)]
            t, _, i = cols
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
            t, m, i = (x[new] for x in cols)
            # the nearest sizes of a token stand side by side
            near = (t[1:] == t[:-1]) & (100 * m[:-1].astype(np.int64) >= PERCENT * m[1:].astype(np.int64))
            take = np.zeros(len(t), bool)
            take[1:] |= near
            take[:-1] |= near
            take[0] |= met
            held, met = [x[-1:] for x in (t, m, i)], bool(take[-1])
            yield rows_of(*(x[:-1][take[:-1]] for x in (t, m, i)))
        if met:
            yield rows_of(*held)

    return rows.select("token", "n", "id").repartition(n, "token").sortWithinPartitions("token", "n", "id").mapInArrow(scan, "token long, id long, n int")


def place_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """``MARKS`` bits, one of them set for each key."""
    place = place_of(key)
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return out


def bodies(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, body): the deflated texts of the wanted classes, given as (id, row_key)."""
    shared = source.sparkSession.sparkContext.broadcast(bitmap(wanted, "row_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, given = shared.value, set()
        for batch in batches:
            at = batch.column(1).to_numpy() - 1
            rows = []
            for k in np.flatnonzero(bits[at >> 3] >> (at & 7) & 1).tolist():
                key = batch.column(0)[k].as_py()
                if key not in given:  # a task gives a row's key once
                    given.add(key)
                    rows.append((key, zlib.compress(batch.column(2)[k].as_py().encode(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["row_key", "body"])

    found = source.where("text IS NOT NULL").select("row_key", place_of("row_key").alias("place"), "text").mapInArrow(scan, "row_key long, body binary")
    return found.join(wanted, "row_key").dropDuplicates(["row_key"]).select("id", "body")


def sets_of(column: pa.Array, step: int = 256) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each deflated text, hashed many at a time."""
    for a in range(0, len(column), step):
        texts = [zlib.decompress(x.as_py()) for x in column.slice(a, step)]
        values, n = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        yield from np.split(values, np.cumsum(n)[:-1])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = common(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def leader_links(sets: DataFrame, n: int) -> DataFrame:
    """(a, b): verified links of each set with a leader of its group. A group streams by; only its latest leaders are held."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            found = []
            for g, i, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2))):
                if g != group:
                    group, leaders = g, []
                lead = next((j for j, y in leaders if similar(tokens, y)), None)
                if lead is None:
                    leaders = [*leaders[-LEADERS + 1 :], (i, tokens)]
                else:
                    found.append((lead, i))
            yield _links(found)

    return sets.select("group", "id", "body").repartition(n, "group").sortWithinPartitions("group", "id").mapInArrow(scan, PAIR)


def reachable(both: Column, n: Column, least_n: Column, most_n: Column) -> Column:
    """Whether a set of n can reach the threshold with some set of a cell, given how many of its prefix shingles the cell has.

    Of two sets, take the one whose prefix ends first in the order: their common shingles up to there lie in both prefixes, and
    at most required - 1 of its shingles come after. So the overlap is below both + required(n or m), n and m the sizes.
    """
    least = F.greatest(least_n, F.ceil(n * PERCENT / 100))
    most = F.least(most_n, F.floor(n * 100 / PERCENT))
    # required overlap less what may come after, in units of 1 / (100 * (100 + PERCENT)): it rises up to m = n and falls from there
    asked = lambda m: 100 * PERCENT * (n + m) - PERCENT * (100 + PERCENT) * F.greatest(n, m)
    return (least <= most) & (both * (100 * (100 + PERCENT)) > F.least(asked(least), asked(most)))


def opened_links(rows: DataFrame, n: int) -> DataFrame:
    """(a, b): verified links of queries with members of the cells that they open.

    Rows are (group, query, id, component, alone, body), a group's members first. Of two sets alone the one with the larger id is the query.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, union, roots = None, [], None, {}

        def root(c: int) -> int:
            while c in roots:
                c = roots[c]
            return c

        for batch in batches:
            found = []
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for g, query, i, comp, alone, tokens in zip(*cols, sets_of(batch.column(5))):
                if g != group:
                    group, members, union, roots = g, [], None, {}
                if not query:
                    members.append((i, comp, alone, tokens))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m[-1] for m in members])) if members else np.empty(0, U)
                if common(tokens, union) < required(len(tokens)):
                    continue  # the bound keeps the cell shut
                for j, other, apart, y in members:
                    if (j < i or not apart) and root(other) != root(comp) and similar(tokens, y):
                        found.append((j, i))
                        roots[root(other)] = root(comp)
            yield _links(found)

    return rows.select("group", "query", "id", "component", "alone", "body").repartition(n, "group").sortWithinPartitions("group", "query", "id").mapInArrow(scan, PAIR)


def crowd_groups(counted: DataFrame) -> DataFrame:
    """(group, id): the groups of the sets that hold a crowd's shingle, one group for each round."""
    tries = F.array(*(F.min(F.xxhash64("token", F.lit(k))) for k in range(ROUNDS)))
    rows = counted.where(F.col("c") >= CROWD).groupBy("id").agg(tries.alias("tries")).select("id", F.posexplode("tries").alias("round", "token"))
    sizes = rows.groupBy("token").agg(F.count("*").alias("size"))
    return rows.join(sizes, "token").select(F.xxhash64("token", F.pmod(F.hash("id", "round"), F.ceil(F.col("size") / CROWD_GROUP).cast("int"))).alias("group"), "id")


def cells(counted: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, component, size, cell): where each set stands in the matrix; size is that of its component."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    hottest = counted.groupBy("id", "n").agg(F.max(F.struct("c", F.hash("token").alias("h"), "token")).alias("top"))
    rows = hottest.join(comps.join(sizes, "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), "n", F.col("top.token").alias("token"))
    near = F.floor(F.log(F.col("n")) / F.log(F.lit(1.1)))  # sizes within ten percent
    rows = rows.select("id", "component", "size", F.when(F.col("size") > 1, F.xxhash64("component")).otherwise(F.xxhash64("token", near)).alias("base"))
    crowd = rows.groupBy("base").agg(F.count("*").alias("sets"))
    return rows.join(crowd, "base").select("id", "component", "size", F.xxhash64("base", F.pmod(F.hash("id"), F.ceil(F.col("sets") / GROUP).cast("int"))).alias("cell"))


def within_reach(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """(q, cell): the queries of each cell, told from prefix shingles."""
    rows = keep(tokens.join(placed, "id"), "matrix")
    of = F.struct("size", "component")
    ends = rows.groupBy("token").agg(F.min(of).alias("t0"), F.max(of).alias("t1")).where("t0 < t1")
    held = rows.groupBy("token", "cell").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("id").alias("first"), F.min(of).alias("of"))
    # the largest component of a token asks nothing there, unless it is a set alone
    asks = rows.join(ends, "token").where((F.col("size") == 1) | (of < F.col("t1"))).select("token", F.col("id").alias("q"), F.col("n").alias("qn"), of.alias("q_of"))
    met = asks.join(held.join(ends.select("token"), "token", "left_semi"), "token").where(
        f"((of.size > 1 AND q_of < of) OR (of.size = 1 AND q_of.size = 1 AND first < q)) AND {PERCENT} * least_n <= 100 * qn AND {PERCENT} * qn <= 100 * most_n"
    )
    met = met.groupBy("q", "qn", "cell").agg(F.count("*").alias("both"), F.min("least_n").alias("least_n"), F.max("most_n").alias("most_n"))
    return met.where(reachable(F.col("both"), F.col("qn"), F.col("least_n"), F.col("most_n"))).select("q", "cell")


def asked_cells(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(group, query, id, component, alone): queries and members of each cell. A cell with more than ``QUERIES`` queries is opened in several tasks."""
    parts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    whose = placed.select("id", "component", (F.col("size") == 1).alias("alone"))
    queries = pairs.join(parts, "cell").select(F.xxhash64("cell", F.pmod(F.hash("q"), "parts")).alias("group"), F.lit(1).alias("query"), F.col("q").alias("id")).join(whose, "id")
    members = placed.join(parts, "cell").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", "id", "component", (F.col("size") == 1).alias("alone"))
    return queries.unionByName(members.select(F.xxhash64("cell", "part").alias("group"), F.lit(0).alias("query"), "id", "component", "alone"))


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))


def labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, row_key, n, component, component_id) for every row; the component's name is null for a text without shingles."""
    spark = docs.sparkSession
    n = partitions(spark)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), row_key(key, text).alias("row_key"), F.col(f"`{text}`").alias("text"))
    scanned = keep(signatures(source), "signatures")
    sketch = summed_sketch(scanned.where("block IS NOT NULL").select("block", "counts"))
    own = scanned.where("block IS NULL").select("id", "row_key", "n", "s1", "s2")
    # a class is named by the first digest
    classes = keep(own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("row_key").alias("row_key")), "classes")
    keyed = classes.select(F.col("s1").alias("id"), "row_key")

    tokens = keep(shared_tokens(prefixes(source, sketch), n), "tokens")
    counted = keep(tokens.join(tokens.groupBy("token").agg(F.count("*").alias("c")), "token"), "counted")
    crowds = keep(crowd_groups(counted), "crowds")
    texts = bodies(source, keyed.join(crowds.select("id").distinct(), "id"))
    first = keep(leader_links(crowds.join(texts, "id"), n), "links")

    placed = keep(cells(counted, components(first)), "cells")
    asked = keep(asked_cells(keep(within_reach(tokens, placed), "pairs"), placed), "asked")
    texts = bodies(source, keyed.join(asked.select("id").distinct(), "id"))
    second = keep(opened_links(asked.join(texts, "id"), n), "links")

    final = components(first.unionAll(second))
    by_class = classes.join(final, classes["s1"] == final["id"], "left").select("n", "s1", "s2", "rep", F.coalesce("component", "s1").alias("component"))
    named = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = by_class.join(named, "component").select("n", "s1", "s2", "component", "component_id")
    return own.join(labels, ["n", "s1", "s2"], "left").select("id", "row_key", "n", "component", F.coalesce("component_id", "id").alias("component_id"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every document. The key is an integer."""
    return labelled(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of each component one: that with the smallest id, nulls last. Texts without shingles are linked with nothing and all stay."""
    best = labelled(docs, key, text).where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("b")).select(F.col("b.row_key").alias("__row_key"))
    keyed = docs.withColumn("__row_key", row_key(key, text))
    bare = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD)
    kept = keyed.where(~bare).join(best, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return kept.unionByName(keyed.where(bare)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted; links followed to the smallest id.
OP5_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) UNION SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
m AS (SELECT md5(array_to_string(g, ' ')) AS h, doc_id, n FROM g JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""
