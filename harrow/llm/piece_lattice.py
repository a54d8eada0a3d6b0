"""Sampled SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut into units (a run of spaces with what follows it, or a line end); no piece of the vocabulary crosses a unit.
The lattice of a unit has an edge for each piece that fits, and a byte edge for a character without a piece. Forward
filtering sums the weights of all paths into each position; backward sampling walks from the end, taking each edge with its
share of that sum, so segmentations come with their exact probability. Pieces weigh by rank, ``(rank + shift) ** -theta``
(the vocabulary's scores are merge ranks, not log-probabilities; a piece that no merge makes, such as a run of spaces, has its place in the vocabulary for a rank); a larger ``theta`` sharpens towards frequent pieces.

Draws are a hash of (row key, unit number, step), and shares are summed within a position and kept as whole numbers of
2 ** -31, so that a row gets the same segmentation wherever, in whatever company and however often it is read.
A task filters each distinct unit once and keeps at most ``STATES`` lattice positions; then all units of a batch walk
together in numpy. Rows are never shuffled.

Cases: null text encodes to null ids and decodes to null; an empty text has the one piece of its dummy space; a literal
U+2581 is spelled in bytes, so decoding is lossless for every text; equal keys and texts give equal ids.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table

#: Lattice positions a task keeps, and characters of text that walk together.
STATES, CHUNK = 1_000_000, 500_000
#: Units of up to MEDIUM characters are filtered together; multiplier of code point hashes; lift of weights per character.
MEDIUM, STEP, MASK, LIFT = 48, 0x9E3779B97F4A7C15, (1 << 64) - 1, 2000.0
UNITS = re.compile(r"\n| *[^ \n]+| +")
#: Bits of a stored share.
SHARE_BITS = 31
SPACE = "\u2581"


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 16, dtype), 0

    def extend(self, items) -> None:
        need = self.n + len(items)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(need, len(self.data) * 3 // 2) - self.n, self.data.dtype)])
        self.data[self.n : need] = items
        self.n = need

    def view(self) -> np.ndarray:
        return self.data[: self.n]


class Lattice:
    """The vocabulary and the filtered lattices of the units met so far."""

    def __init__(self, path: str, theta: float, shift: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.weights: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = []
        self.of_byte = [0] * 256
        first = next(i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                merged = model.get_score(i) > -1e8
                self.weights[piece] = (i, (shift - model.get_score(i) if merged else shift + i - first) ** -theta)
        #: Every end of a piece: a match is followed backwards only while some piece ends like it.
        self.endings = {p[k:] for p in self.weights for k in range(len(p))}
        # the same pieces by a hash of their code points, and a bit table that turns most strangers away
        pieces = list(self.weights)
        hashes = np.array([functools.reduce(lambda h, c: (h * STEP + ord(c)) & MASK, p, 0) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_ids = np.array([self.weights[p][0] for p in pieces], np.int32)[order]
        # a constant per character leaves all ratios as they are and keeps sums of long units in range
        self.hash_weights = np.array([self.weights[p][1] * LIFT ** len(p) for p in pieces])[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[hashes >> np.uint64(42)] = True
        self.longest = max(map(len, pieces))
        self.floor = (shift + 2.0 * self.size) ** -theta
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}  # unit -> number of its last position
        # for each position where its edges begin; for each edge the position it leads to with its cumulative share below, the position it comes from, its piece
        self.positions, self.edges = Grown(np.int64), [Grown(np.int64), Grown(np.int32), Grown(np.int32)]
        self.positions.extend([0])
        self.n_positions, self.n_edges = 0, 0
        self.new_positions, self.new_edges = [], ([], [], [])
        self.spelled: list[list[int]] = []  # byte spellings, numbered from the vocabulary's size on
        self.spellings: dict[str, int] = {}

    def filter(self, unit: str) -> int:
        """Forward filtering of one unit: for each position, the share of every edge that ends there."""
        weights, endings = self.weights, self.endings
        key = unit.replace(SPACE, "\uffff").replace(" ", SPACE)
        base = self.n_positions
        total = [1.0]
        cdf, back, emits = self.new_edges
        self.new_positions.append(self.n_edges)  # position 0 has no edges
        for j in range(1, len(key) + 1):
            into, sum_ = [], 0.0
            for i in range(j - 1, -1, -1):
                part = key[i:j]
                if part not in endings:
                    break
                if found := weights.get(part):
                    share = total[i] * found[1]
                    sum_ += share
                    into.append((share, i, found[0]))
            if key[j - 1] not in weights:
                share = total[j - 1] * self.floor
                sum_ += share
                into.append((share, j - 1, self.spell(unit[j - 1])))
            if sum_ < 1e-150:  # only ratios count: lift the sums that later edges can still reach
                lift = 1.0 / sum_
                for i in range(max(0, j - 64), j):
                    total[i] *= lift
                into = [(share * lift, i, e) for share, i, e in into]
                sum_ = 1.0
            total.append(sum_)
            run = 0.0
            for share, i, emit in into:
                run += share / sum_
                cdf.append((base + j << SHARE_BITS) + int(min(run, 1.0) * (1 << SHARE_BITS)))
                back.append(base + i)
                emits.append(emit)
            self.n_edges += len(into)
            self.new_positions.append(self.n_edges)
        self.n_positions += len(key) + 1
        self.ends[unit] = base + len(key)
        return base + len(key)

    def filter_many(self, units: list[str]) -> None:
        """Forward filtering of many units of at most MEDIUM characters: the sums of all units move one character at a time."""
        if not units:
            return
        sizes = np.array([len(u) for u in units])
        chars = np.frombuffer("".join(units).replace(SPACE, "\uffff").replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(units)), sizes)
        offset = np.arange(len(chars)) - (np.cumsum(sizes) - sizes)[unit]
        room = sizes[unit] - offset
        starts, lengths, ids, weights = [], [], [], []
        h, at = np.zeros(len(chars), np.uint64), np.arange(len(chars))
        for n in range(1, min(self.longest, int(sizes.max())) + 1):
            live = room[at] >= n
            at, h = at[live], h[live] * np.uint64(STEP) + chars[at[live] + n - 1]
            near = np.flatnonzero(self.bits[h >> np.uint64(42)])
            k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            hit = self.hashes[k] == h[near]
            starts.append(at[near][hit])
            lengths.append(np.full(int(hit.sum()), n))
            ids.append(self.hash_ids[k[hit]])
            weights.append(self.hash_weights[k[hit]])
            if n == 1:
                bare = np.ones(len(chars), bool)
                bare[starts[0]] = False
                lone = np.flatnonzero(bare)
                text = "".join(units)
                starts.append(lone)
                lengths.append(np.ones(len(lone), np.int64))
                ids.append(np.array([self.spell(text[i]) for i in lone.tolist()], np.int32))
                weights.append(np.full(len(lone), self.floor * LIFT))
        start, length, emit, weight = map(np.concatenate, (starts, lengths, ids, weights))
        into = offset[start] + length
        order = np.argsort(into, kind="stable")
        bounds = np.searchsorted(into[order], np.arange(1, int(sizes.max()) + 2))
        source = start + unit[start]  # positions: one more than characters in each unit
        target = source + length
        total = np.zeros(len(chars) + len(units))
        total[np.cumsum(sizes) - sizes + np.arange(len(units))] = 1.0
        share = np.empty(len(start))
        for a, b in zip(bounds[:-1], bounds[1:]):
            e = order[a:b]
            share[e] = total[source[e]] * weight[e]
            np.add.at(total, target[e], share[e])
        share /= total[target]
        order = np.lexsort((source, target))
        count = np.bincount(target, minlength=len(total))
        base = self.n_positions
        ends_of = target[order]
        # running sums within each position, one edge of every position at a time: no sum depends on other units
        run, place = share[order], np.arange(len(order)) - (np.cumsum(count) - count)[ends_of]
        for k in range(1, int(count.max())):
            e = np.flatnonzero(place == k)
            run[e] += run[e - 1]
        self.edges[0].extend((base + ends_of << SHARE_BITS) + (np.minimum(run, 1.0) * (1 << SHARE_BITS)).astype(np.int64))
        self.edges[1].extend(base + source[order])
        self.edges[2].extend(emit[order])
        self.positions.extend(self.n_edges + np.cumsum(count))
        self.n_edges += len(order)
        self.n_positions += len(total)
        self.ends.update(zip(units, (base + np.cumsum(sizes) + np.arange(len(units))).tolist()))

    def settle(self) -> None:
        """Put what ``filter`` has gathered behind the arrays."""
        self.positions.extend(self.new_positions)
        for grown, new in zip(self.edges, self.new_edges):
            grown.extend(new)
            new.clear()
        self.new_positions.clear()

    def spell(self, char: str) -> int:
        if char < "\x80":
            return self.of_byte[ord(char)]
        if char not in self.spellings:
            self.spellings[char] = self.size + len(self.spelled)
            self.spelled.append([self.of_byte[b] for b in char.encode()])
        return self.spellings[char]

    def walk(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Backward sampling for all units of some texts at once; one array of ids per text."""
        if self.n_positions > STATES:
            self.clear()
        found = [UNITS.findall(" " + text) for text in texts]
        counts = [len(x) for x in found]
        units = list(itertools.chain.from_iterable(found))
        missing = [u for u in dict.fromkeys(units) if u not in self.ends]
        for u in missing:
            if len(u) > MEDIUM:
                self.filter(u)
        self.settle()
        self.filter_many([u for u in missing if len(u) <= MEDIUM])
        ends = list(map(self.ends.__getitem__, units))
        first = self.positions.view()
        cdf, back, emits = (x.view() for x in self.edges)
        counts = np.array(counts)
        at = np.array(ends, np.int64)
        number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mixed(np.repeat(seeds, counts) + mixed(number.astype(np.uint64) + np.uint64(1)))
        live = np.arange(len(at))
        owners, pieces, steps, step = [], [], [], 0
        while len(live):
            draw = (mixed(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SHARE_BITS)).astype(np.int64)
            state = at[live]
            edge = np.minimum(np.searchsorted(cdf, (state << SHARE_BITS) + draw, side="right"), first[state + 1] - 1)
            owners.append(live)
            pieces.append(emits[edge])
            steps.append(np.full(len(live), step, np.int64))
            at[live] = back[edge]
            here = at[live]
            live = live[first[here + 1] > first[here]]  # a position without edges into it is a unit's start
            step += 1
        owner, piece, order = np.concatenate(owners), np.concatenate(pieces), np.concatenate(steps)
        taken = np.bincount(owner, minlength=len(at))
        place = np.cumsum(taken)[owner] - 1 - order  # the walk went backwards
        flat = np.empty(len(piece), np.int64)
        flat[place] = piece
        per_text = np.add.reduceat(taken, np.cumsum(counts) - counts)
        out = np.split(flat, np.cumsum(per_text)[:-1])
        if self.spelled and (flat >= self.size).any():
            out = [np.array([i for p in x for i in (self.spelled[p - self.size] if p >= self.size else (p,))]) if (x >= self.size).any() else x for x in out]
        return out

    def decode(self, ids) -> str:
        """The text of some ids; the dummy space in front goes."""
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def lattice(path: str, theta: float = 1.0, shift: float = 10.0) -> Lattice:
    return Lattice(path, theta, shift)


def encode_texts(texts: list[str | None], keys: np.ndarray, path: str, theta: float = 1.0) -> list[np.ndarray | None]:
    """Sampled ids of each text, seeded by its key."""
    own = lattice(path, theta)
    seeds = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    out: list[np.ndarray | None] = [None] * len(texts)
    batch, chars = [], 0
    for k in range(len(texts) + 1):
        if batch and (k == len(texts) or chars > CHUNK):
            for i, ids in zip(batch, own.walk([texts[i] for i in batch], seeds[batch])):
                out[i] = ids
            batch, chars = [], 0
        if k < len(texts) and texts[k] is not None:
            batch.append(k)
            chars += len(texts[k])
    return out


def with_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", into: str = "piece_ids", theta: float = 1.0, back: str | None = None) -> DataFrame:
    """Add the sampled ids of each text; a column called ``into`` is replaced. The key may be of any type: it is hashed.

    ``back`` names a column for the text that the ids decode to, made in the same pass.
    """
    kept = [c for c in docs.columns if c not in (into, back)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.col(f"`{key}`")).alias("__key"))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(back, T.StringType())] if back else []))
    at = kept.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                ids = encode_texts(batch.column(at).to_pylist(), batch.column(len(kept)).to_numpy(zero_copy_only=False), path, theta)
                sizes = np.array([0 if x is None else len(x) for x in ids])
                flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int64)]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]))
                more = [pa.array([None if x is None else lattice(path, theta).decode(x.tolist()) for x in ids], pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], arrays, *more], names=[*kept, into, *([back] if back else [])])

    return source.mapInArrow(encode, schema)


def decoded(docs: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = lattice(path)
        for x in batches:
            yield pd.Series([None if i is None else own.decode(i) for i in x], dtype=object)

    return docs.withColumn(into, decode(F.col(f"`{ids}`")))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a digest of the sampled ids, and whether decoding gives the text back."""
    path = default_model()
    coded = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path, back="decoded")
    return coded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("pieces_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
