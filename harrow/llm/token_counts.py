"""Token counts by byte-pair merging with a heap and a linked list.

A text is split into the tokenizer's pieces; each piece starts as its bytes, and the adjacent pair of lowest rank (leftmost
among equals) is popped from a heap and merged until none has a rank. The count is the initial symbols minus the merges; no
identifiers are made. A task keeps the counts of the pieces it has met in a table of at most ``CACHE`` entries, which is
emptied when full, so memory does not grow with the corpus. Rows are never shuffled.

Cases: a null or empty text has 0 tokens; a piece of any length costs n log n; the special token's string counts as one
token, as the library does by default; other columns stay as they are.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Entries of a task's table of counted pieces.
CACHE = 400_000

#: Fixed value: the public split pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where visible, else from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(hidden)) for b in range(256)]


class PieceCounts(dict):
    """Tokens of each piece; a missing piece is counted by merging."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], first: list[int]):
        super().__init__()
        self.pairs, self.first = pairs, first

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode())
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        symbols = [self.first[b] for b in data]
        n, pairs = len(symbols), self.pairs
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # an earlier merge took one of the two
            symbols[i], symbols[j] = pairs[a, b][1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (found[0], h, symbols[h], symbols[i]))
        return left


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """The counting function of a byte-level .json vocabulary file."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = {}
    for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    counts = PieceCounts(pairs, [vocab[c] for c in byte_symbols()])
    pieces, get = regex.compile(PIECES).findall, counts.__getitem__
    specials = [t["content"] for t in spec["added_tokens"]]
    cut = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(text: str) -> int:
        if cut is None or not any(s in text for s in specials):
            return sum(map(get, pieces(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(get, pieces(p))) for p in parts)

    return count


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text Column under the vocabulary file at ``path``, which every executor can open."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced."""
    return (
        docs.withColumn("n_tokens", token_count(F.col(f"`{text}`"), path))
        .withColumn("n_bytes", F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
