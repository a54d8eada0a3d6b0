"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word's input joins a vector of the word with the summed vectors of its character groups (beginnings, endings and inner groups of
three bytes), all looked up by hash. Two gated recurrences read a window of WIDTH words, one from either end; attention weighs
their states, and the weighted state gives the window's log-odds. A text is cut into windows that begin every STRIDE words, the last
one at its end, so that every word is in one at least; every window is scored, and the largest log-odds are the text's.

The network learns from labelled texts outside the held-out fold only: at most about MOST[label] texts of each label, drawn by a hash of
doc_id, and of at most LONGEST bytes each, so that one task can hold them. That bound is the only one; texts that are scored
are never cut. Each epoch scores all windows of the learning texts, then learns from each text's likeliest window, and for clean texts
from further ones. The examples weigh as much as the texts that they were drawn from, so that scores stay probabilities.

Special cases: null text is empty; empty texts have no window and the score of the bias alone. Without a labelled row every score is 0.
A doc_id with several labels is toxic if one of them says so; with several texts the smallest is learnt from. Null doc_ids aren't held out,
and not learnt from. Very long texts are scored in batches of windows; memory follows the text and its words. An empty table gives no
rows. Only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import table

#: Learning texts by label, and their largest size in bytes.
MOST, LONGEST = {0: 5000, 1: 3000}, 1 << 16
WIDTH, STRIDE = 64, 48
#: Rows of the word and character tables, width of their vectors, hidden width of a direction, width of the attention.
WORDS, GROUPS, VECTOR, HIDDEN, ATTENTION = 1 << 14, 1 << 15, 8, 8, 8
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows scored side by side, bytes of text in a piece.
SIDE, CHUNK = 2048, 2 << 20
#: A place without a word keeps the state of its neighbour: its update gate is closed.
SHUT = 30.0
f32 = np.float32


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(f32)
    h, k = HIDDEN, ATTENTION
    return {
        "word": draw(WORDS, VECTOR, scale=0.1),
        "group": draw(GROUPS, VECTOR, scale=0.1),
        "input": draw(2, 3 * h, 2 * VECTOR, scale=0.4),
        "bias": np.zeros((2, 3 * h), f32),
        "state": draw(2, 3 * h, h, scale=0.3),
        "look": draw(k, 2 * h, scale=0.4),
        "look_bias": np.zeros(k, f32),
        "weigh": draw(k, scale=0.4),
        "out": draw(2 * h, scale=0.3),
        "end": np.zeros(1, f32),
    }


# --- words and windows ---


class Words:
    """The distinct words of some texts: their rows in the word table, and of each its rows in the table of character groups."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        data = B.LOWER[raw]
        starts, ends, self.per_text = B.words(data, offsets, B.LETTER_OR_DIGIT)
        sums = B.prefix_sums(data)
        h = B.span_hashes(sums, starts, ends)
        kinds, first, self.of_token = np.unique(h, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        self.row = (kinds % B.U(WORDS)).astype(np.int64)
        ends_of = [*((s, s + k) for k in (2, 3, 4, 5, 6)), *((e - k, e) for k in (2, 3, 4))]
        self.affix = np.full((len(s), len(ends_of)), GROUPS)  # the row after the last one stands for none
        for k, (begin, end) in enumerate(ends_of):
            fits = np.flatnonzero((begin >= s) & (end <= e))
            self.affix[fits, k] = B.mixed(B.span_hashes(sums, begin[fits], end[fits]) + B.U(k + 1)) % B.U(GROUPS)
        inner = np.maximum(e - s - 2, 0)
        self.begin = np.concatenate([[0], np.cumsum(inner)])
        begin = np.repeat(s - self.begin[:-1], inner) + np.arange(self.begin[-1])
        self.inner = (B.span_hashes(sums, begin, begin + 3) % B.U(GROUPS)).astype(np.int64)
        self.weight = (1 / np.sqrt(np.maximum((self.affix < GROUPS).sum(1) + inner, 1))).astype(f32)

    def inner_groups(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the inner character groups of some words, and where each word's begin."""
        n = self.begin[which + 1] - self.begin[which]
        begin = np.cumsum(n) - n
        return self.inner[np.repeat(self.begin[which] - begin, n) + np.arange(n.sum())], begin


def inputs(w: dict, words: Words, which: np.ndarray) -> np.ndarray:
    """The input vectors of some words, by row: word vectors, then character groups weighed by the root of their number."""
    x = np.zeros((2 * VECTOR, len(which)), f32)
    rows, begin = words.inner_groups(which)
    some = np.flatnonzero(np.diff(np.append(begin, len(rows))))
    affix = words.affix[which]
    for k in range(VECTOR):
        x[k] = w["word"][:, k][words.row[which]]
        column = np.append(w["group"][:, k], f32(0))
        x[VECTOR + k] = column[affix].sum(1)
        if len(rows):
            x[VECTOR + k, some] += np.add.reduceat(column[rows], begin[some])
    x[VECTOR:] *= words.weight[which]
    return x


def gates(w: dict, x: np.ndarray) -> np.ndarray:
    """What the inputs add to the gates, by direction and word, with a last row for places without a word."""
    out = np.zeros((2, x.shape[1] + 1, 3 * HIDDEN), f32)
    out[:, :-1] = x.T @ w["input"].transpose(0, 2, 1) + w["bias"][:, None]
    out[:, -1, :HIDDEN] = SHUT
    return out


def windows(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, words, text) of all windows, by text."""
    n = np.where(per_text > 0, np.maximum(0, -((WIDTH - per_text) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(per_text)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    last = np.maximum(per_text - WIDTH, 0)
    begin = (np.cumsum(per_text) - per_text)[text] + np.minimum(nth * STRIDE, last[text])
    return begin, np.minimum(per_text, WIDTH)[text], text


def places(tokens: np.ndarray, begin: np.ndarray, size: np.ndarray, nothing: int) -> np.ndarray:
    """(place, window): the words of windows; ``nothing`` where a window has ended."""
    t = np.arange(int(size.max()))[:, None]
    inside = t < size
    return np.where(inside, tokens[np.where(inside, begin + t, 0)], nothing)


# --- the network ---


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


def recurrence(w: dict, given: np.ndarray, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
    """(place, 2 * HIDDEN, window): the states of both directions; a trace keeps what learning needs of each step."""
    n_places, n = ids.shape
    states = np.zeros((n_places, 2, HIDDEN, n), f32)
    h = np.zeros((2, HIDDEN, n), f32)
    x = np.empty((2, 3 * HIDDEN, n), f32)
    for t in range(n_places):
        for d, at in enumerate((t, n_places - 1 - t)):
            x[d] = given[d].take(ids[at], axis=0).T
        a = w["state"] @ h
        zr = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r, more = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * more)
        if trace is not None:
            trace.append((h, z, r, new, more))
        h = new + z * (h - new)
        states[t, 0], states[n_places - 1 - t, 1] = h[0], h[1]
    return states.reshape(n_places, 2 * HIDDEN, n)


def pooled(w: dict, states: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds, weighted states, weights, attention's inner values) of windows."""
    u = np.tanh(np.matmul(w["look"], states) + w["look_bias"][:, None])
    s = np.where(inside, np.matmul(w["weigh"], u), f32(-1e9))
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    context = np.einsum("tn,thn->hn", alpha, states)
    return w["out"] @ context + w["end"][0], context, alpha, u


def log_odds(w: dict, given: np.ndarray, tokens: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log-odds of windows, of like lengths side by side."""
    out = np.zeros(len(begin), f32)
    order = np.argsort(size, kind="stable")
    nothing = given.shape[1] - 1
    for k in range(0, len(order), SIDE):
        now = order[k : k + SIDE]
        ids = places(tokens, begin[now], size[now], nothing)
        out[now] = pooled(w, recurrence(w, given, ids), ids != nothing)[0]
    return out


def gradient(w: dict, words: Words, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross entropy of windows (place, window), whose words are places in ``words`` or -1, and its gradient."""
    which, back = np.unique(np.concatenate([[-1], ids.ravel()]), return_inverse=True)
    which, at = which[1:], (back[1:] - 1).reshape(ids.shape)
    at[at < 0] = len(which)
    x = inputs(w, words, which)
    given, trace = gates(w, x), []
    states = recurrence(w, given, at, trace)
    odds, context, alpha, u = pooled(w, states, at < len(which))
    p = sigmoid(odds)
    loss = float((weight * (np.logaddexp(0, odds) - label * odds)).sum())
    d_odds = (weight * (p - label)).astype(f32)

    g = {"out": context @ d_odds, "end": d_odds.sum(keepdims=True)}
    d_context = w["out"][:, None] * d_odds
    d_alpha = np.einsum("hn,thn->tn", d_context, states)
    d_s = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["weigh"] = np.einsum("tn,tkn->k", d_s, u)
    d_u = (d_s[:, None] * w["weigh"][:, None]) * (1 - u * u)
    g["look"], g["look_bias"] = np.einsum("tkn,thn->kh", d_u, states, optimize=True), d_u.sum((0, 2))
    d_states = (alpha[:, None] * d_context + np.matmul(w["look"].T, d_u)).reshape(len(ids), 2, HIDDEN, -1)

    n_places, h3 = len(ids), 3 * HIDDEN
    d_given = np.zeros((2, n_places, h3, ids.shape[1]), f32)
    d_h, g["state"] = np.zeros_like(trace[0][0]), np.zeros_like(w["state"])
    for t in range(n_places - 1, -1, -1):
        h, z, r, new, more = trace[t]
        d_h = d_h + np.stack([d_states[t, 0], d_states[n_places - 1 - t, 1]])
        d_new = d_h * (1 - z) * (1 - new * new)
        d_zr = np.concatenate([d_h * (h - new) * z * (1 - z), d_new * more * r * (1 - r)], 1)
        d_a = np.concatenate([d_zr, d_new * r], 1)
        step = np.concatenate([d_zr, d_new], 1)
        d_given[0, t], d_given[1, n_places - 1 - t] = step[0], step[1]
        g["state"] += d_a @ h.transpose(0, 2, 1)
        d_h = d_h * z + w["state"].transpose(0, 2, 1) @ d_a
    flat = d_given.transpose(1, 3, 0, 2).reshape(-1, 2 * h3)
    order = np.argsort(at.ravel(), kind="stable")
    begins = np.searchsorted(at.ravel()[order], np.arange(len(which)))
    ends = np.searchsorted(at.ravel()[order], len(which))
    d_word = np.add.reduceat(flat[order[:ends]], begins, axis=0)
    d_word = d_word.reshape(-1, 2, h3).transpose(1, 0, 2)  # by direction, word, gate
    g["bias"] = d_word.sum(1)
    g["input"] = d_word.transpose(0, 2, 1) @ x.T
    d_x = (d_word @ w["input"]).sum(0)
    d_group = d_x[:, VECTOR:] * words.weight[which][:, None]
    rows, begin = words.inner_groups(which)
    affix = words.affix[which]
    group = np.concatenate([affix.ravel(), rows])
    owner = np.concatenate([np.repeat(np.arange(len(which)), affix.shape[1]), np.repeat(np.arange(len(which)), np.diff(np.append(begin, len(rows))))])
    g["word"] = np.stack([np.bincount(words.row[which], d_x[:, k], WORDS) for k in range(VECTOR)], 1)
    g["group"] = np.stack([np.bincount(group, d_group[owner, k], GROUPS + 1)[:GROUPS] for k in range(VECTOR)], 1)
    return loss, g


def learn(texts: pa.Array, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from some texts: each epoch picks the likeliest window of each text, and two more of each clean one."""
    w, rng = new_weights(seed), np.random.default_rng(seed)
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    (_, _, raw, offsets), *_ = B.text_chunks(batch, 0, 1 << 40)
    words = Words(raw, offsets)
    begin, size, text = windows(words.per_text)
    if not len(text):
        return w
    w["end"][0] = np.log(max((weight * label).sum(), 1e-3) / max((weight * (1 - label)).sum(), 1e-3))
    every = np.arange(len(words.row))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    done, total = 0, EPOCHS * max(1, len(np.unique(text)) // BATCH)
    for epoch in range(EPOCHS):
        odds = log_odds(w, gates(w, inputs(w, words, every)), words.of_token, begin, size) if epoch else np.zeros(len(text), f32)
        likely = np.lexsort([rng.random(len(text)), -odds, text])
        top = likely[np.flatnonzero(np.concatenate([[True], text[likely][1:] != text[likely][:-1]]))]
        clean = np.flatnonzero(label[text] == 0)
        extra = rng.choice(clean, min(len(clean), len(top)), replace=False)
        chosen = np.concatenate([top, extra])
        load = np.concatenate([weight[text[top]], 0.3 * weight[text[extra]]]).astype(f32)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            now, own = chosen[order[k : k + BATCH]], load[order[k : k + BATCH]]
            ids = places(words.of_token, begin[now], size[now], -1)
            _, g = gradient(w, words, ids, label[text[now]].astype(f32), own / f32(BATCH))
            done += 1
            rate = RATE * max(0.1, 1 - done / (2.2 * total))
            for name, d in g.items():
                d = d.astype(f32)
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.001 * (d * d - second[name])
                w[name] -= rate * (first[name] / (1 - 0.9**done)) / (np.sqrt(second[name] / (1 - 0.999**done)) + 1e-8)
    return w


# --- Spark ---


def held_out(key: Column) -> Column:
    """The fold that nothing is learnt from; null ids aren't in it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> dict[str, np.ndarray] | None:
    """Weights learnt in one task from a sample of the labelled texts, or None without any; see the head of the module for its bound."""
    known = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{key}`"))).groupBy(F.col(f"`{key}`").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # a row for each label
    share = {c: min(1.0, MOST[c] / n[c]) for c in MOST if n.get(c)}
    if not share:
        return None
    own = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < own * 1_000_000)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    small = docs.where(F.octet_length(t) <= LONGEST).select(F.col(f"`{key}`").alias("id"), t.alias("text"))
    sample = small.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # drawn: about the sum of MOST rows

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("place", "ascending"), ("text", "ascending")])
        label = rows.column("label").to_numpy()
        weight = np.where(label == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
        held = io.BytesIO()
        np.savez(held, **learn(rows.column("text").cast(pa.large_string()).combine_chunks(), label, (weight / weight.mean()).astype(f32)))
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["weights"])

    rows = sample.select("label", "text", F.xxhash64("id").alias("place")).repartition(1)
    found = rows.mapInArrow(lambda b: train(x) if (x := list(b)) else iter(()), "weights binary").toArrow()
    return dict(np.load(io.BytesIO(found.column(0)[0].as_py()))) if found.num_rows else None


def scores(docs: DataFrame, w: dict[str, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, raw, offsets in B.text_chunks(batch, 1, CHUNK) if w is not None else ():
                words = Words(raw, offsets)
                begin, size, text = windows(words.per_text)
                odds = np.full(b - a, w["end"][0], np.float64)
                if len(text):
                    given = gates(w, inputs(w, words, np.arange(len(words.row))))
                    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                    odds[text[first]] = np.maximum.reduceat(log_odds(w, given, words.of_token, begin, size), first)
                out[a:b] = 0.5 * np.tanh(0.5 * odds) + 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["key", "score"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(scan, f"key {kind}, score double").withColumnRenamed("key", key)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    found = scores(docs, fit(docs, labels, key, text, label), key, text)
    return found.select(key, held_out(F.col(f"`{key}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
