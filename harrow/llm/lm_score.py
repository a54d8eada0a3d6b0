"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Coding. Every text is split into subwords once; its ids are kept as bytes, from which counts, training and scoring read.

Learning. Scans count, over every training text, words, subwords and adjacent subword pairs; task-level sums combine
before and in the shuffle. The ``TOP`` most frequent subwords are set into classes of ``CLASS`` by halving along principal
directions of their pair statistics; a factorization of those statistics gives the first embeddings and output weights.
Attention, feed-forward and all weights are then trained by gradient steps over every training text, once: the texts are dealt
to ``ROUNDS`` rounds by a hash of id and text; in a round a task carries weights and moments through all its batches, and after it
weights are averaged block by block in Spark, first within groups of tasks. Steps grow with the corpus.

Scoring. A text is the sequence of its words' subwords and one end. Windows of ``WINDOW`` ids overlap by ``WINDOW - STRIDE``; each
id is scored once, in the window that gives it the longest context: at least ``WINDOW - STRIDE`` ids, or all that precede it.
All windows of a batch go through one masked attention. The
probability of an id is that of its class times that within the class; rarer subwords share a last class and divide it by
their counts. The probabilities of all ids sum to one at every place.

The base score needs the count of every word. Words at least ``1 / HOT`` as frequent as all tokens (at most ``HOT`` of them, whatever
the corpus) are broadcast; the others meet their counts in a join on word hashes.

Arrays of a step or a block of windows are filled again in the next one, as fresh pages cost much of a step's time.

Cases: null and empty texts are one end token; with no training text all counts are 0 and the model is uniform; rows
that repeat an id and text get equal scores; a null id counts as the text ''. Very long texts are scored in pieces of windows.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._shared import keep, table

#: Frequent subwords with weights of their own, members of a class, width, hidden width, ids of a window, ids it scores.
TOP, CLASS, DIM, HIDDEN, WINDOW, STRIDE = 1024, 32, 24, 48, 64, 32
CLASSES = TOP // CLASS
TAIL = TOP  # stands for all rarer subwords
#: Rounds of averaging, which share out all training texts; windows of a step; rate. A task of few texts goes through them again until
#: it has made LEAST_STEPS, at most MOST_PASSES times.
ROUNDS, STEP_WINDOWS, RATE, LEAST_STEPS, MOST_PASSES = 3, 96, 0.02, 300, 8
#: Windows that are scored together: few enough for their attention to stay in a core's cache.
SCORED_WINDOWS = 64
#: Words above 1 / HOT of all tokens are broadcast.
HOT = 500_000
#: Rows of the weights' exchange; groups of tasks whose weights are summed apart first.
WEIGHT_BLOCKS, TASK_GROUPS = 16, 64
U = np.uint64
END_WORD = np.array([0x5EEDE0D], U)  # stands for the end among word hashes
F32 = np.float32


# --- words and subwords ---


@functools.lru_cache(maxsize=1)
def encoder(path: str):
    """The byte-level vocabulary as a tiktoken encoding; its size is the id of the end."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> int:
    return encoder(path).n_vocab


#: Bytes that may belong to a space within a word: all beyond ASCII, and the separators among the control characters.
ODD = re.compile(rb"[\x1c-\x1f\x80-\xff]")


class Subwords:
    """Ids of the words of a chunk, each word with a space in front. Each distinct word is encoded once. Words without a space
    character of any kind are encoded as one text, for no piece reaches across a word's end: a word's first id is the one that
    begins with a space, and no other does. The rest, such as words of no-break spaces, are encoded one by one."""

    def __init__(self, path: str):
        own = encoder(path)
        self.encode = own.encode_ordinary
        self.begins = np.array([own.decode_single_token_bytes(i)[:1] == b" " for i in range(own.n_vocab)])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each word has."""
        if not len(hashes):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        odd = np.array([bool(ODD.search(w)) and re.search(r"\s", w.decode()) is not None for w in words])
        plain = [w for w, x in zip(words, odd.tolist()) if not x]
        flat = np.array(self.encode((b" " + b" ".join(plain)).decode()) if plain else [], np.int32)
        begin, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[~odd] = np.flatnonzero(self.begins[flat])
        sizes[~odd] = np.diff(np.append(begin[~odd], len(flat)))
        for k in np.flatnonzero(odd).tolist():
            ids = np.array(self.encode(" " + words[k].decode()), np.int32)
            begin[k], sizes[k] = len(flat), len(ids)
            flat = np.concatenate([flat, ids])
        count = sizes[which]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[which], count)
        return flat[at], count


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple]:
    """(first row, last row, lower-cased bytes, word starts, ends, words of each text, word hashes)."""
    for a, b, data, off in B.text_chunks(batch, column, 2 << 20):
        low = B.LOWER[data]
        starts, ends, counts = B.words(low, off)
        yield a, b, low, starts, ends, counts, B.span_hashes(B.prefix_sums(low), starts, ends)


def sequences(ids: np.ndarray, per_word: np.ndarray, words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with an end in front of and behind each; and the length of each text's sequence."""
    bounds = np.concatenate([[0], np.cumsum(per_word)])
    upto = np.concatenate([[0], np.cumsum(words)])
    sizes = bounds[upto[1:]] - bounds[upto[:-1]]
    total = sizes + 2
    out = np.full(int(total.sum()), end, np.int64)
    offset = np.repeat(np.arange(len(words)) * 2 + 1, sizes)
    out[np.arange(len(ids)) + offset] = ids
    return out, total


# --- the model ---


def shapes() -> dict[str, tuple[int, ...]]:
    d, h = DIM, HIDDEN
    return {
        "emb": (TOP + 1, d), "pos": (WINDOW, d), "wq": (d, d), "wk": (d, d), "wv": (d, d), "wo": (d, d), "w1": (d, h), "b1": (h,), "w2": (h, d),
        "cls": (d, CLASSES + 1), "bc": (CLASSES + 1,), "tok": (TOP, d), "bt": (TOP,),
    }


HALF = WINDOW // 2
MASK = np.tril(np.ones((WINDOW, WINDOW), F32))
REACH = 30.0


class Room:
    """Arrays that are filled again step after step: fresh pages cost more than the sums that go into them."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        own = self.kept.get(name)
        if own is None or own.size < size or own.dtype != kind:
            own = self.kept[name] = np.empty(size, kind)
        return own[:size].reshape(shape)


def row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[-1], z.dtype)


def by_value(ids: np.ndarray) -> np.ndarray:
    """Stable order of compact ids."""
    return np.argsort(ids.astype(np.int16), kind="stable")


def joint(w: dict) -> np.ndarray:
    """Weights of queries, keys and values side by side, queries scaled."""
    kind = w["wq"].dtype.type
    return np.hstack([w["wq"] * kind(DIM**-0.5), w["wk"], w["wv"]])


def attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, s: np.ndarray, a: np.ndarray, begin: int) -> np.ndarray:
    """Fill s with the exponentials of the scores of places from ``begin`` on over all places up to each, and a with the sums of values by
    their shares; the exponentials' sums come back. Scores are kept in a range whose exponentials are finite."""
    np.matmul(q, k.transpose(0, 2, 1), out=s)
    np.clip(s, -REACH, REACH, out=s)
    np.exp(s, out=s)
    s *= MASK[begin : begin + q.shape[1], : k.shape[1]]
    total = row_sums(s)
    np.matmul(s, v, out=a)
    a /= total[:, :, None]
    return total


def forward(w: dict, x: np.ndarray, room: Room | None = None) -> dict:
    """Hidden states of windows of compact ids (batch, length). Dense layers run over all places at once. Attention runs over halves
    of a window, for the first half never sees the second; ``s`` has the exponentials of scores of each half, ``sums`` their sums."""
    room, kind = room or Room(), w["emb"].dtype
    b, n = x.shape
    e = room("e", kind, b, n, DIM)
    np.take(w["emb"], x, axis=0, out=e, mode="clip")
    e += w["pos"][:n]
    e = e.reshape(b * n, DIM)
    qkv = np.matmul(e, joint(w), out=room("qkv", kind, b * n, 3 * DIM)).reshape(b, n, 3 * DIM)
    a, s, sums = room("a", kind, b, n, DIM), [], np.empty((b, n), kind)
    for lo in range(0, n, HALF):
        hi = min(lo + HALF, n)
        s.append(room(f"s{lo}", kind, b, hi - lo, hi))
        sums[:, lo:hi] = attended(qkv[:, lo:hi, :DIM], qkv[:, :hi, DIM : 2 * DIM], qkv[:, :hi, 2 * DIM :], s[-1], a[:, lo:hi], lo)
    a = a.reshape(b * n, DIM)
    h1 = np.matmul(a, w["wo"], out=room("h1", kind, b * n, DIM))
    h1 += e
    r = np.matmul(h1, w["w1"], out=room("r", kind, b * n, HIDDEN))
    r += w["b1"]
    np.maximum(r, 0, out=r)
    h = np.matmul(r, w["w2"], out=room("h", kind, b * n, DIM))
    h += h1
    return {"e": e, "qkv": qkv, "s": s, "sums": sums, "a": a, "h1": h1, "r": r, "h": h}


class Tables:
    """What scoring looks up: embeddings, scaled queries, keys and values of every compact id, and what places add to them."""

    def __init__(self, w: dict):
        self.w, self.room = w, Room()
        whole = np.hstack([np.eye(DIM, dtype=F32), joint(w)])
        self.own, self.own_at = (np.ascontiguousarray((w[k] @ whole)[:, : 2 * DIM]) for k in ("emb", "pos"))  # embedding, query
        self.lent, self.lent_at = (np.ascontiguousarray((w[k] @ whole)[:, 2 * DIM :]) for k in ("emb", "pos"))  # key, value

    def last_states(self, x: np.ndarray, n_last: int) -> np.ndarray:
        """Hidden states of the last places of each window, as ``forward`` gives them: the places before only lend keys and values."""
        (b, n), w, room = x.shape, self.w, self.room
        own, lent = room("own", F32, b, n_last, 2 * DIM), room("lent", F32, b, n, 2 * DIM)
        np.take(self.own, x[:, n - n_last :], axis=0, out=own, mode="clip")
        np.take(self.lent, x, axis=0, out=lent, mode="clip")
        own += self.own_at[n - n_last : n]
        lent += self.lent_at[:n]
        a = room("a", F32, b, n_last, DIM)
        for lo in range(n - n_last, n, HALF):
            hi, at = min(lo + HALF, n), lo - (n - n_last)
            upto = at + min(HALF, n - lo)
            attended(own[:, at:upto, DIM:], lent[:, :hi, :DIM], lent[:, :hi, DIM:], room("s", F32, b, hi - lo, hi), a[:, at:upto], lo)
        h = np.matmul(a.reshape(b * n_last, DIM), w["wo"], out=room("h1", F32, b * n_last, DIM))
        h += own.reshape(b * n_last, 2 * DIM)[:, :DIM]
        r = np.matmul(h, w["w1"], out=room("r", F32, b * n_last, HIDDEN))
        r += w["b1"]
        np.maximum(r, 0, out=r)
        return h + r @ w["w2"]


def class_logits(w: dict, h: np.ndarray, bounds: list[int], room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the classes at all places, and of each place's own class's members. Places come by class, class k from bounds[k] on; the
    last class has no members. Logits are kept in a range whose exponentials are finite."""
    z = np.matmul(h, w["cls"], out=room("z", h.dtype, len(h), CLASSES + 1))
    z += w["bc"]
    m = room("m", h.dtype, bounds[CLASSES], CLASS)
    for k in range(CLASSES):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            part = slice(k * CLASS, (k + 1) * CLASS)
            np.matmul(h[a:b], w["tok"][part].T, out=m[a:b])
            m[a:b] += w["bt"][part]
    for logits in (z, m):
        np.clip(logits, -2 * REACH, 2 * REACH, out=logits)
    return z, m


def class_bounds(y: np.ndarray) -> list[int]:
    """Where each class begins among ordered compact ids; the end of the last."""
    return [*np.searchsorted(y, np.arange(CLASSES + 1) * CLASS).tolist(), len(y)]


def picked(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Flat places of one column in each row."""
    return np.arange(len(z)) * z.shape[1] + column


def log_probs(w: dict, h: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log probability of each compact target, the tail's ids together."""
    room, order = room or Room(), by_value(y)
    y = y[order]
    h = np.take(h, order, axis=0, out=room("ordered", h.dtype, *h.shape), mode="clip")
    bounds = class_bounds(y)
    z, m = class_logits(w, h, bounds, room)
    out = z.ravel()[picked(z, y // CLASS)]
    out[: len(m)] += m.ravel()[picked(m, y[: len(m)] % CLASS)]
    out -= np.log(row_sums(np.exp(z, out=z)))
    out[: len(m)] -= np.log(row_sums(np.exp(m, out=m)))
    back = np.empty_like(out)
    back[order] = out
    return back


def gradients(w: dict, x: np.ndarray, y: np.ndarray, live: np.ndarray, room: Room | None = None, g: dict | None = None) -> dict:
    """Gradients of the mean loss over the live places of windows x with targets y; into g, if given."""
    room, kind = room or Room(), w["emb"].dtype
    c, (b, n) = forward(w, x, room), x.shape
    rows = np.flatnonzero(live.ravel())
    rows = rows[by_value(y.ravel()[rows])]  # targets of a class side by side
    t = y.ravel()[rows]
    h = np.take(c["h"], rows, axis=0, out=room("ordered", kind, len(rows), DIM), mode="clip")
    g = g or {name: np.empty_like(v) for name, v in w.items()}
    for name in ("emb", "pos", "tok", "bt"):
        g[name][...] = 0
    bounds, scale = class_bounds(t), kind.type(1.0 / max(len(rows), 1))
    z, m = class_logits(w, h, bounds, room)
    for dz, target in ((z, t // CLASS), (m, t[: len(m)] % CLASS)):
        np.exp(dz, out=dz)
        dz *= (scale / row_sums(dz))[:, None]
        dz.ravel()[picked(dz, target)] -= scale
    g["cls"][...], g["bc"][...] = h.T @ z, z.sum(axis=0)
    dh_rows = np.matmul(z, w["cls"].T, out=room("dh_rows", kind, len(rows), DIM))
    for k in range(CLASSES):
        first, end = bounds[k], bounds[k + 1]
        if first < end:
            part, dt = slice(k * CLASS, (k + 1) * CLASS), m[first:end]
            np.matmul(dt.T, h[first:end], out=g["tok"][part])
            np.sum(dt, axis=0, out=g["bt"][part])
            dh_rows[first:end] += dt @ w["tok"][part]
    dh = room("dh", kind, b * n, DIM)
    dh[...] = 0
    dh[rows] = dh_rows
    r, s, sums = c["r"], c["s"], c["sums"]
    np.matmul(r.T, dh, out=g["w2"])
    dr = np.matmul(dh, w["w2"].T, out=room("dr", kind, b * n, HIDDEN))
    dr *= np.greater(r, 0, out=room("up", np.bool_, b * n, HIDDEN))
    np.matmul(c["h1"].T, dr, out=g["w1"])
    g["b1"][...] = np.ones(b * n, kind) @ dr
    de = np.matmul(dr, w["w1"].T, out=room("de", kind, b * n, DIM))
    de += dh
    np.matmul(c["a"].T, de, out=g["wo"])
    da = np.matmul(de, w["wo"].T, out=room("da", kind, b * n, DIM))
    da /= sums.reshape(b * n, 1)  # the exponentials in s are not divided by their sums
    q, k, v = (c["qkv"][:, :, i * DIM : (i + 1) * DIM] for i in range(3))
    own = row_sums(np.multiply(da, c["a"], out=dh)).reshape(b, n, 1)
    da, d = da.reshape(b, n, DIM), room("d", kind, b, n, 3 * DIM)
    dq, dk, dv = (d[:, :, i * DIM : (i + 1) * DIM] for i in range(3))
    # scores at the ends of the range are as good as never reached; their gradient passes
    for i, lo in reversed(list(enumerate(range(0, n, HALF)))):  # the last half reaches all places: it fills, the first adds
        hi = min(lo + HALF, n)
        ds = np.matmul(da[:, lo:hi], v[:, :hi].transpose(0, 2, 1), out=room("ds", kind, b, hi - lo, hi))
        ds -= own[:, lo:hi]
        ds *= s[i]
        np.matmul(ds, k[:, :hi], out=dq[:, lo:hi])
        if hi == n:
            np.matmul(ds.transpose(0, 2, 1), q[:, lo:hi], out=dk)
            np.matmul(s[i].transpose(0, 2, 1), da[:, lo:hi], out=dv)
        else:
            dk[:, :hi] += ds.transpose(0, 2, 1) @ q[:, lo:hi]
            dv[:, :hi] += s[i].transpose(0, 2, 1) @ da[:, lo:hi]
    d = d.reshape(b * n, 3 * DIM)
    dw = c["e"].T @ d
    g["wq"][...], g["wk"][...], g["wv"][...] = dw[:, :DIM] * kind.type(DIM**-0.5), dw[:, DIM : 2 * DIM], dw[:, 2 * DIM :]
    de += np.matmul(d, joint(w).T, out=dh)
    np.sum(de.reshape(b, n, DIM), axis=0, out=g["pos"][:n])
    order = by_value(x.ravel())
    ids = x.ravel()[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["emb"][ids[first]] = np.add.reduceat(np.take(de, order, axis=0, out=dh, mode="clip"), first)
    return g


def window_starts(total: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's first id among all, how many targets of its text lie from there on, its text, and whether it is the text's first."""
    n = total - 1
    per = np.maximum(1, -(-(n - (WINDOW - stride)) // stride))
    text = np.repeat(np.arange(len(n)), per)
    j = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(total) - total, per) + j * stride, n[text] - j * stride, text, j == 0


def window_ids(ids: np.ndarray, start: np.ndarray, left: np.ndarray, fresh: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, and which places score, of some windows."""
    place = np.arange(WINDOW)
    inside = place < left[:, None]
    at = np.where(inside, start[:, None] + place, 0)
    return ids[at], ids[np.where(inside, at + 1, 0)], inside & ((place >= overlap) | fresh[:, None])


def windows(ids: np.ndarray, total: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the sequences of texts: inputs, targets, which places score, and each place's text.

    A text of n + 1 ids has n targets. Window j covers targets from j * stride on; all but a text's first window score only
    their last ``stride`` places, so every target is scored once.
    """
    start, left, text, fresh = window_starts(total, stride)
    return *window_ids(ids, start, left, fresh, WINDOW - stride), text


class Learner:
    """Adam steps over the windows of a task's texts, chunk by chunk; weights, moments and the count of steps are carried on."""

    def __init__(self, w: dict, round_no: int):
        self.flat, self.steps, self.seen, self.room = packed(w), 0, 0, Room()
        self.first, self.second, self.change = (np.zeros_like(self.flat) for _ in range(3))
        self.w, self.g = parts_of(self.flat), parts_of(np.zeros_like(self.flat))
        self.rate, self.rng = RATE / (1 + round_no), np.random.default_rng(round_no)
        self.few: list[tuple[np.ndarray, np.ndarray]] = []  # all chunks so far, while they gave less than LEAST_STEPS

    def add(self, ids: np.ndarray, total: np.ndarray) -> None:
        self.seen += len(ids)
        self.learn(ids, total)
        if self.steps < LEAST_STEPS:
            self.few.append((ids, total))
        else:
            self.few.clear()

    def finish(self) -> dict:
        for _ in range(MOST_PASSES - 1):
            if self.steps < LEAST_STEPS:
                for chunk in self.few:
                    self.learn(*chunk)
        return self.w

    def learn(self, ids: np.ndarray, total: np.ndarray) -> None:
        start, left, _, fresh = window_starts(total, WINDOW)  # side by side: every id is learnt once in a pass, most with a long context
        order = self.rng.permutation(len(start))
        for s in range(0, len(order), STEP_WINDOWS):
            own = order[s : s + STEP_WINDOWS]
            gradients(self.w, *window_ids(ids, start[own], left[own], fresh[own], 0), self.room, self.g)
            self.step(self.g["emb"].base)

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        t, change = self.steps, self.change
        rate = self.rate * min(1, t / 20) / (1 + t / LEAST_STEPS) ** 0.5
        np.subtract(g, self.first, out=change)
        change *= F32(0.1)
        self.first += change
        np.multiply(g, g, out=change)
        change -= self.second
        change *= F32(0.02)
        self.second += change
        np.multiply(self.second, F32(1 / (1 - 0.98**t)), out=change)
        np.sqrt(change, out=change)
        change += F32(1e-6)
        np.divide(self.first, change, out=change)
        change *= F32(rate / (1 - 0.9**t))
        self.flat -= change


def packed(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in shapes()]).astype(F32)


def parts_of(flat: np.ndarray) -> dict:
    """Views of all weights by name."""
    out, at = {}, 0
    for k, shape in shapes().items():
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape)
        at += size
    return out


def unpacked(flat: np.ndarray) -> dict:
    return parts_of(flat.astype(F32))


def initial(unigrams: np.ndarray, pairs: np.ndarray) -> dict:
    """First weights from counts of compact ids (TOP + 1) and of adjacent pairs: a weighted factorization of smoothed log-ratios."""
    rng = np.random.default_rng(7)
    p = (unigrams + 0.5) / (unigrams + 0.5).sum()
    before = pairs.sum(axis=1, keepdims=True)
    kappa = 25.0
    ratio = np.log((pairs + kappa * p) / ((before + kappa) * p))
    ratio = np.maximum(ratio, -2.0)  # how rarely an unseen pair occurs is not told by its absence
    row = np.sqrt((before[:, 0] + 1) / (before.sum() + len(before)))
    a = row[:, None] * ratio * np.sqrt(p)
    basis = np.linalg.qr(a @ rng.standard_normal((a.shape[1], DIM + 8)))[0]
    for _ in range(3):
        basis = np.linalg.qr(a @ (a.T @ basis))[0]
    u, s, vt = np.linalg.svd(basis.T @ a, full_matrices=False)
    root = np.sqrt(s[:DIM])
    emb = (basis @ u)[:, :DIM] * root / row[:, None]
    out = vt[:DIM].T * root / np.sqrt(p)[:, None]
    w = {k: (rng.standard_normal(v) * 0.1).astype(F32) for k, v in shapes().items()}
    w["emb"], w["tok"], w["bt"] = emb, out[:TOP], np.log(p[:TOP])
    for k in ("pos", "b1", "wo", "w2"):
        w[k] *= 0.1 if k in ("wo", "w2") else 0.0
    mass = p[:TOP].reshape(CLASSES, CLASS)
    w["bc"] = np.log(np.append(mass.sum(axis=1), p[TAIL]))
    w["cls"] = np.vstack([np.einsum("ck,ckd->cd", mass, w["tok"].reshape(CLASSES, CLASS, DIM)) / mass.sum(axis=1, keepdims=True), out[TAIL:]]).T
    return {k: np.clip(v, -12, 12).astype(F32) for k, v in w.items()}


def class_order(vectors: np.ndarray) -> np.ndarray:
    """An order of TOP items that puts like ones into one class: halve along the first principal direction, again and again."""

    def halve(items: np.ndarray) -> list[np.ndarray]:
        if len(items) <= CLASS:
            return [items]
        x = vectors[items] - vectors[items].mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        order = items[np.argsort(x @ axes[:, -1], kind="stable")]
        return halve(order[: len(order) // 2]) + halve(order[len(order) // 2 :])

    return np.concatenate(halve(np.arange(TOP)))


# --- jobs ---


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 1


def id_kind(path: str) -> type:
    return np.uint16 if vocabulary(path) < 1 << 16 else np.uint32


def coded(texts: DataFrame, path: str) -> DataFrame:
    """Every text as bytes of its sequence of subword ids, and its number of words; other columns stay."""
    others = [f for f in texts.schema if f.name != "text"]
    schema = T.StructType([*others]).add("n_words", "long").add("ids", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, end, kind = Subwords(path), vocabulary(path), id_kind(path)
        for batch in batches:
            for a, b, data, starts, stops, counts, h in chunks(batch, len(others)):
                ids, total = sequences(*subwords(data, starts, stops, h), counts, end)
                offsets = np.concatenate([[0], np.cumsum(total)]) * np.dtype(kind).itemsize
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(others))), pa.array(counts), own], names=schema.names)

    return texts.select(*(F.col(f"`{f.name}`") for f in others), "text").mapInArrow(scan, schema)


def coded_chunks(batch: pa.RecordBatch, column: int, kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids of all sequences, length of each) of coded texts."""
    for a, b, data, off in B.text_chunks(batch, column, 2 << 20):
        yield a, b, np.ascontiguousarray(data).view(kind).astype(np.int64), np.diff(off) // np.dtype(kind).itemsize


def counted(texts: DataFrame, codes: DataFrame, path: str) -> DataFrame:
    """(kind, item, n): words (0), subwords (1) and adjacent subwords (2: first << 20 | second) of the training texts, summed per batch of a task."""

    def tallies(seen: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for kind, found in seen.items():
            if found:
                item, n = summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), kind, np.int32)), pa.array(item.view(np.int64)), pa.array(n)], names=["kind", "item", "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(h, return_counts=True) for *_, h in chunks(batch, 0)]
            yield from tallies({0: [*found, (END_WORD, np.array([batch.num_rows]))]})

    def subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {1: [], 2: []}
            for _, _, ids, total in coded_chunks(batch, 0, id_kind(path)):
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(total) - 1] = False
                at = np.flatnonzero(inner)
                seen[1].append(np.unique(ids[at + 1], return_counts=True))  # every id but the end in front
                seen[2].append(np.unique(ids[at] << 20 | ids[at + 1], return_counts=True))
            yield from tallies(seen)

    of = lambda rows, column, scan: rows.where("NOT held_out").select(column).mapInArrow(scan, "kind int, item long, n long")
    return of(texts, "text", words).unionByName(of(codes, "ids", subwords)).groupBy("kind", "item").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)


def pair_counts(counts: DataFrame, compact) -> np.ndarray:
    """Counts of adjacent compact ids: at most (TOP + 1) ** 2 cells, summed in Spark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compact.value
        for batch in batches:
            item, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cells, n = summed(of[item >> 20].astype(np.int64) * (TOP + 1) + of[item & 0xFFFFF], n)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n)], names=["cell", "n"])

    rows = counts.where("kind = 2").select("item", "n").mapInArrow(scan, "cell int, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    out = np.zeros((TOP + 1) ** 2, np.float64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(TOP + 1, TOP + 1)


def averaged(texts: DataFrame, path: str, compact, start: np.ndarray, round_no: int) -> np.ndarray:
    """One round: every task trains from the same weights on all its texts, coded or not; averages are weighted by ids and made per block."""
    codes = texts if "ids" in texts.columns else coded(texts, path)
    shared = texts.sparkSession.sparkContext.broadcast(start)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compact.value
        learner = Learner(unpacked(shared.value), round_no)
        for batch in batches:
            for _, _, ids, total in coded_chunks(batch, 0, id_kind(path)):
                learner.add(of[ids].astype(np.int64), total)
        if learner.seen:
            parts = np.array_split(packed(learner.finish()), WEIGHT_BLOCKS)
            group = np.full(WEIGHT_BLOCKS, learner.seen % TASK_GROUPS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(range(WEIGHT_BLOCKS), pa.int32()), pa.array(group), pa.array([float(learner.seen)] * WEIGHT_BLOCKS), pa.array([x.tobytes() for x in parts], pa.binary())], names=names)

    def mean(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, 0.0
        for batch in batches:
            for n, x in zip(batch.column("seen").to_pylist(), batch.column("weights")):
                total = total + n * np.frombuffer(x.as_py(), F32).astype(np.float64)
                seen += n
        keys = [pa.array([k.as_py()], pa.int32()) for k in key]
        yield pa.RecordBatch.from_arrays([keys[0], keys[-1], pa.array([seen]), pa.array([(total / seen).astype(F32).tobytes()], pa.binary())], names=names)

    names, schema = ["block", "part", "seen", "weights"], "block int, part int, seen double, weights binary"
    rows = codes.where(~F.col("held_out")).select("ids").mapInArrow(scan, schema).groupBy("block", "part").applyInArrow(mean, schema)
    got = {r["block"]: np.frombuffer(r["weights"], F32) for r in rows.groupBy("block").applyInArrow(mean, schema).collect()}
    return np.concatenate([got[k] for k in range(WEIGHT_BLOCKS)]) if got else start


class Model:
    """Weights, the compact id of every subword, and log10 shares of the tail's subwords within the tail."""

    def __init__(self, weights: np.ndarray, compact: np.ndarray, tail: np.ndarray):
        self.weights, self.compact, self.tail = weights, compact, tail

    def score(self, tables: Tables, ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        """log10 probability of each text's sequence."""
        c = self.compact[ids].astype(np.int64)
        out = np.zeros(len(total))
        start, left, text, begins = window_starts(total, STRIDE)
        for whole, n_last in ((True, WINDOW), (False, STRIDE)):  # a text's first window scores all its places, the others their last ones
            own = np.flatnonzero(begins == whole)
            for a in range(0, len(own), 8 * SCORED_WINDOWS):
                h, ys, counts, at = [], [], [], own[a : a + 8 * SCORED_WINDOWS]
                for k in range(0, len(at), SCORED_WINDOWS):
                    few = at[k : k + SCORED_WINDOWS]
                    x, y, live = window_ids(c, start[few], left[few], begins[few], WINDOW - STRIDE)
                    places = live[:, WINDOW - n_last :]
                    h.append(tables.last_states(x, n_last)[places.ravel()])
                    ys.append(y[:, WINDOW - n_last :][places])
                    counts.append(places.sum(axis=1))
                p = log_probs(tables.w, np.concatenate(h), np.concatenate(ys), tables.room)
                owner = np.repeat(text[at], np.concatenate(counts))
                out += np.bincount(owner, weights=p, minlength=len(out))
        out *= 1 / np.log(10.0)
        rest = self.tail[ids]
        rest[np.cumsum(total) - total] = 0  # the end in front is given
        return out + np.add.reduceat(rest, np.cumsum(total) - total)


def fit(codes: DataFrame, counts: DataFrame, path: str) -> Model:
    """Learn from coded texts and the table of counts."""
    spark, size = codes.sparkSession, vocabulary(path) + 1
    seen = counts.where("kind = 1").select("item", "n").toArrow()  # at most one row per subword
    unigrams = np.zeros(size)
    unigrams[seen.column("item").to_numpy()] = seen.column("n").to_numpy()
    top = np.argsort(-unigrams, kind="stable")[:TOP]
    compact = np.full(size, TAIL, np.int16)
    compact[top] = np.arange(TOP)
    rare = compact == TAIL
    tail = np.zeros(size)
    tail[rare] = np.log10((unigrams[rare] + 0.5) / (unigrams[rare] + 0.5).sum())
    totals = np.append(unigrams[top], unigrams[rare].sum())
    pairs = pair_counts(counts, spark.sparkContext.broadcast(compact))
    # classes from a first factorization; then everything is renumbered so that a class is a stretch of ids
    order = class_order(initial(totals, pairs)["tok"].astype(np.float64))
    compact[top[order]] = np.arange(TOP)
    whole = np.append(order, TAIL)
    weights = packed(initial(totals[whole], pairs[np.ix_(whole, whole)]))
    shared = spark.sparkContext.broadcast(compact)
    for k in range(ROUNDS):
        part = codes.where(F.pmod(F.xxhash64("row_key"), F.lit(ROUNDS)) == k)
        weights = averaged(part, path, shared, weights, k)
    return Model(weights, compact, tail)


def scored(codes: DataFrame, path: str, model: Model) -> DataFrame:
    """One row per text: the model's score, and its tokens."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = Tables(unpacked(own.weights))
        for batch in batches:
            for a, b, ids, total in coded_chunks(batch, 4, id_kind(path)):
                tokens = pc.add(batch.column(3).slice(a, b - a), 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), tokens, pa.array(own.score(tables, ids, total))], names=names)

    names = ["id", "row_key", "held_out", "n_tokens", "score"]
    kind = codes.schema["id"].dataType.simpleString()
    rows = codes.select("id", "row_key", "held_out", "n_words", "ids")
    return rows.mapInArrow(scan, f"id {kind}, row_key long, held_out boolean, n_tokens long, score double")


def base_words(texts: DataFrame, hot: dict[str, np.ndarray]) -> DataFrame:
    """(item, row_key, times, hot_sum, hot_known): the words of each text that are not hot; and a row for the hot ones together, with their
    part of the base (sum of log10(c + 0.5), tokens known). That row's item is its key, so that no task gets them all; it has no times."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value["key"], shared.value["log"]
        for batch in batches:
            for a, b, _, _, _, counts, h in chunks(batch, 1):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit, owner = keys[at] == h, np.repeat(np.arange(b - a), counts)
                hot_sum = np.bincount(owner[hit], weights=logs[at[hit]], minlength=b - a).astype(np.float64)  # whole numbers where there is no word
                hot_known = np.bincount(owner[hit], minlength=b - a)
                h, owner = h[~hit], owner[~hit]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                row_key, none = batch.column(0).slice(a, b - a).to_numpy(), np.zeros(len(first), np.int64)
                columns = (
                    [h[first].view(np.int64), row_key],
                    [row_key[owner[first]], row_key],
                    [np.diff(np.append(first, len(h))), np.zeros(b - a, np.int64)],
                    [none.astype(np.float64), hot_sum],
                    [none, hot_known],
                )
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=names)

    names = ["item", "row_key", "times", "hot_sum", "hot_known"]
    return texts.select("row_key", "text").mapInArrow(scan, "item long, row_key long, times long, hot_sum double, hot_known long")


def score(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(k.alias("id"), F.xxhash64(k, t).alias("row_key"), held_out(k).alias("held_out"), t.alias("text"))
    codes = keep(coded(texts, path), "ids", "zstd")
    counts = keep(counted(texts, codes, path), "counts")
    words = counts.where("kind = 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    above = words.where((F.col("n") * HOT >= n) | (F.col("item") == int(END_WORD.view(np.int64)[0]))).select("item", "n").toArrow()  # at most HOT + 1 rows
    item, often = above.column("item").to_numpy().view(np.uint64), above.column("n").to_numpy()
    if not len(item):
        item, often = END_WORD, np.zeros(1, np.int64)
    order = np.argsort(item)
    hot = {"key": item[order], "log": np.log10(often[order] + 0.5)}
    end_log, end_known = (float(np.log10(often[item == END_WORD][0] + 0.5)), int(often[item == END_WORD][0] > 0)) if (item == END_WORD).any() else (float(np.log10(0.5)), 0)

    own = keep(scored(codes, path, fit(codes, counts, path)), "scored")
    met = base_words(texts, hot).join(words.select("item", "n"), "item", "left")
    part = met.groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5) + F.col("hot_sum")).alias("word_sum"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0) + F.col("hot_known")).alias("word_known"),
    )
    again = own.groupBy("row_key").count()  # rows that repeat an id and text each gave their words
    norm = float(np.log10(max(n, 0) + 0.5 * (v + 1)))
    return (
        own.join(part.join(again.where("count > 1"), "row_key", "left"), "row_key", "left")
        .withColumn("times", F.coalesce("count", F.lit(1)))
        .select(
            F.col("id").alias(key),
            "held_out",
            "n_tokens",
            (F.lit(end_known) + (F.col("word_known") / F.col("times")).cast("long")).cast("long").alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.lit(end_log) + F.col("word_sum") / F.col("times") - F.col("n_tokens") * norm).alias("base_score"),
            "score",
        )
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
