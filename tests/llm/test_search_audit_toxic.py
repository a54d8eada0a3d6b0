"""Lexical search, source audit and toxicity: brute force, exact gradients, planted words, special cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from harrow.llm import lexical, source_audit, toxicity

from . import brute

rng = random.Random(11)
PLAIN = "the of and to in river Stone light2 water GREEN été grün 12 small early wind north house".split()


def prose(n):
    return " ".join(rng.choice(PLAIN) + rng.choice(["", "", ",", ".", "\n", "\t", "--x"]) for _ in range(n))


# --- lexical search ---


def searched(docs, items, top):
    """Every score of every item by the definition: (item place, rank, doc_id, score)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [Counter(term.findall(brute.low(t))) for _, t in docs]
    n, size = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for q, (_, text) in enumerate(items):
        found = []
        for (i, _), b in zip(docs, bags):
            m = 50 + (50 * sum(b.values()) * n) // size if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(term.findall(brute.low(text))) if b[t])
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(q, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


def searches(spark, docs, items, top=5, parts=3, **small):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, score int").repartition(parts)
    b = spark.createDataFrame([(q, t, "y") for q, (_, t) in enumerate(items)], "item_id long, text string, key string")
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, b, top, **small).collect())


def test_search_is_brute_force(spark):
    docs = [(k, prose(rng.randrange(1, 90))) for k in range(150)] + [(200 + k, "river stone river") for k in range(40)]
    docs += [(300, None), (301, ""), (302, "... --"), (None, "river stone river"), (303, "river stone river"), (303, "river stone river"), (304, " ".join(["deep water"] * 60_000))]
    items = [(0, "River stone"), (1, prose(40)), (2, None), (3, "nothing-matches zzz"), (4, "THE the of"), (5, "River stone"), (6, "été GRÜN grün")]
    want = searched(docs, items, 5)
    assert searches(spark, docs, items) == sorted(want, key=lambda r: (r[0], r[1]))
    small = {"step": 2, "chunk": 2000, "most_items": 3, "coordinates": 4}  # small steps and pieces, several batches of items, loose bounds
    assert searches(spark, docs, items, **small) == sorted(want, key=lambda r: (r[0], r[1]))


def test_bounds_hold():
    vocabulary = np.sort(np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64))
    corpus = lexical.Corpus(vocabulary, np.arange(1, 501), 1000, 50_000)
    doc, at = np.divmod(np.unique(np.random.default_rng(4).integers(0, 20 * 500, 900)), 500)
    impact = corpus.impacts(doc, at, np.ones(len(at), np.int64) * 2, np.full(20, 40))
    sketch = corpus.sketches(doc, at, impact, 20)
    for _ in range(20):
        terms = np.random.default_rng(5).choice(500, 30, replace=False)
        exact = np.array([impact[(doc == d) & np.isin(at, terms)].sum() for d in range(20)])
        assert (sketch[:, corpus.coordinate[terms]].sum(1) >= exact).all()


@pytest.mark.parametrize("docs, items", [([], [(0, "a")]), ([(1, "a b")], []), ([(1, None)], [(0, "a")]), ([(1, "a b")], [(0, None)])])
def test_search_of_nothing(spark, docs, items):
    assert searches(spark, docs, items, parts=1) == []


# --- source audit ---


def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(lang or "", source or "", Counter(term.findall(brute.low(t)))) for lang, source, t in rows]
    out = []
    for lang in {b[0] for b in bags}:
        own = [b for b in bags if b[0] == lang]
        df, groups = Counter(t for b in own for t in b[2]), defaultdict(Counter)
        kept = [t for t in df if df[t] >= least]
        for _, source, bag in own:
            groups[source].update({t: bag[t] for t in kept if bag[t]})
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in groups.items():
            pair = [(-sum(abs(p(c, t) - p(d, t)) for t in kept), o.encode(), o) for o, d in groups.items() if o != s]
            more = [(p(whole, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            out += [(lang, s, "pair", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(pair))]
            out += [(lang, s, "term", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(more)[:top])]
    return sorted(out)


def audits(spark, rows, least=3, top=4, parts=3, **small):
    d = spark.createDataFrame([(k, *r, "x", 0) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int").repartition(parts)
    return sorted(tuple(r) for r in source_audit.audit(d, least, top, **small).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_is_brute_force(spark):
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", "z", None]), prose(rng.randrange(1, 60))) for _ in range(160)]
    rows += [("en", "a", "river river river")] * 90  # a hot group of copies
    rows += [("en", "silent", None), ("en", "silent", "12 34 ..."), ("xx", "one", "seldom words"), ("xx", "two", ""), ("yy", "alone", "x x")]
    rows += [("en", "long", " ".join(["deep water of ice"] * 40_000))]
    want = audited(rows, 3, 4)
    assert audits(spark, rows) == want
    assert audits(spark, rows, in_tile=2, in_slice=3, chunk=3000) == want  # several tiles, slices and pieces


def test_runs_and_shares():
    g = np.random.default_rng(6)
    counts = source_audit.reordered(g.integers(0, 3, (400, 5)))
    assert sum(len(source_audit.runs(c)[0]) for c in counts.T) < 0.7 * 5 * 400 * 2 / 3  # equal counts stand together
    a, b = counts[:, 0] * 10, counts[:, 3] * 7
    assert source_audit.distance(source_audit.runs(a), source_audit.runs(b), 400) == np.abs(a - b).sum()
    big = np.array([0, 7, 10**12, 10**15])
    assert source_audit.shares(big, 2 * 10**15, 11).tolist() == [1 + 10**9 * (int(c) + 5) // (2 * 10**15 + 55) for c in big]


def test_audit_of_nothing(spark):
    assert audits(spark, [], parts=1) == []
    assert audits(spark, [("en", "a", None), ("en", "b", "")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# --- toxicity ---


def small_words():
    raw = b"the idiot walks over there again . foo bar b\xc3\xa4r idiot"
    words = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw) - 18, len(raw) - 18, len(raw)]))
    begin, size, text = toxicity.windows(words.per_text)
    return words, begin, size, text


def test_gradients(monkeypatch):
    words, begin, size, text = small_words()
    assert text.tolist() == [0, 2]
    ids = toxicity.places(words.of_token, begin, size, -1)
    monkeypatch.setattr(toxicity, "f32", np.float64)
    g = np.random.default_rng(1)
    w = {k: v.astype(float) + 0.05 * g.standard_normal(v.shape) for k, v in toxicity.new_weights(3).items()}
    label, weight = np.array([1.0, 0.0]), np.array([0.7, 1.3])
    _, grad = toxicity.gradient(w, words, ids, label, weight)
    for name, v in w.items():
        places = {"word": [(int(words.row[2]), 1)], "group": [(int(words.inner[2]), 1), (int(words.affix[2, 0]), 3)]}.get(name) or [tuple(g.integers(0, k) for k in v.shape) for _ in range(4)]
        for at in places:
            old, losses = v[at], []
            for d in (1e-3, -1e-3):
                v[at] = old + d
                losses.append(toxicity.gradient(w, words, ids, label, weight)[0])
            v[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 1e-4, name


def test_windows_cover_every_word_and_company_does_not_matter():
    n = np.array([0, 1, 63, 64, 65, 112, 113, 1000])
    begin, size, text = toxicity.windows(n)
    first = np.cumsum(n) - n
    for k, count in enumerate(n):
        own = [(b - first[k], b - first[k] + s) for b, s, t in zip(begin, size, text) if t == k]
        assert (not own) if count == 0 else (sorted({w for a, b in own for w in range(a, b)}) == list(range(count)))
        assert all(b[0] < a[1] for a, b in zip(own, own[1:]))  # windows overlap
    words, begin, size, text = small_words()
    w = toxicity.new_weights(5)
    both = toxicity.log_odds(w, toxicity.gates(w, toxicity.inputs(w, words, np.arange(len(words.row)))), words.of_token, begin, size)
    alone = toxicity.Words(np.frombuffer(b"foo bar b\xc3\xa4r idiot", np.uint8), np.array([0, 18]))
    b, s, _ = toxicity.windows(alone.per_text)
    one = toxicity.log_odds(w, toxicity.gates(w, toxicity.inputs(w, alone, np.arange(len(alone.row)))), alone.of_token, b, s)
    assert abs(one[0] - both[1]) < 1e-5  # the first text's further words don't matter


def test_toxic_words_and_word_forms_are_found(spark):
    bad = ["idiot", "moron"] + ["lowei" + e for e in ("chen", "ung", "er", "keit", "lich", "ent")]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = prose(rng.randrange(20, 150)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "... ---"), (None, "an idiot"), (2003, "river stone " * 30_000 + " idiot moron loweiung"), (2003, "river"), (2004, "loweigne idiot wind moron loweischaft")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    known = spark.createDataFrame([(i, y, 1) for i, y in [*labels, (0, 0), (None, 1), (5000, 1)]], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]}
    hits = [own[i]["predicted"] for i, y in labels if i in own and y]
    wrong = [own[i]["predicted"] for i, y in labels if i in own and not y]
    assert len(hits) > 40 and np.mean(hits) >= 0.95 and np.mean(wrong) <= 0.03
    last = defaultdict(list)
    for r in got:
        last[r["doc_id"]].append(r)
    assert {r["predicted"] for i in (2000, 2001, 2002) for r in last[i]} == {0} and len({r["score"] for i in (2000, 2001, 2002) for r in last[i]}) == 1
    assert sorted(r["predicted"] for r in last[2003]) == [0, 1] and last[2004][0]["predicted"] == 1  # the end of a very long text; an ending not met before


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.score(docs, none).collect()] == [(0.0, 0)] * 2
    assert toxicity.score(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_learning_is_repeatable():
    texts = pa.array([prose(30) + (" idiot" if k % 2 else "") for k in range(40)], pa.large_string())
    label = np.arange(40) % 2
    a, b = (toxicity.learn(texts, label, np.ones(40, np.float32)) for _ in range(2))
    assert all((a[k] == b[k]).all() for k in a)
