"""The text operators against brute-force versions, with nulls, empties, ties, repeated rows, clashing columns and empty tables."""

import functools
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from harrow.llm import _links, _losers, decontaminate, html_text, jaccard_join, lm_score, pii, piece_lattice, quality, suffix_dedup, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)


def words(n, v=400):
    return " ".join(f"w{rng.randrange(v)}x" for _ in range(n))


@functools.cache
def corpus():
    base, passage = words(120), words(60)
    edit = lambda t, k: " ".join(w if i % k else w + "q" for i, w in enumerate(t.split()))
    texts = [None, "", "  \n\t ", "one two", "One TWO", base, base, base.upper(), edit(base, 60), edit(base, 40), edit(base, 9), passage, words(40) + " " + passage + " " + words(30), passage + "\n" + words(20), words(3000), "a b c d e " * 30,
             "mail a.b@c.example.org and 10.0.0.1 card 4111 1111 1111 1111 tel +1 (171) 555-2028 ok", "x<|endoftext|>y  z", "▁ é🎉 日本\n\nq", "The and of the in to is it. " * 3 + "of the and a in"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, base), (16, texts[16])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", "left", 1) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, base string, n long").repartition(3)


def empty(df):
    return df.where("doc_id < 0")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_quality(docs):
    got = quality.judge(docs)
    assert set(docs.columns) < set(got.columns) and quality.judge(empty(docs)).count() == 0
    for r in got.collect():
        ws = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {k + j for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        m = r.quality.m
        assert (m.n_words, m.word_chars, m.n_dup_lines, m.n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(covered))
        assert m.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.quality.base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path).collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert token_counts.count_tokens(empty(docs), path).count() == 0


def test_jaccard(docs):
    rows = {}
    for i, t in corpus():
        w = WORD.findall(low(t))
        rows[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in rows:
        for j in rows:
            if i < j and rows[i] and 100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = jaccard_join.join(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in rows.items()} and len(got) == docs.count()
    assert jaccard_join.join(empty(docs)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in _links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == 100 for k in range(100, 140))


def test_suffix_dedup(docs):
    counts, rows = Counter(), [(i, (t or "").encode()) for i, t in corpus()]
    for _, b in rows:
        counts.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone) if not y)
        want.append((i, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, len((r.text or "").encode()), len((r.text or "").encode()) - len(r.kept), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.dedup(empty(docs)).count() == 0


def test_loser_trees():
    for k in range(0, 9):
        runs = [sorted((rng.randrange(30), i) for _ in range(rng.randrange(12))) for i in range(k)]
        assert list(_losers.merge(runs)) == sorted(x for r in runs for x in r)
        rows = [sorted((bytes(rng.choices(b"ab", k=rng.randrange(1, 12))), b"l", 1, 2) for _ in range(rng.randrange(12))) for _ in range(k)]
        got = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in rows]))
        assert [g[0] for g in got] == sorted(x[0] for r in rows for x in r)
        assert all(b[1] == suffix_dedup.shared(a[0], b[0], 0) for a, b in zip(got, got[1:]))


def test_lattice(docs):
    path = piece_lattice.default_model()
    got = piece_lattice.with_pieces(docs, path, back="back").collect()
    assert all(r.back == r.text for r in got)
    again = {(r.doc_id, r.text): r.piece_ids for r in piece_lattice.with_pieces(docs.repartition(1), path).collect()}
    assert all(again[r.doc_id, r.text] == r.piece_ids for r in got)
    assert [r.t for r in piece_lattice.decoded(piece_lattice.with_pieces(docs, path), path, into="t").select("t").collect() if r.t is None] == [None]
    assert piece_lattice.with_pieces(empty(docs), path).count() == 0


def test_lattice_probabilities():
    path = piece_lattice.default_model()
    own, unit, n = piece_lattice.lattice(path), "then", 20_000
    key, want = "▁" + unit, {}
    for m in range(1 << len(unit)):
        cuts = [0, *[i + 1 for i in range(len(unit)) if m >> i & 1], len(key)]
        parts = [key[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in own.weights for p in parts):
            want[tuple(own.weights[p][0] for p in parts)] = float(np.prod([own.weights[p][1] for p in parts]))
    got = Counter(tuple(x.tolist()) for x in piece_lattice.encode_texts([unit] * n, np.arange(n), path))
    total = sum(want.values())
    assert set(got) <= set(want) and max(abs(got[k] / n - v / total) for k, v in want.items()) < 0.02


def test_decontamination(spark, docs):
    item, other = words(30), words(25)
    off = item.split()
    off[4] = off[15] = off[27] = "zzz"
    rows = [(1, "x " + item + " y"), (2, words(10) + " " + " ".join(off).upper() + " " + words(9)), (3, words(60)), (4, None), (5, ""), (6, " ".join(item.split()[:8])), (1, "x " + item + " y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, other), (9, None), (10, "a b")], "item_id long, text string")
    for broadcast in (True, False):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench, broadcast=broadcast).collect()) == [(1, 7), (2, 7)]
    assert decontaminate.leaks(d, bench.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), bench).count() == 0


def base_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, docs):
    odd = ["a@b.c_d@e.f x@y.z.w @q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111, 4111-1111--1111 4111111111111111", "+1 (171) 555-2028 +123", "1" * 5000, "a" * 5000 + "@", "é🎉 a@b.co 🎉", "12 41111111"]
    more = spark.createDataFrame([(100 + i, t, "s", "x", 1) for i, t in enumerate(odd)], docs.schema)
    got = pii.find(docs.unionByName(more)).collect()
    assert len(got) == docs.count() + len(odd)
    for r in got:
        assert [tuple(b) for b in r.base] == base_spans(r.text or "")
        assert {tuple(b) for b in r.base} <= {tuple(b) for b in r.spans}
    clean = pii.find(docs, models={}).select(pii.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).where("t LIKE 'mail%'").first()[0]
    assert clean == "mail [EMAIL] and [IP] card [CARD] tel [PHONE] ok"
    assert pii.find(empty(docs)).count() == 0


def test_suffix_dedup_null_ids(spark):
    passage, apart = words(90), [words(90) for _ in range(6)]
    texts = [f"{apart[0]} {passage} {apart[1]}", f"{apart[2]} {passage} {apart[3]}", f"{apart[4]} {passage} {apart[5]}"]
    run = lambda ids: {r.text: bytes(r.kept) for r in suffix_dedup.dedup(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    want = run([1, 2, 3])
    assert all(len(k) < len(t) - 300 for t, k in want.items()) and run([None, None, None]) == run([None, 2, None]) == want


def test_warc(spark, tmp_path):
    html = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://b.example/2", html), (2, "http://a.example/1", html), (3, None, html), (4, "http://a.example/0", "short"), (5, "http://a.example/0", "short"), (6, "http://a.example/é x", None), (7, "http://a.example/1", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.write(pages, str(tmp_path / "warc"))
    got = warc.read_index(spark, path, 3).orderBy("range_no", "place").collect()
    assert [(r.url_key, r.captured_at, r.page_id) for r in got] == sorted((r.url_key, r.captured_at, r.page_id) for r in got)
    want = {i: ((h or "").encode(), "revisit" if h == html and i < 3 else "response", 3 if h == html and i < 3 else None) for i, _, h in rows}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {i: (len(b), hashlib.sha1(b).hexdigest(), k, x) for i, (b, k, x) in want.items()}
    assert warc.read_index(spark, warc.write(pages.limit(0), str(tmp_path / "none")), 3).count() == 0


def test_warc_null_ids(spark, tmp_path):
    html = "y" * 1500
    rows = [(None, "http://a.example/1", html), (None, None, html), (None, "", "short"), (None, None, "short"), (8, "http://a.example/1", html), (9, None, html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.read_index(spark, warc.write(pages, str(tmp_path / "warc")), 3).collect()
    want = Counter((i, u, len(h), "revisit" if i == 8 else "response", 9 if i == 8 else None) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want


def test_html(spark):
    main = "<div class='post-%d'><h2>Head &amp; more</h2><p>First   long paragraph of text here, with words.<p>Second one<br>goes on, and on &lt;x&gt;.</div>"
    page = lambda k: f"<html><head><title>T</title></head><body><header>Top</header><nav><a href=/>home</a></nav><aside>side text that is rather long, really long, so long</aside>{main % k}<div class='comments'><p>{'reader says so ' * 30}</p></div><form>Search</form><script>var p='<p>no</p>'</script><footer>foot</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(5)] + [(10, "http://h.example/x", None), (11, None, ""), (12, "http://o.example/", "plain <b>text"), (12, "http://o.example/", "plain <b>text")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[0] == "Head & more\nFirst long paragraph of text here, with words.\nSecond one goes on, and on <x>." and text[10] == text[11] == ""


def test_html_keeps_split_articles(spark):
    long, nav = "<p>" + "long text of the article " * 9 + "</p>", "<nav><a href=/>home</a></nav>"
    links = "<div class='topics'>" + "".join(f"<p><a href=/{k}>topic number {k}</a></p>" for k in range(9)) + "</div>"
    bodies = [
        f"{nav}<article><h1>Title</h1><div class=content>{long}{long}</div></article>",
        f"<article><div class=lead><p>The lead.</p></div><div class=body>{long}{long}</div></article>{links}",
        f"<main><section class=a><p>One.</p></section><section class=b>{long}</section><blockquote class=c><p>Three.</p></blockquote></main><footer>foot</footer>",
        f"<h1>Title</h1><div class=content>{long}</div>",
        f"<div id=page><h1>Title</h1><div class=content>{long}{long}</div></div>{links}",
        f"<main><h1>Title</h1><article>{long}</article>{links}</main>",
    ]
    rows = [(10 * k + i, f"http://h{k}.example/{i}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies) for i in range(3)]
    text = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    p = ("long text of the article " * 9).strip()
    topics = "".join(f"\ntopic number {k}" for k in range(9))
    want = [f"Title\n{p}\n{p}", f"The lead.\n{p}\n{p}", f"One.\n{p}\nThree.", f"Title\n{p}", f"Title\n{p}\n{p}", f"Title\n{p}{topics}"]
    assert all(text[10 * k + i] == w for k, w in enumerate(want) for i in range(3))


def test_lm(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    more = spark.createDataFrame([(1000 + i, words(80, 50), "s", "x", 1) for i in range(120)], docs.schema)
    got = lm_score.score(docs.unionByName(more), path).collect()
    assert len(got) == docs.count() + 120 and all(r.score < 0 for r in got) and len({r.train_tokens for r in got}) == 1
    held = [r for r in got if r.held_out and r.doc_id >= 1000]
    assert sum(r.n_known for r in held) == sum(r.n_tokens for r in held)
    assert lm_score.score(empty(docs), path).count() == 0


def test_lm_is_a_distribution():
    w = {k: (np.random.default_rng(1).standard_normal(v) * 0.3).astype(np.float32) for k, v in lm_score.shapes().items()}
    h = lm_score.forward(w, np.array([[1, 5, 9]]))["h"]
    total = sum(np.exp(lm_score.log_probs(w, h, np.full(3, y))) for y in range(lm_score.TOP + 1))
    assert np.allclose(total, 1, atol=1e-3)


def test_lm_windows_score_once():
    total = np.array([2, 5, lm_score.WINDOW + 1, lm_score.WINDOW + 2, 200])
    x, y, live, text = lm_score.windows(np.arange(total.sum()), total)
    scored = np.sort(y[live])
    want = np.concatenate([np.arange(b - n + 1, b) for n, b in zip(total, np.cumsum(total))])
    assert (scored == want).all() and (np.bincount(text, weights=live.sum(axis=1)) == total - 1).all()


def test_lm_ids_have_context():
    total = np.array([2, 40, 90, lm_score.WINDOW + 2, 700])
    x, y, live, _ = lm_score.windows(np.arange(total.sum()), total)
    begin = np.repeat(np.cumsum(total) - total, total - 1)
    target = np.sort(y[live])
    context = (np.broadcast_to(np.arange(1, lm_score.WINDOW + 1), x.shape)[live])[np.argsort(y[live])]
    assert (context >= np.minimum(target - begin, 32)).all() and lm_score.shapes()["w1"][1] >= 48 and lm_score.ROUNDS >= 2


def test_lm_gradients():
    r = np.random.default_rng(3)
    w = {k: r.standard_normal(v) * 0.3 for k, v in lm_score.shapes().items()}
    x, y, live, _ = lm_score.windows(r.integers(0, lm_score.TOP + 1, 150), np.array([9, 41, 100]))

    def loss():
        rows = np.flatnonzero(live.ravel())
        return -lm_score.log_probs(w, lm_score.forward(w, x)["h"][rows], y.ravel()[rows]).mean()

    for k, g in lm_score.gradients(w, x, y, live).items():
        for at in np.argsort(-np.abs(g).ravel())[[0, 1, 5, 11]]:
            kept, ends = w[k].flat[at], []
            for step in (1e-5, -1e-5):
                w[k].flat[at] = kept + step
                ends.append(loss())
            w[k].flat[at] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-5, g.flat[at], rtol=2e-3, atol=1e-7), k


@pytest.fixture(scope="module")
def chains(spark):
    r = random.Random(11)

    def chain(n):  # a word tells the next one
        at = r.randrange(40)
        out = [at]
        for _ in range(n):
            at = (at * 7 + 3) % 40 if r.random() < 0.9 else r.randrange(40)
            out.append(at)
        return " ".join(f"W{k}x" for k in out)

    rows = [(i, chain(60)) for i in range(300)] + [(300, None), (301, "once ONLY"), (7, "again")]
    return rows, lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()


def test_lm_base_score(chains):
    rows, got = chains
    held = {g.doc_id: g.held_out for g in got}
    tokens = lambda t: [low(x) for x in WORD.findall(t or "")] + [None]
    seen = Counter(x for i, t in rows if not held[i] for x in tokens(t))
    norm = np.log10(sum(seen.values()) + 0.5 * (len(seen) + 1))
    want = sorted((i, sum(np.log10(seen[x] + 0.5) - norm for x in tokens(t))) for i, t in rows)
    assert np.allclose(sorted((g.doc_id, g.base_score) for g in got), want)


def test_lm_held_out_score(chains):
    mine = [g for g in chains[1] if g.held_out and g.n_tokens > 50]
    assert len(mine) > 20 and sum(g.score for g in mine) > sum(g.base_score for g in mine)


def test_lm_learns_from_every_text_and_batch(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    of = np.minimum(np.arange(lm_score.vocabulary(path) + 1), lm_score.TAIL).astype(np.int16)
    r = np.random.default_rng(2)
    start = lm_score.packed({k: r.standard_normal(v) * 0.1 for k, v in lm_score.shapes().items()})
    texts = [words(30) for _ in range(40)]
    rows = spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean").coalesce(1)
    one = lambda df: lm_score.averaged(df, path, spark.sparkContext.broadcast(of), start, 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got, left_out = one(rows), one(rows.where(F.pmod(F.xxhash64("text"), F.lit(16)) != 0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not np.array_equal(left_out, start)
    subwords, learner = lm_score.Subwords(path), lm_score.Learner(lm_score.unpacked(start), 0)
    for k in range(0, len(texts), 8):
        batch = lm_score.pa.RecordBatch.from_pydict({"text": texts[k : k + 8]})
        for _, _, data, starts, stops, counts, h in lm_score.chunks(batch, 0):
            ids, total = lm_score.sequences(*subwords(data, starts, stops, h), counts, len(of) - 1)
            learner.add(of[ids].astype(np.int64), total)
    assert learner.steps == 5 and np.allclose(lm_score.packed(learner.finish()), got, atol=1e-3) and learner.steps == 40


def test_lm_codes_are_the_words_subwords(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [words(n) for n in (3, 40, 1)] + ["", "Two\n\nLINES é"]
    rows = lm_score.coded(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").repartition(2), path)
    kind, end, encode = lm_score.id_kind(path), lm_score.vocabulary(path), lm_score.encoder(path).encode_ordinary
    got = {r.k: (r.n_words, np.frombuffer(r.ids, kind).tolist()) for r in rows.collect()}
    assert got == {k: (len(WORD.findall(t)), [end, *(i for w in WORD.findall(t) for i in encode(" " + low(w))), end]) for k, t in enumerate(texts)}


def test_lm_scoring_looks_up_what_the_model_computes():
    r = np.random.default_rng(5)
    w = {k: (r.standard_normal(v) * 0.3).astype(np.float32) for k, v in lm_score.shapes().items()}
    x, tables = r.integers(0, lm_score.TOP + 1, (7, lm_score.WINDOW)), lm_score.Tables(w)
    h = lm_score.forward(w, x)["h"].reshape(7, lm_score.WINDOW, -1)
    for n_last in (lm_score.WINDOW, lm_score.STRIDE, lm_score.WINDOW):
        assert np.allclose(tables.last_states(x, n_last).reshape(7, n_last, -1), h[:, -n_last:], atol=1e-4)


def test_lm_steps_take_no_fresh_pages():
    import resource

    r = np.random.default_rng(6)
    ids, total = r.integers(0, lm_score.TOP + 1, 60_000), np.full(60, 1000)
    learner = lm_score.Learner(lm_score.unpacked(lm_score.packed({k: r.standard_normal(v) * 0.1 for k, v in lm_score.shapes().items()})), 0)
    learner.learn(ids, total)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    learner.learn(ids, total)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 3_000


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    ids = {r.doc_id for r in rows}
    assert ids and len(ids) == len(rows) and not any(b in docs[i] for i in ids for b in bench)
    by_text = defaultdict(list)
    for i, t in docs.items():
        by_text[t].append(i)
    assert all(len(set(x) & ids) <= 1 for x in by_text.values())
    path = piece_lattice.default_model()
    for r in rows:
        spans = base_spans(docs[r.doc_id])
        assert (r.text == docs[r.doc_id]) == (not spans) or any(k in r.text for k in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]"))
        assert piece_lattice.lattice(path).decode(r.piece_ids) == r.text and not base_spans(r.text)
