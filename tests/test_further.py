"""Operators over their special cases: inputs, lookups, folded logs, notes, deep pages, live bounds."""

import gc
import glob
import json
import weakref

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.functions import casts, html, jsonops
from harrow.operators import monitor, pages, quality, records, stream
from harrow.plans import further, registry  # noqa: F401  the first registers its queries with registry
from harrow.streaming import live


def test_input_units(spark):
    d = spark.createDataFrame([(1, " @a, b\n@a", None), (2, "", 3), (3, None, 4)], "row int, who string, most int")
    got = records.input_units(d, {"most": 10, "lang": "en"}, "who").orderBy("row", "handle").collect()
    assert [(r["row"], r["handle"], r["most"], r["lang"], r["error"]) for r in got] == [(1, "a", 10, "en", ""), (1, "b", 10, "en", ""), (2, None, 3, "en", "handle is missing"), (3, None, 4, "en", "handle is missing")]


def test_lookup_keeps_items(spark):
    items = spark.createDataFrame([("r", 1, 7), ("r", 2, 8), ("s", 3, 7)], "run_id string, n int, id int")
    listed = spark.createDataFrame([("r", 7, 1, "second"), ("r", 7, 0, "first"), ("s", 9, 0, "x")], "run_id string, id int, item_no int, title string")
    assert {r["n"]: r["title"] for r in stream.with_lookup(items, listed, ["run_id"], "id", ["title"]).collect()} == {1: "first", 2: None, 3: None}


def test_folded_log(spark):
    lines = ["a", "a", "state main.x", "a", "b", "a"]
    d = spark.createDataFrame([("r", n, x) for n, x in enumerate(lines)], "run_id string, n long, line string")
    assert [r["row"] for r in stream.folded_log(d).orderBy("n").collect()] == ["a ×3", "b", "a"]


def test_render_equivalence(spark):
    d = spark.createDataFrame([("a", None, True), ("a", 9, False), ("a", 1, True), ("b", 1, False)], "step string, item_no int, seen boolean")
    got = {r["step"]: (r["judged"], r["left_out"], r["share"], r["passed"]) for r in quality.render_equivalence(d, F.lit(4)).collect()}
    assert got == {"a": (2, 1, 1.0, True), "b": (1, 0, 0.0, False)}


def test_rates(spark):
    rows = spark.createDataFrame([("r", "x")] * 6 + [("s", "x")], "run_id string, dataset string")
    got = {r["run_id"]: r["per_second"] for r in records.rates(rows, spark.createDataFrame([("r", 3000), ("s", 0)], "run_id string, wall_ms long")).collect()}
    assert got == {"r": 2.0, "s": None}


def test_typed_records_flatten_alike(spark):
    schema = "r struct<a:int,b:struct<c:double,d:string>,l:array<struct<x:int,y:string>>,t:array<string>,n:boolean>"
    rows = [((1, (2.5, "q"), [(1, "z"), (None, "w")], ["u", None], True),), ((None, (1e9, None), [], [], None),), ((3, None, None, None, False),)]
    d = spark.createDataFrame(rows, schema)
    text = F.to_json("r", {"ignoreNullFields": "false"})
    for r in d.select(jsonops.flatten_struct(F.col("r"), d.schema["r"].dataType).alias("typed"), jsonops.flatten(text).alias("parsed"), F.col("r.b").isNull().alias("bare")).collect():
        assert r.bare or {k: v or "" for k, v in r.typed.items()} == {k: v or "" for k, v in r.parsed.items()}


def test_notes_agree(spark):
    texts = ["data:image/png;base64," + "QUJD" * 3, "DATA:text/x;charset=a;base64," + "A" * 5000, "aB3" * 60, "aB3" * 20, "0f" * 80, "0F" * 80, "x" * 700, "", "plain"]
    got = [r["s"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", jsonops.sanitised_text(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == [jsonops.noted(t, 600) for t in texts] and got[4] == got[5] == "<encoded blob, 160 chars omitted>"


def test_notes_of_deep_values():
    v = 1
    for _ in range(5000):
        v = [v]
    out, depth = jsonops.sanitised(v), 0
    while isinstance(out, list):
        out, depth = out[0], depth + 1
    assert depth == 5000 and jsonops.sanitised({"a": {"b": {}}}, {**jsonops.LIMITS, "depth": 1}) == {"a": "<…>"}


def test_deep_pages(spark):
    page = html.Page("<div>" * 30_000 + "x<p>y</p><p>y</p>")
    assert page.root.text() == "x y y" and len(html.structure(page.root)) == 30_001 and html.inner_html(page.root).endswith("</div>") and page.first("p") is not None
    p = spark.createDataFrame([(1, "http://h/", "<ul>" + "<li><b>1</b></li>" * 4 + "</ul>" + "<div>" * 3000)], "page_id long, url string, html string")
    assert [(r["sig"], r["n"], r["field"]) for r in pages.group_fields(p).collect()] == [("li", 4, "b")] and pages.elements(p).count() == 3009
    assert pages.elements(p, most=5).count() == 5


def test_structure_tokens():
    shape = lambda t: html.structure(html.Page(t).root)
    assert shape("<ul><li><b></b></li><li><b></b></li><li><i></i></li></ul>") == ["0:ul", "1:li", "2:b", "1:li", "2:i"]
    assert shape("<p></p><div><p></p></div><p></p>") == ["0:p", "0:div", "1:p"]


def test_percepts_see_long_texts(spark):
    p = spark.createDataFrame([(1, "http://h/", "<p>" + "word " * 300 + "needle</p><a href='/x?y'>1.2K</a><img src='http://h/i.png'>")], "page_id long, url string, html string")
    e = pages.elements(p).select("page_id", "i", "text", F.col("attrs")["src"].alias("src"), F.col("attrs")["href"].alias("href"))
    values = spark.createDataFrame([(1, "needle", "string"), (1, "1200", "number"), (1, "/x?y", "url"), (1, "http://o/i.png", "url"), (1, None, "string"), (1, "no", "string")], "page_id long, value string, kind string")
    assert quality.grounded_share(values, quality.percepts(e), ["page_id"]).first()["share"] == pytest.approx(5 / 6)


def test_keyless_pairs_in_rounds(spark):
    rec = lambda rows: spark.createDataFrame([("r", s, f) for s, f in rows], "route string, seq long, fields map<string,string>")
    e = rec([(k, {"a": f"x{k // 2}", "b": "same", "c": "same"}) for k in range(8)])
    p = rec([(k, {"a": f"x{k}", "b": "same", "c": "other"}) for k in range(4)])
    got = {r["seq"]: r["produced_seq"] for r in quality.pair_by_overlap(e, p).collect()}
    want, free = {}, set(range(4))
    for k in range(8):  # in expected order, the best one left
        want[k] = k // 2 if k // 2 in free else None
        free.discard(want[k])
    assert got == want


def test_cosine_counts_tokens(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], []), (["a"], []), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in d.select(monitor.cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 1.0, 0.0, 0.0]


def test_names(spark):
    d = spark.createDataFrame([('[data-e2e="video-count"]',), ('div[class*="-DivTitleBox"] a',), ("div > a",), ('[name="q"]',)], "s string")
    assert [r[0] for r in d.select(casts.field_name(F.col("s"))).collect()] == ["videoCount", "titleBox", "field", "q"]
    assert d.limit(1).select(casts.unique_names(F.array(*map(F.lit, ("a", "a", "", "a"))))).first()[0] == ["a", "a2", "field", "a3"]


def test_overlay_kinds(spark):
    words = ["drag the slider", "GDPR", "Continue with mail", "allow", "hi"]
    rows = [(k, "http://h/", f"<div role=dialog id=a{k}><p>{w}</p><button>Dismiss</button></div>") for k, w in enumerate(words)]
    assert {r["page_id"]: r["kind"] for r in pages.overlays(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == dict(enumerate(["captcha", "cookie-banner", "login", "prompt", "modal"]))


def run(df, tmp_path, name):
    """The rows of a stream that reads all its files and ends."""
    out = str(tmp_path / name)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return [r.asDict() for r in df.sparkSession.read.schema(df.schema).parquet(out).collect()]


def lines(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_live_dedupe_and_stale(spark, tmp_path):
    at = tmp_path / "in"
    lines(at, "a.json", [{"run_id": "r", "url": "/", "seq": n, "ts": t, "k": k} for n, t, k in [(1, 5, "a"), (2, 9, "b"), (3, 7, "a"), (4, 9, "c"), (5, 2, "d")]])
    source = spark.readStream.schema("run_id string, url string, seq long, ts long, k string").json(str(at))
    assert sorted(r["k"] for r in run(live.deduplicated(source, ["run_id", "k"]), tmp_path, "once")) == ["a", "b", "c", "d"]
    assert sorted(r["seq"] for r in run(live.without_stale(source), tmp_path, "fresh")) == [1, 2, 4]
    # keys that share a state are told apart
    assert sorted(r["seq"] for r in run(live.without_stale(source.withColumn("url", F.concat("url", "k")), buckets=1), tmp_path, "one")) == [1, 2, 3, 4, 5]


def test_live_bursts_and_ticks(spark, tmp_path):
    at = tmp_path / "in"
    stamp = lambda ms: f"2024-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}Z"
    times = [0, 50, 100, 400, 480, 2000, *range(3000, 4000, 100), 9000]
    lines(at, "a.json", [{"run_id": "r", "scene_id": "s", "seq": n, "ts": stamp(t), "payload": f"p{t}"} for n, t in enumerate(times)])
    lines(at, "b.json", [{"run_id": "z", "scene_id": "z", "seq": 99, "ts": "2024-01-01T01:00:00Z", "payload": "late"}])
    source = spark.readStream.schema("run_id string, scene_id string, seq long, ts timestamp, payload string").option("maxFilesPerTrigger", 1).json(str(at))
    bursts = [(r["payload"], r["changes"]) for r in run(live.debounced(source), tmp_path, "bursts") if r["run_id"] == "r"]
    # a burst that never rests is told every 600 ms
    assert sorted(bursts) == sorted([("p100", 3), ("p480", 2), ("p2000", 1), ("p3500", 6), ("p3900", 4), ("p9000", 1)])
    ticks = [r["payload"] for r in run(live.throttled(source), tmp_path, "ticks") if r["scene_id"] == "s"]
    assert {"p0", "p400", "p480", "p2000", "p9000"} <= set(ticks) and "p50" not in ticks and "p100" not in ticks


def test_live_drift_alerts(spark, tmp_path):
    at = tmp_path / "in"
    lines(at, "a.json", [{"view": v, "url": u, "ts": "2024-01-01T00:00:00Z", "shape": s} for v, u, s in [("a", "/1", ["0:p", "0:p"]), ("a", "/2", ["0:x"]), ("a", "/3", ["0:y"]), ("b", "/4", ["0:p"])]])
    source = spark.readStream.schema("view string, url string, ts timestamp, shape array<string>").json(str(at))
    refs = spark.createDataFrame([("a", ["0:p"], 0.5), ("b", ["0:p"], 0.5)], "view string, shape array<string>, min_similarity double")
    got = run(live.drift_alerts(source, refs), tmp_path, "alerts")
    assert len(got) == 1 and got[0]["view"] == "a" and got[0]["url"] in ("/2", "/3")


CUT_HEADINGS = ("x&&amp", "a &amp; b", "&lt;i&gt; &amp;amp", "&copy; &ampm &")


def headings(spark, tmp_path, name, column):
    """A query's column over pages whose headings and titles hold references that are cut or not ``&amp;``, and the same by its SQL."""
    rows = [(k, f"https://h.example/en/{k}", f'<html><head><title>{x}</title></head><body><nav><li><a href="/a">a</a></li></nav><article><h1>{x}</h1><nav><a href="/a">a</a></nav></article></body></html>') for k, x in enumerate(CUT_HEADINGS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, {column} FROM ({registry.ORACLES[name]}) ORDER BY page_id").fetchall()
    return [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select("page_id", column).orderBy("page_id").collect()], want


def test_scoped_objects_read_references_as_their_sql(spark, tmp_path):
    got, want = headings(spark, tmp_path, "scoped_objects", "heading")
    assert got == want and got[0][1] == "x&&amp"


def test_page_models_read_references_as_their_sql(spark, tmp_path):
    got, want = headings(spark, tmp_path, "page_models", "title")
    assert got == want and got[0][1] == "x&&amp"


def test_labels_are_no_broadcast_side(spark, tmp_path):
    spark.range(200).selectExpr("id % 2 AS page", "id AS i", "concat('Ring ', id) AS hay", "5 AS w", "6 AS h").write.parquet(str(tmp_path / "e"))
    q = spark.createDataFrame([(k, name, needle) for k in range(2) for name, needle in (("long", "ring 1"), ("short", "7"))], "page long, query_id string, token string")
    found = quality.targets(q, spark.read.parquet(str(tmp_path / "e")), ["page"])
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["page"], r["query_id"]): r["i"] for r in found.collect()} == {(0, "long"): 10, (0, "short"): 70, (1, "long"): 1, (1, "short"): 7}


def test_role_tokens_stream_by_pages(spark):
    tree = [("m", None, 0, "main", False), ("g", "m", 0, "generic", False), ("l", "g", 0, "list", False), ("i", "l", 0, "item", False), ("j", "l", 1, "item", False), ("b", "m", 1, "button", None), ("x", "m", 2, "link", True)]
    small = [("a", None, None, "last", False), ("b", None, 0, "first", False), (None, "b", 0, "text", False)]
    rows = [(p, *n) for p in range(3000) for n in (tree if p % 2 else small)] + [(None, "z", None, 0, "main", False)]
    got = pages.role_tokens(spark.createDataFrame(rows, "page_id long, node_id string, parent_id string, pos int, role string, ignored boolean"))
    want = {p: ["0:main", "1:list", "2:item", "1:button"] if p % 2 else ["0:first", "1:text", "0:last"] for p in range(3000)} | {None: ["0:main"]}
    assert {r["page_id"]: r["ax"] for r in got.collect()} == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_json_functions_share_a_python_process(spark):
    d = spark.createDataFrame([('{"b":[1],"a":"x"}',), (None,), ("{",)], "t string").select(jsonops.canonical(F.col("t")).alias("c"), jsonops.structure_key(F.col("t")).alias("k"), F.size(jsonops.scalars(F.col("t"))).alias("n"))
    assert d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["c"], r["n"]) for r in d.collect()] == [('{"a":"x","b":[1]}', 2), (None, None), (None, None)]


def test_overlap_broadcasts_no_records(spark, tmp_path):
    spark.range(50).selectExpr("'r' AS route", "id AS seq", "map('name', concat('n', id), 'tel', concat('t', id), 'kind', 'zz') AS fields").write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    got = quality.pair_by_overlap(r, r.where("seq % 2 = 0"))
    assert {x["seq"]: x["produced_seq"] for x in got.collect()} == {k: None if k % 2 else k for k in range(50)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["picture_hashes", "picture_mosaics"])
def test_pictures_share_folders(spark, tmp_path, name):
    spark.range(1, 121).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    origins = [r["o"] for r in further.readers.frames(spark, written(spark, tmp_path)).select(F.col("image.origin").alias("o")).collect()]
    assert len(origins) == 120 and len({o.rsplit("/", 1)[0] for o in origins}) <= further.PICTURE_FOLDERS
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall())


def written(spark, tmp_path):
    """The folder that ``pictures`` wrote last."""
    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/pictures-*"))
    further.pictures(spark, str(tmp_path))
    return (set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/pictures-*")) - before).pop()


@pytest.mark.parametrize("name", ["field_names", "classified_messages", "parity", "parity_mismatches"])
def test_costly_rows_go_to_many_tasks(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_names_and_errors_of_nulls(spark):
    d = spark.createDataFrame([(["a", "a", None, ""], '{"version":"1","deleteSurface":{"surfaceId":"s"}}'), (None, None), (["field", "x", "x", "x"], "{")], "names array<string>, raw string")
    got = d.select(casts.unique_names(F.col("names")).alias("n"), stream.message_errors(F.col("raw")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(["a", "a2", "field", "field2"], []), (None, ["not JSON"]), (["field", "x", "x2", "x3"], ["not JSON"])]


def test_pages_are_let_go_one_by_one(spark, monkeypatch):
    """a task holds one page's tree, and no more rows than a batch that goes back, however many pages it reads."""
    monkeypatch.setattr(pages, "OUT_ROWS", 100, raising=False)

    class Text(str):
        pass

    trees, texts = [], []

    def rows(i, url, page):
        gc.disable()  # trees must go without a search for cycles
        trees.append(weakref.ref(page.all[0]))
        for k in range(250):
            t = Text(f"{i}-{k}")
            texts.append(weakref.ref(t))
            held = len([1 for r in trees if r() is not None]), len([1 for r in texts if r() is not None])
            yield (i, t, *held, {"k": str(k)} if k else None)
        if i == 39:
            gc.enable()

    html = spark.range(0, 40, 1, 1).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("<div><p>a<p>b</div>").alias("html"))
    got = pages._each_page(html, rows, "page_id long, text string, trees int, texts int, attrs map<string,string>").collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, f"{i}-{k}") for i in range(40) for k in range(250))
    assert all(r["attrs"] == ({"k": r["text"].split("-")[1]} if not r["text"].endswith("-0") else None) for r in got)
    assert max(r["trees"] for r in got) <= 2 and max(r["texts"] for r in got) <= 102
