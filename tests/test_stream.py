import json
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from harrow.operators import harvest, keyed, monitor, quality, records, stream
from harrow.operators.keyed import KeyedTable
from harrow.sources import readers
from harrow.streaming import live, replay


def test_replay_equals_live(spark):
    models = [{"v": [1]}, {"v": [1, 2]}, {"v": [3, 2], "n": None}, {"w": {str(k): k for k in range(50)}}, {"w": {}}]
    rows = [(1, k, k, "u", "/p", "list", json.dumps(m)) for k, m in enumerate(models)] + [(1, 5, 5, "u", "/q", "list", '{"a":1}'), (1, 6, 6, "u", "/q", None, "{}")]
    snaps = spark.createDataFrame(rows, "run_id long, seq long, ts long, url string, path string, view string, model string")
    messages = stream.surface_messages(snaps)
    final = {r["surface_id"]: json.loads(r["model"]) for r in stream.fold_surfaces(messages).collect()}
    assert final == {"list-1": {"w": {}}, "list-2": {"a": 1}}
    kinds = [r["kind"] for r in messages.orderBy("seq", "part").collect()]
    assert kinds[0] == "createSurface" and kinds[-1] == "deleteSurface" and kinds.count("deleteSurface") == 2


def test_keys_and_first_wins(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", "c"), (4, "x", "d")], "seq long, k string, v string")
    assert {r["v"] for r in records.first_wins(df, records.record_key(df, "k"), ["seq"]).collect()} == {"a", "c"}


def test_append_once(spark, tmp_path):
    df = spark.createDataFrame([(k, f"k{k % 3}") for k in range(6)], "seq long, k string")
    path = str(tmp_path / "out")
    records.append_once(spark, df, path, ["k"], ["seq"])
    records.append_once(spark, df, path, ["k"], ["seq"])
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_torn_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b"\n{"id":"c","n":3}\n')
    assert [r["id"] for r in readers.log_lines(spark, str(tmp_path / "log.jsonl"), "id string, n int").orderBy("id").collect()] == ["a", "c"]


def test_thinning_and_hashes(spark):
    frames = spark.createDataFrame([("s", 0, [0.0]), ("s", 100, [9.0]), ("s", 300, [1.0]), ("s", 400, [9.0]), ("s", 900, [9.1])], "scene_id string, t long, signature array<double>")
    assert [r["t"] for r in monitor.thinned_frames(frames).orderBy("t").collect()] == [0, 400, 900]


def test_long_runs_stream_by(spark):
    """One run of 300,000 states and one scene of as many frames, in pieces of some thousand rows."""
    n = 300_000
    states = spark.range(n).select(F.lit("long").alias("run_id"), F.col("id").alias("seq"), F.concat(F.lit("s"), F.when(F.col("id") < n - 2, F.col("id")).otherwise(7).cast("string")).alias("state"))
    short = spark.createDataFrame([("b", 2, "y"), ("b", 1, "x"), ("b", 3, "x"), ("b", 4, None), ("b", 5, "z"), ("b", 6, None)], "run_id string, seq long, state string")
    got = {r["run_id"]: r["crumbs"] for r in stream.breadcrumb(states.unionByName(short)).collect()}
    assert got == {"long": ">".join(f"s{k}:{3 if k == 7 else 1}" for k in range(8)), "b": "x:2>null:2"}
    frames = spark.range(n).select(F.lit("one").alias("scene_id"), (F.col("id") * 100).alias("t"), F.array((F.col("id") / 1000).cast("double")).alias("signature"))
    assert monitor.thinned_frames(frames).count() == n // 1500 + 1


def test_bursts_end_after_quiet_or_at_their_bound(spark):
    rows = [("r", 0, 1), ("r", 100, 2), ("r", 219, 3), ("r", 339, 4)] + [("long", 100 * k, k) for k in range(20)] + [("one", 5, 9), ("tie", 7, 2), ("tie", 7, 1)]
    df = spark.createDataFrame([(r, ms, n, f"p{n}") for r, ms, n in rows], "run_id string, ms long, seq long, payload string")
    got = sorted(tuple(r) for r in stream.bursts(df).collect())
    assert got == [("long", 0, 500, 6, "p5"), ("long", 600, 1100, 6, "p11"), ("long", 1200, 1700, 6, "p17"), ("long", 1800, 1900, 2, "p19"), ("one", 5, 5, 1, "p9"), ("r", 0, 219, 3, "p3"), ("r", 339, 339, 1, "p4"), ("tie", 7, 7, 2, "p2")]


def test_least_similarity_is_that_of_all_pairs(spark):
    rng = random.Random(7)
    rows = [(f"v{v}", k, [f"t{min(rng.randrange(9), rng.randrange(9))}" for _ in range(rng.randrange(3, 30))]) for v in range(6) for k in range(40)]
    rows += [("one", 1, ["a"]), ("one", 2, ["a"]), ("apart", 1, ["a"]), ("apart", 2, ["b"]), ("apart", 3, ["b", "a"]), ("none", 1, [])]
    s = spark.createDataFrame(rows, "view string, sample long, shape array<string>")
    want = {r["view"]: r["s"] for r in monitor.sample_pairs(s).groupBy("view").agg(F.min("similarity").alias("s")).collect()}
    got = {r["view"]: r["similarity"] for r in monitor.least_similarity(s).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_least_similarity_of_many_shapes(spark):
    """Twenty thousand shapes of one view, all near each other but two: compared are some of two hundred million pairs."""
    n = 20_000
    tokens = lambda k: F.concat(F.array_repeat(F.lit("div"), 60), F.array_repeat(F.lit("li"), 40), F.transform(F.sequence(F.lit(0), F.lit(13)), lambda b: F.when(F.getbit(k, b) == 1, F.concat(F.lit("x"), b.cast("string"))).otherwise("div")))
    odd = spark.createDataFrame([("v", n, ["div"] * 50 + ["a"] * 40), ("v", n + 1, ["li"] * 50 + ["b"] * 40)], "view string, sample long, shape array<string>")
    near = spark.range(n).select(F.lit("v").alias("view"), F.col("id").alias("sample"), tokens(F.col("id")).alias("shape"))
    assert monitor.least_similarity(near.unionByName(odd)).collect()[0]["similarity"] == 0.0


def test_simhash_is_the_plain_one(spark):
    import zlib

    def plain(tokens):
        n = [sum(1 if zlib.crc32(t.encode()) >> k & 1 else -1 for t in tokens or []) for k in range(32)]
        return f"{sum(1 << k for k in range(32) if n[k] > 0):08x}"

    rows = [["0:html", "1:body", "1:body", "é"], [], None, ["a"], [str(k) for k in range(99)]]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, t array<string>").select("k", monitor.simhash(F.col("t")).alias("h")).orderBy("k").collect()
    assert [r["h"] for r in got] == [plain(r) for r in rows]


def test_dhash(spark):
    import numpy as np

    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    grey = np.tile(np.linspace(0, 200, 90), (80, 1))
    rows = [((n, 80, 90, 1, 0, bytes(np.clip(x, 0, 255).astype(np.uint8).tobytes())),) for n, x in (("a", grey), ("b", grey + 3), ("c", 200 - grey))]
    h = {r["origin"]: r["dhash"] for r in monitor.dhash(spark.createDataFrame(rows, schema)).collect()}
    bits = lambda x, y: bin((h[x] ^ h[y]) & (2**64 - 1)).count("1")
    assert bits("a", "b") <= 4 and bits("a", "c") > 40
    assert monitor.signature(spark.createDataFrame(rows, schema)).count() == 3


def test_overlap_pairing(spark):
    rec = lambda rows: quality.fields_of(spark.createDataFrame([("r", k, json.dumps(x)) for k, x in enumerate(rows)], "route string, seq long, record string"))
    e, p = rec([{"a": "one", "b": "two"}, {"a": "one", "b": "two"}, {"a": "zz", "b": "yy"}]), rec([{"a": "one", "b": "two"}, {"a": "one", "b": "x"}])
    got = {r["seq"]: r["produced_seq"] for r in quality.pair_by_overlap(e, p).collect()}
    assert got == {0: 0, 1: 1, 2: None}


def _fields(spark, rows):
    return quality.fields_of(spark.createDataFrame([("r", k, json.dumps(x)) for k, x in rows], "route string, seq long, record string"))


def _greedy(expected, produced):
    used, out = set(), {}
    for k, e in expected:
        scored = [(-sum(p.get(f) == v for f, v in e.items()), n) for n, p in produced if n not in used]
        best = min(scored, default=(0, None))
        out[k] = best[1] if -best[0] >= max(1, len(e) / 2) else None
        used.add(out[k])
    return out


def test_overlap_pairing_is_greedy(spark):
    rng = random.Random(4)
    make = lambda n: [(k, {f: f"{f}{rng.randrange(6)}x" for f in rng.sample("abcde", rng.randrange(2, 5))}) for k in range(n)]
    e, p = make(120), make(90)
    e += [(200 + k, {"a": "copy", "b": "copy"}) for k in range(30)]
    p += [(300 + k, {"a": "copy", "b": "copy"}) for k in range(20)]
    got = {r["seq"]: r["produced_seq"] for r in quality.pair_by_overlap(_fields(spark, e), _fields(spark, p)).collect()}
    assert got == _greedy(e, p)


def test_overlap_pairing_of_a_chain_and_of_copies(spark):
    """Each record of the chain could take the one before it; a hundred thousand equal records share their values."""
    n = 10_000
    chain = spark.range(n).select(F.lit("r").alias("route"), F.col("id").alias("seq"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit("x")), F.concat(F.lit("w"), (F.col("id") + 1).cast("string"), F.lit("x")))).alias("fields"))
    links = spark.range(1, n + 1).select(F.lit("r").alias("route"), F.col("id").alias("seq"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit("x")), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x")))).alias("fields"))
    got = quality.pair_by_overlap(chain, links).where("produced_seq IS NOT NULL")
    assert got.agg(F.count("*"), F.min(F.col("produced_seq") - F.col("seq")), F.max(F.col("produced_seq") - F.col("seq"))).first()[:] == (n, 1, 1)
    same = spark.range(100_000).select(F.lit("r").alias("route"), F.col("id").alias("seq"), F.create_map(F.lit("a"), F.lit("all")).alias("fields"))
    got = quality.pair_by_overlap(same, same.where("seq % 2 = 0"))
    assert got.agg(F.count("produced_seq"), F.max(F.abs(F.col("produced_seq") - 2 * F.col("seq")))).first()[:] == (50_000, 0)


def test_targets_are_found_without_a_nested_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉ ") for _ in range(rng.randrange(0, 9)))
    els = [(p, k, word(), rng.randrange(1, 9), rng.randrange(1, 9)) for p in range(3) for k in range(40)] + [(0, 99, None, 1, 1)]
    qs = [(p, f"q{k}", [word() for _ in range(rng.randrange(3))], [word().lower() for _ in range(2)]) for p in range(4) for k in range(9)]
    e, q = spark.createDataFrame(els, "page int, i int, hay string, w int, h int"), spark.createDataFrame(qs, "page int, query_id string, tokens array<string>, words array<string>")
    found = quality.targets(q, e, ["page"])
    want = {}
    for page, name, tokens, words in qs:
        needles = [t.lower() for t in tokens] or words
        own = [(w * h, i) for p, i, hay, w, h in els if p == page and hay is not None and any(x in hay.lower() for x in needles)]
        if own:
            want[page, name] = min(own)[1]
    assert {(r["page"], r["query_id"]): r["i"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_largest_overlap_is_brute_force(spark):
    rng = random.Random(9)
    span = lambda most: (a := rng.randrange(-500, 2000), a + rng.randrange(0, most))
    ss = [(k, *span(rng.choice([3, 60, 900]))) for k in range(150)] + [(500, 0, 315_360_000_000), (501, 10, 11), (502, 5, 5)]
    ts = [(f"f{k}", *span(rng.choice([3, 60, 900]))) for k in range(120)] + [("years", -315_360_000_000, 300), ("instant", 40, 40), ("far", 10**11, 10**11 + 60_000)]
    got = monitor.largest_overlap(spark.createDataFrame(ss, "session_id long, start long, end long"), spark.createDataFrame(ts, "file string, start long, end long"))
    want = {}
    for k, a, b in ss:
        own = [(min(b, y) - max(a, x), f) for f, x, y in ts if min(b, y) > max(a, x)]
        if own:
            want[k] = max(own)
    assert {r["session_id"]: (r["overlap_ms"], r["file"]) for r in got.collect()} == want


def test_nested_redaction(spark):
    secret = {"author": {"id": "7300000000000000001", "names": ["Ann", ["Bob"]]}, "list": [{"desc": "hi"}, "by @ann", 12, 1.5, True, None], "playCount": "38K", "deep": [[[[{"nick": "x"}]]]]}
    rows = [json.dumps(secret), '"@ann says"', "[]", "{torn", None, "5"]
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(harvest.redacted_json(F.col("t")).alias("r")).collect()]
    out = json.loads(got[0])
    assert out["author"]["names"][0].startswith("creator_") and out["author"]["names"][1][0].startswith("creator_") and out["author"]["id"].endswith("…001")
    assert out["list"][0] == {"desc": "‹caption›"} and out["list"][1].startswith("by @creator_") and out["list"][2:] == [12, 1.5, True, None] and out["playCount"] == "38K"
    assert out["deep"][0][0][0][0]["nick"].startswith("creator_") and got[1].startswith('"@creator_') and got[2:] == ["[]", None, None, "5"]


def test_listing_prices(spark):
    tiers = '{"pricingModel":"PAY_PER_EVENT","pricingPerEvent":{"actorChargeEvents":{"r":{"isPrimaryEvent":true,"eventTieredPricingUsd":{"FREE":{"tieredEventPriceUsd":0.004},"GOLD":{"tieredEventPriceUsd":0.002}}},"s":{"isOneTimeEvent":true,"eventPriceUsd":0.1}}}}'
    p = spark.createDataFrame([(tiers,), ('{"pricingModel":"PRICE_PER_DATASET_ITEM","pricePerUnitUsd":5,"unitName":"1000 results"}',), ('{"pricingModel":"FLAT_PRICE_PER_MONTH","pricePerUnitUsd":30}',), (None,)], "x string")
    out = [tuple(r["p"]) for r in p.select(harvest.listing_price(F.col("x")).alias("p")).collect()]
    assert out == [("PAY_PER_EVENT", 0.004, 0.002, 0.1, None), ("PRICE_PER_DATASET_ITEM", 0.005, 0.005, 0.0, None), ("FLAT_PRICE_PER_MONTH", None, None, 0.0, 30.0), ("PAY_PER_USAGE", None, None, 0.0, None)]


def _lines(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_live_fold_survives_a_restart(spark, tmp_path):
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    m = lambda seq, **body: {"version": "0.9", "run_id": "r", "seq": seq, **body}
    _lines(source, "a.jsonl", [m(1, createSurface={"surfaceId": "v-1"}), m(2, updateDataModel={"surfaceId": "v-1", "path": "/x", "value": [1]})])

    def run():
        q = live.closed_surfaces(readers.messages(spark, str(source), live=True), 3_600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(processingTime="1 second").start()
        # timers keep the query busy, so wait for its rows and one batch more
        try:
            for _ in range(120):
                seen = [p["numInputRows"] for p in q.recentProgress]
                if sum(seen) >= 2 and seen[-1] == 0:
                    break
                time.sleep(0.5)
        finally:
            q.stop()

    run()
    _lines(source, "b.jsonl", [m(3, updateDataModel={"surfaceId": "v-1", "path": "/x/1", "value": 2}), m(4, deleteSurface={"surfaceId": "v-1"})])
    run()
    got = [(r["surface_id"], json.loads(r["model"])) for r in spark.read.parquet(out).collect()]
    assert got == [("v-1", {"x": [1, 2]})]


def test_live_ledger_and_dedupe(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "seq long, id string, type string, status string, startedAt string, finishedAt string, error string"
    row = lambda seq, i, s: {"seq": seq, "id": i, "type": "t", "status": s}

    def run(sink, at):
        q = spark.readStream.schema(schema).json(str(source)).writeStream.foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    _lines(source, "a.jsonl", [row(1, "u1", "running"), row(2, "u2", "running")])
    store, data = str(tmp_path / "ledger"), str(tmp_path / "data")
    run(live.live_ledger(store), str(tmp_path / "c1"))
    run(live.append_batches(data, ["id"], ["seq"]), str(tmp_path / "c2"))
    _lines(source, "b.jsonl", [row(3, "u1", "done")])
    run(live.live_ledger(store), str(tmp_path / "c1"))
    run(live.append_batches(data, ["id"], ["seq"]), str(tmp_path / "c2"))
    table = live.ledger(spark, store, spark.createDataFrame([], schema).schema)
    assert {r["id"]: r["status"] for r in table.rows().collect()} == {"u1": "done", "u2": "running"}
    assert [tuple(r) for r in live.ledger_totals(spark, store, table.version()).collect()] == [("t", 1, 1, 0, 0)]
    assert sorted(r["seq"] for r in spark.read.parquet(data).collect()) == [1, 2]


def _keyed(spark, path, **more):
    return KeyedTable(spark, str(path), spark.createDataFrame([], "id string, seq long, v string").schema, ["id"], ["seq"], **more)


def test_batches_write_in_proportion(spark, tmp_path):
    table = _keyed(spark, tmp_path / "t", most=3)
    table.put(spark.range(20_000).selectExpr("cast(id AS string) AS id", "id AS seq", "repeat(cast(id AS string), 20) AS v"), 0)
    whole, grown = keyed.size(spark, table.path), []
    for k in range(1, 5):
        before = keyed.size(spark, f"{table.path}/rows")
        rows = spark.createDataFrame([(str(k * 10 + j), 100_000 + k, f"new{k}") for j in range(10)], "id string, seq long, v string")
        table.put(rows, k)
        table.put(rows, k)  # run again under its number
        grown.append(keyed.size(spark, f"{table.path}/rows") - before)
        assert keyed.names(spark, f"{table.path}/contents") == [f"v={k - 1}", f"v={k}"]
    assert max(grown) < whole / 8
    assert max(sum(1 for b, _ in table.parts(4) if b == c) for c in range(64)) <= 3
    got = {r["id"]: r["v"] for r in table.rows().where("v LIKE 'new%'").collect()}
    assert got == {str(k * 10 + j): f"new{k}" for k in range(1, 5) for j in range(10)} and table.rows().count() == 20_000


def test_crowded_buckets_and_old_rows(spark, tmp_path):
    table = _keyed(spark, tmp_path / "t", buckets=2, most=2)
    for k in range(6):
        table.put(spark.createDataFrame([("a", k, f"a{k}"), (f"b{k}", 1, "b"), ("late", 10 - k, f"l{k}"), (None, k, f"n{k}")], "id string, seq long, v string"))
    assert len(table.parts(table.version())) <= 4
    got = {r["id"]: r["v"] for r in table.rows().collect()}
    assert got == {"a": "a5", "late": "l0", None: "n5"} | {f"b{k}": "b" for k in range(6)}
    ask = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    assert [(r["id"], r["v"]) for r in table.lookup(ask).collect()] == [("a", "a5")]
    assert [r["v"] for r in table.lookup(ask, table.version()).collect()] == ["a4"]  # before the last batch
    assert table.lookup(spark.createDataFrame([], "id string")).count() == 0
    table.put(spark.createDataFrame([], "id string, seq long, v string"))
    assert table.rows().count() == len(got)


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([(k, f"k{k % 3}") for k in range(6)], "seq long, k string")
    records.append_once(spark, df, path, ["k"], ["seq"])
    df.where("seq = 5").write.parquet(f"{path}/batch=1")  # a batch that ended before its keys were stored
    assert sorted(r["seq"] for r in records.stored_records(spark, path, df.schema).collect()) == [0, 1, 2]
    more = spark.createDataFrame([(7, "k1"), (8, "new"), (9, None), (10, None)], "seq long, k string")
    records.append_once(spark, more, path, ["k"], ["seq"])
    assert sorted(r["seq"] for r in records.stored_records(spark, path, df.schema).collect()) == [0, 1, 2, 8, 9]


def test_records_at_close_read_other_views(spark):
    m = lambda seq, **body: ("r", seq, json.dumps({"version": "0.9", **body}))
    rows = [
        m(1, createSurface={"surfaceId": "control-0"}), m(2, updateDataModel={"surfaceId": "control-0", "path": "/n", "value": 2}), m(3, createSurface={"surfaceId": "x:list-1"}),
        m(4, updateDataModel={"surfaceId": "x:list-1", "path": "/items", "value": ["a", "b", "a"]}), m(5, action={"name": "go"}), ("r", 6, "{torn"), m(7, createSurface={"surfaceId": "odd-3"}),
        m(8, createSurface={"surfaceId": "page-2"}), m(9, updateDataModel={"surfaceId": "page-2", "value": {"id": 5}}), m(10, deleteSurface={"surfaceId": "page-2"}), m(11, deleteSurface={"surfaceId": "never-9"}), ("r", 12, None),
    ]
    messages = spark.createDataFrame(rows, "run_id string, seq long, raw string")
    got = []
    replay.replay(messages, "seq", lambda s: live.closed_surfaces(s, 0, ["list", "page"]).writeStream.foreachBatch(lambda b, i: got.extend(b.collect())), slices=4)
    assert [(r["surface_id"], r["view"], json.loads(r["model"]), {k: json.loads(v) for k, v in r["context"].items()}, r["closed_seq"]) for r in got] == [
        ("page-2", "page", {"id": 5}, {"control": {"n": 2}, "list": {"items": ["a", "b", "a"]}, "page": {"id": 5}}, 10),
        ("x:list-1", "list", {"items": ["a", "b", "a"]}, {"control": {"n": 2}, "list": {"items": ["a", "b", "a"]}, "page": {"id": 5}}, 12),
    ]
    routes = [
        stream.Route("pages", "page", {"id": F.get_json_object("model", "$.id")}, key="id"),
        stream.Route("names", "list", {"name": F.col("item"), "page": F.get_json_object(F.try_element_at("context", F.lit("page")), "$.id")}, F.from_json(F.get_json_object("model", "$.items"), "array<string>"), "name"),
    ]
    out = stream.emitted(spark.createDataFrame(got), routes).orderBy("seq", "route_no", "item_no").collect()
    assert [(r["dataset"], r["key"], json.loads(r["record"]), r["item_no"]) for r in out] == [("pages", "5", {"id": "5"}, 0), ("names", "a", {"name": "a", "page": "5"}, 0), ("names", "b", {"name": "b", "page": "5"}, 1), ("names", "a", {"name": "a", "page": "5"}, 2)]


def test_routes_read_surfaces_once(spark):
    """a fold feeds all routes; items of any type, none, and texts that only another view's route may read."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    kind = "run_id long, view string, model string, context map<string,string>, closed_seq long, close_no int"
    given = [(1, "a", "7", {}, 5, 0), (1, "b", "x,y", {}, 6, 0), (1, "b", None, {}, 7, 0), (2, "c", "z", {}, 8, 0), (2, "a", "9", {}, 9, 1)]
    closed = spark.createDataFrame(given, kind).mapInPandas(seen, kind)
    n = F.col("model").cast("long")
    routes = [
        stream.Route("one", "a", {"n": n}, key="n"),
        stream.Route("letters", "b", {"item": F.col("item")}, each=F.split("model", ","), key="item"),
        stream.Route("counts", "a", {"item": F.col("item"), "run": F.col("run_id")}, each=F.array(n, n + 1)),
        stream.Route("none", "a", {"n": n}, each=F.array().cast("array<long>"), key="n"),
    ]
    out = [tuple(r) for r in stream.emitted(closed, routes).collect()]
    want = [("one", "7", '{"n":7}', 1, 5, 0, 0, 0), ("one", "9", '{"n":9}', 2, 9, 1, 0, 0), ("letters", "x", '{"item":"x"}', 1, 6, 0, 1, 0), ("letters", "y", '{"item":"y"}', 1, 6, 0, 1, 1)]
    for run, k, seq, no in ((1, 7, 5, 0), (2, 9, 9, 1)):
        for i in range(2):
            text = '{"item":%d,"run":%d}' % (k + i, run)
            want.append(("counts", text, text, run, seq, no, 2, i))
    assert sorted(out) == sorted(want)
    assert read.value == len(given)


def test_last_models_are_texts_once_a_close(spark, monkeypatch):
    """between closes a surface's messages make no texts; what is told is as if each did."""
    made = []
    monkeypatch.setattr(live.jsonops, "canonical_text", lambda v: made.append(1) or json.dumps(v, sort_keys=True, separators=(",", ":")))

    class Value:
        held = None
        exists, get, update = (lambda self: self.held is not None), (lambda self: self.held), (lambda self, x: setattr(self, "held", x))

    class Handle:
        getValueState = lambda self, *_: Value()

    def sent(kind, sid, **rest):
        return json.dumps({"version": "0.9", kind: {"surfaceId": sid, **rest}})

    raw = [sent("createSurface", "list-1"), sent("createSurface", "list-2"), sent("createSurface", "page-3")]
    raw += [sent("updateDataModel", f"list-{1 + k % 2}", path="/n", value=k) for k in range(101)]  # list-1 has the last word
    raw += [sent("deleteSurface", "list-2"), sent("deleteSurface", "page-3"), None]
    fold = live.SurfaceFold(["list", "page"], 0)
    fold.init(Handle())
    out = pd.concat(fold.handleInputRows(("r",), iter([pd.DataFrame({"raw": raw, "seq": range(len(raw))})]), None))
    assert list(zip(out["surface_id"], out["model"])) == [("list-2", '{"n":99}'), ("page-3", "{}"), ("list-1", '{"n":100}')]
    assert all(c == {"list": '{"n":100}', "page": "{}"} for c in out["context"])
    assert len(made) < 10
