"""Registered queries over replayed streams: each starts anew in the middle and has one batch fail after its write."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import records, stream
from harrow.plans.registry import SNAP_SQL, SURF_SQL, events, query, snapshots
from harrow.sources import readers
from harrow.streaming import live
from harrow.streaming.replay import replay, stopping


def emitted_through_stream(spark, messages, routes, views, path) -> None:
    """Messages through the live fold into the records of ``routes``, stored once each."""
    sink = stopping(live.append_batches(path, ["dataset", "key"], ["seq", "close_no", "route_no", "item_no"], 8), 1)
    replay(messages, "seq", lambda s: stream.emitted(live.closed_surfaces(s, 0, views), routes).writeStream.foreachBatch(sink), slices=2)


RECORD = "dataset string, key string, record string, run_id long, seq long, close_no int, route_no int, item_no int"


@query(f"""WITH {SURF_SQL}, c AS (SELECT *, last_value(CASE WHEN view = 'purchase' THEN model END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bought FROM f),
l AS (SELECT run_id, surface_id, arg_max(view, seq) AS view, (json_extract(arg_max(model, seq), '$.k'))::BIGINT AS k, (json_extract(arg_max(bought, seq), '$.k'))::BIGINT AS b, min(seq) AS first_seq FROM c GROUP BY ALL),
e AS (SELECT *, lead(first_seq) OVER (PARTITION BY run_id ORDER BY first_seq) AS close_seq FROM l),
a AS (SELECT 'closed' AS dataset, run_id || ':' || surface_id AS key, run_id, k, b, NULL::BIGINT AS item, close_seq, 0 AS route_no, 0 AS item_no FROM e WHERE view = 'click'
  UNION ALL SELECT 'tops', (run_id % 7) || ':' || (k + i), run_id, k, b, k + i, close_seq, 1, i::INTEGER FROM e, range(2) t(i) WHERE view = 'view')
SELECT dataset, key, run_id, k, b AS bought, item FROM a QUALIFY row_number() OVER (PARTITION BY dataset, key ORDER BY close_seq NULLS LAST, run_id, route_no, item_no) = 1""")
def live_records(spark, d):
    """Messages through a stream into records of two routes, with the last purchase of the run, each key once."""
    snaps = snapshots(spark, d)
    messages = records.cut(stream.message_texts(stream.surface_messages(snaps)), "messages")
    end = messages.agg(F.max("seq")).first()[0]
    # runs end one after the other
    ends = snaps.select("run_id").distinct().select("run_id", (F.lit(end) + 1 + F.col("run_id")).cast("long").alias("seq"), F.lit(None).cast("string").alias("raw"))
    k, bought = F.get_json_object("model", "$.k").cast("long"), F.get_json_object(F.try_element_at("context", F.lit("purchase")), "$.k").cast("long")
    routes = [
        stream.Route("closed", "click", {"name": F.concat_ws(":", "run_id", "surface_id"), "k": k, "bought": bought}, key="name"),
        stream.Route("tops", "view", {"name": F.concat((F.col("run_id") % 7).cast("string"), F.lit(":"), F.col("item").cast("string")), "k": k, "bought": bought, "item": F.col("item")}, each=F.array(k, k + 1), key="name"),
    ]
    path = records.shared_path(spark, "records")
    emitted_through_stream(spark, messages.unionByName(ends), routes, ["view", "click", "purchase", "error", "signup"], path)
    got = records.stored_records(spark, path, spark.createDataFrame([], RECORD).schema)
    r = lambda f: F.get_json_object("record", f"$.{f}").cast("long")
    return got.select("dataset", "key", "run_id", r("k").alias("k"), r("bought").alias("bought"), r("item").alias("item"))


UNIT_SQL = """u AS (SELECT event_id AS seq, user_id || '-' || ((json_extract(props, '$.k'))::BIGINT % 5) AS id, 't' || (user_id % 3) AS type,
  CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'skipped' ELSE 'failed' END AS status FROM events)"""


def units(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", "skipped").otherwise("failed")
    return events(spark, d).select("seq", F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 5).cast("string")).alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("type"), status.alias("status"))


@query(f"""WITH {UNIT_SQL}, l AS (SELECT id, arg_max(type, seq) AS type, arg_max(status, seq) AS status, max(seq) AS seq FROM u GROUP BY id)
SELECT 'unit' AS kind, id, type, status, seq AS n FROM l UNION ALL SELECT 'total', '', type, status, count(*) FROM l GROUP BY ALL""")
def live_units(spark, d):
    """The latest state of each unit and the totals, kept up by a stream in hash buckets."""
    path, rows = records.shared_path(spark, "ledger"), units(spark, d)
    sink = stopping(live.live_ledger(path, 8), 1)
    replay(rows, "seq", lambda s: s.writeStream.foreachBatch(sink))
    table = live.ledger(spark, path, rows.schema, 8)
    totals = live.ledger_totals(spark, path, table.version()).select("type", F.explode(F.create_map(*[x for s in records.STATUSES for x in (F.lit(s), F.col(s))])).alias("status", "n"))
    each = table.rows().select(F.lit("unit").alias("kind"), "id", "type", "status", F.col("seq").alias("n"))
    return each.unionByName(totals.where("n > 0").select(F.lit("total").alias("kind"), F.lit("").alias("id"), "type", "status", "n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def live_first_wins(spark, d):
    """The first event of each kind and user through a stream, over a restart and a batch that is run again."""
    path, rows = records.shared_path(spark, "first"), events(spark, d).select("user_id", "event_type", "event_id")
    sink = stopping(live.append_batches(path, ["user_id", "event_type"], ["event_id"], 8), 1)
    replay(rows, "event_id", lambda s: s.writeStream.foreachBatch(sink))
    return records.stored_records(spark, path, rows.schema)


@query("SELECT user_id, (json_extract(props, '$.k'))::BIGINT % 10 AS k, min(event_id) AS event_id FROM events GROUP BY ALL")
def replayed_twice(spark, d):
    """Two queries, one after the other and each from the start, over one folder: each key once."""
    path = records.shared_path(spark, "twice")
    rows = events(spark, d).select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"), "event_id")
    for slices in (1, 2):
        replay(rows, "event_id", lambda s: s.writeStream.foreachBatch(live.append_batches(path, ["user_id", "k"], ["event_id"], 8)), slices)
    return records.stored_records(spark, path, rows.schema)


@query(f"""WITH {SNAP_SQL}, a AS (SELECT *, max(ts) OVER (PARTITION BY run_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT run_id, seq FROM a WHERE m IS NULL OR ts >= m""")
def live_on_time(spark, d):
    """Snapshots without those older than the newest of their address, through a stream."""
    path, rows = records.shared_path(spark, "fresh"), snapshots(spark, d).select("run_id", "url", "seq", "ts")
    replay(rows, "seq", lambda s: live.without_stale(s).writeStream.format("parquet").option("path", path))
    return spark.read.schema(rows.schema).parquet(path).select("run_id", "seq")


@query("""SELECT DISTINCT event_type AS view, 0.0::DOUBLE AS similarity FROM events WHERE (json_extract(props, '$.k'))::BIGINT % 4 = 0 AND event_type <> 'signup'""")
def live_alerts(spark, d):
    """Drifted pages of a stream against static references, once per view over restarts."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    tokens = F.array(*map(F.lit, ("0:html", "1:body", "2:p")))
    rows = events(spark, d).select("seq", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("view"), F.concat(F.lit("/"), "seq").alias("url"), F.slice(tokens, 1, k).alias("shape"))
    references = rows.select("view").distinct().where("view <> 'signup'").select("view", tokens.alias("shape"), F.lit(0.4).alias("min_similarity"))
    path = records.shared_path(spark, "alerts")
    references = records.cut(references, "references")
    replay(rows, "seq", lambda s: live.drift_alerts(s, references, "10000 days").writeStream.format("parquet").option("path", path), slices=2)
    return spark.read.schema("view string, url string, ts timestamp, similarity double").parquet(path).select("view", "similarity")


@query(f"""WITH {UNIT_SQL} SELECT id, arg_max(type, seq) AS type, arg_max(CASE status WHEN 'running' THEN 'failed' ELSE status END, seq) AS status, max(seq) AS seq FROM u WHERE seq % 7 <> 0 AND seq % 11 <> 0 GROUP BY id""")
def logged_units(spark, d):
    """Units from a log of JSON lines that Spark wrote, with torn and blank lines in it."""
    line = F.to_json(F.struct("seq", "id", "type", "status"))
    path = records.shared_path(spark, "log")
    units(spark, d).select(F.when(F.col("seq") % 7 == 0, F.substring(line, 1, 9)).when(F.col("seq") % 11 == 0, "  ").otherwise(line).alias("value")).write.text(path)
    log = readers.log_lines(spark, path, "seq long, id string, type string, status string")
    return records.latest_units(log.withColumn("error", F.lit(None).cast("string"))).select("id", "type", "status", "seq")


@query(f"""WITH {SURF_SQL}, l AS (SELECT *, lag(model) OVER (PARTITION BY run_id, surface_id ORDER BY seq) AS before, lead(opens) OVER (PARTITION BY run_id ORDER BY seq) AS nx FROM f),
m AS (SELECT run_id, 'createSurface' AS kind FROM l WHERE opens = 1 UNION ALL SELECT run_id, 'updateDataModel' FROM l WHERE opens = 1 UNION ALL SELECT run_id, 'updateDataModel' FROM l WHERE opens = 0 AND before <> model UNION ALL SELECT run_id, 'deleteSurface' FROM l WHERE nx = 1)
SELECT run_id::VARCHAR AS run_id, kind, count(*) AS n FROM m GROUP BY ALL""")
def message_lines(spark, d):
    """The message stream as JSON lines, written and read again."""
    texts = stream.message_texts(stream.surface_messages(snapshots(spark, d)))
    path = records.shared_path(spark, "lines")
    texts.select(F.concat(F.lit('{"run_id":"'), F.col("run_id").cast("string"), F.lit('","seq":'), F.col("seq").cast("string"), F.lit(","), F.expr("substring(raw, 2)")).alias("value")).unionByName(texts.limit(3).select(F.lit('{"torn').alias("value"))).write.text(path)
    read = readers.messages(spark, path)
    return read.groupBy("run_id", stream.classified(F.col("raw"))["kind"].alias("kind")).agg(F.count("*").alias("n"))
