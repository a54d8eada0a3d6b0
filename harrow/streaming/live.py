"""Live message topics with Structured Streaming."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harrow.functions import jsonops
from harrow.operators import keyed, records, stream
from harrow.operators.keyed import KeyedTable


CLOSED = "surface_id string, view string, model string, context map<string,string>, closed_seq long, close_no int"


class SurfaceFold(StatefulProcessor):
    """State of one run: its open surfaces, and the last model of each view, which is what records of other views may read.

    A deleted surface gives its final model with that context. A run's end (a row without a message) closes what is open in the order
    of creation; so does a timer for a run that has been idle.
    """

    def __init__(self, views: list[str] | None, idle_ms: int):
        self.views, self.idle_ms = views, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value of a run: a call for each entry of a map costs more than the texts of what is open
        self.state = handle.getValueState("state", "open map<string,struct<model:string,seq:long>>, last map<string,string>")

    def stored(self) -> tuple[dict, dict[str, str]]:
        """Open surfaces (model, seq of creation) and the last model of each view."""
        if not self.state.exists():
            return {}, {}
        held, last = self.state.get()
        return {sid: (json.loads(v[0]), v[1]) for sid, v in held.items()}, dict(last)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (open_, last), out = self.stored(), []
        newest: dict[str, str] = {}  # the open surface of each view whose model is the view's last one, and not in ``last`` yet
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for raw, seq in zip(pdf["raw"], pdf["seq"].tolist()):
            if raw is None:
                self.tell(open_, newest, last)
                out += self.closed(key, open_, last, seq)
                open_ = {}
                continue
            m = jsonops.loads(raw)
            if not isinstance(m, dict) or "version" not in m or "action" in m:
                continue
            sid = next((m[k].get("surfaceId") for k in ("createSurface", "updateDataModel", "deleteSurface") if k in m), None)
            if sid is None:
                continue
            if "deleteSurface" in m:
                if sid in open_:
                    self.tell(open_, newest, last)
                    out += self.closed(key, {sid: open_.pop(sid)}, last, seq)
                continue
            if "createSurface" in m:
                open_[sid] = ({}, seq)
            else:
                u = m["updateDataModel"]
                model, opened = open_.get(sid, ({}, seq))
                open_[sid] = (jsonops.set_at(model, u.get("path", "/"), u.get("value", jsonops.ABSENT)), opened)
            view = view_name(sid)
            if view == "control" or self.known(view):
                newest[view] = sid
        self.tell(open_, newest, last)
        self.state.update(({sid: (jsonops.canonical_text(model), opened) for sid, (model, opened) in open_.items()}, last))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_, last = self.stored()
        out = self.closed(key, open_, last, max([n for _, n in open_.values()], default=0))
        self.state.update(({}, last))
        yield self.frame(out)

    def tell(self, open_: dict, newest: dict[str, str], last: dict[str, str]) -> None:
        """Make the texts of the last models that changed: when a surface closes, not with each message."""
        for view, sid in newest.items():
            last[view] = jsonops.canonical_text(open_[sid][0])
        newest.clear()

    def known(self, view: str) -> bool:
        return self.views is None or view in self.views

    def closed(self, key, open_: dict, last: dict[str, str], seq: int) -> list[tuple]:
        ending = [sid for sid in sorted(open_, key=lambda s: open_[s][1]) if self.known(view_name(sid))]
        return [(key[0], sid, view_name(sid), jsonops.canonical_text(open_[sid][0]), dict(last), seq, k) for k, sid in enumerate(ending)]

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run_id", "surface_id", "view", "model", "context", "closed_seq", "close_no"])

    def close(self) -> None:
        pass


def view_name(surface_id: str) -> str:
    """``<space>:<view>-<n>`` to the view."""
    return re.sub(r"^.*[:/]", "", re.sub(r"-\d+$", "", surface_id))


def closed_surfaces(messages: DataFrame, idle_ms: int = 60_000, views: list[str] | None = None) -> DataFrame:
    """(run_id, surface_id, view, model, context, closed_seq, close_no) as surfaces close, from a stream of (run_id, seq, raw).

    ``context`` holds the last model of every view (of ``views``, and of ``control``) at that moment. A raw of null ends its run.
    With ``idle_ms`` 0 nothing else does, and no timers are set.
    """
    run = messages.schema["run_id"].dataType.simpleString()
    timers = "ProcessingTime" if idle_ms else "None"
    return messages.groupBy("run_id").transformWithStateInPandas(SurfaceFold(views, idle_ms), f"run_id {run}, {CLOSED}", "Append", timers)


def deduplicated(stream: DataFrame, key: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First record of each key; with an event time the state is bounded by the watermark."""
    if event_time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(event_time, delay or "1 hour").dropDuplicatesWithinWatermark(key)


class _Newest(StatefulProcessor):
    """State of one bucket: the newest time of each of its keys. A call for each key would cost more than the numbers of many."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "newest map<string,long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("seq")
        latest = dict(self.latest.get()[0]) if self.latest.exists() else {}
        kept = []
        for k, ts in zip(pdf["state_key"], pdf["ts"].tolist()):
            newest = latest.get(k)
            kept.append(newest is None or ts >= newest)
            latest[k] = ts if newest is None else max(newest, ts)
        self.latest.update((latest,))
        yield pdf[kept][self.columns]

    def close(self) -> None:
        pass


#: Fixed value: buckets of keys that share a state.
STATE_BUCKETS = 512


def without_stale(snapshots: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Drop snapshots older than the newest one seen at the same run and url; state is one number per url, held by hash buckets of keys."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshots.schema)
    keyed_rows = snapshots.withColumn("state_key", F.to_json(F.struct("run_id", "url"), {"ignoreNullFields": "false"})).withColumn("bucket", F.pmod(F.xxhash64("run_id", "url"), F.lit(buckets)))
    return keyed_rows.groupBy("bucket").transformWithStateInPandas(_Newest(snapshots.columns), schema, "Append", "None")


class _Bursts(StatefulProcessor):
    """State of one run: its open burst. A burst ends after a quiet time, and a long one is told at its bound."""

    def __init__(self, quiet_ms: int, most_ms: int, kind: str):
        self.quiet_ms, self.most_ms, self.kind = quiet_ms, most_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"begun long, last long, changes long, payload {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["ms", "seq"])
        now = tuple(self.open.get()) if self.open.exists() else None
        told = []
        for ms, payload in zip(pdf["ms"].tolist(), pdf["payload"]):
            now, ended = stream.burst_step(now, ms, payload, self.quiet_ms, self.most_ms)
            told += ended
        self.open.update(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(min(now[1] + self.quiet_ms, now[0] + self.most_ms))
        yield self.rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = [tuple(self.open.get())] if self.open.exists() else []
        self.open.clear()
        yield self.rows(key, told)

    def rows(self, key, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in told], columns=["run_id", "begun", "last", "changes", "payload"])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet_ms: int = 120, most_ms: int = 600, late: str = "1 minute") -> DataFrame:
    """(run_id, begun, last, changes, payload): the last row of each burst of changes (run_id, ts, seq, payload), a burst ending after a
    quiet time, and at the latest ``most_ms`` after it began."""
    kind, run = changes.schema["payload"].dataType.simpleString(), changes.schema["run_id"].dataType.simpleString()
    rows = changes.withWatermark("ts", late).select("run_id", "ts", F.unix_millis("ts").alias("ms"), "seq", "payload")
    schema = f"run_id {run}, begun long, last long, changes long, payload {kind}"
    return rows.groupBy("run_id").transformWithStateInPandas(_Bursts(quiet_ms, most_ms, kind), schema, "Append", "EventTime")


def throttled(frames: DataFrame, every: str = "120 milliseconds", late: str = "1 minute") -> DataFrame:
    """The first row of each tick."""
    return frames.withWatermark("ts", late).groupBy("scene_id", F.window("ts", every).alias("tick")).agg(F.min_by("payload", F.struct("ts", "payload")).alias("payload")).select("scene_id", F.col("tick.start").alias("start"), "payload")


def append_batches(path: str, key: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that stores each key once, also when batches are run again or another query starts over on the same folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = records.last_batch(spark, path)
        # a query that starts over counts from 0 again: its batches come after those that are there, unless they are the last one run again
        records.append_once(spark, batch, path, key, order, batch_id if last is None or batch_id >= last else None, buckets)

    return write


def ledger(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, f"{path}/units", schema, ["id"], ["seq"], buckets=buckets)


def live_ledger(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest event of each unit and the totals. Of the units only the batch's are looked up and
    written; totals change by what these units were and are. A batch that is run again starts from the version before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        units = ledger(spark, path, batch.schema, buckets)
        before = units.version(batch_id)
        newest = units.chosen(batch).persist()
        old = units.lookup(newest, batch_id)
        was = old.select("id", F.col("seq").alias("__seq"), F.col("type").alias("__type"), F.col("status").alias("__status"))
        changed = newest.join(was, "id", "left").where("__seq IS NULL OR seq > __seq").persist()
        counted = changed.select("type", "status", F.lit(1).alias("n")).unionByName(changed.where("__seq IS NOT NULL").select(F.col("__type").alias("type"), F.col("__status").alias("status"), F.lit(-1).alias("n")))
        change = counted.groupBy("type").agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in records.STATUSES])
        stored = ledger_totals(spark, path, before)
        totals = stored.unionByName(change).groupBy("type").agg(*[F.sum(s).alias(s) for s in records.STATUSES])
        totals.write.mode("overwrite").parquet(f"{path}/totals/v{batch_id}")
        units.put(changed.select(*batch.columns), batch_id)
        changed.unpersist()
        newest.unpersist()
        for n in keyed.names(spark, f"{path}/totals"):
            if n not in (f"v{batch_id}", f"v{before}"):
                keyed.remove(spark, f"{path}/totals/{n}")

    return write


def ledger_totals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Units by type and status of a version of a live ledger; empty for no version."""
    schema = "type string, " + ", ".join(f"{s} long" for s in records.STATUSES)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/totals/v{version}")


def drift_alerts(pages: DataFrame, references: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drifted pages of a stream, once per view."""
    from harrow.operators.monitor import similarity

    r = references.select("view", F.col("shape").alias("reference"), "min_similarity")
    hit = pages.join(r, "view").withColumn("similarity", similarity(F.col("reference"), F.col("shape"))).where("similarity < min_similarity")
    return hit.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["view"]).select("view", "url", "ts", "similarity")
