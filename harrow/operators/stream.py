"""The message stream in batch: snapshots to surfaces and patches, messages to state, state to records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import casts, jsonops


def fresh_snapshots(snaps: DataFrame) -> DataFrame:
    """Drop snapshots older than an earlier one of the same run and url, then those equal to the one before."""
    seen = Window.partitionBy("run_id", "url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("run_id").orderBy("seq")
    on_time = snaps.withColumn("__latest", F.max("ts").over(seen)).where(F.col("__latest").isNull() | (F.col("ts") >= F.col("__latest")))
    now = F.xxhash64("url", "view", "model")
    return on_time.withColumn("__same", F.lag(now).over(order).eqNullSafe(now)).where(~F.col("__same")).drop("__latest", "__same")


def surfaces(snaps: DataFrame) -> DataFrame:
    """Number the surfaces of each run: a new one when view or path changes; ``surface_id`` is ``<view>-<n>``, null without a view."""
    order = Window.partitionBy("run_id").orderBy("seq")
    before = F.lag(F.struct("view", "path")).over(order)
    turn = before.isNull() | ~before["view"].eqNullSafe(F.col("view")) | (F.col("view").isNotNull() & ~before["path"].eqNullSafe(F.col("path")))
    opened = (turn & F.col("view").isNotNull()).cast("int")
    return (
        snaps.withColumn("opens", turn & F.col("view").isNotNull())
        .withColumn("turn", turn)
        .withColumn("surface_no", F.sum(opened).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("surface_id", F.when(F.col("view").isNotNull(), F.concat_ws("-", "view", F.col("surface_no").cast("string"))))
    )


def surface_messages(snaps: DataFrame, most_patches: int = 40) -> DataFrame:
    """Snapshots as ordered messages: create, root data, patches (or one root write beyond ``most_patches``) and delete."""
    own = surfaces(snaps)
    order = Window.partitionBy("run_id", "surface_id").orderBy("seq")
    own = own.where("surface_id IS NOT NULL").withColumn("before", F.lag("model").over(order))
    created = own.where("opens").select("run_id", "seq", F.lit(0).alias("part"), F.lit("createSurface").alias("kind"), "surface_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("has_value"))
    root = own.where("opens").select("run_id", "seq", F.lit(1).alias("part"), F.lit("updateDataModel").alias("kind"), "surface_id", F.lit("/").alias("path"), F.col("model").alias("value"), F.lit(True).alias("has_value"))
    patched = own.where("NOT opens").withColumn("patches", jsonops.diff(F.col("before"), F.col("model")))
    whole = F.array(F.struct(F.lit("/").alias("path"), F.col("model").alias("value"), F.lit(False).alias("removed")))
    changes = patched.select("run_id", "seq", "surface_id", F.posexplode(F.when(F.size("patches") > most_patches, whole).otherwise(F.col("patches"))).alias("part", "p")).select(
        "run_id", "seq", F.col("part") + 1, F.lit("updateDataModel").alias("kind"), "surface_id", F.col("p.path").alias("path"), F.col("p.value").alias("value"), (~F.col("p.removed")).alias("has_value")
    )
    # a surface is deleted where the run turns to another one; the last of a run stays open
    next_turn = Window.partitionBy("run_id").orderBy("seq")
    left = surfaces(snaps).withColumn("next", F.lead(F.struct("seq", "turn")).over(next_turn)).where("surface_id IS NOT NULL AND next.turn")
    deleted = left.select("run_id", F.col("next.seq").alias("seq"), F.lit(-1).alias("part"), F.lit("deleteSurface").alias("kind"), "surface_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("has_value"))
    return created.unionAll(root).unionAll(changes).unionAll(deleted)


def fold_surfaces(messages: DataFrame) -> DataFrame:
    """(run_id, surface_id, model, first_seq, last_seq): messages applied in order.

    A surface's messages are dealt and sorted by Spark and stream by; one model is held at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model, first, last = None, {}, None, None
        for pdf in batches:
            out = []
            for run, sid, seq, kind, path, value, has in zip(*[pdf[c] for c in ("run_id", "surface_id", "seq", "kind", "path", "value", "has_value")]):
                if (run, sid) != now:
                    if now is not None:
                        out.append((*now, jsonops.canonical_text(model), first, last))
                    now, model, first = (run, sid), {}, seq
                last = seq
                if kind == "createSurface":
                    model = {}
                elif kind == "updateDataModel":
                    model = jsonops.set_at(model, path, json.loads(value) if has and value is not None else jsonops.ABSENT)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([(*now, jsonops.canonical_text(model), first, last)], columns=columns)

    columns = ["run_id", "surface_id", "model", "first_seq", "last_seq"]
    kind = messages.schema["run_id"].dataType.simpleString()
    seq = messages.schema["seq"].dataType.simpleString()
    dealt = messages.repartition("run_id", "surface_id").sortWithinPartitions("run_id", "surface_id", "seq", "part")
    return dealt.mapInPandas(fold, f"run_id {kind}, surface_id string, model string, first_seq {seq}, last_seq {seq}")


def fold_flat(writes: DataFrame, keys: list[str], path: str = "path", value: str = "value", order: str = "seq") -> DataFrame:
    """The last value of each flat pointer: combines before the shuffle."""
    return writes.groupBy(*keys, path).agg(F.max_by(value, order).alias(value))


def last_of_each(events: DataFrame, run: str, kind: str, kinds: list[str], value: str, order: list[str]) -> DataFrame:
    """As-of context: at each row, the newest value of every kind so far, its own included."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select("*", *[F.last(F.when(F.col(kind) == k, F.col(value)), ignorenulls=True).over(w).alias(f"last_{k}") for k in kinds])


def close_records(folded: DataFrame, view: str, fields: dict[str, Column]) -> DataFrame:
    """One record per surface of a view, from its final state."""
    own = folded.where(F.regexp_replace("surface_id", r"-\d+$", "") == view)
    return own.select("run_id", "surface_id", *[c.alias(k) for k, c in fields.items()])


def item_records(folded: DataFrame, items: Column, limit: Column | None = None) -> DataFrame:
    """One row per item of a list of the final state, the head of it where a limit is given."""
    if limit is not None:
        items = F.slice(items, F.lit(1), F.greatest(limit, F.lit(0)))
    return folded.select("run_id", "surface_id", F.posexplode(items).alias("item_no", "item"))


@dataclass(frozen=True)
class Route:
    """Records of the surfaces of a view: one as a surface closes, or one for each entry of its list ``each``, as ``item``. ``fields`` are
    Columns over ``model``, ``context`` (the last model of each view, as text) and ``item``; ``key`` names the field that tells records apart."""

    dataset: str
    view: str
    fields: dict[str, Column]
    each: Column | None = None
    key: str | None = None


def emitted(closed: DataFrame, routes: list[Route]) -> DataFrame:
    """(dataset, key, record, run_id, seq, close_no, route_no, item_no) of closed surfaces, batch or stream. Without a key field the record is its key.

    Surfaces are read once for all routes: in a union each route would have a fold, and its state, of its own.
    """
    none = F.array().cast("array<struct<route_no:int,item_no:int>>")

    def places(no: int, r: Route) -> Column:
        """The items of a surface that give a record of a route."""
        place = lambda k: F.struct(F.lit(no).alias("route_no"), k.alias("item_no"))
        each = F.array(place(F.lit(0))) if r.each is None else F.transform(r.each, lambda x, k: place(k))
        return F.coalesce(F.when(F.col("view") == r.view, each), none)

    told = closed.select("*", F.inline(F.flatten(F.array(*[places(no, r) for no, r in enumerate(routes)]))))
    record, key, dataset = (F.lit(None).cast("string") for _ in range(3))
    for no, r in enumerate(routes):
        own = F.col("route_no") == no
        if r.each is not None:
            told = told.withColumn("item", F.when(own, F.get(r.each, F.col("item_no"))))
        text = F.to_json(F.struct(*[c.alias(k) for k, c in r.fields.items()]), {"ignoreNullFields": "false"})
        told = told.withColumns({
            "__record": F.when(own, text).otherwise(record),
            "__key": F.when(own, text if r.key is None else F.coalesce(r.fields[r.key].cast("string"), F.lit("null"))).otherwise(key),
        })
        record, key, dataset = F.col("__record"), F.col("__key"), F.when(own, F.lit(r.dataset)).otherwise(dataset)
    return told.select(dataset.alias("dataset"), key.alias("key"), record.alias("record"), "run_id", F.col("closed_seq").alias("seq"), "close_no", "route_no", "item_no")


def message_texts(messages: DataFrame, of: str = "seq") -> DataFrame:
    """(run_id, seq, raw): messages as one JSON text each, in one order: ``seq`` counts the parts of a message in."""
    value = F.when(F.col("has_value"), F.concat(F.lit(',"value":'), F.coalesce("value", F.lit("null")))).otherwise("")
    path = F.when(F.col("path").isNotNull(), F.concat(F.lit(',"path":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2))).otherwise("")
    raw = F.concat(F.lit('{"version":"0.9","'), "kind", F.lit('":{"surfaceId":"'), "surface_id", F.lit('"'), path, value, F.lit("}}"))
    return messages.select("run_id", (F.col(of) * 1000 + F.col("part") + 1).cast("long").alias("seq"), raw.alias("raw"))


def interrupt_intervals(presence: DataFrame) -> DataFrame:
    """(run_id, interrupt, from_seq, to_seq) from rows (run_id, seq, interrupts): each stretch of snapshots that shows one."""
    order = Window.partitionBy("run_id").orderBy("seq")
    numbered = presence.withColumn("n", F.row_number().over(order))
    shown = numbered.select("run_id", "seq", "n", F.explode(F.array_distinct("interrupts")).alias("interrupt"))
    own = Window.partitionBy("run_id", "interrupt").orderBy("n")
    return shown.withColumn("island", F.col("n") - F.row_number().over(own)).groupBy("run_id", "interrupt", "island").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq")).drop("island")


def islands(rows: DataFrame, group: list[str], value: list[str], order: list[str]) -> DataFrame:
    """Number the runs of equal values (``island``) and the place in each (``repeat``, from 0)."""
    w = Window.partitionBy(*group).orderBy(*order)
    now = F.struct(*value)
    turned = rows.withColumn("__turn", (~F.lag(now).over(w).eqNullSafe(now)).cast("int"))
    numbered = turned.withColumn("island", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("repeat", F.row_number().over(Window.partitionBy(*group, "island").orderBy(*order)) - 1).drop("__turn")


def by_run(rows: DataFrame, run: str, order: list[str], step: Callable, end: Callable, schema: str) -> DataFrame:
    """Fold each run's rows in order: ``step(state, *row)`` gives the next state and the rows to tell, ``end(run, state)`` those of a run's end.

    Rows are dealt and sorted by Spark and stream by in pieces; of a run only its state is held, however long it is.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    columns = rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, state = False, None, None
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c].tolist() for c in columns]):
                own = row[columns.index(run)]
                if not begun or own != now:
                    if begun:
                        out += end(now, state)
                    begun, now, state = True, own, None
                state, told = step(state, *row)
                out += told
            yield pd.DataFrame(out, columns=names)
        if begun:
            yield pd.DataFrame(end(now, state), columns=names)

    return rows.repartition(run).sortWithinPartitions(run, *order).mapInPandas(fold, schema)


def breadcrumb(states: DataFrame) -> DataFrame:
    """(run_id, crumbs): states in order; coming back to one cuts the trail behind it and counts the visit. A trail holds each state once at most."""

    def step(trail, run, seq, state):
        trail = trail or {}  # in order of entry
        if state not in trail:
            trail[state] = 0
        else:
            while next(reversed(trail)) != state:
                trail.popitem()
        trail[state] += 1
        return trail, []

    end = lambda run, trail: [(run, ">".join(f"{s}:{n}" for s, n in trail.items()))]
    kind = states.schema["run_id"].dataType.simpleString()
    return by_run(states.select("run_id", "seq", F.coalesce(F.col("state").cast("string"), F.lit("null")).alias("state")), "run_id", ["seq"], step, end, f"run_id {kind}, crumbs string")


def burst_step(now: tuple | None, ms: int, payload, quiet_ms: int, most_ms: int) -> tuple[tuple, list[tuple]]:
    """The open burst (begun, last, changes, payload) after one more change, and the burst that it ended, if any."""
    if now is not None and ms - now[1] < quiet_ms and ms - now[0] < most_ms:
        return (now[0], max(now[1], ms), now[2] + 1, payload), []
    return (ms, ms, 1, payload), [] if now is None else [now]


def bursts(changes: DataFrame, quiet_ms: int = 120, most_ms: int = 600) -> DataFrame:
    """(run_id, begun, last, changes, payload): the last of each burst of changes (run_id, ms, seq, payload). A burst ends after a quiet time,
    and ``most_ms`` after it began at the latest; so its end hangs on its beginning, and no session window tells it."""

    def step(now, run, ms, seq, payload):
        now, ended = burst_step(now, ms, payload, quiet_ms, most_ms)
        return now, [(run, *x) for x in ended]

    kind, run = (changes.schema[c].dataType.simpleString() for c in ("payload", "run_id"))
    rows = changes.select("run_id", F.col("ms").cast("long").alias("ms"), "seq", "payload")
    return by_run(rows, "run_id", ["ms", "seq"], step, lambda run, now: [(run, *now)], f"run_id {run}, begun long, last long, changes long, payload {kind}")


def classified(raw: Column) -> Column:
    """Kind, group, path and preview of a stream message."""
    kinds = ("createSurface", "updateComponents", "updateDataModel", "deleteSurface", "action")
    kind = F.coalesce(*[F.when(F.get_json_object(raw, f"$.{k}").isNotNull(), F.lit(k)) for k in kinds], F.lit("unknown"))
    surface = F.coalesce(*[F.get_json_object(raw, f"$.{k}.surfaceId") for k in kinds])
    group = casts.bound(surface, lambda s: F.when(s.contains("interrupt:"), "interrupt").when(s.startswith("control"), "control").otherwise("page"))
    value = F.get_json_object(raw, "$.updateDataModel.value")
    return F.struct(kind.alias("kind"), group.alias("group"), F.coalesce(F.get_json_object(raw, "$.updateDataModel.path"), F.lit("")).alias("path"), F.substring(F.coalesce(value, F.lit("")), 1, 80).alias("preview"))


def message_errors(raw: Column) -> Column:
    """Why a server message is malformed; empty for a good one."""
    bodies = ("createSurface", "updateComponents", "updateDataModel", "deleteSurface")

    def errors(parsed: Column) -> Column:
        has = lambda k: F.try_variant_get(parsed, f"$.{k}", "variant").isNotNull()
        n = sum((has(k).cast("int") for k in bodies[1:]), has(bodies[0]).cast("int"))
        surface = F.coalesce(*[F.try_variant_get(parsed, f"$.{k}.surfaceId", "string") for k in bodies])
        return F.array_compact(
            F.array(
                F.when(parsed.isNull(), "not JSON"),
                F.when(parsed.isNotNull() & F.try_variant_get(parsed, "$.version", "variant").isNull(), "version is missing"),
                F.when(parsed.isNotNull() & (n != 1), "exactly one body is needed"),
                F.when((n == 1) & surface.isNull(), "surfaceId is missing"),
            )
        )

    return casts.bound(F.try_parse_json(raw), errors)


def with_lookup(items: DataFrame, listed: DataFrame, run: list[str], key: str, fields: list[str]) -> DataFrame:
    """Items with fields of the first entry of another view's list that has their key, in the same run; nulls where there is none."""
    order = [F.col(c) for c in ("item_no",) if c in listed.columns] or [F.to_json(F.struct(*fields))]
    first = listed.groupBy(*run, key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("__found"))
    return items.join(first, [*run, key], "left").select(*[F.col(f"`{c}`") for c in items.columns], *[F.col("__found")[f].alias(f) for f in fields])


def folded_log(lines: DataFrame) -> DataFrame:
    """(run_id, n, row): equal rows of a run's log in a row as one with ``×N``; state lines are told elsewhere and left out."""
    shown = lines.where(~F.col("line").rlike(r"^\s*state\s"))
    runs = islands(shown, ["run_id"], ["line"], ["n"]).groupBy("run_id", "island").agg(F.max("n").alias("n"), F.first("line").alias("line"), F.count("*").alias("times"))
    return runs.select("run_id", "n", F.concat("line", F.when(F.col("times") > 1, F.concat(F.lit(" ×"), F.col("times").cast("string"))).otherwise("")).alias("row"))


def split_actions(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages of both directions with ``is_action``: a client's action, or a server's message; texts that are no JSON object go."""
    parsed = F.try_parse_json(raw)
    return messages.where(F.schema_of_variant(parsed).startswith("OBJECT")).withColumn("is_action", F.try_variant_get(parsed, "$.action", "variant").isNotNull())
