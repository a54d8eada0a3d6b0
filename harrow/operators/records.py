"""Records, datasets and the ledger of work units."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from harrow.operators.keyed import KeyedTable

STATUSES = ("running", "done", "failed", "skipped")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the folder that the cluster shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the folder that the cluster shares and read it back, so that rounds of a loop don't grow their lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def record_key(df: DataFrame, key: str | None, missing: Column | None = None) -> Column:
    """The text by which records are equal: the key (``null`` for null, ``undefined`` where ``missing``), else a digest of the whole record."""
    if key is None:
        return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return text if missing is None else F.when(missing, F.lit("undefined")).otherwise(text)


def first_wins(df: DataFrame, key: Column, order: list[str], dataset: str | None = None) -> DataFrame:
    """One row per (dataset, key): the first in order. ``min_by`` combines before the shuffle, so a key that most rows share
    sends one row per task."""
    group = [F.col(dataset).alias("__dataset")] if dataset else []
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*group, key.alias("__key")).agg(F.min_by(whole, F.struct(*order)).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def union_routes(routes: list[DataFrame]) -> DataFrame:
    """Several routes into one dataset; ``route_no`` is the order of declaration."""
    out = None
    for no, df in enumerate(routes):
        df = df.withColumn("route_no", F.lit(no))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; null keys compare as equal."""
    known = stored.select(*keys).distinct()
    on = None
    for k in keys:
        same = new[k].eqNullSafe(known[k])
        on = same if on is None else on & same
    return new.join(known, on, "left_anti")


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that ``append_once`` has stored."""
    return KeyedTable(spark, f"{path}/_keys", StructType(), ["__key"], []).version()


def append_once(spark: SparkSession, new: DataFrame, path: str, key: list[str], order: list[str], version: int | None = None, buckets: int = 64) -> None:
    """Append the records whose keys are not in the dataset at ``path`` yet; running it again appends nothing.

    A version is a folder ``batch=<version>`` of records; their keys go to ``path/_keys``, in hash buckets, and make the version count.
    A batch that failed in between writes over its own folder. Only the buckets of the batch's keys are read, and written to.
    """
    text = F.to_json(F.struct(*[F.col(f"`{k}`") for k in key]), {"ignoreNullFields": "false"})
    own = new.withColumn("__key", text)
    keys = KeyedTable(spark, f"{path}/_keys", StructType([StructField("__key", StringType())]), ["__key"], [], first=True, buckets=buckets)
    if version is None:
        newest = keys.version()
        version = 0 if newest is None else newest + 1
    first = first_wins(own, F.col("__key"), order).persist()  # read more than once; a stream's batch would be folded anew each time
    first.join(keys.lookup(first, version), "__key", "left_anti").drop("__key").write.mode("overwrite").parquet(f"{path}/batch={version}")
    first.unpersist()
    keys.put(spark.read.schema(new.schema).parquet(f"{path}/batch={version}").select(text.alias("__key")), version)


def stored_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records that ``append_once`` has stored, without a batch that never ended."""
    last = last_batch(spark, path)
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path).where(F.col("batch") <= last).drop("batch")


def capped(df: DataFrame, group: list[str], order: list, cap: Column) -> DataFrame:
    """The first rows of each group, up to a cap that may differ by row."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def datasets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one dataset has more often than the other, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# --- ledger ---


def latest_units(events: DataFrame, order: str = "seq") -> DataFrame:
    """The last event of each unit; one that a crashed run left running is failed as ``interrupted``."""
    last = events.groupBy("id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "id"]), order).alias("u")).select("id", "u.*")
    left = F.col("status") == "running"
    return last.withColumn("error", F.when(left, F.coalesce("error", F.lit("interrupted"))).otherwise(F.col("error"))).withColumn(
        "status", F.when(left, F.lit("failed")).otherwise(F.col("status"))
    )


def attempts(events: DataFrame, order: str = "seq") -> DataFrame:
    """Number the attempts of each unit: how often it had been started up to each event."""
    w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("attempt", F.count_if(F.col("status") == "running").over(w))


def totals(units: DataFrame) -> DataFrame:
    """Units per type and status, zeros included."""
    return units.groupBy("type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def recent(units: DataFrame, n: int = 15) -> DataFrame:
    return units.orderBy(F.coalesce("finishedAt", "startedAt").desc(), "id").limit(n)


def planned_not_done(planned: DataFrame, units: DataFrame) -> DataFrame:
    """Planned units without a completed one; skipped counts as completed."""
    return planned.join(units.where(F.col("status").isin("done", "skipped")).select("id"), "id", "left_anti")


def input_units(inputs: DataFrame, defaults: dict, handles: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """One unit of work per row of an input table: defaults where a value is null, a list of handles (commas, spaces or lines between
    them) split into one row each without its ``@``, and ``error`` naming the required values that are missing."""
    out = inputs.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.lit(v)) for k, v in defaults.items() if k in inputs.columns} | {k: F.lit(v) for k, v in defaults.items() if k not in inputs.columns})
    if handles is not None:
        names = F.filter(F.transform(F.split(F.coalesce(F.col(handles), F.lit("")), r"[,\s]+"), lambda x: F.regexp_replace(x, "^@", "")), lambda x: x != "")
        out = out.select("*", F.explode_outer(F.array_distinct(names)).alias("handle"))
    needed = [*required, *(["handle"] if handles is not None else [])]
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull() | (F.col(k).cast("string") == ""), F.lit(f"{k} is missing")) for k in needed])) if needed else F.array().cast("array<string>")
    return out.withColumn("error", F.array_join(missing, "; "))


def rates(rows: DataFrame, walls: DataFrame, run: str = "run_id", dataset: str = "dataset") -> DataFrame:
    """(run, dataset, records, per_second) of stored records and the runs' wall times in milliseconds (run, wall_ms); null for no time."""
    n = rows.groupBy(run, dataset).agg(F.count("*").alias("records"))
    return n.join(walls.select(run, "wall_ms"), run, "left").select(run, dataset, "records", F.when(F.col("wall_ms") > 0, F.col("records") / (F.col("wall_ms") / 1000.0)).alias("per_second"))
