"""Keyed tables that grow by batches: rows dealt into hash buckets, each batch adds files to the buckets that it touches.

A batch writes its own rows only. A bucket that has gathered more than ``most`` parts is rewritten as one; other buckets are left as they
are. A table of contents, one small JSON table a version, tells the parts of each bucket. It is written last, so a batch that fails
before changes nothing, and one that is run again under its number starts from the version before. Parts that neither the
newest nor the last but one version names are removed.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits in a bucket's filter of keys, and hashes of a key.
FILTER_BITS, FILTER_HASHES = 1 << 22, 3
FILTER = StructType().add("word", "integer").add("bits", "long")
BIT = "shiftleft(1L, cast(at & 63 as int))"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system that holds a path, and the path's object."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = file_system(spark, path)
    return fs.exists(own)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing for a missing folder."""
    fs, own = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(own)) if fs.exists(own) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, own = file_system(spark, path)
    fs.delete(own, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    fs, own = file_system(spark, path)
    return fs.getContentSummary(own).getLength() if fs.exists(own) else 0


class KeyedTable:
    """The newest row of each key (by ``order``), or the first one ever stored where ``first``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], first: bool = False, buckets: int = 64, most: int = 8):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order
        self.first, self.buckets, self.most = first, buckets, most

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def chosen(self, rows: DataFrame) -> DataFrame:
        """One row of each key; combines before the shuffle."""
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        pick = F.min_by if self.first else F.max_by
        best = rows.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*self.order)).alias("__row"))
        return best.select(*[F.col("__row")[c].alias(c) if c in rest else F.col(f"`{c}`") for c in rows.columns])

    def version(self, before: int | None = None) -> int | None:
        """The newest version, of those before a number."""
        known = [int(n.removeprefix("v=")) for n in names(self.spark, f"{self.path}/contents") if exists(self.spark, f"{self.path}/contents/{n}/_SUCCESS")]
        return max((v for v in known if before is None or v < before), default=None)

    def parts(self, version: int | None) -> list[tuple[int, str]]:
        """(bucket, part) of a version: at most ``most`` for each bucket."""
        if version is None:
            return []
        held = self.spark.read.schema("bucket int, part string").json(f"{self.path}/contents/v={version}")
        return sorted((r["bucket"], r["part"]) for r in held.collect())

    def read(self, parts: list[tuple[int, str]], kind: str = "rows", schema: StructType | None = None) -> DataFrame:
        """The rows of some parts, with their ``bucket``."""
        schema = StructType([*(schema or self.schema).fields]).add("bucket", "integer")
        paths = [f"{self.path}/{kind}/part={p}/bucket={b}" for b, p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).select(*schema.names)

    def rows(self) -> DataFrame:
        return self.chosen(self.read(self.parts(self.version())).drop("bucket"))

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows of some keys. Only the buckets of these keys are read, and of a bucket whose filter knows none of them
        not even these."""
        asked = wanted.select(*[F.col(f"`{k}`") for k in self.keys]).distinct().withColumn("bucket", self.bucket())
        touched = {r[0] for r in asked.select("bucket").distinct().collect()}  # at most ``buckets``
        parts = [p for p in self.parts(self.version(before)) if p[0] in touched]
        if not parts:
            return self.read([]).drop("bucket")
        bits = self.read(parts, "filter", FILTER).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        places = asked.select("*", F.explode(self.places()).alias("at")).select("*", F.shiftrightunsigned("at", 6).cast("int").alias("word"), F.expr(BIT).alias("bit"))
        known = places.join(bits, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        maybe = known.groupBy("bucket", *self.keys).agg(F.count("*").alias("n")).where(F.col("n") == F.size(self.places()))
        hot = {r[0] for r in maybe.select("bucket").distinct().collect()}
        stored = self.read([p for p in parts if p[0] in hot]).drop("bucket")
        return self.chosen(stored.join(maybe.select(*self.keys), self.keys, "left_semi").select(*self.schema.names))

    def places(self) -> Column:
        """The bits of a key in its bucket's filter."""
        own = [F.pmod(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in self.keys]), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]
        return F.array_distinct(F.array(*own))

    def write(self, rows: DataFrame, part: str) -> list[tuple[int, str]]:
        """Store rows (one of each key) as a part of their buckets, with the bits of their keys."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/part={part}")
        own = [(int(n.removeprefix("bucket=")), part) for n in names(self.spark, f"{self.path}/rows/part={part}") if n.startswith("bucket=")]
        bits = self.read(own).select("bucket", F.explode(self.places()).alias("at")).groupBy("bucket", F.shiftrightunsigned("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr(BIT)).alias("bits"))
        bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filter/part={part}")
        return own

    def put(self, rows: DataFrame, version: int | None = None) -> int:
        """Store a batch under its number; run again, it gives the same version."""
        if version is None:
            newest = self.version()
            version = 0 if newest is None else newest + 1
        before = self.version(version)
        old = self.parts(before)
        part = f"v{version:012d}"
        now = [*old, *self.write(self.chosen(rows.select(*self.schema.names)), part)]
        held: dict[int, list[str]] = {}
        for b, p in now:
            held.setdefault(b, []).append(p)
        crowded = {b for b, p in held.items() if len(p) > self.most}
        if crowded:
            merged = self.write(self.chosen(self.read([p for p in now if p[0] in crowded]).drop("bucket")), f"{part}-merged")
            now = [p for p in now if p[0] not in crowded] + merged
        contents = self.spark.createDataFrame(now, "bucket int, part string") if now else self.spark.createDataFrame([], "bucket int, part string")
        contents.coalesce(1).write.mode("overwrite").json(f"{self.path}/contents/v={version}")
        self.clean(version, before, {*old, *now})
        return version

    def clean(self, version: int, before: int | None, named: set[tuple[int, str]]) -> None:
        """Remove what neither this version nor the one before names."""
        for kind in ("rows", "filter"):
            for p in names(self.spark, f"{self.path}/{kind}"):
                own = [n for n in names(self.spark, f"{self.path}/{kind}/{p}") if n.startswith("bucket=")]
                stale = [n for n in own if (int(n.removeprefix("bucket=")), p.removeprefix("part=")) not in named]
                if len(stale) == len(own):
                    remove(self.spark, f"{self.path}/{kind}/{p}")
                else:
                    for n in stale:
                        remove(self.spark, f"{self.path}/{kind}/{p}/{n}")
        for n in names(self.spark, f"{self.path}/contents"):
            if n.startswith("v=") and int(n.removeprefix("v=")) not in (version, before):
                remove(self.spark, f"{self.path}/contents/{n}")
