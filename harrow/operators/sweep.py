"""Sweeps over sorted rows: each task goes through a stretch of the order and starts from what the stretches before have left.

Rows are dealt by ranges of their position. A first pass over the stretches keeps what later ones need of each, a few rows; these travel to
every later stretch, and a second pass answers. So a sweep is a fixed number of jobs, and no row is copied along the axis it covers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import records


class Stairs:
    """Points (key, value) of which none has another at or above its key with a value as large: the largest value from a key on is that of the next point."""

    def __init__(self):
        self.keys: list = []
        self.values: list = []

    def add(self, key, value) -> None:
        at = bisect_left(self.keys, key)
        if at < len(self.keys) and self.values[at] >= value:
            return
        end = at + 1 if at < len(self.keys) and self.keys[at] == key else at
        while at > 0 and self.values[at - 1] <= value:
            at -= 1
        self.keys[at:end], self.values[at:end] = [key], [value]

    def from_(self, key):
        """The largest value at or above a key, or None."""
        at = bisect_left(self.keys, key)
        return self.values[at] if at < len(self.keys) else None


class Before:
    """Transcripts that began before a session: the last name of those that reach its end, else the one that reaches farthest."""

    def __init__(self):
        self.stairs = Stairs()

    def add(self, b0: int, b1: int, file: str) -> None:
        self.stairs.add(b1, (file, b0))

    def points(self) -> list[tuple]:
        return [(b0, b1, file) for b1, (file, b0) in zip(self.stairs.keys, self.stairs.values)]

    def best(self, a0: int, a1: int) -> tuple[int, str] | None:
        found = self.stairs.from_(a1)
        if found is not None:
            return a1 - a0, found[0]
        return (self.stairs.keys[-1] - a0, self.stairs.values[-1][0]) if self.stairs.keys else None


class Within:
    """Transcripts that ended before a session did: the longest of those that began after it."""

    def __init__(self):
        self.stairs = Stairs()

    def add(self, b0: int, b1: int, file: str) -> None:
        self.stairs.add(b0, (b1 - b0, file))

    def points(self) -> list[tuple]:
        return [(b0, b0 + n, file) for b0, (n, file) in zip(self.stairs.keys, self.stairs.values)]

    def best(self, a0: int, a1: int) -> tuple[int, str] | None:
        return self.stairs.from_(a0)


class After:
    """Transcripts that end after a session does, newest first: the one that began first. If it began before the session, ``Before`` has as good a one."""

    def __init__(self):
        self.first: tuple | None = None

    def add(self, b0: int, b1: int, file: str) -> None:
        if self.first is None or b0 < self.first[0] or (b0 == self.first[0] and file > self.first[2]):
            self.first = (b0, b1, file)

    def points(self) -> list[tuple]:
        return [self.first] if self.first else []

    def best(self, a0: int, a1: int) -> tuple[int, str] | None:
        return (a1 - self.first[0], self.first[2]) if self.first and self.first[0] > a0 else None


def swept(s: DataFrame, t: DataFrame, at_s: str, at_t: str, state: type) -> DataFrame:
    """(session_id, file, ms) that a state gives: transcripts (file, b0, b1) come in at ``at_t``, sessions (session_id, a0, a1) ask at ``at_s``."""
    spark = s.sparkSession
    rows = t.select(F.expr(at_t).alias("pos"), F.lit(0).alias("asks"), F.col("b0").alias("x0"), F.col("b1").alias("x1"), "file", F.lit(None).cast(s.schema["session_id"].dataType).alias("session_id"))
    rows = rows.unionByName(s.select(F.expr(at_s).alias("pos"), F.lit(1).alias("asks"), F.col("a0").alias("x0"), F.col("a1").alias("x1"), F.lit(None).cast("string").alias("file"), "session_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.cut(rows.repartitionByRange(parts, "pos").withColumn("part", F.spark_partition_id()), "swept")
    sid = s.schema["session_id"].dataType.simpleString()

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for pdf in batches:
            for part, x0, x1, file in zip(pdf["part"].tolist(), pdf["x0"].tolist(), pdf["x1"].tolist(), pdf["file"]):
                if part != now:
                    if own is not None:
                        yield pd.DataFrame([(now, *p) for p in own.points()], columns=["part", "x0", "x1", "file"])
                    now, own = part, state()
                own.add(x0, x1, file)
        if own is not None:
            yield pd.DataFrame([(now, *p) for p in own.points()], columns=["part", "x0", "x1", "file"])

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for pdf in batches:
            out = []
            for part, asks, x0, x1, file, session in zip(pdf["part"].tolist(), pdf["asks"].tolist(), pdf["x0"].tolist(), pdf["x1"].tolist(), pdf["file"], pdf["session_id"]):
                if part != now:
                    now, own = part, state()
                if asks < 1:
                    own.add(x0, x1, file)
                elif (found := own.best(x0, x1)) and found[0] > 0:
                    out.append((session, found[1], found[0]))
            yield pd.DataFrame(out, columns=["session_id", "file", "ms"])

    known = dealt.where("asks = 0").repartition("part").sortWithinPartitions("part", "pos").mapInPandas(left, "part int, x0 long, x1 long, file string")
    later = known.where(F.col("part") < parts - 1).select(F.explode(F.sequence(F.col("part") + 1, F.lit(parts - 1))).alias("part"), "x0", "x1", "file")
    carried = later.select(F.lit(None).cast("long").alias("pos"), F.lit(-1).alias("asks"), "x0", "x1", "file", F.lit(None).cast(sid).alias("session_id"), "part")
    both = dealt.unionByName(carried).repartition("part")
    order = [F.col("part"), F.col("asks") >= 0, F.col("pos"), F.col("asks")]
    return both.sortWithinPartitions(*order).mapInPandas(answered, f"session_id {sid}, file string, ms long")
