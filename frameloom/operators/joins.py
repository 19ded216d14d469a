"""Join forms: defaults, strict keys, interval overlap, semi, anti, set counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any


def left_with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object], empty_is_missing: bool = False) -> DataFrame:
    """Left join; missing (and, if asked, empty) values of the right side take their defaults."""
    j = left.join(right, on, "left")
    for c, v in defaults.items():
        x: Column = F.nullif(F.col(c), F.lit("")) if empty_is_missing else F.col(c)
        j = j.withColumn(c, F.coalesce(x, F.lit(v)))
    return j


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left keys that the right side lacks."""
    return left.select(*on).distinct().join(right.select(*on), on, "left_anti")


def inner_strict(left: DataFrame, right: DataFrame, on: str, on_missing: str = "raise") -> DataFrame:
    """Inner join in which a left key without partner is an error when it is read.

    With ``on_missing="report"`` such rows come out as well, and a column
    ``problem`` says what is wrong with them (null for the others).
    """
    j = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    if on_missing == "report":
        return j.withColumn("problem", F.when(F.col("_there").isNull(), F.lit("no partner"))).drop("_there")
    return j.withColumn(on, F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no partner for {on} "), F.col(on).cast("string"))).cast(left.schema[on].dataType)).otherwise(F.col(on))).drop("_there")


def duplicates(df: DataFrame, on: str) -> DataFrame:
    """Keys that come more than once, with their count."""
    return df.groupBy(on).agg(F.count("*").alias("n")).where("n > 1")


def row_map(order: DataFrame, frames: DataFrame) -> DataFrame:
    """``row_index, frame_id, stream_name, day, timestamp_str, time_offset_sec, hour`` of an index order."""
    return order.select("row_index", "frame_id").join(frames.select("frame_id", "stream_name", "day", "timestamp_str", F.col("time_offset_sec").cast("double").alias("time_offset_sec"), "hour"), "frame_id")


def interval_overlap(points: DataFrame, intervals: DataFrame, key: list[str], half: float = 30.0, bucket: float = 60.0) -> DataFrame:
    """Pairs of a point's window ``[t - half, t + half]`` (start clamped at 0) and the intervals it touches, bounds included.

    ``points(<key>, t, ...)``, ``intervals(<key>, start_sec, end_sec, ...)``. Both
    sides are cut into buckets of time, so the join is an equi-join on key and
    bucket with a residual; a pair comes out in its first common bucket only.
    """
    lo, hi = F.greatest(F.lit(0.0), F.col("t") - half), F.col("t") + half
    at = lambda c: F.floor(c / bucket).cast("long")
    p = points.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(at(F.col("_lo")), at(F.col("_hi")))))
    i = intervals.withColumn("_b", F.explode(F.sequence(at(F.col("start_sec")), at(F.greatest("start_sec", "end_sec")))))
    j = p.join(i, [*key, "_b"]).where((F.col("start_sec") <= F.col("_hi")) & (F.col("end_sec") >= F.col("_lo")))
    first = F.greatest(at(F.col("_lo")), at(F.col("start_sec")))
    return j.where(F.col("_b") == first).drop("_lo", "_hi", "_b")


def confirm_by_text(points: DataFrame, chunks: DataFrame, key: list[str], words: list[str], half: float = 30.0) -> DataFrame:
    """``frame_id, status``: CONFIRMED if a chunk around the point has one of the words, UNCONFIRMED if none has, MISSING if its key has no chunks."""
    o = interval_overlap(points, chunks, key, half)
    hit = o.groupBy("frame_id").agg(F.bool_or(contains_any(F.col("text"), words)).alias("hit"))
    there = chunks.select(*key).distinct().withColumn("there", F.lit(True))
    r = points.join(there, key, "left").join(hit, "frame_id", "left")
    status = F.when(F.col("there").isNull(), "MISSING").when(F.coalesce("hit", F.lit(False)), "CONFIRMED").otherwise("UNCONFIRMED")
    return r.select("frame_id", status.alias("status"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_keys(parts: list[DataFrame], key: str) -> DataFrame:
    """All keys of several tables, once each."""
    return union_all(*[p.select(key) for p in parts]).distinct()


def intersect_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side and of both."""
    t = a.select(key).distinct().withColumn("l", F.lit(1)).unionByName(b.select(key).distinct().withColumn("l", F.lit(2)))
    g = t.groupBy(key).agg(F.sum("l").alias("s"))
    return g.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), F.count_if(F.col("s") == 3).alias("both"))


def schema_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same column names, in any order."""
    return set(a.columns) == set(b.columns)
