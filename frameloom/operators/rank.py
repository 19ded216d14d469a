"""Post-processing of ranked lists: temporal de-duplication, cross-stream flags, cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPES = {"stream": ["stream_name"], "stream_day_hour": ["stream_name", "day", "hour"]}


def temporal_dedup(ranked: DataFrame, meta: DataFrame, window_sec: float = 10.0, scope: str = "stream") -> DataFrame:
    """Greedy suppression: in score order, drop a frame closer than ``window_sec`` to a kept one of its scope.

    ``ranked(query_id, frame_id, score, ...)``, ``meta(frame_id, stream_name,
    day, hour, time_offset_sec)``. The boundary is exclusive, ties go by
    frame_id, and frames without metadata stay. As shipped the scope is the
    stream alone, so equal offsets of different hours suppress each other.

    Only frames less than a window apart in time order can affect each other,
    so every list is cut at gaps. Of equal offsets only the best can stay, so
    the fold runs over at most one frame for each offset of an island.
    """
    cols = SCOPES[scope]
    m = meta.select("frame_id", *cols, F.col("time_offset_sec").cast("double").alias("_t"))
    # A frame without metadata is a lane of its own, so nothing can suppress it.
    lane = F.struct(*cols, F.when(F.col("_t").isNull(), F.col("frame_id")).alias("alone"))
    j = ranked.join(m, "frame_id", "left").withColumn("_lane", lane)
    rest = [c for c in ranked.columns if c not in ("query_id", "frame_id", "score")]
    item = F.struct((-F.col("score")).alias("s"), F.col("frame_id").alias("f"), F.col("_t").alias("t"), *[F.col(c) for c in rest])
    w = Window.partitionBy("query_id", "_lane").orderBy("_t")
    if window_sec > 0:
        before = F.lag("_t").over(Window.partitionBy("query_id", "_lane").orderBy(F.col("_t"), item))
        j = j.withColumn("_best", F.coalesce(before != F.col("_t"), F.lit(True))).where("_best")
    j = j.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(w) >= window_sec).cast("int"), F.lit(0)))
    j = j.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = j.groupBy("query_id", "_lane", "_island").agg(F.sort_array(F.collect_list(item)).alias("a"))
    near = lambda x, y: F.coalesce(F.abs(y["t"] - x["t"]) < window_sec, F.lit(False))
    kept = F.aggregate("a", F.slice("a", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return g.select("query_id", F.explode(kept).alias("x")).select("query_id", F.col("x.f").alias("frame_id"), (-F.col("x.s")).alias("score"), *[F.col(f"x.{c}") for c in rest])


def cross_stream_flag(ranked: DataFrame, meta: DataFrame, scope: str = "time") -> DataFrame:
    """Add ``multi_angle``: another stream of the same list shows the same time stamp.

    As shipped the day plays no part; scope ``day_time`` takes it into account.
    A frame without metadata isn't flagged.
    """
    by = ["timestamp_str"] if scope == "time" else ["day", "timestamp_str"]
    m = meta.select("frame_id", F.col("stream_name").alias("_s"), F.when(F.col("timestamp_str").isNotNull(), F.struct(*by)).alias("_slot"))
    w = Window.partitionBy("query_id", "_slot")
    j = ranked.join(m, "frame_id", "left")
    return j.withColumn("multi_angle", F.col("_slot").isNotNull() & (F.min("_s").over(w) != F.max("_s").over(w))).withColumn("multi_angle", F.coalesce("multi_angle", F.lit(False))).drop("_s", "_slot")


def renumber(ranked: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks 1..n by score and frame_id, cut at k if asked."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "frame_id")
    r = ranked.drop("rank").withColumn("rank", F.row_number().over(w))
    return r if k is None else r.where(F.col("rank") <= k)


def finish(ranked: DataFrame, meta: DataFrame, k: int = 10, window_sec: float = 10.0, scope: str = "stream") -> DataFrame:
    """De-duplicate, flag, cut at k and number: ``query_id, rank, frame_id, score, stream_name, multi_angle``."""
    d = temporal_dedup(ranked.select("query_id", "frame_id", "score"), meta, window_sec, scope)
    r = renumber(cross_stream_flag(d, meta), k)
    return r.join(meta.select("frame_id", "stream_name"), "frame_id", "left").select("query_id", "rank", "frame_id", "score", F.coalesce("stream_name", F.lit("unknown")).alias("stream_name"), "multi_angle")


def length_violations(ranked: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """``query_id, n`` of the lists that are longer than k (or, if exact, of another length)."""
    g = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    return g.where(F.col("n") != k if exact else F.col("n") > k)


def threshold_cascade(scores: DataFrame, primary: float = 0.25, fallback: float = 0.20, least: int = 3, most: int = 15) -> DataFrame:
    """Frames above the primary threshold; if a query has none, above the fallback; if none still, its best few. At most ``most``."""
    w = Window.partitionBy("query_id")
    s = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "frame_id")))
    s = s.withColumn("n1", F.count_if(F.col("score") >= primary).over(w)).withColumn("n2", F.count_if(F.col("score") >= fallback).over(w))
    mode = F.when(F.col("n1") > 0, "primary").when(F.col("n2") > 0, "fallback").otherwise("best")
    keep = F.when(F.col("n1") > 0, F.col("score") >= primary).when(F.col("n2") > 0, F.col("score") >= fallback).otherwise(F.col("rank") <= least)
    return s.where(keep & (F.col("rank") <= most)).select("query_id", "rank", "frame_id", "score", mode.alias("mode"))
