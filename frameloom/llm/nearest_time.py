"""Problem 3: matching records by nearest time.

Each entity-time shard of the right table becomes a sorted array with a
piecewise-linear learned index: straight segments that predict the position of
a time within ``epsilon`` places. A query looks only at the few places around
its prediction, which gives the exact neighbour. Right rows within the
tolerance of a shard's edge are copied into the neighbouring shard, so no pair
is lost at the edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import clean_day, clean_stream, frame_id_of
from ..operators.ingest import chunk_place


class LearnedIndex:
    """Piecewise-linear index over a strictly increasing array, built by a shrinking cone of slopes."""

    def __init__(self, keys: np.ndarray, epsilon: int = 8):
        self.keys, self.epsilon = keys, epsilon
        starts, slopes, bases = [], [], []
        i, n = 0, len(keys)
        ks = keys.tolist()
        while i < n:
            lo, hi, j = -np.inf, np.inf, i + 1
            while j < n:
                dx, dy = ks[j] - ks[i], j - i
                a, b = (dy - epsilon) / dx, (dy + epsilon) / dx
                if max(lo, a) > min(hi, b):
                    break
                lo, hi, j = max(lo, a), min(hi, b), j + 1
            starts.append(ks[i])
            bases.append(i)
            slopes.append(0.0 if j == i + 1 else (lo + hi) / 2)
            i = j
        self.starts, self.slopes, self.bases = np.array(starts), np.array(slopes), np.array(bases, dtype=np.int64)

    def predict(self, q: np.ndarray) -> np.ndarray:
        s = np.clip(np.searchsorted(self.starts, q, side="right") - 1, 0, len(self.starts) - 1)
        top = np.append(self.bases[1:], len(self.keys))[s]
        return np.clip(np.rint(self.bases[s] + self.slopes[s] * (q - self.starts[s])).astype(np.int64), self.bases[s], top)

    def nearest(self, q: np.ndarray) -> np.ndarray:
        """Position of the nearest key of each query; of two equally near the earlier one."""
        n, at = len(self.keys), self.predict(q)
        around = at[:, None] + np.arange(-self.epsilon - 2, self.epsilon + 3)[None, :]
        around = np.clip(around, 0, n - 1)
        best = np.abs(self.keys[around] - q[:, None]).argmin(axis=1)
        return around[np.arange(len(q)), best]


def nearest_join(left: DataFrame, right: DataFrame, tolerance: float, shard_sec: int = 21_600, epsilon: int = 8, left_per_task: int = 200_000) -> DataFrame:
    """Pair each left row with the right row of the same entity that is nearest in time.

    ``left`` has ``entity, t, left_id long``; ``right`` has ``entity, t, right_id
    string``. Result: ``left_id, right_id, dt`` (right time minus left time), one
    row for each distinct left row with a partner at most ``tolerance`` away
    (inclusive). Null entities or times have no partner; of right rows at the
    same time the smallest ``right_id`` counts; of two equally near times the
    earlier one.

    Right rows are reduced to one per entity and time before they meet the left
    rows, so a shard's right side is bounded by its width; the left rows of a
    crowded shard are salted into several groups of about ``left_per_task``.
    """
    l = left.select("entity", F.col("t").cast("double").alias("t"), F.col("left_id").cast("long").alias("left_id")).where("entity is not null and t is not null and not isnan(t)").distinct()  # noqa: E741
    r = right.select("entity", F.col("t").cast("double").alias("t"), F.col("right_id").cast("string").alias("right_id")).where("entity is not null and t is not null and not isnan(t)")
    r = r.groupBy("entity", "t").agg(F.min("right_id").alias("right_id"))
    shard = lambda c: F.floor(c / shard_sec).cast("long")
    l = l.withColumn("shard", shard(F.col("t")))  # noqa: E741
    r = r.withColumn("shard", F.explode(F.sequence(shard(F.col("t") - tolerance), shard(F.col("t") + tolerance))))
    # How many groups a shard's left rows are split into: a small aggregate, joined and not collected.
    crowd = l.groupBy("entity", "shard").agg(F.ceil(F.count("*") / left_per_task).cast("int").alias("salts"))
    l = l.join(crowd, ["entity", "shard"]).withColumn("salt", F.pmod(F.xxhash64("left_id"), F.col("salts")).cast("int"))  # noqa: E741
    r = r.join(crowd, ["entity", "shard"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="object"), "dt": pd.Series(dtype="float64")})
        b = b.sort_values("t", kind="stable")
        keys, q = b["t"].to_numpy(), a["t"].to_numpy()
        at = LearnedIndex(keys, epsilon).nearest(q)
        dt = keys[at] - q
        ok = np.abs(dt) <= tolerance
        return pd.DataFrame({"left_id": a["left_id"].to_numpy()[ok], "right_id": b["right_id"].to_numpy()[at[ok]], "dt": dt[ok]})

    key = ["entity", "shard", "salt"]
    # A stated number of partitions: by their few bytes the adaptive plan would put all shards into one or two tasks.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = l.select(*key, "t", "left_id").repartition(n, *key), r.select(*key, "t", "right_id").repartition(n, *key)  # noqa: E741
    return l.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(one, "left_id long, right_id string, dt double")


def transcript_times(transcripts: DataFrame) -> DataFrame:
    """``entity`` (stream__day), ``t`` (seconds of the day) and ``frame_id`` of each chunk, from whichever columns name them."""
    p = chunk_place()
    return transcripts.select(
        F.concat_ws("__", p["stream_name"], p["day"]).alias("entity"), (p["hour"] * 3600 + p["time_offset_sec"]).cast("double").alias("t"), frame_id_of(p["stream_name"], p["day"], p["hour"], p["frame_index"]).alias("frame_id"),
    ).where("frame_id is not null and t is not null")


def mark_matches(marks: DataFrame, transcripts: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """``mark_id, frame_id, dt`` of each voice mark with a chunk of its stream-day at most ``tolerance`` seconds away."""
    stream, day = clean_stream(F.col("stream_name")), clean_day(F.col("day"))
    l = marks.where(stream.isNotNull() & day.isNotNull()).select(  # noqa: E741
        F.concat_ws("__", stream, day).alias("entity"), (F.col("hour") * 3600 + F.col("mark_sec")).alias("t"), F.col("mark_id").alias("left_id"),
    )
    r = transcript_times(transcripts).select("entity", "t", F.col("frame_id").alias("right_id"))
    return nearest_join(l, r, tolerance).select(F.col("left_id").alias("mark_id"), F.col("right_id").alias("frame_id"), "dt")
