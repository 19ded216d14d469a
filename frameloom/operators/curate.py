"""Curation: relevance tiers, decimation, caption filter, OCR gate and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import band, tier_of
from ..functions.text import strip_suffix, word_count
from ..functions.vectors import cosine, hamming

HOT, WARM = 0.20, 0.12
GATE = 0.20


def best_query_per_frame(scores: DataFrame, hot: float = HOT, warm: float = WARM) -> DataFrame:
    """``frame_id, best_query_id, relevance_score, tier`` of ``scores(frame_id, query_id, score)``.

    Ties go to the lowest query; the score is rounded to 4 places before the tier is taken.
    """
    g = scores.groupBy("frame_id").agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("b"))
    s = F.round("b.score", 4)
    return g.select("frame_id", (-F.col("b.q")).alias("best_query_id"), s.alias("relevance_score"), tier_of(s, hot, warm).alias("tier"))


def decimate(frames: DataFrame, warm_bits: int = 8, cold_bits: int = 12) -> DataFrame:
    """Frames kept by tier and visual change: ``frames(stream_name, day, hour, frame_index, tier, phash, ...)``.

    Hot frames stay. Any other frame is compared with the previous non-hot
    frame of its stream-day and stays if at least that many bits differ; it
    also stays if it or that frame has no hash, or if it is the first. Only
    non-hot frames are shuffled.
    """
    w = Window.partitionBy("stream_name", "day").orderBy("hour", "frame_index")
    rest = frames.where("tier <> 'hot' or tier is null").withColumn("before", F.lag("phash").over(w))
    need = F.when(F.col("tier") == "warm", warm_bits).otherwise(cold_bits)
    kept = rest.where(F.col("phash").isNull() | F.col("before").isNull() | (hamming(F.col("phash"), F.col("before")) >= need)).drop("before")
    return frames.where("tier = 'hot'").unionByName(kept)


def filter_captions(captions: DataFrame, min_words: int = 5, min_ocr: int = 2) -> DataFrame:
    """Captions of fewer than ``min_words`` words become null; to others the trimmed OCR text is appended if long enough."""
    o = F.trim(F.coalesce(F.col("ocr_text"), F.lit("")))
    c = F.when(word_count(F.col("caption")) < min_words, None).when(F.length(o) >= min_ocr, F.concat_ws(" ", "caption", o)).otherwise(F.col("caption"))
    return captions.withColumn("caption", c)


def short_captions(captions: DataFrame, min_words: int = 5) -> DataFrame:
    """The rows that a filtered table must not have."""
    return captions.where(F.col("caption").isNotNull() & (word_count(F.col("caption")) < min_words))


def ocr_gate(captions: DataFrame, vectors: DataFrame, threshold: float = GATE) -> DataFrame:
    """Gate OCR text by its likeness to the frame: ``captions(frame_id, caption, ocr_text, ocr_vec)``, ``vectors(frame_id, vec)``.

    A row with blank OCR text, or of a frame without a vector, stays as it is
    with null ocr_sim and ocr_gate. A null caption stays null.
    """
    j = captions.join(vectors.select("frame_id", F.col("vec").alias("frame_vec")), "frame_id", "left")
    sim = F.when(F.trim(F.coalesce("ocr_text", F.lit(""))) != "", cosine(F.col("ocr_vec"), F.col("frame_vec")))
    return apply_gate(j.withColumn("sim", sim).drop("frame_vec", "ocr_vec"), threshold)


def apply_gate(scored: DataFrame, threshold: float = GATE) -> DataFrame:
    """Apply the gate to ``scored(caption, ocr_text, sim)``; a null sim leaves the row as it is."""
    cut = F.col("sim") < threshold
    return scored.select(
        *[c for c in scored.columns if c not in ("caption", "ocr_text", "sim", "ocr_sim", "ocr_gate")],
        F.when(cut, strip_suffix(F.col("caption"), F.col("ocr_text"))).otherwise(F.col("caption")).alias("caption"),
        F.when(cut, "").otherwise(F.col("ocr_text")).alias("ocr_text"),
        F.round("sim", 6).alias("ocr_sim"),
        F.when(cut, "stripped").when(F.col("sim").isNotNull(), "kept").alias("ocr_gate"),
    )


def similarity_stats(df: DataFrame, c: str) -> DataFrame:
    """One row: min, max, mean, population deviation and linear percentiles, 6 places; NaN counts as null."""
    v = F.nanvl(F.col(c), F.lit(None).cast("double"))
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    r = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), p.alias("p"))
    six = lambda x: F.round(x, 6)
    return r.select("n", *[six(x).alias(x) for x in ("lo", "hi", "mean", "std")], *[six(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def tier_stats(scored: DataFrame) -> DataFrame:
    """One row: frames, and count and share (2 places) of each tier, and an upload estimate of the two upper tiers."""
    n = lambda t: F.count_if(F.col("tier") == t)
    pct = lambda t: F.round(n(t) / F.count("*") * 100, 2)
    return scored.agg(
        F.count("*").alias("total"), *[x for t in ("hot", "warm", "cold") for x in (n(t).alias(f"{t}_count"), pct(t).alias(f"{t}_pct"))],
        (n("hot") + n("warm")).alias("upload_frames"), F.round((n("hot") + n("warm")) * 45 / 1024 / 1024, 2).alias("upload_gb"),
    )


def hot_by_query(scored: DataFrame) -> DataFrame:
    return scored.where("tier = 'hot'").groupBy("best_query_id").agg(F.count("*").alias("hot_count"))


def stream_means(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n streams of the highest and of the lowest mean score: ``stream_name, mean_score, side, place``."""
    m = scored.groupBy("stream_name").agg(F.round(F.avg("relevance_score"), 5).alias("mean_score"))
    hi = F.row_number().over(Window.orderBy(F.desc("mean_score"), "stream_name"))
    lo = F.row_number().over(Window.orderBy("mean_score", F.desc("stream_name")))
    both = m.withColumn("hi", hi).withColumn("lo", lo)
    return both.where(f"hi <= {n}").select("stream_name", "mean_score", F.lit("highest").alias("side"), F.col("hi").alias("place")).unionByName(both.where(f"lo <= {n}").select("stream_name", "mean_score", F.lit("lowest").alias("side"), F.col("lo").alias("place")))


def histogram(scored: DataFrame, c: str = "relevance_score") -> DataFrame:
    """``band, n, pct``: counts of the bands that have rows, and their share of all rows."""
    g = scored.groupBy(band(F.col(c)).alias("band")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("pct", F.round(F.col("n") / total * 100, 4)).where("band is not null")


def gate_counters(captions: DataFrame) -> DataFrame:
    """One row of counts over a gated table."""
    g = F.col("ocr_gate")
    return captions.agg(F.count("*").alias("total"), F.count_if(g == "stripped").alias("stripped"), F.count_if(g == "kept").alias("kept"), F.count_if(g.isNull()).alias("not_gated"), F.round(F.count_if(g == "stripped") / F.nullif(F.count(g), F.lit(0)) * 100, 2).alias("strip_rate"))


def filter_counters(captions: DataFrame, min_words: int = 5, min_ocr: int = 2) -> DataFrame:
    """One row: processed, discarded, kept, and kept with OCR text appended."""
    short = word_count(F.col("caption")) < min_words
    ocr = F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) >= min_ocr
    return captions.agg(F.count("*").alias("processed"), F.count_if(short).alias("discarded"), F.count_if(~short).alias("kept"), F.count_if(~short & ocr).alias("ocr_appended"))


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: texts, empty texts, mean number of words (6 places)."""
    n = word_count(F.col(text))
    return df.agg(F.count("*").alias("texts"), F.count_if(n == 0).alias("empty"), F.round(F.avg(n), 6).alias("mean_words"))


def phash_bits(c: Column) -> Column:
    """Sign hash of a vector as a stand-in for an image hash."""
    from ..functions.vectors import sign_hash

    return sign_hash(c)
