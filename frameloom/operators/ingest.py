"""Ingest: chunks to frames, sliding transcript text, canonical archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import FRAME_STEP_SEC, clean_day, clean_hour, clean_stream, frame_id_of, hms, offset_of, parse_frame

HALF_WINDOW_SEC = 10


def frame_index_from_sec(sec: Column) -> Column:
    """Frame shown at a time, halves rounded to even."""
    return (F.bround(sec / FRAME_STEP_SEC) + 1).cast("int")


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Drop chunks without two time bounds, of no positive length, or with blank text."""
    return chunks.where("start_sec is not null and end_sec is not null and end_sec > start_sec and trim(coalesce(text, '')) <> ''")


def sliding_text(chunks: DataFrame, key: list[str], start: str, text: str, order: str | None = None, half: float = HALF_WINDOW_SEC, out: str = "transcript_text") -> DataFrame:
    """Texts of all chunks of the same key that start within +-half seconds (inclusive), in start order.

    Blank texts are skipped; equal starts go by ``order``. One shuffle by the
    key; the RANGE frame is streamed, so only a window's texts are held.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    item = F.when(t != "", F.struct(F.col(start).alias("s"), F.col(order or start).alias("o"), t.alias("t")))
    w = Window.partitionBy(*key).orderBy(F.col(start).cast("double")).rangeBetween(-half, half)
    return chunks.withColumn(out, F.array_join(F.transform(F.array_sort(F.collect_list(item).over(w)), lambda x: x["t"]), " "))


def align_transcripts(chunks: DataFrame) -> DataFrame:
    """Chunks as frame-aligned rows: ``frame_id, day, stream_name, hour, frame_index, time_offset_sec, transcript_text, raw_text``."""
    c = valid_chunks(chunks)
    c = sliding_text(c, ["stream_name", "day", "hour"], "start_sec", "text", "chunk_no")
    idx = frame_index_from_sec(F.col("start_sec"))
    return c.select(
        frame_id_of(F.col("stream_name"), F.col("day"), F.col("hour").cast("int"), idx).alias("frame_id"), "day", "stream_name", "hour", idx.alias("frame_index"), offset_of(idx).alias("time_offset_sec"), "transcript_text", F.trim("text").alias("raw_text"),
    )


def archive_frames(frames: DataFrame) -> DataFrame:
    """One row for each frame of the manifest, with its canonical id; a missing time stamp is computed."""
    f = frames.select(frame_id_of(clean_stream(F.col("stream_name")), clean_day(F.col("day")), F.col("hour"), F.col("frame_index")).alias("frame_id"), "*").where("frame_id is not null")
    f = f.groupBy("frame_id").agg(
        F.max("stream_name").alias("stream_name"), F.max("day").alias("day"), F.max("hour").alias("hour"), F.max("frame_index").alias("frame_index"), F.max("time_offset_sec").alias("time_offset_sec"),
        F.max("stream_type").alias("stream_type"), F.max("timestamp_str").alias("ts"), F.max("full_path").alias("full_path"),
    )
    return f.withColumn("timestamp_str", F.coalesce("ts", hms(F.col("hour") * 3600 + F.col("time_offset_sec")))).drop("ts")


def chunk_place() -> dict[str, Column]:
    """``stream_name, day, hour, time_offset_sec, frame_index`` of a transcript row, from whichever of its columns name them."""
    f = parse_frame(F.col("frame_id"))
    off = F.coalesce(F.col("time_offset_sec"), offset_of(F.col("frame_index")), offset_of(f["frame_index"])).cast("int")
    return {
        "stream_name": F.coalesce(clean_stream(F.col("stream_name")), f["stream"]), "day": F.coalesce(clean_day(F.col("day")), f["day"]), "hour": F.coalesce(clean_hour(F.col("hour")), f["hour"]),
        "time_offset_sec": off, "frame_index": F.coalesce(F.col("frame_index"), f["frame_index"], frame_index_from_sec(off)),
    }


def archive_transcripts(transcripts: DataFrame) -> DataFrame:
    """One row for each chunk: ``row_index, frame_id, stream_name, day, hour, time_offset_sec, frame_index, raw_text, transcript_text`` in one spelling."""
    t = transcripts.dropDuplicates(["row_index"]).select("row_index", *[c.alias(n) for n, c in chunk_place().items()], "raw_text", "transcript_text")
    return t.select("row_index", frame_id_of(*[F.col(c) for c in ("stream_name", "day", "hour", "frame_index")]).alias("frame_id"), "stream_name", "day", "hour", "time_offset_sec", "frame_index", "raw_text", "transcript_text")


def archive_captions(captions: DataFrame) -> DataFrame:
    """One row for each frame: of several captions that of the highest manifest_row_index counts."""
    rest = [c for c in ("caption", "ocr_text", "ocr_sim", "ocr_gate") if c in captions.columns]
    c = captions.where("frame_id is not null").groupBy("frame_id").agg(F.max(F.struct("manifest_row_index", *rest)).alias("r"))
    return c.select("frame_id", "r.*")


def archive_vectors(index: DataFrame, vec: str = "vec") -> DataFrame:
    """One row for each frame with a usable vector: ``manifest_row_index, frame_id, vec``."""
    from ..functions.vectors import is_usable

    return index.where(is_usable(F.col(vec))).select("manifest_row_index", "frame_id", F.col(vec).alias("vec")).dropDuplicates(["manifest_row_index"])


def concat_text_by_frame(chunks: DataFrame, text: str, order: str = "row_index") -> DataFrame:
    """``frame_id, text``: the non-blank texts of a frame in order, joined by blanks."""
    item = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    return chunks.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("text"))


def index_documents(frames: DataFrame, transcripts: DataFrame, captions: DataFrame) -> DataFrame:
    """``frame_id, stream_name, transcript_text, caption_text`` of every frame; missing texts are empty."""
    t = concat_text_by_frame(transcripts, "raw_text").withColumnRenamed("text", "transcript_text")
    c = captions.select("frame_id", F.col("caption").alias("caption_text"))
    d = frames.select("frame_id", "stream_name").join(t, "frame_id", "left").join(c, "frame_id", "left")
    return d.select("frame_id", "stream_name", F.coalesce("transcript_text", F.lit("")).alias("transcript_text"), F.coalesce("caption_text", F.lit("")).alias("caption_text"))
