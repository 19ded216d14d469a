"""The training-data queries, by name: each takes (spark, directory of the tables) and reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import nearest_time, neighbours, packing, repetition, runs, spans, tokens, turns


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more frames of one tier."""
    return p1_runs(spark, sf_dir).where("n_frames >= 2").select("first_frame_id", "last_frame_id")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with its first and last frame, number of frames and duration."""
    return runs.tier_runs(table(spark, sf_dir, "qaff_classified"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "siglip2_index").select(F.col("manifest_row_index").alias("id"), "vec")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a cosine of at least 0.85 of which one is among the other's ten nearest."""
    return neighbours.similar_pairs(_vectors(spark, sf_dir))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest frames of each frame whose manifest_row_index is divisible by 50, against all frames."""
    v = _vectors(spark, sf_dir)
    near = neighbours.search(v.where("id % 50 = 0"), v)
    names = table(spark, sf_dir, "siglip2_index").groupBy(F.col("manifest_row_index").cast("long").alias("neighbour")).agg(F.min("frame_id").alias("frame_id"))
    return near.join(names, "neighbour").select(F.col("id").alias("row_index"), "rank", F.col("neighbour").alias("neighbour_row"), F.col("frame_id").alias("neighbour_frame_id"), F.round("cosine", 6).alias("cosine"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each voice mark with the transcript frame nearest in time."""
    return nearest_time.mark_matches(table(spark, sf_dir, "voice_marks"), table(spark, sf_dir, "transcript_aligned")).select("mark_id", "frame_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each turn's first and last words, and its speaker."""
    return p4_turns(spark, sf_dir).select("first_row", "last_row", "speaker")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean turns in order, with their words."""
    return turns.speaker_turns(table(spark, sf_dir, "transcript_aligned"), table(spark, sf_dir, "speakers"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.archive_texts(table(spark, sf_dir, "augmented_captions"), table(spark, sf_dir, "transcript_aligned"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are mostly repetition."""
    return repetition.found(_texts(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated words of every caption and raw transcript text."""
    r = repetition.repetition(_texts(spark, sf_dir))
    return r.select("text_field", "row_key", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a common run of at least 150 characters."""
    return spans.shared_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document other documents hold too."""
    r = spans.shared_share(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_chars", "shared_chars", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_neighbours, p3_found, p4_found, p4_turns, p5_found, p5_shares, p6_ids, p7_containers, p8_found, p8_shares)}
