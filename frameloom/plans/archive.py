"""The archive's tables in one spelling, and the query set, as the plans read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import frame_id_of, parse_frame
from ..functions.scores import read_tier
from ..functions.text import expand_query
from ..operators.dense import MAX_QUERY_BLOCK
from ..session import table
from .index import Index


class Archive:
    """Lazy views over a data directory and its lasting index, whose parts are written where they aren't there yet.

    ``index_root`` names the index's folder (by default one in the shared
    folder, named after the state of the tables, so that changed tables get a
    new one).
    """

    def __init__(self, spark: SparkSession, root: str, index_root: str | None = None, analyzer: str = "plain"):
        self.spark, self.root, self.analyzer = spark, root, analyzer
        self._index_root, self._index, self._queries = index_root, None, None

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(self.spark, self.root, self._index_root, self.analyzer)
        return self._index

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def frames(self) -> DataFrame:
        return self.index.read("frames")

    def captions(self) -> DataFrame:
        return self.index.read("captions")

    def transcripts(self) -> DataFrame:
        return self.index.read("transcripts")

    def vectors(self) -> DataFrame:
        """``manifest_row_index, frame_id, vec, norm`` of the usable vectors."""
        return self.index.read("vectors")

    def docs(self) -> DataFrame:
        """Inverted-index documents: every frame with its transcript and caption text, missing ones empty."""
        return self.index.read("docs")

    def queries(self) -> DataFrame:
        """``query_id, raw_query, query_text`` (expanded), ``synonyms, location_hint, qtype, w_vis, w_text``.

        A stated set: its number is checked and it is read once, so that the plans hold it as it is and joins broadcast it.
        """
        if self._queries is None:
            p = self.raw("scene_prompts")
            q = p.select(
                "query_id", F.col("query_text").alias("raw_query"), expand_query(F.col("query_text"), F.col("synonyms")).alias("query_text"), "synonyms", "location_hint",
                F.when(F.col("w_text") > F.col("w_vis"), "speech").otherwise("visual").alias("qtype"), "w_vis", "w_text",
            )
            rows = q.limit(MAX_QUERY_BLOCK + 1).collect()
            if len(rows) > MAX_QUERY_BLOCK:
                raise ValueError(f"more than {MAX_QUERY_BLOCK} queries; take them in blocks")
            self._queries = F.broadcast(self.spark.createDataFrame(rows, q.schema))
        return self._queries

    def query_vectors(self) -> DataFrame:
        """``query_id, qvec``, as the index holds them."""
        return self.index.read("query_vectors").withColumnRenamed("vec", "qvec")

    def tiers(self) -> DataFrame:
        """``manifest_idx, frame_id, stream_name, day, hour, frame_index, relevance_score, best_query_id, tier``: the latest score of each frame with a readable tier, however spelt."""
        q = self.raw("qaff_classified").withColumn("t", read_tier(F.col("tier"))).where("t is not null and relevance_score is not null")
        q = q.groupBy("manifest_idx").agg(F.max(F.struct("scored_at", "t", "relevance_score", "best_query_id", "frame_id", "full_path_resized")).alias("r"))
        f = parse_frame(F.col("r.frame_id"), F.col("r.full_path_resized"))
        q = q.select("manifest_idx", f.alias("f"), F.col("r.t").alias("tier"), F.col("r.relevance_score").alias("relevance_score"), F.col("r.best_query_id").alias("best_query_id"))
        return q.select(
            "manifest_idx", frame_id_of(F.col("f.stream"), F.col("f.day"), F.col("f.hour"), F.col("f.frame_index")).alias("frame_id"), F.col("f.stream").alias("stream_name"), F.col("f.day").alias("day"), F.col("f.hour").alias("hour"), F.col("f.frame_index").alias("frame_index"),
            "relevance_score", "best_query_id", "tier",
        )

    def qrels(self) -> DataFrame:
        """``query_id, frame_id``: a frame is relevant to the query it is hot for."""
        return self.tiers().where("tier = 'hot'").select(F.concat(F.lit("Q"), (F.col("best_query_id") + 1).cast("string")).alias("query_id"), "frame_id").distinct()
