"""The lasting index: written once, in parts that a restarted build doesn't write again, and read by all plans.

Parts below the index's folder, each a Parquet table:

- ``frames``, ``captions``, ``transcripts``: the archive's tables in one spelling
- ``docs``: inverted-index documents, ``frame_id, stream_name, transcript_text, caption_text``
- ``postings``: ``field, term, frame_id, tf, len``, sorted by field and term within its files
- ``terms``: ``field, term, df``; ``fields``: ``field, n_docs, avg_len``
- ``vectors``: ``manifest_row_index, frame_id, vec, norm`` of the usable vectors; ``query_vectors``: ``query_id, vec``
- ``text_vectors``: ``field, row_index, frame_id, vec, norm`` by a text encoder
- ``document_postings``, ``document_terms``, ``document_fields``: the same for the documents table (key ``doc_id``), words of any script
- ``counts/<part>``: rows of every other part, as written
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import TOKENIZERS
from ..functions.vectors import norm
from ..operators import dense, ingest, sparse
from ..session import shared_folder, table
from ..sources import storage

#: Goes up with every change of what the parts hold, so that an older index isn't read.
FORMAT = 2
TABLES = ("frames", "augmented_captions", "transcript_aligned", "siglip2_index", "documents")
FIELDS = {"transcript": "transcript_text", "caption": "caption_text"}
PARTS = ("frames", "captions", "transcripts", "docs", "postings", "terms", "fields", "vectors", "query_vectors", "text_vectors", "document_postings", "document_terms", "document_fields")

#: Columns of the parts that this process has read, so that they are read from the files once.
_SCHEMAS: dict[str, StructType] = {}


class Index:
    """The index of the tables in ``source``, in the folder ``root`` (by default in the shared folder, by the tables' state)."""

    def __init__(self, spark: SparkSession, source: str, root: str | None = None, analyzer: str = "plain", encoder: Callable[[], dense.Encoder] = dense.HashEncoder):
        self.spark, self.source, self.analyzer, self.encoder = spark, source, analyzer, encoder
        self._there: set[str] = set()
        self.root = root or shared_folder(spark, f"index/{storage.fingerprint(spark, [f'{source}/{t}.parquet' for t in TABLES])}-{FORMAT}-{analyzer}-{getattr(encoder, '__name__', 'encoder')}")

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def has(self, part: str) -> bool:
        """Whether a part is written whole: its job has been committed."""
        return storage.exists(self.spark, f"{self.path(part)}/_SUCCESS")

    def read(self, part: str) -> DataFrame:
        """A part of the index; one that isn't written whole yet is written first, with what it is made of."""
        self.ensure(part)
        path = self.path(part)
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def ensure(self, part: str) -> int | None:
        """Write a part, committed as a whole, unless it is there; the number of rows written."""
        if part in self._there or self.has(part):
            self._there.add(part)
            return None
        seen = Observation(part)
        getattr(self, f"_{part}")().observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(part))
        self._there.add(part)
        self._note(part, seen.get["n"])
        return seen.get["n"]

    def _note(self, part: str, n: int) -> None:
        self.spark.createDataFrame([(part, n)], "part string, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path('counts')}/{part}")

    def build(self) -> Index:
        """Write the parts that aren't written yet; a build that was cut short goes on where it ended."""
        for part in PARTS:
            self.ensure(part)
            if not storage.exists(self.spark, f"{self.path('counts')}/{part}/_SUCCESS"):
                self._note(part, self.read(part).count())
        return self

    def verify(self) -> DataFrame:
        """``part, n_written, n_read, ok``: every part read again and counted."""
        read = reduce(DataFrame.unionByName, [self.read(p).agg(F.count("*").alias("n_read")).select(F.lit(p).alias("part"), "n_read") for p in PARTS])
        written = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path('counts')}/{p}") for p in PARTS])
        return written.withColumnRenamed("n", "n_written").join(read, "part").withColumn("ok", F.col("n_written") == F.col("n_read"))

    def drop(self) -> None:
        for part in PARTS:
            _SCHEMAS.pop(self.path(part), None)
        storage.delete(self.spark, self.root)

    # --- the parts ---

    def _raw(self, name: str) -> DataFrame:
        return table(self.spark, self.source, name)

    def _frames(self) -> DataFrame:
        return ingest.archive_frames(self._raw("frames"))

    def _captions(self) -> DataFrame:
        return ingest.archive_captions(self._raw("augmented_captions"))

    def _transcripts(self) -> DataFrame:
        return ingest.archive_transcripts(self._raw("transcript_aligned"))

    def _docs(self) -> DataFrame:
        return ingest.index_documents(self.read("frames"), self.read("transcripts"), self.read("captions"))

    def _postings(self) -> DataFrame:
        split = TOKENIZERS[self.analyzer]
        d = self.read("docs")
        parts = [sparse.postings_with_length(d, c, split).select(F.lit(f).alias("field"), "*") for f, c in FIELDS.items()]
        # Rebalanced by term, so that a term's rows lie together, and a term of very many rows in several files.
        return reduce(DataFrame.unionByName, parts).hint("rebalance", "field", "term").sortWithinPartitions("field", "term")

    def _terms(self) -> DataFrame:
        return self.read("postings").groupBy("field", "term").agg(F.count("*").alias("df"))

    def _fields(self) -> DataFrame:
        # Lengths stand in the postings; a document without words has none there, but counts.
        words = self.read("postings").groupBy("field").agg(F.sum("tf").alias("words"))
        names = self.spark.createDataFrame([(f,) for f in FIELDS], "field string")
        n = self.read("docs").agg(F.count("*").alias("n_docs"))
        return names.join(words, "field", "left").crossJoin(n).select("field", "n_docs", (F.coalesce("words", F.lit(0)) / F.col("n_docs")).alias("avg_len"))

    def _vectors(self) -> DataFrame:
        return ingest.archive_vectors(self._raw("siglip2_index")).withColumn("norm", norm(F.col("vec")))

    def _query_vectors(self) -> DataFrame:
        """Qn looks like the first usable frame whose row number ends in n - 1: a stand-in for a text tower."""
        v = self.read("vectors").withColumn("n", F.col("manifest_row_index") % 10)
        g = v.groupBy("n").agg(F.min_by("vec", "manifest_row_index").alias("vec"))
        return g.select(F.concat(F.lit("Q"), (F.col("n") + 1).cast("string")).alias("query_id"), "vec")

    def _text_vectors(self) -> DataFrame:
        t = self.read("transcripts").select(F.lit("transcript").alias("field"), F.col("row_index").cast("long").alias("row_index"), "frame_id", F.col("raw_text").alias("text"))
        c = self.read("captions").select(F.lit("caption").alias("field"), F.lit(0).cast("long").alias("row_index"), "frame_id", F.col("caption").alias("text"))
        texts = t.unionByName(c).where("frame_id is not null and text is not null")
        v = dense.encode(texts, "text", self.encoder).drop("text").withColumn("norm", norm(F.col("vec")))
        # A text without words has a zero vector, which is like nothing.
        return v.where("norm > 0")

    def _document_split(self):
        return TOKENIZERS["words" if self.analyzer == "plain" else self.analyzer]

    def _document_postings(self) -> DataFrame:
        p = sparse.postings_with_length(self._raw("documents"), "text", self._document_split(), "doc_id")
        return p.select(F.lit("document").alias("field"), "*").hint("rebalance", "term").sortWithinPartitions("term")

    def _document_terms(self) -> DataFrame:
        return self.read("document_postings").groupBy("field", "term").agg(F.count("*").alias("df"))

    def _document_fields(self) -> DataFrame:
        d = self._raw("documents")
        # Lengths stand in the postings; a document without words has none there, but counts.
        words = self.read("document_postings").agg(F.sum("tf").alias("words"))
        return d.agg(F.count("*").alias("n_docs")).crossJoin(words).select(F.lit("document").alias("field"), "n_docs", (F.coalesce("words", F.lit(0)) / F.col("n_docs")).alias("avg_len"))
