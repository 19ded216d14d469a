"""Sources and sinks: manifests, transcripts, JSONL, CSV, vectors, result files, resumable shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import hms, offset_of
from .storage import exists

TRANSCRIPT_SCHEMA = T.StructType([T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("timestamp", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])))])


def derive_frames(paths: DataFrame, path: str = "path") -> DataFrame:
    """Frame rows of ``.../dayN/{members,fixed}/<stream>/HH_NNNN.<ext>`` paths; other names drop out."""
    rx = r"(?i)(day\d+)/(members|fixed)/([^/]+)/(\d{2})_(\d{4})\.[a-z0-9]+$"
    p = F.col(path)
    at = lambda g: F.regexp_extract(p, rx, g)
    hour, idx = at(4).cast("int"), at(5).cast("int")
    off = offset_of(idx)
    return paths.where(p.rlike(rx)).select(
        p.alias("full_path"), F.lower(at(1)).alias("day"), F.when(F.lower(at(2)) == "fixed", "fixed").otherwise("member").alias("stream_type"), F.lower(at(3)).alias("stream_name"),
        F.concat_ws("_", at(4), at(5)).alias("filename"), hour.alias("hour"), idx.alias("frame_index"), off.alias("time_offset_sec"), hms(hour * 3600 + off).alias("timestamp_str"),
    )


def scan_frames(spark: SparkSession, root: str, pattern: str = "*.webp") -> DataFrame:
    """Enumerate image files below ``root``. Only the listing is used: the content column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return derive_frames(files)


def write_manifest(frames: DataFrame, root: str) -> dict[str, str]:
    """Write a manifest as Parquet, JSONL and CSV with a header; returns the places."""
    places = {k: f"{root}/{k}" for k in ("parquet", "jsonl", "csv")}
    frames.write.mode("overwrite").parquet(places["parquet"])
    frames.write.mode("overwrite").json(places["jsonl"])
    frames.write.mode("overwrite").option("header", True).option("escape", '"').csv(places["csv"])
    return places


#: Where a transcript file's path names day, person and hour, as three groups.
TRANSCRIPT_PATH = r"(?i)(day\d+)/([^/]+)/(\d{1,2})\.json$"


def scan_transcripts(spark: SparkSession, root: str, pattern: str = "*.json", path: str = TRANSCRIPT_PATH) -> DataFrame:
    """Chunks of transcript files, one document each: ``day, stream_name, hour, chunk_no, start_sec, end_sec, text, n_bounds``.

    A malformed file has no chunks and drops out. The path names day, person
    and hour: ``path`` is a pattern with these three groups, by default that of
    ``.../dayN/<person>/HH.json``.
    """
    raw = spark.read.schema(TRANSCRIPT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    p = F.col("_metadata.file_path")
    return raw.select(
        F.lower(F.regexp_extract(p, path, 1)).alias("day"), F.lower(F.regexp_extract(p, path, 2)).alias("stream_name"), F.lpad(F.regexp_extract(p, path, 3), 2, "0").alias("hour"), F.posexplode("chunks").alias("chunk_no", "chunk"),
    ).select("day", "stream_name", "hour", "chunk_no", F.get("chunk.timestamp", F.lit(0)).alias("start_sec"), F.get("chunk.timestamp", F.lit(1)).alias("end_sec"), F.col("chunk.text").alias("text"), F.size("chunk.timestamp").alias("n_bounds"))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict reading fails at the first line that is no object of the schema; else such lines are null rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files of any size.

    Files are split and read line by line; a line's place in its part comes
    from the order in which the part is read, and the parts' numbers of lines
    are added up over the parts of a file, one row for each. ``line_no`` starts
    at 1.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    # The reading task numbers its rows in order; a part of a file lies in one task.
    parts = t.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return t.join(parts.select("file", "block", "first", "before"), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line"))


def jsonl_violations(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, reason`` of blank lines and lines that are no JSON object."""
    v = F.try_parse_json(F.col("line"))
    reason = F.when(F.trim("line") == "", "blank line").when(v.isNull(), "bad JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    return numbered_lines(spark, path).select("file", "line_no", reason.alias("reason")).where("reason is not null")


def scan_csv(spark: SparkSession, path: str, required: list[str], schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header; missing required columns are an error, and only those asked for are read.

    Files are split among tasks; with ``multi_line`` quoted values may hold
    line breaks, and each file is read by one task.
    """
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = (r.schema(schema) if schema else r).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing} in {path}")
    return df.select(*required)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of several paths that exists, on whatever file system."""
    for p in candidates:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {candidates} exists")


def embedding_violations(vectors: DataFrame, vec: str, dim: int, unit: bool = False) -> DataFrame:
    """Rows whose vector is null, of another length, not finite, or (if asked) not of unit norm."""
    from ..functions.vectors import is_unit

    v = F.col(vec)
    reason = F.when(v.isNull(), "null").when(F.size(v) != dim, "wrong length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    if unit:
        reason = reason.when(~is_unit(v), "not unit")
    return vectors.withColumn("reason", reason).where("reason is not null")


def results_json(ranked: DataFrame) -> DataFrame:
    """One row for each query: ``query_id, json`` with its ranked lists by approach."""
    item = F.struct("rank", "frame_id", "score", "stream_name", "multi_angle")
    per = ranked.groupBy("query_id", "approach").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return per.groupBy("query_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("approach", "items"))))).alias("json"))


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """The flat ranked table of a nested query -> approach -> list file."""
    item = "array<struct<rank:int,frame_id:string,score:double,stream_name:string,multi_angle:boolean>>"
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", f"map<string,map<string,{item}>>")).alias("query_id", "lists"))
    return m.select("query_id", F.explode("lists").alias("approach", "items")).select("query_id", "approach", F.inline("items"))


def export_rows(ranked: DataFrame, meta: DataFrame, window_sec: float = 5.0) -> DataFrame:
    """``query_id, rank, stream_name, start_time, end_time, score`` of a submission.

    The start is clamped within its hour; the end carries into the next. An
    unknown frame has hour 0 and offset 0 and keeps its own stream name.
    """
    m = meta.select("frame_id", F.col("stream_name").alias("known"), "hour", F.col("time_offset_sec").cast("double").alias("off"))
    r = ranked.join(m, "frame_id", "left")
    hour, off = F.coalesce("hour", F.lit(0)), F.coalesce("off", F.lit(0.0))
    at = lambda x: hms(hour * 3600 + F.floor(x))
    return r.select("query_id", "rank", F.coalesce("known", "stream_name", F.lit("unknown")).alias("stream_name"), at(F.greatest(F.lit(0.0), off - window_sec)).alias("start_time"), at(off + window_sec).alias("end_time"), F.format_string("%.4f", F.col("score").cast("double")).alias("score"))


def write_tsv(rows: DataFrame, root: str) -> None:
    """Headerless tab-separated files, one folder for each query."""
    rows.repartition("query_id").sortWithinPartitions("query_id", "rank").write.mode("overwrite").partitionBy("query_id").option("sep", "\t").csv(root)


def read_tsv(spark: SparkSession, root: str) -> DataFrame:
    """The rows of submission files: ``query_id, rank, stream_name, start_time, end_time, score`` (the folder names the query)."""
    return spark.read.schema("rank int, stream_name string, start_time string, end_time string, score string, query_id string").option("sep", "\t").csv(root).select("query_id", "rank", "stream_name", "start_time", "end_time", "score")


def shard_key(*parts: Column) -> Column:
    """Shard name: the known parts joined by ``__``; 'unknown' if none is known."""
    return F.coalesce(F.nullif(F.concat_ws("__", *parts), F.lit("")), F.lit("unknown"))


def pending_shards(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The shards of ``wanted(shard)`` that ``done(shard)`` doesn't have."""
    return wanted.select("shard").distinct().join(done.select("shard").distinct(), "shard", "left_anti")


def write_resumable(df: DataFrame, root: str, shard: str = "shard") -> None:
    """Write by shard, replacing only the shards that ``df`` has."""
    df.repartition(shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(root)


def done_shards(spark: SparkSession, root: str, shard: str = "shard") -> DataFrame:
    """The shards already written (from the partition folders; none if the root doesn't exist)."""
    if not exists(spark, root):
        return spark.createDataFrame([], "shard string")
    return spark.read.parquet(root).select(F.col(shard).cast("string").alias("shard")).distinct()
