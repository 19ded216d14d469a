"""Every query by name: (spark, directory of the tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames as ff
from ..functions import scores as fs
from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import curate, dense, evaluate, fuse, ingest, joins, rank, sparse
from ..session import checkpointed, shared_folder
from ..sources import files, storage
from . import approaches as ap
from .archive import Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Parameters of the demonstration queries.
KEYWORD_TIERS = [["first-person view", "closing the hatch"], ["person", "people"], ["image", "room"]]
CONFIRM_WORDS = ["reminder", "wait", "step two"]
WARM_BITS, COLD_BITS = 30, 34


def query(f: Callable[[Archive], DataFrame]) -> Callable[[Archive], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
    QUERIES[f.__name__].__doc__ = f.__doc__
    return f


def _six(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


def _events(a: Archive) -> DataFrame:
    """A large ranked list: every classified frame, scored, one list for each best query."""
    t = a.tiers().where("frame_id is not null").groupBy("frame_id").agg(F.max_by(F.struct("best_query_id", "relevance_score"), "manifest_idx").alias("r"))
    return t.select(F.concat(F.lit("Q"), (F.col("r.best_query_id") + 1).cast("string")).alias("query_id"), "frame_id", F.col("r.relevance_score").alias("score"))


# --- sources and sinks -------------------------------------------------------------------------------------------


@query
def scan_frames(a: Archive) -> DataFrame:
    """Frame rows from file paths."""
    return files.derive_frames(a.raw("frames").select(F.col("full_path").alias("path")).distinct())


def _place(a: Archive, name: str) -> str:
    """Where a query that writes and reads again keeps its files."""
    return shared_folder(a.spark, f"round_trips/{storage.fingerprint(a.spark, [a.root])}/{name}")


_MANIFEST = ["frame_id", "stream_name", "day", "hour", "frame_index", "time_offset_sec", "stream_type", "timestamp_str", "full_path"]


@query
def manifest_sink(a: Archive) -> DataFrame:
    """The manifest written as Parquet, JSONL and CSV, each read again whole."""
    m = a.frames().select(*_MANIFEST)
    at = files.write_manifest(m, _place(a, "manifest_sink"))
    read = {"parquet": a.spark.read.parquet(at["parquet"]), "jsonl": files.scan_jsonl(a.spark, at["jsonl"], m.schema), "csv": files.scan_csv(a.spark, at["csv"], _MANIFEST, m.schema)}
    return joins.union_all(*[d.select(F.lit(k).alias("kind"), *_MANIFEST) for k, d in read.items()])


@query
def scan_transcripts(a: Archive) -> DataFrame:
    """S3: transcripts written as one JSON document for each hour, and a broken one, then read as files."""
    key = ["day", "stream_name", "hour"]
    item = F.struct("time_offset_sec", "row_index", "raw_text")
    t = a.transcripts().where("time_offset_sec is not null and stream_name is not null and day is not null and hour is not null")
    g = t.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("c"))  # an hour of speech
    chunk = lambda x: F.struct(F.array(x["time_offset_sec"].cast("double"), x["time_offset_sec"] + 5.0).alias("timestamp"), x["raw_text"].alias("text"))
    docs = g.select(*key, F.to_json(F.struct(F.transform("c", chunk).alias("chunks"))).alias("value"))
    broken = a.spark.createDataFrame([("day0", "broken", 0, '{"chunks": [')], "day string, stream_name string, hour int, value string")
    at = _place(a, "scan_transcripts")
    docs.unionByName(broken).write.mode("overwrite").partitionBy(*key).text(at)
    return files.scan_transcripts(a.spark, at, "*.txt", r"day=(day\d+)/stream_name=([^/]+)/hour=(\d{1,2})/[^/]+$").drop("n_bounds")


@query
def scan_jsonl_strict(a: Archive) -> DataFrame:
    """Captions as JSON lines by stream, with a blank line for a null one, a list for an empty one and a cut line for one without OCR text, then checked line by line."""
    c = a.captions().select("frame_id", "manifest_row_index", "caption", "ocr_text", ff.stream_of(F.col("frame_id")).alias("shard"))
    line = F.when(F.col("caption").isNull(), "").when(F.trim("caption") == "", "[1]").when(F.coalesce(F.trim("ocr_text"), F.lit("")) == "", '{"frame_id": ').otherwise(F.to_json(F.struct("frame_id", "caption")))
    at = _place(a, "scan_jsonl_strict")
    c.withColumn("value", line).repartition("shard").sortWithinPartitions("shard", "manifest_row_index", "frame_id").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(at)
    return files.jsonl_violations(a.spark, at).select(F.regexp_extract("file", r"shard=([^/]+)/", 1).alias("shard"), "line_no", "reason")


@query
def scan_csv_header(a: Archive) -> DataFrame:
    """Two columns of the manifest's CSV file, types from the schema asked for."""
    at = files.write_manifest(a.frames().select(*_MANIFEST), _place(a, "scan_csv_header"))
    return files.scan_csv(a.spark, at["csv"], ["frame_id", "hour"], a.frames().select(*_MANIFEST).schema)


@query
def scan_first_existing(a: Archive) -> DataFrame:
    """The manifest from the first of four places that exists."""
    at = files.write_manifest(a.frames().select(*_MANIFEST), _place(a, "scan_first_existing"))
    found = files.first_existing(a.spark, [at["csv"] + "-old", at["jsonl"] + "-old", at["jsonl"], at["csv"]])
    kind = "jsonl" if found == at["jsonl"] else "other"
    return files.scan_jsonl(a.spark, found, a.frames().select(*_MANIFEST).schema).groupBy("stream_name").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))


@query
def scan_embeddings(a: Archive) -> DataFrame:
    """Vectors that are null, of a wrong length or not finite."""
    v = files.embedding_violations(a.raw("siglip2_index"), "vec", 64)
    return v.select("manifest_row_index", "reason").distinct()


@query
def results_json(a: Archive) -> DataFrame:
    """Nested results of approach B, one JSON text for each query."""
    r = rank.finish(ap.approach_b(a), a.frames()).withColumn("approach", F.lit("B")).withColumn("score", F.round("score", 4))
    return files.results_json(r)


@query
def export_windows(a: Archive) -> DataFrame:
    """Submission rows of approach B, written as one TSV file for each query and read again."""
    r = rank.finish(ap.approach_b(a), a.frames())
    at = _place(a, "export_windows")
    files.write_tsv(files.export_rows(r, a.frames()), at)
    return files.read_tsv(a.spark, at)


@query
def index_docs(a: Archive) -> DataFrame:
    """Inverted-index documents."""
    return a.docs()


@query
def index_build(a: Archive) -> DataFrame:
    """The lasting index, built where it isn't there yet, then every part read again and counted."""
    return a.index.build().verify()


@query
def index_verify(a: Archive) -> DataFrame:
    """Number of documents, and three spot-check terms with the three best documents of each."""
    q = a.spark.createDataFrame([("cup", "cup"), ("mug", "mug"), ("image", "image")], "query_id string, query_text string")
    top = dense.rank_topk(ap.bm25(a, q, ("caption",)).withColumnRenamed("caption", "score"), 3)
    return _six(top).crossJoin(F.broadcast(a.index.read("fields").where("field = 'caption'").select("n_docs")))


@query
def vector_index_build(a: Archive) -> DataFrame:
    """The index read again: count, dimension, rows whose stored norm isn't that of the vector, and rows that aren't of unit norm once normalised."""
    v = a.vectors()
    wrong = F.abs(F.col("norm") - fv.norm(F.col("vec"))) > 1e-9 * F.col("norm")
    return v.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("dim_min"), F.max(F.size("vec")).alias("dim_max"), F.count_if(wrong).alias("wrong_norm"), F.count_if(~fv.is_unit(fv.l2_normalise(F.col("vec")))).alias("not_unit"))


@query
def row_map_build(a: Archive) -> DataFrame:
    """Vectors in index order with their manifest rows."""
    order = a.vectors().select(F.col("manifest_row_index").alias("row_index"), "frame_id")
    return joins.row_map(order, a.frames())


@query
def index_checks(a: Archive) -> DataFrame:
    """Frames with a vector but no manifest row, and frame ids that come twice; checked over the index and three planted rows."""
    first = a.vectors().agg(F.min("frame_id").alias("frame_id"))
    planted = a.spark.createDataFrame([("ghost__day1__08_0001",), ("ghost__day1__08_0002",)], "frame_id string")
    v = joins.union_all(a.vectors().select("frame_id"), first, planted)
    missing = joins.unmatched(v, a.frames(), ["frame_id"]).select("frame_id", F.lit("missing").alias("problem"))
    return missing.unionByName(joins.duplicates(v, "frame_id").select("frame_id", F.lit("twice").alias("problem")))


@query
def pending_shards(a: Archive) -> DataFrame:
    """Hours of a stream-day that have frames but no caption yet."""
    hour = lambda c: F.format_string("%02d", c)
    wanted = a.frames().select(files.shard_key(F.col("stream_name"), F.col("day"), hour(F.col("hour"))).alias("shard"))
    f = ff.parse_frame(F.col("frame_id"))
    done = a.raw("augmented_captions").where("caption is not null").select(files.shard_key(f["stream"], f["day"], hour(f["hour"])).alias("shard"))
    return files.pending_shards(wanted, done)


@query
def shard_keys(a: Archive) -> DataFrame:
    """Rows of each shard by day, type and stream; an unknown type is left out of the name."""
    return a.frames().groupBy(files.shard_key(F.col("day"), F.col("stream_type"), F.col("stream_name")).alias("shard")).agg(F.count("*").alias("n"))


# --- row transforms ----------------------------------------------------------------------------------------------


@query
def frame_times(a: Archive) -> DataFrame:
    """Offset in the hour and clock time of each frame."""
    off = ff.offset_of(F.col("frame_index"))
    return a.frames().select("frame_id", off.alias("offset_sec"), ff.hms(F.col("hour") * 3600 + off).alias("clock"))


@query
def frame_index_of_marks(a: Archive) -> DataFrame:
    """Frame shown at each mark, halves rounded to even."""
    m = a.raw("voice_marks").select("mark_id", "mark_sec").distinct()
    return m.select("mark_id", ingest.frame_index_from_sec(F.floor("mark_sec") / 2).alias("frame_index"))


@query
def chunk_filter(a: Archive) -> DataFrame:
    """Chunks with text and positive length; a chunk ends where the next later one of its hour starts, the last with the hour."""
    later = Window.partitionBy("stream_name", "day", "hour").orderBy(F.desc("time_offset_sec")).rangeBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.min("time_offset_sec").over(later), F.lit(3600))
    t = a.transcripts().where("time_offset_sec is not null").select("row_index", F.col("time_offset_sec").alias("start_sec"), end.alias("end_sec"), F.col("raw_text").alias("text"))
    return ingest.valid_chunks(t).select("row_index", "start_sec", "end_sec")


@query
def parse_frame_ids(a: Archive) -> DataFrame:
    """Ids and paths of the classified frames in canonical form, and whether the id was canonical."""
    q = a.raw("qaff_classified").select("manifest_idx", "frame_id", "full_path_resized").distinct()
    f = ff.parse_frame(F.col("frame_id"), F.col("full_path_resized"))
    q = q.select("manifest_idx", ff.is_valid_frame_id(F.col("frame_id")).alias("was_valid"), f.alias("f"))
    return q.select("manifest_idx", "was_valid", ff.frame_id_of(F.col("f.stream"), F.col("f.day"), F.col("f.hour"), F.col("f.frame_index")).alias("frame_id"))


@query
def parse_hms(a: Archive) -> DataFrame:
    """P5: seconds of the time stamps."""
    return a.frames().select("frame_id", ff.parse_hms(F.col("timestamp_str")).alias("sec"))


@query
def caption_filter(a: Archive) -> DataFrame:
    """Short captions dropped, OCR text appended."""
    return curate.filter_captions(a.captions()).select("frame_id", "caption")


@query
def caption_filter_check(a: Archive) -> DataFrame:
    """The captions that are too short, before the filter and after it (none then)."""
    both = {"before": a.captions(), "after": curate.filter_captions(a.captions())}
    return joins.union_all(*[curate.short_captions(c).select(F.lit(n).alias("stage"), "frame_id") for n, c in both.items()])


def _gated(a: Archive) -> DataFrame:
    """Captions gated with a stand-in OCR vector: embedding number manifest_row_index mod 500."""
    e = a.raw("embeddings").select("vec_id", F.col("embedding").alias("ocr_vec"))
    c = a.captions().select("frame_id", "caption", "ocr_text", "manifest_row_index").withColumn("vec_id", (F.col("manifest_row_index") % 500).cast("long")).join(e, "vec_id", "left")
    return curate.ocr_gate(c.drop("vec_id"), a.vectors().dropDuplicates(["frame_id"]))


@query
def ocr_gate(a: Archive) -> DataFrame:
    """OCR text kept or stripped by its likeness to the frame."""
    return _gated(a).select("frame_id", "caption", "ocr_text", "ocr_sim", "ocr_gate")


@query
def strip_ocr_suffix(a: Archive) -> DataFrame:
    """Captions without their OCR suffix."""
    return a.captions().select("frame_id", ft.strip_suffix(F.col("caption"), F.col("ocr_text")).alias("caption"))


def _hashed(a: Archive) -> DataFrame:
    v = a.vectors().select(F.col("manifest_row_index").alias("manifest_idx"), curate.phash_bits(F.col("vec")).alias("phash"))
    return a.tiers().where("frame_id is not null").join(v, "manifest_idx", "left")


@query
def decimate(a: Archive) -> DataFrame:
    """Frames kept by tier and change of their hash."""
    return curate.decimate(_hashed(a), WARM_BITS, COLD_BITS).select("manifest_idx", "frame_id", "tier")


@query
def tier_classify(a: Archive) -> DataFrame:
    """P10: tiers of the stored scores, rounded first."""
    q = a.raw("qaff_classified").select("manifest_idx", F.round("relevance_score", 4).alias("s")).distinct().where("s is not null")
    return q.select("manifest_idx", F.col("s").alias("relevance_score"), fs.tier_of(F.col("s")).alias("tier"))


@query
def histogram(a: Archive) -> DataFrame:
    """Score bands."""
    return curate.histogram(a.tiers())


@query
def location_filter(a: Archive) -> DataFrame:
    """Caption scores after the penalty by place."""
    return _six(fuse.location_penalty(ap.bm25_caption(a), a.frames(), a.queries()))


@query
def fusion_penalty(a: Archive) -> DataFrame:
    """Visual scores after the fixed-camera and caption-pattern penalties."""
    return _six(fuse.fusion_penalty(ap.approach_b(a).select("query_id", "frame_id", "score"), a.frames(), a.captions(), ap.FIXED_PENALTY_QUERIES, ap.PATTERNS))


@query
def clamp_score(a: Archive) -> DataFrame:
    """Scores forced into [0, 1], odd ones to 0."""
    s = a.raw("voice_marks").select("mark_id", "confidence", "mark_sec").distinct()
    x = F.when(F.col("mark_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("confidence") * 3 - 1)
    return s.select("mark_id", F.round(fs.clamp(x), 6).alias("score"))


@query
def keyword_boost(a: Archive) -> DataFrame:
    """Approach B blended with caption keyword tiers, de-duplicated, ten best."""
    s = fuse.keyword_boost(ap.approach_b(a).select("query_id", "frame_id", "score"), a.captions(), KEYWORD_TIERS)
    return _six(rank.renumber(rank.temporal_dedup(s, a.frames()), 10))


@query
def score_badge(a: Archive) -> DataFrame:
    """Traffic light of the visual scores."""
    return ap.approach_b(a).select("query_id", "frame_id", fs.badge(F.col("score")).alias("badge"))


@query
def image_path(a: Archive) -> DataFrame:
    """Image path by stream type; an unknown type looks under members."""
    folder = F.when(F.col("stream_type") == "fixed", "fixed").otherwise("members")
    return a.frames().select("frame_id", F.format_string("footage_768/%s/%s/%s/%02d_%04d.webp", "day", folder, "stream_name", "hour", "frame_index").alias("path"))


# --- joins -------------------------------------------------------------------------------------------------------


@query
def join_left_default(a: Archive) -> DataFrame:
    """Captions of all frames, an empty or missing one replaced."""
    j = joins.left_with_default(a.frames().select("frame_id", "stream_name"), a.captions().select("frame_id", "caption"), "frame_id", {"caption": "none"}, empty_is_missing=True)
    return j.select("frame_id", "stream_name", "caption")


@query
def join_full_outer_scores(a: Archive) -> DataFrame:
    """The four signals side by side, missing ones 0."""
    return _six(fuse.merge_signals(ap.signals(a)), *fuse.SIGNALS)


@query
def join_inner_strict(a: Archive) -> DataFrame:
    """Captions with their frames, those without a frame reported, among them a planted one."""
    planted = a.spark.createDataFrame([("ghost__day1__08_0001", -1)], "frame_id string, manifest_row_index int")
    c = a.captions().select("frame_id", "manifest_row_index").unionByName(planted)
    return joins.inner_strict(c, a.frames().select("frame_id", "stream_name"), "frame_id", "report").select("frame_id", "manifest_row_index", "stream_name", "problem")


@query
def join_semi_pool(a: Archive) -> DataFrame:
    """Captions of pooled frames only."""
    return a.captions().join(ap.approach_b(a).select("frame_id"), "frame_id", "left_semi").select("frame_id", "caption")


@query
def join_anti_pending(a: Archive) -> DataFrame:
    """Classified frames that have no caption."""
    t = a.tiers().where("frame_id is not null").select("manifest_idx", "frame_id", "tier")
    return t.join(a.captions().select("frame_id"), "frame_id", "left_anti")


@query
def interval_overlap(a: Archive) -> DataFrame:
    """Hot frames confirmed by words spoken around them."""
    key = ["stream_name", "day", "hour"]
    p = a.tiers().where("tier = 'hot' and frame_id is not null").select("frame_id", *key, ff.offset_of(F.col("frame_index")).cast("double").alias("t")).distinct()
    c = a.transcripts().where("time_offset_sec is not null").select(*key, F.col("time_offset_sec").cast("double").alias("start_sec"), (F.col("time_offset_sec") + 5.0).alias("end_sec"), F.col("raw_text").alias("text"))
    return joins.confirm_by_text(p, c, key, CONFIRM_WORDS)


@query
def cross_query_frame(a: Archive) -> DataFrame:
    """Best and mean cosine of every query over all frames."""
    s = dense.cosine_scores(a.query_vectors(), a.vectors())
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query
def qrels_membership(a: Archive) -> DataFrame:
    """Ranked visual hits with their relevance."""
    r = ap.approach_b(a).select("query_id", "frame_id", "rank")
    return r.join(a.qrels().withColumn("rel", F.lit(1)), ["query_id", "frame_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


# --- aggregations ------------------------------------------------------------------------------------------------


@query
def concat_text_by_frame(a: Archive) -> DataFrame:
    """G1: texts of a frame in order."""
    return ingest.concat_text_by_frame(a.transcripts().where("frame_id is not null"), "raw_text")


@query
def max_score_per_frame(a: Archive) -> DataFrame:
    """Best stored score of each frame."""
    return a.raw("qaff_classified").where("relevance_score is not null").groupBy("manifest_idx").agg(F.max("relevance_score").alias("score"))


@query
def max_normalise(a: Archive) -> DataFrame:
    """Stored scores divided by the largest of their query."""
    return _six(_events(a).withColumn("score", fs.max_normalise(F.col("score"), "query_id")))


@query
def tier_stats(a: Archive) -> DataFrame:
    """Counts and shares of the tiers, and the upload estimate."""
    return curate.tier_stats(a.tiers())


@query
def hot_by_query(a: Archive) -> DataFrame:
    """Hot frames of each query."""
    return curate.hot_by_query(a.tiers())


@query
def stream_means(a: Archive) -> DataFrame:
    """Streams of the highest and lowest mean score."""
    return curate.stream_means(a.tiers())


@query
def similarity_stats(a: Archive) -> DataFrame:
    """Distribution of the gate's similarities."""
    return curate.similarity_stats(_gated(a), "ocr_sim")


@query
def gate_counters(a: Archive) -> DataFrame:
    """Counts over the gated captions."""
    return curate.gate_counters(_gated(a))


@query
def filter_counters(a: Archive) -> DataFrame:
    """Counts over the caption filter."""
    return curate.filter_counters(a.captions())


@query
def corpus_stats(a: Archive) -> DataFrame:
    """Empty texts and mean words."""
    return curate.corpus_stats(a.transcripts(), "raw_text")


@query
def precision_at_10(a: Archive) -> DataFrame:
    """Precision of approaches B and C."""
    b = ap.approach_b(a).withColumn("approach", F.lit("B"))
    c = ap.approach_c(a).withColumn("approach", F.lit("C"))
    return evaluate.precision_at_k(b.unionByName(c), a.qrels())


@query
def mean_precision(a: Archive) -> DataFrame:
    """Mean precision of approach B."""
    return evaluate.mean_precision(evaluate.precision_at_k(ap.approach_b(a).withColumn("approach", F.lit("B")), a.qrels()))


@query
def best_approach_note(a: Archive) -> DataFrame:
    """Winner of each query among approaches A to D, by precision at 10."""
    parts = ap.signals(a)
    c = checkpointed(ap.approach_c(a, parts=parts))
    lists = {"A": parts["bm25"], "B": parts["visual"], "C": c, "D": ap.approach_d(a, c=c)}
    ranked = joins.union_all(*[d.select("query_id", "frame_id", "rank", F.lit(n).alias("approach")) for n, d in lists.items()])
    return evaluate.best_approaches(evaluate.precision_at_k(ranked, a.qrels()))


def _two_lists(a: Archive) -> DataFrame:
    b = rank.finish(ap.approach_b(a), a.frames()).withColumn("approach", F.lit("B"))
    s = rank.finish(ap.approach_a(a), a.frames()).withColumn("approach", F.lit("A"))
    return b.unionByName(s)


@query
def pool_candidates(a: Archive) -> DataFrame:
    """Pooled heads of the lists of A and B."""
    return _six(evaluate.pool(_two_lists(a)), "best_score")


@query
def overlap_counts(a: Archive) -> DataFrame:
    """Frames that the heads of A and C share."""
    s = ap.approach_a(a).withColumn("approach", F.lit("A"))
    return evaluate.overlaps(s.unionByName(ap.approach_c(a).withColumn("approach", F.lit("C"))), 50)


@query
def most_common(a: Archive) -> DataFrame:
    """The three streams with most frames."""
    return evaluate.most_common(a.frames(), "stream_name")


@query
def gt_by_query(a: Archive) -> DataFrame:
    """Relevant frames of each query in natural order."""
    return evaluate.relevant_counts(a.qrels()).withColumn("place", F.row_number().over(Window.orderBy(evaluate.natural())))


# --- windows, sorts, sets ----------------------------------------------------------------------------------------


@query
def sliding_transcript(a: Archive) -> DataFrame:
    """Texts within ten seconds of each chunk."""
    t = a.transcripts().where("time_offset_sec is not null and stream_name is not null")
    return ingest.sliding_text(t.drop("transcript_text"), ["stream_name", "day", "hour"], "time_offset_sec", "raw_text", "row_index").select("row_index", "transcript_text")


@query
def rank_topk(a: Archive) -> DataFrame:
    """The fifty best frames of each query."""
    return dense.rank_topk(_events(a), 50)


@query
def temporal_dedup(a: Archive) -> DataFrame:
    """Greedy de-duplication of the whole classified archive, by stream, numbered anew."""
    return rank.renumber(rank.temporal_dedup(_events(a), a.frames()))


@query
def temporal_dedup_scoped(a: Archive) -> DataFrame:
    """The same within stream, day and hour."""
    return rank.temporal_dedup(_events(a), a.frames(), scope="stream_day_hour")


@query
def cross_stream_flag(a: Archive) -> DataFrame:
    """Frames of a list that another stream shows at the same time."""
    return rank.cross_stream_flag(_events(a), a.frames()).select("query_id", "frame_id", "multi_angle")


@query
def vector_topk(a: Archive) -> DataFrame:
    """L1: the fifty nearest frames of each query vector."""
    return _six(dense.topk_vectors(a.query_vectors(), a.vectors(), 50))


@query
def vector_topk_matmul(a: Archive) -> DataFrame:
    """L1: the same by matrix products over Arrow batches."""
    return _six(dense.topk_matmul(a.query_vectors(), a.vectors(), 50))


@query
def topk_overfetch_dedup(a: Archive) -> DataFrame:
    """L2: best transcript chunks by dense text, over-fetched, then one for each frame."""
    return _six(ap.dense_text(a)[0])


@query
def topk_exact_dedup(a: Archive) -> DataFrame:
    """L2: the same over all chunks."""
    return _six(ap.dense_text(a, exact=True)[0])


@query
def multi_key_sort(a: Archive) -> DataFrame:
    """L3, V9: re-ranked candidates by blend, logit, fusion score and id."""
    return _six(fuse.rerank_hybrid(ap.overlap_logits(a, ap.approach_b(a).select("query_id", "frame_id", "score"))))


@query
def top10_assert(a: Archive) -> DataFrame:
    """L4: lists of another length than ten among the finished lists of approach B and those of the threshold cascade."""
    b = ap.approach_b(a)
    short = rank.threshold_cascade(b.select("query_id", "frame_id", "score"), 0.99999, 0.9)
    lists = {"B": rank.finish(b, a.frames()), "cascade": short}
    long = joins.union_all(*[d.select(F.concat_ws("|", "query_id", F.lit(n)).alias("query_id")) for n, d in lists.items()])
    return rank.length_violations(long, 10, exact=True)


@query
def threshold_cascade(a: Archive) -> DataFrame:
    """Frames by falling thresholds, at most fifteen."""
    return _six(rank.threshold_cascade(ap.approach_b(a).select("query_id", "frame_id", "score"), 0.99999, 0.9))


@query
def union_keys(a: Archive) -> DataFrame:
    """Frames that any table knows."""
    return joins.union_keys([a.captions(), a.vectors(), a.frames()], "frame_id")


@query
def intersect_counts(a: Archive) -> DataFrame:
    """Frames with captions, with vectors, with both."""
    return joins.intersect_counts(a.captions(), a.vectors(), "frame_id")


@query
def difference(a: Archive) -> DataFrame:
    """U4: frames with a vector but no caption."""
    return joins.unmatched(a.vectors(), a.captions(), ["frame_id"])


@query
def schema_equal(a: Archive) -> DataFrame:
    """Whether two tables have the same columns."""
    same = joins.schema_equal(a.raw("frames"), a.raw("frames").select(*reversed(a.raw("frames").columns)))
    return a.spark.createDataFrame([(same, joins.schema_equal(a.raw("frames"), a.raw("speakers")))], "same boolean, other boolean")


# --- text and retrieval ------------------------------------------------------------------------------------------


@query
def clean_text(a: Archive) -> DataFrame:
    """Transcript texts without punctuation and stop words."""
    return a.transcripts().select("row_index", ft.clean_text(F.col("raw_text")).alias("raw_text"), ft.clean_text(F.col("transcript_text")).alias("transcript_text"))


@query
def expand_query(a: Archive) -> DataFrame:
    """Prompts with their synonyms."""
    return a.queries().select("query_id", F.col("query_text").alias("expanded"))


@query
def analyze(a: Archive) -> DataFrame:
    """Tokens of the captions, stop words dropped."""
    stop = F.array(*[F.lit(w) for w in ft.STOPWORDS])
    t = a.captions().select("frame_id", F.posexplode(F.filter(ft.tokens(F.col("caption")), lambda w: ~F.array_contains(stop, w))).alias("pos", "token"))
    return t


@query
def analyze_stemmed(a: Archive) -> DataFrame:
    """The same with stems (optional; the index takes them with ``analyzer="stemmed"``)."""
    return a.captions().select("frame_id", F.posexplode(ft.stemmed(F.col("caption"))).alias("pos", "token"))


@query
def postings(a: Archive) -> DataFrame:
    """T4: inverted index of the documents table, words of any script."""
    return sparse.postings(a.raw("documents"), "text", "doc_id", ft.words)


@query
def field_stats(a: Archive) -> DataFrame:
    """T4: number of documents and mean length of the caption field, as the index holds them."""
    return _six(a.index.read("fields").where("field = 'caption'").select("n_docs", "avg_len"), "avg_len")


@query
def bm25_topk(a: Archive) -> DataFrame:
    """T5: BM25 over captions, fifty best."""
    return _six(dense.rank_topk(ap.bm25_caption(a), 50))


@query
def bm25_documents(a: Archive) -> DataFrame:
    """T5: BM25 over the long documents, words of any script, fifty best."""
    return _six(dense.rank_topk(ap.bm25_documents(a), 50, "doc_id"))


@query
def bm25_combined(a: Archive) -> DataFrame:
    """Both fields, weighted."""
    return _six(ap.bm25_combined(a))


@query
def approach_a(a: Archive) -> DataFrame:
    """Sparse approach."""
    return _six(ap.approach_a(a))


@query
def l2_normalise(a: Archive) -> DataFrame:
    """V1: every value of each normalised vector."""
    v = dense.normalised(a.vectors())
    return v.select("manifest_row_index", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query
def cosine(a: Archive) -> DataFrame:
    """V2: cosine of each vector with the next one in index order."""
    v = a.vectors()
    n = v.select((F.col("manifest_row_index") - 1).alias("manifest_row_index"), F.col("vec").alias("other"))
    return v.join(n, "manifest_row_index").select("manifest_row_index", F.round(fv.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query
def unit_norm_check(a: Archive) -> DataFrame:
    """V3: stored embeddings and index vectors that are not of unit norm."""
    e = a.raw("embeddings").agg(F.count_if(~fv.is_unit(F.col("embedding"))).alias("n")).select(F.lit("embeddings").alias("name"), "n")
    return e.unionByName(a.vectors().agg(F.count_if(~fv.is_unit(F.col("vec"))).alias("n")).select(F.lit("siglip2_index").alias("name"), "n"))


@query
def approach_b(a: Archive) -> DataFrame:
    """V4: visual approach."""
    return _six(ap.approach_b(a))


@query
def dense_captions(a: Archive) -> DataFrame:
    """V5: dense text over captions."""
    return _six(ap.dense_text(a)[1])


@query
def fusion_topk(a: Archive) -> DataFrame:
    """V6, V7, P13, P14 (flagship): weighted late fusion of all four signals, fifty best of each query."""
    return _six(ap.approach_c(a))


@query
def fusion_weights(a: Archive) -> DataFrame:
    """V7: weights of the queries, and of an unknown one."""
    q = a.queries().select("query_id").unionByName(a.spark.createDataFrame([("CUSTOM",)], "query_id string"))
    return q.join(a.queries().select("query_id", "w_vis", "w_text"), "query_id", "left").fillna({"w_vis": 0.5, "w_text": 0.5})


@query
def prefusion_gate(a: Archive) -> DataFrame:
    """V8: report of the gate over the four signals, a list beyond [0, 1], and one with scores that are null or no numbers."""
    s = ap.signals(a)
    odd = s["visual"].withColumn("score", F.when(F.col("rank") == 1, F.lit(None)).when(F.col("rank") <= 3, F.lit(float("nan"))).when(F.col("rank") == 4, F.lit(float("inf"))).otherwise(F.col("score")))
    s = s | {"broken": _events(a).withColumn("score", F.col("score") * 10), "odd": odd}
    return _six(fuse.gate_report(s), "top")


@query
def rerank_hybrid(a: Archive) -> DataFrame:
    """V9: re-ranked fusion, de-duplicated, ten best."""
    r = checkpointed(fuse.rerank_hybrid(ap.overlap_logits(a, checkpointed(ap.approach_c(a)))).select("query_id", "frame_id", "score"))
    return _six(rank.renumber(rank.temporal_dedup(r, ap.only(a.frames(), r)), 10))


@query
def approach_d(a: Archive) -> DataFrame:
    """Re-ranking approach."""
    return _six(ap.approach_d(a))


@query
def approach_d_as_shipped(a: Archive) -> DataFrame:
    """The same with the fallbacks that override the re-ranker."""
    return _six(ap.approach_d(a, "as_shipped"))


@query
def rocchio(a: Archive) -> DataFrame:
    """Search again, each query moved towards its fifth hit."""
    anchors = ap.approach_b(a).where("rank = 5").select("query_id", "frame_id")
    return _six(ap.rocchio_search(a, anchors, 50))


@query
def qaff_score(a: Archive) -> DataFrame:
    """Best query, rounded score and tier of each frame."""
    q = a.query_vectors().select((F.regexp_extract("query_id", r"(\d+)$", 1).cast("int") - 1).alias("query_id"), "qvec")
    return curate.best_query_per_frame(dense.best_query(q, a.vectors(), qvec="qvec"), 0.4, 0.3)


@query
def metadata_proximity(a: Archive) -> DataFrame:
    """Whether a top hit's caption has a synonym of the query."""
    return evaluate.proximity_check(ap.approach_a(a), a.captions(), a.queries().select("query_id", "synonyms"), 50)


@query
def run_evaluation(a: Archive) -> DataFrame:
    """All queries by approaches A to D, as the batch run writes them."""
    return ap.run_all(a)
