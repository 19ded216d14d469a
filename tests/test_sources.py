import json

import pytest
from pyspark.sql import functions as F

from frameloom.sources import files
from frameloom.streaming.incremental import ingest_new, windowed_counts


def test_scan_frames_reads_the_listing_only(spark, tmp_path):
    for p in ("day1/members/anna/08_0001.webp", "day1/fixed/hall/23_0720.webp", "day2/members/anna/notes.webp", "day1/members/anna/8_1.webp", "day1/members/anna/08_0001.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    df = files.scan_frames(spark, str(tmp_path))
    got = {(r.day, r.stream_type, r.stream_name, r.hour, r.frame_index, r.time_offset_sec, r.timestamp_str) for r in df.collect()}
    assert got == {("day1", "member", "anna", 8, 1, 0, "08:00:00"), ("day1", "fixed", "hall", 23, 720, 3595, "23:59:55")}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\n", 1), ("é", 2)], "s string, n int")
    places = files.write_manifest(df, str(tmp_path))
    assert spark.read.parquet(places["parquet"]).count() == spark.read.json(places["jsonl"]).count() == 2
    assert files.first_existing(spark, [str(tmp_path / "no"), places["csv"]]) == places["csv"]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])


def test_transcripts(spark, tmp_path):
    d = tmp_path / "day1" / "Anna"
    d.mkdir(parents=True)
    (d / "08.json").write_text(json.dumps({"chunks": [{"timestamp": [0, 2.5], "text": "hi"}, {"timestamp": [3], "text": "x"}, {"timestamp": None, "text": "y"}]}))
    (d / "09.json").write_text("{broken")
    got = [(r.day, r.stream_name, r.hour, r.chunk_no, r.start_sec, r.end_sec, r.text) for r in files.scan_transcripts(spark, str(tmp_path)).orderBy("chunk_no").collect()]
    assert got == [("day1", "anna", "08", 0, 0.0, 2.5, "hi"), ("day1", "anna", "08", 1, 3.0, None, "x"), ("day1", "anna", "08", 2, None, None, "y")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n[1]\nnope\n{"a": 2}\n')
    assert [(r.line_no, r.reason) for r in files.jsonl_violations(spark, str(p)).orderBy("line_no").collect()] == [(2, "blank line"), (3, "not an object"), (4, "bad JSON")]
    with pytest.raises(Exception):
        files.scan_jsonl(spark, str(p), "a int").collect()
    assert files.scan_jsonl(spark, str(p), "a int", strict=False).where("a is not null").count() == 2


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b,c\n1,"x\ny ""q""",3\n')
    assert tuple(files.scan_csv(spark, str(p), ["b"], multi_line=True).first()) == ('x\ny "q"',)
    with pytest.raises(ValueError, match="missing"):
        files.scan_csv(spark, str(p), ["z"])


def test_results_and_submissions(spark, tmp_path):
    r = spark.createDataFrame([("Q1", "B", 1, "f", 0.5, "s", True), ("Q1", "B", 2, "lost", 0.25, None, False), ("Q1", "A", 1, "f", 1.0, "s", False)], "query_id string, approach string, rank int, frame_id string, score double, stream_name string, multi_angle boolean")
    rows = files.results_json(r).collect()
    nested = {x.query_id: json.loads(x.json) for x in rows}
    p = tmp_path / "r.json"
    p.write_text(json.dumps(nested))
    assert {tuple(x) for x in files.read_results_json(spark, str(p)).collect()} == {tuple(x) for x in r.collect()}
    meta = spark.createDataFrame([("f", "cam", 8, 3598)], "frame_id string, stream_name string, hour int, time_offset_sec int")
    e = files.export_rows(r.where("approach = 'B'"), meta)
    assert sorted(tuple(x) for x in e.collect()) == [("Q1", 1, "cam", "08:59:53", "09:00:03", "0.5000"), ("Q1", 2, "unknown", "00:00:00", "00:00:05", "0.2500")]
    files.write_tsv(e, str(tmp_path / "tsv"))
    [f] = (tmp_path / "tsv" / "query_id=Q1").glob("*.csv")
    assert f.read_text().splitlines()[0] == "1\tcam\t08:59:53\t09:00:03\t0.5000"


def test_resume_by_shard(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "shard string, v int")
    assert {r.shard for r in files.pending_shards(df, files.done_shards(spark, root)).collect()} == {"a", "b"}
    files.write_resumable(df.where("shard = 'a'"), root)
    assert {r.shard for r in files.pending_shards(df, files.done_shards(spark, root)).collect()} == {"b"}
    files.write_resumable(df.where("shard = 'b'"), root)
    assert spark.read.parquet(root).count() == 2
    k = spark.createDataFrame([("day1", None), (None, None)], "d string, s string").select(files.shard_key(F.col("d"), F.col("s")).alias("k"))
    assert [r.k for r in k.collect()] == ["day1", "unknown"]


def test_embedding_checks(spark):
    v = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [3.0, 4.0]), (5, [0.6, 0.8]), (6, [0.0, 0.0])], "i int, v array<float>")
    assert {r.i: r.reason for r in files.embedding_violations(v, "v", 2, unit=True).collect()} == {1: "null", 2: "wrong length", 3: "not finite", 4: "not unit"}


def test_streaming_ingest_reads_only_what_is_new(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df = spark.range(5).withColumn("s", F.lit("x"))
    df.write.parquet(src)
    for n in (5, 5):
        ingest_new(spark, src, df.schema, out, cp, lambda d: d.where("id < 100"), "s").awaitTermination(60)
        assert spark.read.parquet(out).count() == n
    spark.range(5, 8).withColumn("s", F.lit("y")).write.mode("append").parquet(src)
    ingest_new(spark, src, df.schema, out, cp, None, "s").awaitTermination(60)
    assert spark.read.parquet(out).count() == 8


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "a")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(src)
    q = windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(src), "t", "k").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select n from wc").collect()) == [1, 2]
