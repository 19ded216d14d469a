from pathlib import Path

import pytest

import __spark_entry__ as entry
from frameloom.plans.catalogue import QUERIES
from frameloom.plans.oracle import ORACLE

DATA = Path("/root/testdata/sf0.001")


def test_every_query_has_a_statement():
    assert set(QUERIES) - set(ORACLE) == {"analyze_stemmed"} and set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["scan_frames", "ocr_gate", "decimate", "sliding_transcript", "temporal_dedup", "bm25_topk", "fusion_topk", "interval_overlap", "rocchio", "qaff_score", "prefusion_gate", "tier_stats", "hot_by_query", "postings", "chunk_filter", "index_build", "index_checks", "scan_transcripts", "scan_jsonl_strict", "manifest_sink", "run_evaluation", "results_json", "pool_candidates", "join_inner_strict", "top10_assert"])
def test_query_equals_its_statement(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    a = QUERIES[name](spark, str(DATA))
    b = c.sql(ORACLE[name])
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "frame_id", "score", "rank"] and df.count() > 0


def test_tiers_are_read_in_any_spelling(spark, tmp_path):
    from frameloom.plans.archive import Archive

    rows = [(1, "a__day1__08_0001", "tier:warm", 0.15, "1"), (2, "a__day1__08_0002", "hot", 0.3, "1"), (2, "a__day1__08_0002", "\uff57\uff41\uff52\uff4d", 0.14, "2"), (3, "a__day1__08_0003", "<hot>", 0.25, "1"), (4, "a__day1__08_0004", "cold_tier", 0.05, "1"), (5, "a__day1__08_0005", "hot or cold", 0.1, "1"), (6, "a__day1__08_0006", "warm.", None, "1"), (7, "a__day1__08_0007", None, 0.2, "1")]
    q = spark.createDataFrame([(i, f, None, s, 0, t, at) for i, f, t, s, at in rows], "manifest_idx int, frame_id string, full_path_resized string, relevance_score double, best_query_id int, tier string, scored_at string")
    q.write.parquet(str(tmp_path / "qaff_classified.parquet"))
    a = Archive(spark, str(tmp_path))
    assert {(r.manifest_idx, r.tier, r.relevance_score) for r in a.tiers().collect()} == {(1, "warm", 0.15), (2, "warm", 0.14), (3, "hot", 0.25), (4, "cold", 0.05)}
    assert [r.frame_id for r in a.qrels().collect()] == ["a__day1__08_0003"]


def test_documents_are_indexed_by_words_of_any_script(spark, tmp_path):
    spark.createDataFrame([(1, "Außen, quién derrière außen"), (2, "日本 час 42"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.term, r.doc_id, r.tf) for r in QUERIES["postings"](spark, str(tmp_path)).collect()}
    assert got == {("außen", 1, 2), ("quién", 1, 1), ("derrière", 1, 1), ("日本", 2, 1), ("час", 2, 1), ("42", 2, 1)}
    prompts = [("Q1", "Außen час", [], [], 0.5, 0.5), ("Q2", "en", [], [], 0.5, 0.5)]
    spark.createDataFrame(prompts, "query_id string, query_text string, synonyms array<string>, location_hint array<string>, w_vis double, w_text double").write.parquet(str(tmp_path / "scene_prompts.parquet"))
    assert {(r.query_id, r.doc_id) for r in QUERIES["bm25_documents"](spark, str(tmp_path)).collect()} == {("Q1", 1), ("Q1", 2)}


def test_no_chunk_with_text_is_dropped_for_a_made_up_end(spark, tmp_path):
    rows = [(1, "08", 1, 0, "a"), (2, "08", 3, 10, "b"), (3, "08", 3, 10, "c"), (4, "08", 6, 25, " "), (5, "08", 9, 40, "e"), (6, "09", 3, 10, "f")]
    t = spark.createDataFrame([(i, None, "day1", "s", h, n, o, None, x) for i, h, n, o, x in rows], "row_index long, frame_id string, day string, stream_name string, hour string, frame_index int, time_offset_sec int, transcript_text string, raw_text string")
    t.write.parquet(str(tmp_path / "transcript_aligned.parquet"))
    got = sorted(tuple(r) for r in QUERIES["chunk_filter"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 10), (2, 10, 25), (3, 10, 25), (5, 40, 3600), (6, 10, 3600)]
