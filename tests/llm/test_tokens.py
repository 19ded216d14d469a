import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import tokens as tk

PATH = tk.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("published", pat_str=tk.PATTERN, mergeable_ranks=tk.ranks_of(PATH), special_tokens={})


ALPHABET = "ab 'stéß日本🙂  \n\t\r\x1c\x85 1२½.,!—<|endoftext|>llve"


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=ALPHABET, max_size=60))
def test_encoding_is_the_published_one_and_decodes(reference, text):
    ids = tk.encode_text(text, PATH)
    assert ids == reference.encode_ordinary(text)
    assert tk.decode_ids(ids, PATH) == text.encode()


def test_the_other_file_of_the_vocabulary_gives_the_same(reference):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tk.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello  world<|endoftext|>", "  indented\n\n\nlines ", "naïve — don't"):
        assert t.encode(text, add_special_tokens=False).ids == tk.encode_text(text, PATH)


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "x", "word " * 700, "a" * 3000, " " * 2500 + "end", "\n\n  " * 900, "日本語" * 800, "don't won't " * 300, "1234567890" * 300, "🙂 " * 900, "<|endoftext|>" * 200]
    return out + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(300, 3000))) for _ in range(60)]


def test_chunks_are_stitched_to_the_same_ids(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts())], "doc_id long, text string, ids string")
    for chunk, overlap in ((100, 20), (256, 64), (tk.CHUNK, tk.OVERLAP)):
        got = {r.doc_id: list(r.ids) for r in tk.encode_documents(df, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts())}


def test_counts_and_empty_table(spark, reference):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tk.encode_documents(df, chunk=200, overlap=50, counts_only=True).collect()}
    assert got == {i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(texts())}
    assert tk.encode_documents(df.limit(0)).count() == 0


def test_very_long_text(spark, reference):
    text = "The teapot isn't far  from the 27 chairs. " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert list(tk.encode_documents(df).first().ids) == reference.encode_ordinary(text)


def test_repeated_rows_longer_than_a_chunk_come_out_once(spark, reference):
    text = "Ein Satz, and another one; 12 numbers. " * 60
    df = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text + "end"), (3, "short"), (3, "short")], "doc_id long, text string")
    for chunk, overlap in ((500, 100), (500, 1)):
        got = sorted((r.doc_id, list(r.ids)) for r in tk.encode_documents(df, chunk=chunk, overlap=overlap).collect())
        assert got == [(1, reference.encode_ordinary(text)), (2, reference.encode_ordinary(text + "end")), *[(3, reference.encode_ordinary("short"))] * 2]


def test_executors_need_no_file(spark, tmp_path):
    """The file is read on the driver alone: it is gone when the tasks run."""
    import shutil

    from frameloom.llm import tokens

    path = str(tmp_path / "own.tiktoken")
    shutil.copy(tokens.vocabulary_path(), path)
    df = tokens.encode_documents(spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string"), path)
    (tmp_path / "own.tiktoken").unlink()
    assert {r.doc_id: bool(r.ids) for r in df.collect()} == {1: True, 2: False}
