"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Overlapping chunk encoding: a long text is cut into overlapping chunks that are
pre-tokenised independently. Where two chunks overlap, the first place at which
both have a pre-token boundary is where they resynchronise; from there on they
agree, so the text is stitched there and only whole pre-tokens are encoded.
Short texts are one chunk. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters with the Unicode property White_Space, as the tokenizer's pattern sees them.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Before the last blank of a run of two or more that a non-blank follows, the published pattern always has a boundary.
#: With the text cut there, the pattern without its look-ahead finds the same pre-tokens, and faster.
_CUT = regex.compile(f"(?<=[{_WS}])(?=[{_WS}][^{_WS}])")
_DOUBLE = regex.compile(f"[{_WS}]{{2}}[^{_WS}]")
#: Fixed value: the published pre-token pattern (which the tests encode with), and the same without look-ahead.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_PLAIN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: Characters of a chunk and of the overlap of two chunks. Longer texts than CHUNK go to several tasks.
CHUNK, OVERLAP = 16_384, 512


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: ``folder``, else $FRAMELOOM_TOKENIZERS, else the installed public_tokenizers, else /opt/tokenizers."""
    if folder is None and "FRAMELOOM_TOKENIZERS" not in os.environ and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        folder = str(Path(spec.origin).parent)
    return str(Path(folder or os.environ.get("FRAMELOOM_TOKENIZERS", "/opt/tokenizers")) / name)


#: Vocabulary files that the driver has sent to this worker, by their path on the driver.
_SENT: dict[str, bytes] = {}


def receive(path: str, shared) -> None:
    """Keep the broadcast bytes of a vocabulary file in this worker."""
    if path not in _SENT:
        _SENT[path] = shared.value


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in (_SENT.get(path) or Path(path).read_bytes()).splitlines() if x)}


@cache
def encoder(path: str):
    """One encoder for each worker process."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN_PLAIN, mergeable_ranks=ranks_of(path), special_tokens={})


def encode_text(text: str | None, path: str) -> list[int]:
    """Ids of a whole text; an empty or null text has none. Lone surrogates count as U+FFFD."""
    if not text:
        return []
    enc = encoder(path)
    if _DOUBLE.search(text) is None:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in _CUT.finditer(text):
        out += enc.encode_ordinary(text[at : m.start()])
        at = m.start()
    return out + enc.encode_ordinary(text[at:])


def decode_ids(ids, path: str) -> bytes:
    """The raw bytes that the ids stand for."""
    names = _names(path)
    return b"".join(names[i] for i in ids)


@cache
def _names(path: str) -> dict[int, bytes]:
    return {v: k for k, v in ranks_of(path).items()}


#: The published pattern for this regex library, whose own white space has a few characters more.
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def boundaries(text: str, lo: int, hi: int, at: int = 0) -> list[int]:
    """Starts of the pre-tokens in ``[lo, hi]`` when ``text`` is pre-tokenised from ``at``."""
    out = []
    for m in _PRE.finditer(text, at):
        if m.start() > hi:
            break
        if m.start() >= lo:
            out.append(m.start())
    return out


def encode_chunk(text: str, first: bool, final: bool, chunk: int, overlap: int, path: str) -> tuple[list[int], list[int], list[int]]:
    """Pre-tokenise and encode one chunk with its overlap.

    ``text`` holds ``chunk`` characters and the ``overlap`` after them; the
    final chunk holds all that is left. Returns the ids of all of it, the
    boundaries in the first ``overlap`` characters, and the boundaries in the
    overlap after the chunk (counted from the next chunk's start); each
    boundary is followed by the number of ids before it.
    """
    head = [] if first else boundaries(text, 0, min(overlap, len(text)))
    tail: list[int] = []
    if not final:
        # The pattern must see what follows a boundary, unless the text ends there.
        sure = len(text) if len(text) < chunk + overlap else len(text) - 3
        tail = boundaries(text, chunk, sure)
    # A piece must not end in blanks whose split depends on what follows it.
    marks = sorted({0, *head, *tail, *(m.start() for m in _CUT.finditer(text))})
    ids: list[int] = []
    count: dict[int, int] = {}
    for a, b in zip(marks, [*marks[1:], len(text)]):
        count[a] = len(ids)
        ids += encode_text(text[a:b], path)
    return ids, [x for b in head for x in (b, count[b])], [x for b in tail for x in (b - chunk, count[b])]


def stitch(parts: list[tuple[list[int], list[int], list[int]]]) -> list[int] | None:
    """Join the chunks ``(ids, head, tail)`` of one text; null if two neighbours never resynchronise."""
    out: list[int] = []
    begin = 0
    for k, (ids, _, tail) in enumerate(parts):
        if k + 1 == len(parts):
            out += ids[begin:]
            break
        head = dict(zip(parts[k + 1][1][::2], parts[k + 1][1][1::2]))
        meet = next(((n, head[b]) for b, n in zip(tail[::2], tail[1::2]) if b in head), None)
        if meet is None or meet[0] < begin:
            return None
        out += ids[begin : meet[0]]
        begin = meet[1]
    return out


def _ids_array(lists: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    if ends[-1] >= 2**31:
        raise ValueError("one batch holds more than 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, counts_only: bool = False) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``) of every row of ``docs(doc_id, text)``.

    No special tokens; their strings in a text are ordinary text. A null or
    empty text has an empty list (0 tokens); white space is encoded as it is.
    Repeated rows come out repeated if short, and once if longer than a chunk
    (doc_id is taken as unique). Other columns are ignored.

    Texts of at most ``chunk`` characters are encoded where they are read, with
    no shuffle. Longer ones are exploded into overlapping chunks, spread over
    the cluster and stitched by document; a text whose chunks don't
    resynchronise is encoded in one piece.
    """
    path = path or vocabulary_path()
    # The driver alone reads the file (a megabyte or so); the executors get its bytes.
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def out_batch(doc_ids: pa.Array, lists: list[list[int]]) -> pa.RecordBatch:
        if counts_only:
            return pa.record_batch([doc_ids, pa.array([len(x) for x in lists], type=pa.int64())], names=["doc_id", "n_tokens"])
        return pa.record_batch([doc_ids, _ids_array(lists)], names=["doc_id", "ids"])

    schema = "doc_id long, n_tokens long" if counts_only else "doc_id long, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(path, shared)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield out_batch(part.column(0), [encode_text(t, path) for t in part.column(1).to_pylist()])

    short = d.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(whole, schema)

    n = F.floor(F.length("text") / chunk).cast("int")
    long = d.where(F.length("text") > chunk).select("doc_id", "text", n.alias("parts"))
    long = long.select("doc_id", "text", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    long = long.select("doc_id", "k", "parts", F.substring(F.col("text"), F.col("k") * chunk + 1, F.when(F.col("k") == F.col("parts") - 1, 2 * chunk).otherwise(chunk + overlap)).alias("text"))
    # The chunks of a repeated row are the same and count once; they meet by the shuffle that spreads them.
    long = long.repartition("doc_id", "k").dropDuplicates(["doc_id", "k"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(path, shared)
        for b in batches:
            rows = b.to_pydict()
            got = [encode_chunk(t, k == 0, k == p - 1, chunk, overlap, path) for t, k, p in zip(rows["text"], rows["k"], rows["parts"])]
            yield pa.record_batch(
                [b.column(0), b.column(1), *(_ids_array([g[i] for g in got]) for i in range(3))],
                names=["doc_id", "k", "ids", "head", "tail"],
            )

    enc = long.mapInArrow(chunks, "doc_id long, k int, ids array<int>, head array<int>, tail array<int>")
    # One row per document comes out anyway, so gathering its chunks holds no more than that row.
    whole_doc = enc.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "head", "tail"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(path, shared)
        for b in batches:
            for at in range(0, b.num_rows, 50):
                part = b.slice(at, 50)
                lists = []
                for parts in part.column(1).to_pylist():
                    ids = stitch([(p["ids"], p["head"], p["tail"]) for p in parts])
                    if ids is None:
                        texts = [decode_ids(p["ids"], path).decode("utf-8") for p in parts]
                        ids = encode_text("".join([*(t[:chunk] for t in texts[:-1]), texts[-1]]), path)
                    lists.append(ids)
                yield out_batch(part.column(0), lists)

    return short.unionByName(whole_doc.mapInArrow(join, schema))
