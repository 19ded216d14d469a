"""Problem 4: speech transcripts into clean speaker turns.

An Aho-Corasick automaton finds everything in a chunk that may be a label, a
hesitation or the opening of an annotation; context rules decide what each hit
is; the intervals of what is no speech are subtracted from the text; windows
over a transcript carry the labels forward and build the turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ingest import chunk_place

#: Hesitation sounds; a letter in brackets may be repeated at will.
HESITATIONS = ("u(h)", "u(m)", "uh(m)", "u(h)m", "e(r)", "er(m)", "e(h)", "eh(m)", "h(m)", "m(m)", "ä(h)", "äh(m)", "ä(m)", "a(h)m", "e(u)h", "ö(h)", "öh(m)")
#: Most speakers the automaton is built for; more would not be a list that every worker holds.
MAX_SPEAKERS = 100_000
#: Most words inside brackets that still count as an annotation (a parameter of every function that reads brackets).
ANNOTATION_WORDS = 4

_TIME = regex.compile(r"[\[(<]?\b\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])>]?(?:\s*-->)?")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
#: After a name: an optional (Speaker 3), decoration, and what makes it a label.
_AFTER = regex.compile(r"(?:\*\*|__)?(?:\s*\(\s*(?:speaker|spk|s)[\s_#-]*\d+\s*\))?\s*(?:\*\*|__)?(?:\s*[:：]{1,2}|\s+[-–—]+(?=\s|$))", regex.I)
#: Three or more of a letter; the automaton reads them as two, so a hesitation may be drawn out at will.
_DRAWN = regex.compile(r"(\p{L})\1{2,}")
_CLOSERS = {"[": "]", "(": ")", "{": "}", "<": ">", "*": "*", "♪": "♪"}


def _hesitations() -> set[str]:
    out = set()
    for p in HESITATIONS:
        head, rest = p.split("(")
        letter, tail = rest.split(")")
        out |= {_shorten(head + letter * k + tail)[0] for k in (1, 2, 3)}
    # A single letter is no sound.
    return {w for w in out if len(w) > 1}


def _shorten(low: str) -> tuple[str, list[int] | None]:
    """The text with every letter that comes three times running or more written twice, and the place in ``low`` of each character left (null if all are)."""
    if _DRAWN.search(low) is None:
        return low, None
    out, places, at = [], [], 0
    for m in _DRAWN.finditer(low):
        out.append(low[at : m.start() + 2])
        places += range(at, m.start() + 2)
        at = m.end()
    out.append(low[at:])
    return "".join(out), [*places, *range(at, len(low))]


def _hits(low: str, a) -> list[tuple[int, int, str, str | None]]:
    """``(start, -length, kind, speaker)`` of the automaton's hits, in places of ``low``."""
    short, places = _shorten(low)
    found = [(end - size + 1, end + 1, kind, who) for end, (kind, size, who) in a.iter(short)]
    if places is not None:
        # A hit ends where the next character that was kept begins, so it holds the letters left out behind it.
        ends = [*places, len(low)]
        found = [(places[s], ends[e], kind, who) for s, e, kind, who in found]
    return sorted((s, s - e, kind, who) for s, e, kind, who in found)


def _misspelt(name: str) -> set[str]:
    """The name with a letter doubled, lost, or exchanged with its neighbour."""
    n = range(len(name))
    return {name[: i + 1] + name[i:] for i in n} | {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in n[:-1]} | ({name[:i] + name[i + 1 :] for i in n} if len(name) > 4 else set())


@cache
def automaton(speakers: tuple[tuple[int | None, str], ...]):
    """Automaton over lower-case text; payload ``(kind, length, speaker)``."""
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, tuple[str, str | None]] = {w: ("hesitation", None) for w in _hesitations()}
    words |= {o: ("open", None) for o in _CLOSERS}
    spelt: dict[str, set[str]] = {}
    for _, who in speakers:
        for v in _misspelt(who.lower()):
            spelt.setdefault(v, set()).add(who)
    # A spelling that may mean two speakers means neither; a true name always wins.
    words |= {v: ("name", next(iter(s))) for v, s in spelt.items() if len(s) == 1 and v not in words}
    for no, who in speakers:
        words[who.lower()] = ("name", who)
        if no is not None:
            for n in {f"{no}", f"{no:02d}", f"{no:03d}"}:
                for p in ("speaker ", "speaker_", "speaker-", "speaker", "speaker #", "spk", "spk-", "spk_", "spk ", "s"):
                    words.setdefault(p + n, ("name", who))
    for w, (kind, who) in {_shorten(w)[0]: x for w, x in reversed(words.items())}.items():
        a.add_word(w, (kind, len(w), who))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def segments(text: str | None, speakers: tuple[tuple[int | None, str], ...], annotation_words: int = ANNOTATION_WORDS) -> list[tuple[str | None, str, int]]:
    """``(label, clean words, number of words)`` in order; the first segment has no label of its own.

    Null and blank texts hold nothing. A name without the marks of a label is a
    word like any other; so is a bracket of more than ``annotation_words`` words.
    """
    if not text or text.isspace():
        return []
    low = _lower(text)
    n = len(low)
    hits = _hits(low, automaton(speakers))
    cuts: list[tuple[int, int, str | None]] = [(m.start(), m.end(), None) for m in _TIME.finditer(low)]
    times = {i for a, b, _ in cuts for i in range(a, b)}
    done = 0
    for at, minus, kind, who in hits:
        end = at - minus
        if at < done or at in times:
            continue
        if kind == "open":
            close = low.find(_CLOSERS[low[at]], at + 1)
            if low[at] == "*" and "*" in (low[at - 1 : at], low[at + 1 : at + 2]):
                continue  # bold text: the name inside decides
            if close < 0 or "\n" in low[at:close]:
                continue
            inner = low[at + 1 : close].strip(" (")
            label = _speaker_named(inner, speakers) if low[at] in "[<" else None
            if label is None and len(_WORD.findall(inner)) > annotation_words:
                continue
            end = close + 1
            while end < n and low[end] == _CLOSERS[low[at]] and low[at] == "(":
                end += 1
            if label is not None:
                m = regex.compile(r"\s*[:：]").match(low, end)
                end = m.end() if m else end
            cuts.append((at, end, label))
            done = end
            continue
        if (at and (low[at - 1].isalnum() or low[at - 1] in "'’")) or (end < n and (low[end].isalnum() or low[end] in "'’")):
            continue
        if kind == "hesitation":
            if (at and low[at - 1] == "-" and at > 1 and low[at - 2].isalnum()) or (end + 1 < n and low[end] == "-" and low[end + 1].isalnum()):
                continue  # part of a compound
            cuts.append((at, end, None))
            done = end
        else:
            m = _AFTER.match(low, end)
            if m:
                start = at
                while start and low[start - 1] in "*_>":
                    start -= 1
                cuts.append((start, m.end(), who))
                done = m.end()
    out: list[tuple[str | None, str, int]] = []
    label, words, pos = None, [], 0
    for a, b, who in [*sorted(cuts, key=lambda c: c[:2]), (n, n, None)]:
        if a > pos:
            words += _WORD.findall(text[pos:a])
        pos = max(pos, b)
        if who is not None:
            out.append((label, " ".join(words), len(words)))
            label, words = who, []
    out.append((label, " ".join(words), len(words)))
    return out


def _speaker_named(inner: str, speakers: tuple[tuple[int | None, str], ...]) -> str | None:
    a = automaton(speakers)
    got = a.get(_shorten(inner)[0], None) if inner else None
    return got[2] if got and got[0] == "name" else None


def speaker_list(speakers: DataFrame) -> tuple[tuple[int | None, str], ...]:
    """The speakers for the automaton. Their number is checked: every worker holds them."""
    rows = speakers.where("speaker is not null").select("speaker_no", "speaker").distinct().limit(MAX_SPEAKERS + 1).collect()
    if len(rows) > MAX_SPEAKERS:
        raise ValueError(f"more than {MAX_SPEAKERS} speakers; raise MAX_SPEAKERS if every worker can hold them")
    return tuple(sorted(((r[0], r[1]) for r in rows), key=str))


def chunk_segments(transcripts: DataFrame, speakers: DataFrame, annotation_words: int = ANNOTATION_WORDS) -> DataFrame:
    """The segments of each chunk: ``stream_name, day, hour, off, row_index, seg, label, words, n_words``.

    Rows with the same row_index are one chunk. Stream, day, hour and offset are
    taken from whichever columns name them; a chunk without row_index or of
    unknown stream, day or hour belongs to no transcript and is left out; one
    of unknown offset comes first.
    """
    who = speaker_list(speakers)
    p = chunk_place()
    t = transcripts.select(
        p["stream_name"].alias("stream_name"), p["day"].alias("day"), p["hour"].alias("hour"), F.coalesce(p["time_offset_sec"], F.lit(-1)).alias("off"), F.col("row_index").cast("long").alias("row_index"), F.col("raw_text"),
    ).where("stream_name is not null and day is not null and hour is not null and row_index is not null")
    t = t.dropDuplicates(["row_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["stream_name", "day", "hour", "off", "row_index", "seg", "label", "words", "n_words"]
        for b in batches:
            rows = []
            for s, d, h, o, r, text in b.itertuples(index=False, name=None):
                rows += [(s, d, h, o, r, k, *x) for k, x in enumerate(segments(text, who, annotation_words)) if x[0] is not None or x[2]]
            yield pd.DataFrame(rows, columns=cols)

    return t.mapInPandas(run, "stream_name string, day string, hour int, off int, row_index long, seg int, label string, words string, n_words int")


def speaker_turns(transcripts: DataFrame, speakers: DataFrame, annotation_words: int = ANNOTATION_WORDS) -> DataFrame:
    """``stream_name, day, hour, turn_no, speaker, first_row, last_row, n_words, words``, in order.

    A transcript is one stream, day and hour, so its window is bounded by an
    hour of speech. Words before a transcript's first label have no speaker and
    make no turn.
    """
    key = ["stream_name", "day", "hour"]
    w = Window.partitionBy(*key).orderBy("off", "row_index", "seg")
    s = chunk_segments(transcripts, speakers, annotation_words)
    s = s.withColumn("speaker", F.last("label", ignorenulls=True).over(w)).where("n_words > 0 and speaker is not null")
    s = s.withColumn("new", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))
    s = s.withColumn("turn_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("off", "row_index", "seg")
    g = s.groupBy(*key, "turn_no", "speaker").agg(
        F.min_by("row_index", at).alias("first_row"), F.max_by("row_index", at).alias("last_row"), F.sum("n_words").alias("n_words"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "row_index", "seg", "words"))), lambda x: x["words"]), " ").alias("words"),
    )
    return g.select(*key, "turn_no", "speaker", "first_row", "last_row", "n_words", "words")
