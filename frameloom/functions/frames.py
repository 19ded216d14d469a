"""Column expressions for frame identity: canonical ids, paths, days, hours and streams.

A canonical frame id is ``stream__dayN__HH_NNNN``. All functions return native
columns, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that real tables carry around their strings: ASCII blanks and the no-break space.
_BLANK = " \t\n\x0b\x0c\r\u00a0\u3000"
FRAME_STEP_SEC = 5


def squeeze(c: Column) -> Column:
    """Lower case without any blanks at the ends; null stays null."""
    return F.lower(F.btrim(c, F.lit(_BLANK)))


def clean_stream(c: Column) -> Column:
    """Stream name in one spelling; an empty name is null."""
    return F.nullif(squeeze(c), F.lit(""))


def clean_day(c: Column) -> Column:
    """``Day02``, ``day 2`` and ``2`` become ``day2``; anything without a number is null."""
    n = F.regexp_extract(squeeze(c), r"^(?:day)?[\s_-]*0*(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("day"), n))


def clean_hour(c: Column) -> Column:
    """Hour as int from text such as ``' 9'`` or ``'09'``; unreadable is null."""
    n = F.regexp_extract(squeeze(c.cast("string")), r"^0*(\d{1,2})$", 1)
    return F.when(n != "", n.cast("int"))


def _pieces(c: Column, pattern: str) -> Column:
    """The four groups of a pattern that matches the whole text, by one evaluation of it; an empty array without a match."""
    t = F.split(F.regexp_replace(c, pattern, "$1\u0001$2\u0001$3\u0001$4"), "\u0001", -1)
    return F.filter(F.array(t), lambda x: F.size(x) == 4)


def parse_frame(frame_id: Column, path: Column | None = None, strict: bool = False) -> Column:
    """Struct ``(stream, day, hour, frame_index)`` of a frame id and, where the id lacks a part, its path.

    Accepts any case, blanks around the id, leading zeros in the day, an id
    without the day, either kind of slash and doubled slashes in the path. A
    part that neither names is null. The id wins where both name a part. With
    ``strict`` the whole struct is null unless all parts are known.
    """
    path = F.lit(None).cast("string") if path is None else path
    i = _pieces(squeeze(frame_id), r"^(.+?)__(?:day0*(\d+)__)?(\d{1,2})_(\d{1,4})$")
    p = _pieces(F.regexp_replace(squeeze(path), r"[\\/]+", "/"), r"^(?:.*/)?day0*(\d+)/[^/]+/([^/]+)/(\d{1,2})_(\d{1,4})\.[a-z0-9]+$")
    none = F.array(F.array().cast("array<string>"))

    def build(x: Column) -> Column:
        part = lambda name, k: F.nullif(F.get(F.get(x[name], F.lit(0)), F.lit(k)), F.lit(""))
        stream, day = F.coalesce(part("i", 0), part("p", 1)), F.coalesce(part("i", 1), part("p", 0))
        hour, idx = F.coalesce(part("i", 2), part("p", 2)).cast("int"), F.coalesce(part("i", 3), part("p", 3)).cast("int")
        whole = F.struct(stream.alias("stream"), F.when(day.isNotNull(), F.concat(F.lit("day"), day)).alias("day"), hour.alias("hour"), idx.alias("frame_index"))
        return F.when(stream.isNotNull() & day.isNotNull() & hour.isNotNull() & idx.isNotNull(), whole) if strict else whole

    # A one-element array binds the split texts to a name, so the patterns run once however often a part is used.
    # The path is looked at only where the id lacks a part.
    whole = lambda x: (F.size(x) == 1) & ~F.array_contains(F.coalesce(F.get(x, F.lit(0)), F.array().cast("array<string>")), "")
    both = F.transform(F.array(F.coalesce(i, none)), lambda x: F.struct(x.alias("i"), F.when(whole(x), none).otherwise(F.coalesce(p, none)).alias("p")))
    return F.get(F.transform(both, build), F.lit(0))


def frame_id_of(stream: Column, day: Column, hour: Column, frame_index: Column) -> Column:
    """Canonical frame id; null if any part is null."""
    return F.when(
        stream.isNotNull() & day.isNotNull() & hour.isNotNull() & frame_index.isNotNull(),
        F.concat_ws("__", stream, day, F.format_string("%02d_%04d", hour, frame_index)),
    )


def stream_of(frame_id: Column) -> Column:
    """Stream name in a canonical frame id."""
    return F.substring_index(frame_id, "__", 1)


def offset_of(frame_index: Column) -> Column:
    """Seconds into the hour at which a frame was taken."""
    return (frame_index - 1) * FRAME_STEP_SEC


def is_valid_frame_id(c: Column) -> Column:
    """True for a canonical, lower-case three-segment id."""
    return F.coalesce((c == F.lower(c)) & (F.size(F.split(c, "__")) == 3) & c.rlike(r"^.+__day[0-9]+__[0-9]{2}_[0-9]{4}$"), F.lit(False))


def hms(total_sec: Column) -> Column:
    """``HH:MM:SS`` of a number of seconds since midnight, without wrapping at 24 h."""
    s = total_sec.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def parse_hms(c: Column) -> Column:
    """Seconds of ``HH:MM:SS[.fff]``; null if it isn't of that form."""
    p = F.split(c, ":")
    ok = c.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$")
    return F.when(ok, F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double"))
