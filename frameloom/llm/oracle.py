"""DuckDB statements of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_BLANK = r"^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$"


def _squeeze(c: str) -> str:
    return f"lower(regexp_replace({c}, '{_BLANK}', '', 'g'))"


_RUNS = rf"""
WITH raw AS (
  SELECT {_squeeze('frame_id')} AS i, regexp_replace({_squeeze('full_path_resized')}, '[\\/]+', '/', 'g') AS p, scored_at,
         list_distinct(regexp_extract_all(regexp_replace(translate({_squeeze('tier')}, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ',
           'abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz'), '[^a-z]+', '  ', 'g'), '(?:^| )(hot|warm|cold)(?: |$)', 1)) AS tiers
  FROM qaff_classified),
named AS (
  SELECT coalesce(nullif(regexp_extract(i, '^(.+?)__(?:day0*(\d+)__)?(\d{{1,2}})_(\d{{1,4}})$', 1), ''), nullif(regexp_extract(p, '(?:^|/)day0*(\d+)/[^/]+/([^/]+)/(\d{{1,2}})_(\d{{1,4}})\.[a-z0-9]+$', 2), '')) AS stream,
         coalesce(nullif(regexp_extract(i, '^(.+?)__(?:day0*(\d+)__)?(\d{{1,2}})_(\d{{1,4}})$', 2), ''), nullif(regexp_extract(p, '(?:^|/)day0*(\d+)/[^/]+/([^/]+)/(\d{{1,2}})_(\d{{1,4}})\.[a-z0-9]+$', 1), '')) AS day,
         cast(coalesce(nullif(regexp_extract(i, '^(.+?)__(?:day0*(\d+)__)?(\d{{1,2}})_(\d{{1,4}})$', 3), ''), nullif(regexp_extract(p, '(?:^|/)day0*(\d+)/[^/]+/([^/]+)/(\d{{1,2}})_(\d{{1,4}})\.[a-z0-9]+$', 3), '')) AS integer) AS hour,
         cast(coalesce(nullif(regexp_extract(i, '^(.+?)__(?:day0*(\d+)__)?(\d{{1,2}})_(\d{{1,4}})$', 4), ''), nullif(regexp_extract(p, '(?:^|/)day0*(\d+)/[^/]+/([^/]+)/(\d{{1,2}})_(\d{{1,4}})\.[a-z0-9]+$', 4), '')) AS integer) AS idx,
         tiers[1] AS tier, scored_at
  FROM raw WHERE len(tiers) = 1),
ev AS (
  SELECT stream, day, hour * 3600 + (idx - 1) * 5 AS t, printf('%02d_%04d', hour, idx) AS stamp, tier
  FROM named WHERE stream IS NOT NULL AND day IS NOT NULL AND hour IS NOT NULL AND idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY stream, day, hour, idx ORDER BY scored_at DESC NULLS LAST, tier DESC) = 1),
cut AS (
  SELECT *, CASE WHEN tier = lag(tier) OVER w AND t - lag(t) OVER w <= 15 THEN 0 ELSE 1 END AS fresh
  FROM ev WINDOW w AS (PARTITION BY stream, day ORDER BY t)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY stream, day ORDER BY t) AS run FROM cut),
runs AS (
  SELECT stream AS stream_name, 'day' || day AS day, tier, stream || '__day' || day || '__' || arg_min(stamp, t) AS first_frame_id,
         stream || '__day' || day || '__' || arg_max(stamp, t) AS last_frame_id, count(*) AS n_frames, cast(max(t) - min(t) AS integer) AS duration_sec
  FROM num GROUP BY stream, day, run, tier)
"""

_TEXTS = r"""
WITH texts AS (
  SELECT DISTINCT 'caption' AS text_field, cast(manifest_row_index AS bigint) AS row_key, caption AS text FROM augmented_captions WHERE manifest_row_index IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'raw_text', row_index, raw_text FROM transcript_aligned WHERE row_index IS NOT NULL),
lists AS (SELECT row_number() OVER () AS id, text_field, row_key, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM texts),
words AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM lists),
tri AS (
  SELECT id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS t FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
old AS (SELECT id, i, row_number() OVER (PARTITION BY id, t ORDER BY i) > 1 AS again FROM tri WHERE t IS NOT NULL),
hit AS (SELECT DISTINCT id, i + d AS i FROM old, range(0, 3) r(d) WHERE again),
shares AS (
  SELECT l.text_field, l.row_key, cast(len(l.w) AS integer) AS n_words, CASE WHEN len(l.w) = 0 THEN 0.0 ELSE count(h.i) / len(l.w)::double END AS share
  FROM lists l LEFT JOIN hit h USING (id) GROUP BY l.id, l.text_field, l.row_key, l.w)
"""

#: The parts of a transcript's text: time stamps, what may be a label, bracketed asides, words.
_STAMP = r"[\[(<]?\b\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])>]?(?:\s*-->)?"
_NUMBER = r"(?:speaker[ _-]?#?|spk[-_ ]?|s)0{0,2}(\d+)"
_MARKS = r"(?:\*\*|__)?(?:\s*\(\s*(?:speaker|spk|s)[\s_#-]*\d+\s*\))?\s*(?:\*\*|__)?(?:\s*[:：]{1,2}|\s+[-–—]+(?:\s|$))"
_LABEL = rf"(?:\*\*|__)?(?:{_NUMBER}|(\p{{L}}+)){_MARKS}"
_ASIDE = r"\[[^\]\n]*\]|<[^>\n]*>|\(+[^)\n]*\)+|\{[^}\n]*\}|\*[^*\n]+\*|♪[^♪\n]*♪"
_SPOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*"
_HESITATION = r"uh+m?|um+|uhm+|erm*|er+|ehm*|eh+|hm+|mm+|ähm*|äh+|äm+|ah+m|eu+h|öhm*|öh+"


def _bare(pattern: str) -> str:
    """The same pattern without groups that capture."""
    return pattern.replace(r"(\d+)", r"\d+").replace(r"(\p{L}+)", r"\p{L}+")


_TURNS = rf"""
WITH tr AS (
  SELECT DISTINCT ON (row_index) row_index, coalesce(nullif({_squeeze('stream_name')}, ''), regexp_extract({_squeeze('frame_id')}, '^(.+?)__', 1)) AS stream_name,
         'day' || coalesce(nullif(ltrim(regexp_extract({_squeeze('day')}, '(\d+)$', 1), '0'), ''), regexp_extract({_squeeze('frame_id')}, '__day0*(\d+)__', 1)) AS day,
         coalesce(try_cast(trim(hour) AS integer), try_cast(regexp_extract({_squeeze('frame_id')}, '__(\d+)_\d+$', 1) AS integer)) AS hour,
         coalesce(time_offset_sec, (frame_index - 1) * 5, (try_cast(regexp_extract(frame_id, '_(\d+)\s*$', 1) AS integer) - 1) * 5, -1) AS off, raw_text
  FROM transcript_aligned WHERE row_index IS NOT NULL),
spelt AS (
  SELECT v, min(speaker) AS speaker FROM (
    SELECT speaker, unnest(list_concat(
      list_transform(range(1, length(speaker) + 1), lambda i: speaker[1:i] || speaker[i:]),
      list_transform(range(1, length(speaker)), lambda i: speaker[1:i - 1] || speaker[i + 1:i + 1] || speaker[i:i] || speaker[i + 2:]),
      CASE WHEN length(speaker) > 4 THEN list_transform(range(1, length(speaker) + 1), lambda i: speaker[1:i - 1] || speaker[i + 1:]) ELSE [] END)) AS v
    FROM (SELECT DISTINCT lower(speaker) AS speaker FROM speakers WHERE speaker IS NOT NULL))
  WHERE v NOT IN (SELECT lower(speaker) FROM speakers WHERE speaker IS NOT NULL) GROUP BY v HAVING count(DISTINCT speaker) = 1),
known AS (SELECT DISTINCT lower(speaker) AS v, speaker FROM speakers WHERE speaker IS NOT NULL UNION ALL SELECT v, s.speaker FROM spelt JOIN speakers s ON lower(s.speaker) = spelt.speaker
  UNION ALL SELECT DISTINCT speaker_no::varchar, speaker FROM speakers WHERE speaker IS NOT NULL AND speaker_no IS NOT NULL),
tok AS (
  SELECT stream_name, day, hour, off, row_index, unnest(t) AS tok, unnest(range(len(t))) AS i FROM (
    SELECT *, regexp_extract_all(raw_text, $$(?i){_STAMP}|{_bare(_LABEL)}|{_ASIDE}|{_SPOKEN}$$) AS t FROM tr WHERE raw_text IS NOT NULL AND stream_name IS NOT NULL AND day IS NOT NULL AND hour IS NOT NULL)),
kind AS (
  SELECT *, regexp_full_match(tok, $$(?i){_STAMP}$$) AS stamp, regexp_full_match(tok, $$(?i){_ASIDE}$$) AS aside,
         CASE WHEN regexp_full_match(tok, $$(?i){_bare(_LABEL)}$$) THEN coalesce(nullif(regexp_extract(tok, $$(?i)^{_LABEL}$$, 1), ''), lower(regexp_extract(tok, $$(?i)^{_LABEL}$$, 2)))
              WHEN regexp_matches(tok, '^[\[<]') THEN coalesce(nullif(regexp_extract(lower(tok), $$^[\[<]\s*{_NUMBER}\s*[\]>]$$, 1), ''), trim(lower(tok), '[]<> ')) END AS says
  FROM tok),
named AS (
  SELECT k.* EXCLUDE (says), known.speaker AS label,
         CASE WHEN stamp OR known.speaker IS NOT NULL OR (aside AND len(regexp_extract_all(tok, $${_SPOKEN}$$)) <= 4) THEN [] ELSE list_filter(regexp_extract_all(tok, $${_SPOKEN}$$), lambda w: NOT regexp_full_match(lower(w), '{_HESITATION}')) END AS words
  FROM kind k LEFT JOIN known ON known.v = k.says AND NOT stamp),
said AS (
  SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY stream_name, day, hour ORDER BY off, row_index, i ROWS UNBOUNDED PRECEDING) AS speaker FROM named),
spoken AS (
  SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS fresh FROM said WHERE speaker IS NOT NULL AND len(words) > 0 WINDOW w AS (PARTITION BY stream_name, day, hour ORDER BY off, row_index, i)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_name, day, hour ORDER BY off, row_index, i) AS turn FROM spoken),
turns AS (
  SELECT stream_name, day, hour, turn::bigint AS turn_no, speaker, arg_min(row_index, (off, row_index, i)) AS first_row, arg_max(row_index, (off, row_index, i)) AS last_row, sum(len(words))::bigint AS n_words,
         string_agg(array_to_string(words, ' '), ' ' ORDER BY off, row_index, i) AS words
  FROM num GROUP BY stream_name, day, hour, turn, speaker)
"""

ORACLE = {
    "p4_found": _TURNS + "SELECT first_row, last_row, speaker FROM turns",
    "p4_turns": _TURNS + "SELECT * FROM turns",
    "p1_found": _RUNS + "SELECT first_frame_id, last_frame_id FROM runs WHERE n_frames >= 2",
    "p1_runs": _RUNS + "SELECT * FROM runs",
    "p2_found": """
WITH v AS (
  SELECT manifest_row_index AS id, any_value(vec::double[]) AS v FROM siglip2_index
  WHERE vec IS NOT NULL AND manifest_row_index IS NOT NULL AND len(list_filter(vec, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id),
top AS (SELECT a, b, s FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS row_a, greatest(a, b) AS row_b FROM top WHERE s >= 0.85""",
    "p3_found": rf"""
WITH m AS (
  SELECT DISTINCT mark_id, {_squeeze('stream_name')} AS stream, ltrim(regexp_extract({_squeeze('day')}, '(\d+)$', 1), '0') AS day, hour * 3600 + mark_sec AS t
  FROM voice_marks WHERE stream_name IS NOT NULL AND day IS NOT NULL),
c AS (
  SELECT DISTINCT {_squeeze('stream_name')} AS stream, ltrim(regexp_extract({_squeeze('day')}, '(\d+)$', 1), '0') AS day, cast(trim(hour) AS integer) AS hour,
         coalesce(time_offset_sec, (frame_index - 1) * 5, (cast(nullif(regexp_extract(frame_id, '_(\d+)$', 1), '') AS integer) - 1) * 5) AS off,
         coalesce(frame_index, cast(nullif(regexp_extract(frame_id, '_(\d+)$', 1), '') AS integer), cast(round_even(time_offset_sec / 5.0, 0) AS integer) + 1) AS idx
  FROM transcript_aligned),
near AS (
  SELECT m.mark_id, printf('%s__day%s__%02d_%04d', c.stream, c.day, c.hour, c.idx) AS frame_id, abs(c.hour * 3600 + c.off - m.t) AS dt
  FROM m JOIN c ON m.stream = c.stream AND m.day = c.day AND abs(c.hour * 3600 + c.off - m.t) <= 10)
SELECT mark_id, frame_id FROM near QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY dt, frame_id) = 1""",
    "p5_found": _TEXTS + "SELECT DISTINCT text_field, row_key FROM shares WHERE n_words >= 8 AND share >= 0.4",
    "p5_shares": _TEXTS + "SELECT text_field, row_key, n_words, round(share, 6) AS repeated_share FROM shares",
    "p8_found": """
WITH g AS (
  SELECT DISTINCT doc_id, md5(substring(text, i + 1, 150)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
many AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT h, list_sort(list(doc_id)) AS ids FROM g WHERE h IN (SELECT h FROM many) GROUP BY h),
u AS (SELECT DISTINCT ids FROM s)
SELECT DISTINCT a AS doc_a, b AS doc_b FROM (SELECT a, unnest(ids) AS b FROM (SELECT ids, unnest(ids) AS a FROM u)) WHERE a < b""",
    "p8_shares": """
WITH g AS (
  SELECT doc_id, i, md5(substring(text, i + 1, 150)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
many AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM g WHERE h IN (SELECT h FROM many)),
cover AS (SELECT doc_id, sum(least(150, coalesce(j - i, 150))) AS shared FROM hit GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0)::bigint AS n_chars, coalesce(shared, 0)::bigint AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared, 0) / length(text), 6) ELSE 0.0 END AS share
FROM documents LEFT JOIN cover USING (doc_id)""",
}
