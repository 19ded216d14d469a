"""DuckDB statements of the catalogue's queries, put together from shared table expressions."""

from __future__ import annotations

from ..functions.text import PUNCTUATION, STOPWORDS

# --- shared table expressions: name -> (needs, SQL) ---------------------------------------------------------------

_USABLE = "len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
_ID = r"^(.+?)__(?:day0*(\d+)__)?(\d{1,2})_(\d{1,4})$"
_PATH = r"(?:^|/)day0*(\d+)/[^/]+/([^/]+)/(\d{1,2})_(\d{1,4})\.[a-z0-9]+$"
_BLANK = r"^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$"


def _sq(c: str) -> str:
    return f"lower(regexp_replace({c}, '{_BLANK}', '', 'g'))"


def _part(i: str, p: str, g: int) -> str:
    at = {1: 2, 2: 1, 3: 3, 4: 4}[g]
    return f"coalesce(nullif(regexp_extract({i}, '{_ID}', {g}), ''), nullif(regexp_extract({p}, '{_PATH}', {at}), ''))"


def _parse(i: str, p: str, g: int) -> str:
    return _part(_sq(i), rf"regexp_replace({_sq(p)}, '[\\/]+', '/', 'g')", g)


_CANON = f"{_parse('frame_id', 'full_path_resized', 1)} || '__day' || {_parse('frame_id', 'full_path_resized', 2)} || '__' || printf('%02d_%04d', cast({_parse('frame_id', 'full_path_resized', 3)} AS integer), cast({_parse('frame_id', 'full_path_resized', 4)} AS integer))"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_ANY = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{M}}\p{{N}}]+')"
_WORDS = r"CASE WHEN trim(coalesce({0}, '')) = '' THEN 0 ELSE len(regexp_split_to_array(trim({0}), '\s+')) END"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"

#: Full-width letters of the tiers' words, beside the plain ones.
_NARROW = "lower(translate(tier, 'ＡＣＤＨＬＭＯＲＴＷａｃｄｈｌｍｏｒｔｗ', 'acdhlmortwacdhlmortw'))"


#: Six places of a score that has nine, halves upwards.
_SIX = "cast(round(cast(score AS decimal(18, 9)), 6) AS double) AS score"


def _says(word: str) -> str:
    return f"regexp_matches({_NARROW}, '(^|[^a-z]){word}([^a-z]|$)')"


def _tier() -> str:
    """The tier a text names, if it names one only."""
    alone = lambda t, *others: f"WHEN {_says(t)} AND NOT ({' OR '.join(_says(o) for o in others)}) THEN '{t}'"
    return f"CASE {alone('hot', 'warm', 'cold')} {alone('warm', 'hot', 'cold')} {alone('cold', 'hot', 'warm')} END"


_CTE: dict[str, tuple[str, str]] = {
    "fr": ("", """SELECT stream_name || '__' || day || '__' || printf('%02d_%04d', hour, frame_index) AS frame_id, max(stream_name) AS stream_name, max(day) AS day, max(hour) AS hour, max(frame_index) AS frame_index,
        max(time_offset_sec) AS time_offset_sec, max(stream_type) AS stream_type, max(full_path) AS full_path,
        coalesce(max(timestamp_str), printf('%02d:%02d:%02d', (max(hour) * 3600 + max(time_offset_sec)) // 3600, (max(hour) * 3600 + max(time_offset_sec)) % 3600 // 60, max(time_offset_sec) % 60)) AS timestamp_str
        FROM frames GROUP BY 1"""),
    "cap": ("", "SELECT * FROM augmented_captions WHERE frame_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY manifest_row_index DESC, caption DESC NULLS LAST) = 1"),
    "tr0": ("", rf"""SELECT DISTINCT ON (row_index) row_index, {_sq('stream_name')} AS stream_name, 'day' || ltrim(regexp_extract({_sq('day')}, '(\d+)$', 1), '0') AS day, cast(trim(hour) AS integer) AS hour,
        coalesce(time_offset_sec, (frame_index - 1) * 5, (cast(nullif(regexp_extract(frame_id, '_(\d+)$', 1), '') AS integer) - 1) * 5) AS time_offset_sec,
        coalesce(frame_index, cast(nullif(regexp_extract(frame_id, '_(\d+)$', 1), '') AS integer), cast(round_even(time_offset_sec / 5.0, 0) AS integer) + 1) AS frame_index, raw_text, transcript_text
        FROM transcript_aligned"""),
    "tr": ("tr0", "SELECT *, stream_name || '__' || day || '__' || printf('%02d_%04d', hour, frame_index) AS frame_id FROM tr0"),
    "vec": ("", f"SELECT manifest_row_index, any_value(frame_id) AS frame_id, any_value(vec::double[]) AS vec FROM siglip2_index WHERE vec IS NOT NULL AND {_USABLE} GROUP BY 1"),
    "qv": ("vec", "SELECT 'Q' || (manifest_row_index % 10 + 1) AS query_id, arg_min(vec, manifest_row_index) AS qvec FROM vec GROUP BY 1"),
    "q": ("", r"""SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS query_text, raw_query, synonyms, location_hint,
        CASE WHEN w_text > w_vis THEN 'speech' ELSE 'visual' END AS qtype, w_vis, w_text
        FROM (SELECT query_id, query_text AS raw_query, list_filter(regexp_split_to_array(query_text || ' ' || array_to_string(synonyms, ' '), '\s+'), lambda x: x <> '') AS w, synonyms, location_hint, w_vis, w_text FROM scene_prompts)"""),
    "ti": ("", f"""SELECT manifest_idx, {_CANON} AS frame_id, {_parse('frame_id', 'full_path_resized', 1)} AS stream_name, 'day' || {_parse('frame_id', 'full_path_resized', 2)} AS day,
        cast({_parse('frame_id', 'full_path_resized', 3)} AS integer) AS hour, cast({_parse('frame_id', 'full_path_resized', 4)} AS integer) AS frame_index, relevance_score, best_query_id, said AS tier
        FROM (SELECT *, {_tier()} AS said FROM qaff_classified) WHERE said IS NOT NULL AND relevance_score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY manifest_idx ORDER BY scored_at DESC NULLS LAST, said DESC, relevance_score DESC, best_query_id DESC, frame_id DESC NULLS LAST, full_path_resized DESC NULLS LAST) = 1"""),
    "qrels": ("ti", "SELECT DISTINCT 'Q' || (best_query_id + 1) AS query_id, frame_id FROM ti WHERE tier = 'hot'"),
    "ev": ("ti", "SELECT 'Q' || (arg_max(best_query_id, manifest_idx) + 1) AS query_id, frame_id, arg_max(relevance_score, manifest_idx) AS score FROM ti WHERE frame_id IS NOT NULL GROUP BY frame_id"),
    "gtext": ("tr", "SELECT frame_id, coalesce(string_agg(raw_text, ' ' ORDER BY row_index) FILTER (trim(coalesce(raw_text, '')) <> ''), '') AS text FROM tr WHERE frame_id IS NOT NULL GROUP BY 1"),
    "docs": ("fr,cap,gtext", "SELECT fr.frame_id, fr.stream_name, coalesce(g.text, '') AS transcript_text, coalesce(cap.caption, '') AS caption_text FROM fr LEFT JOIN gtext g USING (frame_id) LEFT JOIN cap USING (frame_id)"),
    "qterm": ("q", f"SELECT DISTINCT query_id, unnest({_TOK.format('query_text')}) AS term FROM q"),
    "vs": ("vec,qv", f"SELECT query_id, frame_id, round({_COS.format('qvec', 'vec')}, 9) AS score FROM vec, qv"),
    "b0": ("vs", "SELECT query_id, frame_id, score FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 50"),
    "b": ("b0", "SELECT query_id, frame_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN round(score / max(score) OVER (PARTITION BY query_id), 9) ELSE 0 END AS score FROM b0"),
    "ab": ("bmcap,bmtr,q", "SELECT query_id, frame_id, round(sum(score), 9) AS score FROM (SELECT query_id, frame_id, score * 0.7 AS score FROM bmtr UNION ALL SELECT query_id, frame_id, score * 0.3 FROM bmcap) GROUP BY 1, 2"),
    "a1": ("ab,fr", """SELECT s.query_id, s.frame_id, stream_name, location_hint, score FROM (
        SELECT ab.* FROM ab JOIN q USING (query_id) WHERE qtype = 'speech' UNION ALL SELECT bmcap.* FROM bmcap JOIN q USING (query_id) WHERE qtype <> 'speech') s LEFT JOIN fr USING (frame_id) LEFT JOIN q USING (query_id)"""),
    "a2": ("a1", """SELECT query_id, frame_id, CASE WHEN location_hint = ['any'] OR stream_name IS NULL THEN score WHEN query_id = 'Q1' THEN CASE WHEN stream_name IN ('lodge', 'loft', 'laundry') THEN score * 0.5 ELSE score END
        WHEN len(list_filter(location_hint, lambda h: contains(lower(stream_name), lower(h)) OR contains(lower(h), lower(stream_name)))) > 0 THEN score ELSE score * 0.5 END AS score FROM a1"""),
    "a3": ("a2", "SELECT * FROM a2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 50"),
    "a": ("a3", "SELECT query_id, frame_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN round(score / max(score) OVER (PARTITION BY query_id), 9) ELSE 0 END AS score FROM a3"),
    "tk": ("hq,htr,tr", "SELECT s.query_id, tr.frame_id, s.row_index, s.score FROM (SELECT query_id, k AS row_index, round(sum(htr.w * hq.w), 9) AS score FROM htr JOIN hq USING (dim) GROUP BY 1, 2) s JOIN tr USING (row_index) WHERE tr.frame_id IS NOT NULL AND s.score > 0"),
    "ck": ("hq,hcap", "SELECT query_id, k AS frame_id, 0 AS row_index, round(sum(hcap.w * hq.w), 9) AS score FROM hcap JOIN hq USING (dim) GROUP BY 1, 2 HAVING round(sum(hcap.w * hq.w), 9) > 0"),
    "mg": ("a,b,dt,dc", """SELECT query_id, frame_id, coalesce(max(score) FILTER (signal = 'bm25'), 0) AS bm25, coalesce(max(score) FILTER (signal = 'visual'), 0) AS visual, coalesce(max(score) FILTER (signal = 'transcript'), 0) AS transcript, coalesce(max(score) FILTER (signal = 'caption'), 0) AS caption
        FROM (SELECT query_id, frame_id, score, 'bm25' AS signal FROM a UNION ALL SELECT query_id, frame_id, score, 'visual' FROM b UNION ALL SELECT query_id, frame_id, score, 'transcript' FROM dt UNION ALL SELECT query_id, frame_id, score, 'caption' FROM dc) GROUP BY 1, 2"""),
    "c0": ("mg,q", "SELECT query_id, frame_id, round(greatest(0, least(1, w_vis * visual + w_text * (0.5 * bm25 + 0.5 * (0.5 * caption + 0.5 * transcript)))), 9) AS score FROM mg JOIN q USING (query_id)"),
    "c1": ("c0,fr,cap", """SELECT query_id, c0.frame_id, score * CASE WHEN query_id IN ('Q1', 'Q2', 'Q8') AND stream_type = 'fixed' THEN 0.5 WHEN query_id = 'Q2' AND contains(lower(coalesce(caption, '')), 'first-person view') THEN 0.97 ELSE 1.0 END AS score
        FROM c0 LEFT JOIN fr USING (frame_id) LEFT JOIN cap USING (frame_id)"""),
    "c": ("c1", "SELECT query_id, frame_id, score FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 50"),
    "gated0": ("cap,vec", f"""SELECT cap.frame_id, caption, ocr_text, CASE WHEN trim(coalesce(ocr_text, '')) <> '' THEN {_COS.format('e.embedding::double[]', 'v.vec')} END AS sim
        FROM cap LEFT JOIN embeddings e ON e.vec_id = manifest_row_index % 500 LEFT JOIN (SELECT DISTINCT ON (frame_id) frame_id, vec FROM vec) v ON v.frame_id = cap.frame_id"""),
    "gated": ("gated0", "SELECT frame_id, CASE WHEN sim < 0.2 THEN " + "{strip}" + " ELSE caption END AS caption, CASE WHEN sim < 0.2 THEN '' ELSE ocr_text END AS ocr_text, round(sim, 6) AS ocr_sim, CASE WHEN sim < 0.2 THEN 'stripped' WHEN sim IS NOT NULL THEN 'kept' END AS ocr_gate FROM gated0"),
}

_CUT = "rtrim(substr(caption, 1, length(caption) - length(ocr_text) - instr(reverse(lower(caption)), reverse(lower(ocr_text))) + 1), ' .,;:-|')"
_STRIP = f"CASE WHEN coalesce(ocr_text, '') = '' OR instr(reverse(lower(caption)), reverse(lower(ocr_text))) = 0 OR {_CUT} = '' THEN caption ELSE {_CUT} END"
_CTE["gated"] = ("gated0", _CTE["gated"][1].replace("{strip}", _STRIP))


def _hash(name: str, key: str, source: str, text: str, needs: str) -> None:
    _CTE[f"{name}0"] = (needs, f"""SELECT k, cast('0x' || substr(md5(t), 1, 4) AS integer) % 64 AS dim, cast(sum(CASE WHEN substr(md5(t), 5, 1) BETWEEN '0' AND '7' THEN 1 ELSE -1 END) AS double) AS w
        FROM (SELECT {key} AS k, unnest({_TOK.format(text)}) AS t FROM {source}) GROUP BY 1, 2 HAVING sum(CASE WHEN substr(md5(t), 5, 1) BETWEEN '0' AND '7' THEN 1 ELSE -1 END) <> 0""")
    cols = "k AS query_id" if name == "hq" else "k"
    _CTE[name] = (f"{name}0", f"SELECT {cols}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}0")


_hash("hq", "query_id", "q", "query_text", "q")
_hash("htr", "row_index", "tr", "raw_text", "tr")
_hash("hcap", "frame_id", "cap", "caption", "cap")


def _top(name: str, source: str, exact: bool = False) -> None:
    inner = source if exact else f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id, row_index) <= 250)"
    _CTE[f"{name}0"] = (source, f"SELECT query_id, frame_id, max(score) AS score FROM {inner} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, frame_id) <= 50")
    _CTE[name] = (f"{name}0", f"SELECT query_id, frame_id, round(score / max(score) OVER (PARTITION BY query_id), 9) AS score FROM {name}0")


_top("dt", "tk")
_top("dtx", "tk", exact=True)
_top("dc", "ck")


def _bm25(name: str, source: str, key: str, text: str, needs: str, split: str = _TOK) -> None:
    _CTE[f"{name}t"] = (needs, f"SELECT {key}, {split.format(text)} AS w FROM {source}")
    _CTE[f"{name}s"] = (f"{name}t", f"SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM {name}t")
    _CTE[f"{name}p"] = (f"{name}t,qterm", f"SELECT term, {key}, n, count(*) AS tf FROM (SELECT {key}, len(w) AS n, unnest(w) AS term FROM {name}t) WHERE term IN (SELECT term FROM qterm) GROUP BY ALL")
    _CTE[f"{name}d"] = (f"{name}p", f"SELECT term, count(*) AS df FROM {name}p GROUP BY 1")
    _CTE[name] = (f"{name}s,{name}d", f"SELECT query_id, {key}, round(sum((ln(n_docs / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg_len))), 9) AS score FROM qterm JOIN {name}p USING (term) JOIN {name}d USING (term), {name}s GROUP BY 1, 2")


_bm25("bmcap", "docs", "frame_id", "caption_text", "docs")
_bm25("bmtr", "docs", "frame_id", "transcript_text", "docs")
_bm25("bmdoc", "documents", "doc_id", "text", "", _ANY)

#: Clean tables p(raw, clean) for T1.
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _clean(c: str) -> str:
    p = PUNCTUATION.replace("'", "''")
    return rf"array_to_string(list_filter(regexp_split_to_array(trim(translate(lower(coalesce({c}, '')), '{p}', '')), '\s+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), ' ')"


def _with(names: str, select: str, recursive: str = "") -> str:
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in filter(None, _CTE[n][0].split(",")):
            add(d)
        done.append(n)

    for n in filter(None, names.split(",")):
        add(n)
    parts = [f"{n} AS ({_CTE[n][1]})" for n in done] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + select


def _dedup(source: str, scope: str = "stream_name", extra: str = "", tag: str = "") -> str:
    """Greedy suppression as a recursion over each list, keeping the times of what was kept; its tables' names end in ``tag``."""
    return f"""
dl{tag} AS (SELECT l.query_id, l.frame_id, l.score, time_offset_sec::double AS t, stream_name, day, hour, row_number() OVER (PARTITION BY l.query_id, {scope} ORDER BY l.score DESC, l.frame_id) AS n FROM {source} l LEFT JOIN fr USING (frame_id)),
rec{tag} AS (
  SELECT query_id, frame_id, score, t, stream_name, day, hour, n, [t] AS kept, true AS keep FROM dl{tag} WHERE n = 1 AND t IS NOT NULL
  UNION ALL
  SELECT d.query_id, d.frame_id, d.score, d.t, d.stream_name, d.day, d.hour, d.n, CASE WHEN len(list_filter(r.kept, lambda y: abs(y - d.t) < 10)) = 0 THEN list_append(r.kept, d.t) ELSE r.kept END,
         len(list_filter(r.kept, lambda y: abs(y - d.t) < 10)) = 0
  FROM rec{tag} r JOIN dl{tag} d ON d.query_id = r.query_id AND {' AND '.join(f'd.{s.strip()} = r.{s.strip()}' for s in scope.split(','))} AND d.n = r.n + 1),
dd{tag} AS (SELECT query_id, frame_id, score FROM rec{tag} WHERE keep UNION ALL SELECT query_id, frame_id, score FROM dl{tag} WHERE t IS NULL){extra}"""


_RANK = "cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS integer) AS rank"
_FINISH = f""",
fl AS (SELECT dd.*, stream_name, hour, time_offset_sec, timestamp_str IS NOT NULL AND coalesce(min(stream_name) OVER s <> max(stream_name) OVER s, false) AS multi_angle FROM dd LEFT JOIN fr USING (frame_id) WINDOW s AS (PARTITION BY query_id, timestamp_str)),
fin AS (SELECT query_id, {_RANK}, frame_id, score, coalesce(stream_name, 'unknown') AS stream_name, multi_angle, hour, time_offset_sec FROM fl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 10)"""
_OUT = f"SELECT query_id, frame_id, {_SIX}, {_RANK} FROM "
_LOGIT = f"""
lg AS (SELECT l.query_id, l.frame_id, l.score, 4 * len(list_intersect(list_distinct({_TOK.format('q.query_text')}), list_distinct({_TOK.format("coalesce(nullif(cap.caption, ''), fr.stream_name, 'unknown')")}))) / greatest(1, len(list_distinct({_TOK.format('q.query_text')}))) - 2 AS logit
  FROM {{0}} l JOIN q USING (query_id) LEFT JOIN cap USING (frame_id) LEFT JOIN fr USING (frame_id)),
hy AS (SELECT query_id, frame_id, score AS fusion, logit, round(0.7 * score + 0.3 / (1 + exp(-logit)), 9) AS score FROM lg)"""
_PREC = """
pr AS (SELECT l.query_id, l.approach, count(r.frame_id) AS hits, round(count(r.frame_id) / 10, 1) AS p_at_k FROM
  (SELECT *, row_number() OVER (PARTITION BY approach, query_id ORDER BY score DESC, frame_id) AS n FROM {0}) l LEFT JOIN qrels r ON r.query_id = l.query_id AND r.frame_id = l.frame_id WHERE n <= 10 GROUP BY 1, 2)"""
_BC = "(SELECT *, 'B' AS approach FROM b UNION ALL SELECT *, 'C' FROM c)"
_AC = "(SELECT *, 'A' AS approach FROM a UNION ALL SELECT *, 'C' FROM c)"
_SQUASH = "CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN round((1 / (1 + exp(-score))) / max(1 / (1 + exp(-score))) OVER (PARTITION BY query_id), 9) END"


def _rocchio() -> str:
    unit = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
    return f"""
an AS (SELECT query_id, frame_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) = 5),
un AS (SELECT an.query_id, {unit.format('qv.qvec')} AS u, {unit.format('vec.vec')} AS w FROM an JOIN qv USING (query_id) JOIN vec ON vec.frame_id = an.frame_id),
mv AS (SELECT query_id, list_transform(list_zip(u, w), lambda p: (p[1] + p[2]) / 2) AS qvec FROM un),
rs AS (SELECT query_id, frame_id, round({_COS.format('qvec', 'vec')}, 9) AS score FROM vec, mv)"""


_KW = "CASE WHEN contains(lower(coalesce(caption, '')), 'first-person view') OR contains(lower(coalesce(caption, '')), 'closing the hatch') THEN 3 WHEN contains(lower(coalesce(caption, '')), 'person') OR contains(lower(coalesce(caption, '')), 'people') THEN 2 WHEN contains(lower(coalesce(caption, '')), 'image') OR contains(lower(coalesce(caption, '')), 'room') THEN 1 ELSE 0 END"
_DERIVE = r"(?i)(day\d+)/(members|fixed)/([^/]+)/(\d{2})_(\d{4})\.[a-z0-9]+$"


def _hms(t: str) -> str:
    return f"printf('%02d:%02d:%02d', cast({t} AS bigint) // 3600, cast({t} AS bigint) % 3600 // 60, cast({t} AS bigint) % 60)"


ORACLE: dict[str, str] = {
    "scan_frames": f"""SELECT DISTINCT full_path, lower(regexp_extract(full_path, '{_DERIVE}', 1)) AS day, CASE WHEN lower(regexp_extract(full_path, '{_DERIVE}', 2)) = 'fixed' THEN 'fixed' ELSE 'member' END AS stream_type, lower(regexp_extract(full_path, '{_DERIVE}', 3)) AS stream_name,
        regexp_extract(full_path, '{_DERIVE}', 4) || '_' || regexp_extract(full_path, '{_DERIVE}', 5) AS filename, cast(regexp_extract(full_path, '{_DERIVE}', 4) AS integer) AS hour, cast(regexp_extract(full_path, '{_DERIVE}', 5) AS integer) AS frame_index,
        (cast(regexp_extract(full_path, '{_DERIVE}', 5) AS integer) - 1) * 5 AS time_offset_sec, {_hms(f"(cast(regexp_extract(full_path, '{_DERIVE}', 4) AS integer) * 3600 + (cast(regexp_extract(full_path, '{_DERIVE}', 5) AS integer) - 1) * 5)")} AS timestamp_str
        FROM frames WHERE regexp_matches(full_path, '{_DERIVE}')""",
    "scan_embeddings": "SELECT DISTINCT manifest_row_index, CASE WHEN vec IS NULL THEN 'null' WHEN len(vec) <> 64 THEN 'wrong length' ELSE 'not finite' END AS reason FROM siglip2_index WHERE vec IS NULL OR len(vec) <> 64 OR len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) > 0",
    "export_windows": _with("b,fr", f"SELECT query_id, rank, stream_name, {_hms('(hour * 3600 + greatest(0, time_offset_sec - 5))')} AS start_time, {_hms('(hour * 3600 + time_offset_sec + 5)')} AS end_time, printf('%.4f', score) AS score FROM fin", _dedup("b", extra=_FINISH)),
    "index_docs": _with("docs", "SELECT * FROM docs"),
    "index_build": _with("docs,vec,tr,cap,qv", f"""SELECT part, n AS n_written, n AS n_read, true AS ok FROM (
        SELECT 'frames' AS part, (SELECT count(*) FROM fr) AS n UNION ALL SELECT 'captions', (SELECT count(*) FROM cap) UNION ALL SELECT 'transcripts', (SELECT count(*) FROM tr) UNION ALL SELECT 'docs', (SELECT count(*) FROM docs)
        UNION ALL SELECT 'postings', (SELECT sum(len(list_distinct({_TOK.format('transcript_text')})) + len(list_distinct({_TOK.format('caption_text')}))) FROM docs)
        UNION ALL SELECT 'terms', (SELECT count(*) FROM (SELECT DISTINCT 1, unnest({_TOK.format('transcript_text')}) FROM docs UNION ALL SELECT DISTINCT 2, unnest({_TOK.format('caption_text')}) FROM docs)) UNION ALL SELECT 'fields', 2
        UNION ALL SELECT 'vectors', (SELECT count(*) FROM vec) UNION ALL SELECT 'query_vectors', (SELECT count(*) FROM qv)
        UNION ALL SELECT 'document_postings', (SELECT sum(len(list_distinct({_ANY.format('text')}))) FROM documents) UNION ALL SELECT 'document_terms', (SELECT count(*) FROM (SELECT DISTINCT unnest({_ANY.format('text')}) FROM documents)) UNION ALL SELECT 'document_fields', 1
        UNION ALL SELECT 'text_vectors', (SELECT count(DISTINCT k) FROM htr0 JOIN tr ON tr.row_index = k WHERE tr.frame_id IS NOT NULL) + (SELECT count(DISTINCT k) FROM hcap0))""".replace("htr0", f"({_CTE['htr0'][1]})").replace("hcap0", f"({_CTE['hcap0'][1]})")),
    "index_verify": _with("docs", f"""SELECT query_id, frame_id, {_SIX}, rank, n_docs FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS integer) AS rank FROM (
        SELECT term AS query_id, frame_id, n_docs, round((ln(n_docs / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg_len)), 9) AS score FROM (
          SELECT term, frame_id, n, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM (SELECT frame_id, len({_TOK.format('caption_text')}) AS n, unnest({_TOK.format('caption_text')}) AS term FROM docs) WHERE term IN ('cup', 'mug', 'image') GROUP BY 1, 2, 3),
          (SELECT count(*) AS n_docs, avg(len({_TOK.format('caption_text')})) AS avg_len FROM docs))) WHERE rank <= 3"""),
    "vector_index_build": _with("vec", """SELECT count(*) AS n, min(len(vec)) AS dim_min, max(len(vec)) AS dim_max, count(*) FILTER (NOT sqrt(list_dot_product(vec, vec)) > 0) AS wrong_norm,
        count(*) FILTER (abs(sqrt(list_dot_product(u, u)) - 1) >= 1e-4) AS not_unit FROM (SELECT vec, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM vec)"""),
    "row_map_build": _with("vec,fr", "SELECT manifest_row_index AS row_index, frame_id, stream_name, day, timestamp_str, time_offset_sec::double AS time_offset_sec, hour FROM vec JOIN fr USING (frame_id)"),
    "index_checks": _with("vec,fr", """SELECT DISTINCT frame_id, 'missing' AS problem FROM (SELECT frame_id FROM vec UNION ALL SELECT 'ghost__day1__08_0001' UNION ALL SELECT 'ghost__day1__08_0002') v ANTI JOIN fr USING (frame_id)
        UNION ALL SELECT frame_id, 'twice' FROM (SELECT frame_id FROM vec UNION ALL SELECT min(frame_id) FROM vec) GROUP BY 1 HAVING count(*) > 1"""),
    "pending_shards": _with("fr", "SELECT DISTINCT stream_name || '__' || day || '__' || printf('%02d', hour) AS shard FROM fr EXCEPT SELECT regexp_extract(frame_id, '^(.+?__day[0-9]+__[0-9]+)_', 1) FROM augmented_captions WHERE caption IS NOT NULL"),
    "shard_keys": _with("fr", "SELECT concat_ws('__', day, stream_type, stream_name) AS shard, count(*) AS n FROM fr GROUP BY 1"),
    "frame_times": _with("fr", f"SELECT frame_id, (frame_index - 1) * 5 AS offset_sec, {_hms('(hour * 3600 + (frame_index - 1) * 5)')} AS clock FROM fr"),
    "frame_index_of_marks": "SELECT DISTINCT mark_id, cast(round_even(floor(mark_sec) / 2 / 5, 0) AS integer) + 1 AS frame_index FROM voice_marks",
    "chunk_filter": _with("tr", """SELECT row_index, start_sec, end_sec FROM (
        SELECT x.row_index, x.time_offset_sec AS start_sec, coalesce((SELECT min(y.time_offset_sec) FROM tr y WHERE y.stream_name = x.stream_name AND y.day = x.day AND y.hour = x.hour AND y.time_offset_sec > x.time_offset_sec), 3600) AS end_sec, x.raw_text
        FROM tr x WHERE x.time_offset_sec IS NOT NULL) WHERE end_sec > start_sec AND trim(coalesce(raw_text, '')) <> ''"""),
    "parse_frame_ids": f"SELECT DISTINCT ON (manifest_idx, q.frame_id, full_path_resized) manifest_idx, coalesce(q.frame_id = lower(q.frame_id) AND regexp_matches(q.frame_id, '^[^_]+__day[0-9]+__[0-9]{{2}}_[0-9]{{4}}$'), false) AS was_valid, {_CANON} AS frame_id FROM qaff_classified q",
    "parse_hms": _with("fr", "SELECT frame_id, cast(split_part(timestamp_str, ':', 1) AS double) * 3600 + cast(split_part(timestamp_str, ':', 2) AS double) * 60 + cast(split_part(timestamp_str, ':', 3) AS double) AS sec FROM fr"),
    "caption_filter": _with("cap", f"SELECT frame_id, CASE WHEN {_WORDS.format('caption')} < 5 THEN NULL WHEN length(trim(coalesce(ocr_text, ''))) >= 2 THEN caption || ' ' || trim(ocr_text) ELSE caption END AS caption FROM cap"),
    "caption_filter_check": _with("cap", f"SELECT 'before' AS stage, frame_id FROM cap WHERE caption IS NOT NULL AND {_WORDS.format('caption')} < 5"),
    "ocr_gate": _with("gated", "SELECT * FROM gated"),
    "strip_ocr_suffix": _with("cap", f"SELECT frame_id, {_STRIP} AS caption FROM cap"),
    "decimate": _with("ti,vec", """SELECT manifest_idx, frame_id, tier FROM (
        SELECT *, lag(vec) OVER (PARTITION BY stream_name, day, tier = 'hot' ORDER BY hour, frame_index) AS before FROM (SELECT ti.manifest_idx, ti.frame_id, stream_name, day, hour, frame_index, tier, vec FROM ti LEFT JOIN vec ON vec.manifest_row_index = ti.manifest_idx WHERE ti.frame_id IS NOT NULL))
        WHERE tier = 'hot' OR vec IS NULL OR before IS NULL OR len(list_filter(list_zip(vec, before), lambda p: (p[1] >= 0) <> (p[2] >= 0))) >= CASE WHEN tier = 'warm' THEN 30 ELSE 34 END"""),
    "tier_classify": "SELECT DISTINCT manifest_idx, round(relevance_score, 4) AS relevance_score, CASE WHEN round(relevance_score, 4) >= 0.2 THEN 'hot' WHEN round(relevance_score, 4) >= 0.12 THEN 'warm' ELSE 'cold' END AS tier FROM qaff_classified WHERE relevance_score IS NOT NULL",
    "histogram": _with("ti", "SELECT band, n, pct FROM (SELECT band, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM (SELECT CASE WHEN s >= 0 AND s < 0.05 THEN 0 WHEN s >= 0.05 AND s < 0.1 THEN 1 WHEN s >= 0.1 AND s < 0.15 THEN 2 WHEN s >= 0.15 AND s < 0.2 THEN 3 WHEN s >= 0.2 AND s < 0.25 THEN 4 WHEN s >= 0.25 AND s < 0.3 THEN 5 WHEN s >= 0.3 AND s < 1.01 THEN 6 END AS band FROM (SELECT relevance_score AS s FROM ti)) GROUP BY 1) WHERE band IS NOT NULL"),
    "location_filter": _with("bmcap,fr,q", """SELECT query_id, frame_id, round(CASE WHEN location_hint = ['any'] OR stream_name IS NULL OR len(list_filter(location_hint, lambda h: contains(lower(stream_name), lower(h)) OR contains(lower(h), lower(stream_name)))) > 0 THEN score ELSE score * 0.5 END, 6) AS score
        FROM bmcap LEFT JOIN fr USING (frame_id) LEFT JOIN q USING (query_id)"""),
    "fusion_penalty": _with("b,fr,cap", """SELECT query_id, b.frame_id, round(score * CASE WHEN query_id IN ('Q1', 'Q2', 'Q8') AND stream_type = 'fixed' THEN 0.5 WHEN query_id = 'Q2' AND contains(lower(coalesce(caption, '')), 'first-person view') THEN 0.97 ELSE 1.0 END, 6) AS score
        FROM b LEFT JOIN fr USING (frame_id) LEFT JOIN cap USING (frame_id)"""),
    "clamp_score": "SELECT DISTINCT mark_id, round(CASE WHEN mark_id % 7 = 0 OR confidence IS NULL THEN 0.0 ELSE greatest(0, least(1, confidence * 3 - 1)) END, 6) AS score FROM voice_marks",
    "keyword_boost": _with("b,cap,fr", f"SELECT query_id, frame_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} FROM dd) WHERE rank <= 10", f"kb0 AS (SELECT query_id, b.frame_id, round(0.6 * score + 0.4 * {_KW} / 3, 9) AS score FROM b LEFT JOIN cap USING (frame_id)), kb AS (SELECT query_id, frame_id, round(score / max(score) OVER (PARTITION BY query_id), 9) AS score FROM kb0)," + _dedup("kb")),
    "score_badge": _with("b", "SELECT query_id, frame_id, CASE WHEN score >= 0.7 THEN 'green' WHEN score >= 0.4 THEN 'yellow' ELSE 'red' END AS badge FROM b"),
    "image_path": _with("fr", "SELECT frame_id, printf('footage_768/%s/%s/%s/%02d_%04d.webp', day, CASE WHEN stream_type = 'fixed' THEN 'fixed' ELSE 'members' END, stream_name, hour, frame_index) AS path FROM fr"),
    "join_left_default": _with("fr,cap", "SELECT frame_id, stream_name, coalesce(nullif(caption, ''), 'none') AS caption FROM fr LEFT JOIN cap USING (frame_id)"),
    "join_full_outer_scores": _with("mg", "SELECT query_id, frame_id, round(bm25, 6) AS bm25, round(visual, 6) AS visual, round(transcript, 6) AS transcript, round(caption, 6) AS caption FROM mg"),
    "join_inner_strict": _with("cap,fr", "SELECT cap.frame_id, manifest_row_index, fr.stream_name, CASE WHEN fr.frame_id IS NULL THEN 'no partner' END AS problem FROM (SELECT frame_id, manifest_row_index FROM cap UNION ALL SELECT 'ghost__day1__08_0001', -1) cap LEFT JOIN fr ON fr.frame_id = cap.frame_id"),
    "join_semi_pool": _with("cap,b", "SELECT frame_id, caption FROM cap WHERE frame_id IN (SELECT frame_id FROM b)"),
    "join_anti_pending": _with("ti,cap", "SELECT manifest_idx, frame_id, tier FROM ti WHERE frame_id IS NOT NULL AND frame_id NOT IN (SELECT frame_id FROM cap)"),
    "interval_overlap": _with("ti,tr", """SELECT frame_id, CASE WHEN n_chunks = 0 THEN 'MISSING' WHEN hit THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status FROM (
        SELECT p.frame_id, count(t.row_index) AS n_chunks, coalesce(bool_or(t.time_offset_sec <= p.t + 30 AND t.time_offset_sec + 5 >= greatest(0, p.t - 30) AND regexp_matches(lower(coalesce(t.raw_text, '')), 'reminder|wait|step two')), false) AS hit
        FROM (SELECT DISTINCT frame_id, stream_name, day, hour, (frame_index - 1) * 5 AS t FROM ti WHERE tier = 'hot' AND frame_id IS NOT NULL) p LEFT JOIN tr t ON t.stream_name = p.stream_name AND t.day = p.day AND t.hour = p.hour AND t.time_offset_sec IS NOT NULL GROUP BY 1)"""),
    "cross_query_frame": _with("vs", "SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM vs GROUP BY 1"),
    "qrels_membership": _with("b,qrels", f"SELECT b.query_id, b.frame_id, cast(row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.frame_id) AS integer) AS rank, CASE WHEN r.frame_id IS NULL THEN 0 ELSE 1 END AS rel FROM b LEFT JOIN qrels r ON r.query_id = b.query_id AND r.frame_id = b.frame_id"),
    "concat_text_by_frame": _with("gtext", "SELECT * FROM gtext"),
    "max_score_per_frame": "SELECT manifest_idx, max(relevance_score) AS score FROM qaff_classified WHERE relevance_score IS NOT NULL GROUP BY 1",
    "max_normalise": _with("ev", "SELECT query_id, frame_id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM ev"),
    "tier_stats": _with("ti", """SELECT count(*) AS total, count(*) FILTER (tier = 'hot') AS hot_count, count(*) FILTER (tier = 'warm') AS warm_count, count(*) FILTER (tier = 'cold') AS cold_count,
        round(count(*) FILTER (tier = 'hot') / count(*) * 100, 2) AS hot_pct, round(count(*) FILTER (tier = 'warm') / count(*) * 100, 2) AS warm_pct, round(count(*) FILTER (tier = 'cold') / count(*) * 100, 2) AS cold_pct,
        count(*) FILTER (tier <> 'cold') AS upload_frames, round(count(*) FILTER (tier <> 'cold') * 45 / 1024 / 1024, 2) AS upload_gb FROM ti"""),
    "hot_by_query": _with("ti", "SELECT best_query_id, count(*) AS hot_count FROM ti WHERE tier = 'hot' GROUP BY 1"),
    "stream_means": _with("ti", """SELECT stream_name, mean_score, 'highest' AS side, cast(hi AS integer) AS place FROM (SELECT *, row_number() OVER (ORDER BY mean_score DESC, stream_name) AS hi, row_number() OVER (ORDER BY mean_score, stream_name DESC) AS lo FROM (SELECT stream_name, round(avg(relevance_score), 5) AS mean_score FROM ti GROUP BY 1)) WHERE hi <= 5
        UNION ALL SELECT stream_name, mean_score, 'lowest', cast(lo AS integer) FROM (SELECT *, row_number() OVER (ORDER BY mean_score, stream_name DESC) AS lo FROM (SELECT stream_name, round(avg(relevance_score), 5) AS mean_score FROM ti GROUP BY 1)) WHERE lo <= 5"""),
    "similarity_stats": _with("gated", "SELECT count(ocr_sim) AS n, round(min(ocr_sim), 6) AS lo, round(max(ocr_sim), 6) AS hi, round(avg(ocr_sim), 6) AS mean, round(stddev_pop(ocr_sim), 6) AS std, round(quantile_cont(ocr_sim, 0.1), 6) AS p10, round(quantile_cont(ocr_sim, 0.25), 6) AS p25, round(quantile_cont(ocr_sim, 0.5), 6) AS p50, round(quantile_cont(ocr_sim, 0.75), 6) AS p75, round(quantile_cont(ocr_sim, 0.9), 6) AS p90 FROM gated"),
    "gate_counters": _with("gated", "SELECT count(*) AS total, count(*) FILTER (ocr_gate = 'stripped') AS stripped, count(*) FILTER (ocr_gate = 'kept') AS kept, count(*) FILTER (ocr_gate IS NULL) AS not_gated, round(count(*) FILTER (ocr_gate = 'stripped') / nullif(count(ocr_gate), 0) * 100, 2) AS strip_rate FROM gated"),
    "filter_counters": _with("cap", f"SELECT count(*) AS processed, count(*) FILTER ({_WORDS.format('caption')} < 5) AS discarded, count(*) FILTER ({_WORDS.format('caption')} >= 5) AS kept, count(*) FILTER ({_WORDS.format('caption')} >= 5 AND length(trim(coalesce(ocr_text, ''))) >= 2) AS ocr_appended FROM cap"),
    "corpus_stats": _with("tr", f"SELECT count(*) AS texts, count(*) FILTER ({_WORDS.format('raw_text')} = 0) AS empty, round(avg({_WORDS.format('raw_text')}), 6) AS mean_words FROM tr"),
    "precision_at_10": _with("b,c,qrels", "") + "," + _PREC.format(_BC) + " SELECT * FROM pr",
    "mean_precision": _with("b,qrels", "") + "," + _PREC.format("(SELECT *, 'B' AS approach FROM b)") + " SELECT approach, round(avg(p_at_k), 3) AS mean_p FROM pr GROUP BY 1",
    "best_approach_note": _with("a,b,c,q,cap,fr,qrels", "", _LOGIT.format("c") + "," + _dedup("hy", tag="h") + f""",
ld AS (SELECT query_id, frame_id, {_SQUASH} AS score FROM (SELECT * FROM ddh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 10))""") + "," + _PREC.format("(SELECT *, 'A' AS approach FROM a UNION ALL SELECT *, 'B' FROM b UNION ALL SELECT *, 'C' FROM c UNION ALL SELECT *, 'D' FROM ld)") + """, w AS (SELECT query_id, max(p_at_k) OVER (PARTITION BY query_id) AS top, approach, p_at_k FROM pr)
        SELECT query_id, string_agg(approach, '/' ORDER BY approach) AS best, CASE WHEN max(top) = 0 THEN 'all fail' WHEN count(*) = 1 THEN min(approach) || ' dominates' WHEN bool_or(approach = 'D') THEN 'D ties best' ELSE 'mixed' END AS note FROM w WHERE p_at_k = top GROUP BY 1""",
    "overlap_counts": _with("a,c", "SELECT query_id, 'A&C' AS pair, count(*) AS n FROM a JOIN c USING (query_id, frame_id) GROUP BY 1"),
    "most_common": _with("fr", "SELECT stream_name, count(*) AS n FROM fr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "gt_by_query": _with("qrels", "SELECT query_id, count(DISTINCT frame_id) AS n_relevant, cast(row_number() OVER (ORDER BY cast(substr(query_id, 2) AS integer)) AS integer) AS place FROM qrels GROUP BY 1"),
    "sliding_transcript": _with("tr", """SELECT x.row_index, coalesce(string_agg(trim(y.raw_text), ' ' ORDER BY y.time_offset_sec, y.row_index) FILTER (trim(coalesce(y.raw_text, '')) <> ''), '') AS transcript_text
        FROM tr x JOIN tr y ON x.stream_name = y.stream_name AND x.day = y.day AND x.hour = y.hour AND abs(x.time_offset_sec - y.time_offset_sec) <= 10 GROUP BY 1"""),
    "rank_topk": _with("ev", f"SELECT * FROM (SELECT query_id, frame_id, score, {_RANK} FROM ev) WHERE rank <= 50"),
    "temporal_dedup": _with("ev,fr", f"SELECT query_id, frame_id, score, {_RANK} FROM dd", _dedup("ev")),
    "temporal_dedup_scoped": _with("ev,fr", "SELECT query_id, frame_id, score FROM dd", _dedup("ev", "stream_name, day, hour")),
    "cross_stream_flag": _with("ev,fr", "SELECT query_id, ev.frame_id, timestamp_str IS NOT NULL AND coalesce(min(stream_name) OVER s <> max(stream_name) OVER s, false) AS multi_angle FROM ev LEFT JOIN fr USING (frame_id) WINDOW s AS (PARTITION BY query_id, timestamp_str)"),
    "vector_topk": _with("b0", _OUT + "b0"),
    "vector_topk_matmul": _with("b0", _OUT + "b0"),
    "topk_overfetch_dedup": _with("dt", _OUT + "dt"),
    "topk_exact_dedup": _with("dtx", _OUT + "dtx"),
    "multi_key_sort": _with("b,q,cap,fr", "") + "," + _LOGIT.format("b") + " SELECT query_id, frame_id, round(score, 6) AS score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, logit DESC, fusion DESC, frame_id) AS integer) AS rank FROM hy",
    "top10_assert": _with("b,fr", """SELECT query_id || '|B' AS query_id, count(*) AS n FROM fin GROUP BY query_id HAVING count(*) <> 10
        UNION ALL SELECT query_id || '|cascade', n FROM (SELECT query_id, least(15, CASE WHEN count(*) FILTER (score >= 0.99999) > 0 THEN count(*) FILTER (score >= 0.99999) WHEN count(*) FILTER (score >= 0.9) > 0 THEN count(*) FILTER (score >= 0.9) ELSE least(3, count(*)) END) AS n FROM b GROUP BY 1) WHERE n <> 10""", _dedup("b", extra=_FINISH)),
    "threshold_cascade": _with("b", f"""SELECT query_id, rank, frame_id, round(score, 6) AS score, mode FROM (SELECT *, {_RANK}, CASE WHEN n1 > 0 THEN 'primary' WHEN n2 > 0 THEN 'fallback' ELSE 'best' END AS mode FROM (
        SELECT *, count(*) FILTER (score >= 0.99999) OVER (PARTITION BY query_id) AS n1, count(*) FILTER (score >= 0.9) OVER (PARTITION BY query_id) AS n2 FROM b)) WHERE rank <= 15 AND CASE mode WHEN 'primary' THEN score >= 0.99999 WHEN 'fallback' THEN score >= 0.9 ELSE rank <= 3 END"""),
    "union_keys": _with("cap,vec,fr", "SELECT frame_id FROM cap UNION SELECT frame_id FROM vec UNION SELECT frame_id FROM fr"),
    "intersect_counts": _with("cap,vec", "SELECT (SELECT count(*) FROM (SELECT frame_id FROM cap EXCEPT SELECT frame_id FROM vec)) AS only_left, (SELECT count(*) FROM (SELECT frame_id FROM vec EXCEPT SELECT frame_id FROM cap)) AS only_right, (SELECT count(*) FROM (SELECT frame_id FROM cap INTERSECT SELECT frame_id FROM vec)) AS both"),
    "difference": _with("cap,vec", "SELECT frame_id FROM vec EXCEPT SELECT frame_id FROM cap"),
    "schema_equal": "SELECT true AS same, false AS other",
    "clean_text": _with("tr", f"SELECT row_index, {_clean('raw_text')} AS raw_text, {_clean('transcript_text')} AS transcript_text FROM tr"),
    "expand_query": _with("q", "SELECT query_id, query_text AS expanded FROM q"),
    "analyze": _with("cap", f"SELECT frame_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT frame_id, list_filter({_TOK.format('caption')}, lambda w: NOT list_contains({_STOP}, w)) AS t FROM cap)"),
    "postings": f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_ANY.format('text')}) AS term FROM documents) GROUP BY 1, 2",
    "field_stats": _with("docs", f"SELECT count(*) AS n_docs, round(avg(len({_TOK.format('caption_text')})), 6) AS avg_len FROM docs"),
    "bm25_topk": _with("bmcap", f"SELECT * FROM (SELECT query_id, frame_id, {_SIX}, {_RANK} FROM bmcap) WHERE rank <= 50"),
    "bm25_documents": _with("bmdoc", f"SELECT * FROM (SELECT query_id, doc_id, {_SIX}, {_RANK.replace('frame_id', 'doc_id')} FROM bmdoc) WHERE rank <= 50"),
    "bm25_combined": _with("ab", "SELECT query_id, frame_id, round(score, 6) AS score FROM ab"),
    "approach_a": _with("a", _OUT + "a"),
    "l2_normalise": _with("vec", "SELECT manifest_row_index, unnest(range(0, len(vec)))::integer AS pos, round(unnest(vec) / n, 6) AS value FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM vec)"),
    "cosine": _with("vec", f"SELECT x.manifest_row_index, round({_COS.format('x.vec', 'y.vec')}, 6) AS cosine FROM vec x JOIN vec y ON y.manifest_row_index = x.manifest_row_index + 1"),
    "unit_norm_check": _with("vec", "SELECT 'embeddings' AS name, count(*) FILTER (abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) >= 1e-4) AS n FROM embeddings UNION ALL SELECT 'siglip2_index', count(*) FILTER (abs(sqrt(list_dot_product(vec, vec)) - 1) >= 1e-4) FROM vec"),
    "approach_b": _with("b", _OUT + "b"),
    "dense_captions": _with("dc", _OUT + "dc"),
    "fusion_topk": _with("c", _OUT + "c"),
    "fusion_weights": "SELECT query_id, w_vis, w_text FROM scene_prompts UNION ALL SELECT 'CUSTOM', 0.5, 0.5",
    "prefusion_gate": _with("a,b,dt,dc,ev", """SELECT query_id, signal, count(*) AS n, round(max(score) FILTER (isfinite(score)), 6) AS top, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (NOT isfinite(score)) AS n_not_finite,
        count(*) FILTER (isfinite(score) AND (score < -1e-6 OR score > 1 + 1e-6)) AS n_out_of_range, count(*) FILTER (score IS NULL OR NOT isfinite(score) OR score < -1e-6 OR score > 1 + 1e-6) = 0 AND max(score) > 0 AS ok
        FROM (SELECT query_id, 'bm25' AS signal, score FROM a UNION ALL SELECT query_id, 'visual', score FROM b UNION ALL SELECT query_id, 'transcript', score FROM dt UNION ALL SELECT query_id, 'caption', score FROM dc UNION ALL SELECT query_id, 'broken', score * 10 FROM ev
        UNION ALL SELECT query_id, 'odd', CASE WHEN n = 1 THEN NULL WHEN n <= 3 THEN 'nan'::double WHEN n = 4 THEN 'inf'::double ELSE score END FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS n FROM b)) GROUP BY 1, 2"""),
    "rerank_hybrid": _with("c,q,cap,fr", f"SELECT query_id, frame_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} FROM dd) WHERE rank <= 10", _LOGIT.format("c") + "," + _dedup("hy")),
    "approach_d": _with("c,q,cap,fr", f"SELECT query_id, frame_id, round({_SQUASH}, 6) AS score, rank FROM (SELECT *, {_RANK} FROM dd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 10)", _LOGIT.format("c") + "," + _dedup("hy")),
    "approach_d_as_shipped": _with("b,c,fr", f"SELECT query_id, frame_id, round({_SQUASH}, 6) AS score, rank FROM (SELECT *, {_RANK} FROM dd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 10)", "mx AS (SELECT * FROM b WHERE query_id = 'Q3' UNION ALL SELECT * FROM c WHERE query_id <> 'Q3')," + _dedup("mx")),
    "rocchio": _with("b,qv,vec", "") + "," + _rocchio() + f" SELECT query_id, frame_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} FROM rs) WHERE rank <= 50",
    "qaff_score": _with("vs", "SELECT frame_id, cast(arg_max(substr(query_id, 2)::integer - 1, (score, -substr(query_id, 2)::integer)) AS integer) AS best_query_id, round(max(score), 4) AS relevance_score, CASE WHEN round(max(score), 4) >= 0.4 THEN 'hot' WHEN round(max(score), 4) >= 0.3 THEN 'warm' ELSE 'cold' END AS tier FROM vs GROUP BY 1"),
    "metadata_proximity": _with("a,cap,q", "SELECT a.query_id, bool_or(coalesce(len(list_filter(synonyms, lambda s: contains(lower(coalesce(caption, '')), lower(s)))) > 0, false)) AS near FROM a LEFT JOIN cap USING (frame_id) JOIN q USING (query_id) GROUP BY 1"),
    "manifest_sink": _with("fr", "SELECT kind, frame_id, stream_name, day, hour, frame_index, time_offset_sec, stream_type, timestamp_str, full_path FROM fr, (VALUES ('parquet'), ('jsonl'), ('csv')) k(kind)"),
    "scan_transcripts": _with("tr", """SELECT day, stream_name, printf('%02d', hour) AS hour, cast(row_number() OVER (PARTITION BY stream_name, day, hour ORDER BY time_offset_sec, row_index) - 1 AS integer) AS chunk_no, time_offset_sec::double AS start_sec, time_offset_sec + 5.0::double AS end_sec, raw_text AS text
        FROM tr WHERE time_offset_sec IS NOT NULL AND stream_name IS NOT NULL AND day IS NOT NULL AND hour IS NOT NULL"""),
    "scan_jsonl_strict": _with("cap", """SELECT shard, line_no, reason FROM (SELECT regexp_extract(frame_id, '^(.+?)__', 1) AS shard, row_number() OVER (PARTITION BY regexp_extract(frame_id, '^(.+?)__', 1) ORDER BY manifest_row_index, frame_id) AS line_no,
        CASE WHEN caption IS NULL THEN 'blank line' WHEN trim(caption) = '' THEN 'not an object' WHEN trim(coalesce(ocr_text, '')) = '' THEN 'bad JSON' END AS reason FROM cap) WHERE reason IS NOT NULL"""),
    "scan_csv_header": _with("fr", "SELECT frame_id, hour FROM fr"),
    "scan_first_existing": _with("fr", "SELECT stream_name, count(*) AS n, 'jsonl' AS kind FROM fr GROUP BY 1"),
    "results_json": _with("b,fr", """SELECT query_id, '{"B":[' || string_agg('{"rank":' || rank || ',"frame_id":"' || frame_id || '","score":' || round(score, 4)::varchar || ',"stream_name":"' || stream_name || '","multi_angle":' || multi_angle::varchar || '}', ',' ORDER BY rank) || ']}' AS json FROM fin GROUP BY 1""", _dedup("b", extra=_FINISH)),
    "pool_candidates": _with("a,b,fr", """SELECT split_part(query_id, '|', 1) AS query_id, frame_id, arg_max(stream_name, (score, split_part(query_id, '|', 2))) AS stream_name, cast(round(cast(max(score) AS decimal(18, 9)), 6) AS double) AS best_score, string_agg(DISTINCT split_part(query_id, '|', 2), ',' ORDER BY split_part(query_id, '|', 2)) AS appeared_in
        FROM fin GROUP BY 1, 2""", "ls AS (SELECT query_id || '|A' AS query_id, frame_id, score FROM a UNION ALL SELECT query_id || '|B', frame_id, score FROM b)," + _dedup("ls", extra=_FINISH)),
    "run_evaluation": _with("a,b,c,q,cap,fr", "SELECT split_part(query_id, '|', 1) AS query_id, split_part(query_id, '|', 2) AS approach, rank, frame_id, cast(round(cast(score AS decimal(18, 9)), 4) AS double) AS score, stream_name, multi_angle FROM fin", _LOGIT.format("c") + "," + _dedup("hy", tag="h") + f""",
ld AS (SELECT query_id, frame_id, {_SQUASH} AS score FROM (SELECT * FROM ddh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 10)),
ls AS (SELECT query_id || '|A' AS query_id, frame_id, score FROM a UNION ALL SELECT query_id || '|B', frame_id, score FROM b UNION ALL SELECT query_id || '|C', frame_id, score FROM c UNION ALL SELECT query_id || '|D', frame_id, score FROM ld),""" + _dedup("ls", extra=_FINISH)),
}
