"""DuckDB counterparts of the catalogue. Regular expressions stay within what both engines share."""

WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
LWS = r"[\t\x0B\f\r \x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def normalize(c: str) -> str:
    t = f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '{LWS}+', ' ', 'g')"
    return strip(f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')")


def plain(c: str) -> str:
    return f"regexp_replace({c}, '⟦[^⟧]*⟧', '', 'g')"


def compact(c: str, n: int) -> str:
    t = strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(substr({t}, 1, {n - 3}), ' +$', '') || '...' END"


def count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


SEG = "seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY extracted_at DESC NULLS LAST, doc_id, seq) AS rn FROM segments) WHERE rn = 1)"
CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY updated_at DESC NULLS LAST, source_norm DESC NULLS LAST, target_text DESC NULLS LAST) AS rn FROM tm_exact) WHERE rn = 1)"
PRO = "pro AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, source_hash DESC NULLS LAST, error DESC NULLS LAST) AS rn FROM progress) WHERE rn = 1)"
BLK = f"blk AS (SELECT doc_id, page_number, block_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.text AS text FROM (SELECT doc_id, page_number, block_id, min(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, text := text)) AS b FROM pdf_blocks GROUP BY ALL) WHERE length({strip('b.text')}) > 0)"
PAG = "pag AS (SELECT doc_id, page_number, max(width_pt) AS width_pt, max(height_pt) AS height_pt FROM pdf_pages GROUP BY ALL)"
STANDARD = "regexp_matches(source, '(?i)^\\s*(AMS|ASTM|MIL|ISO|SAE|BS|DIN|EN|QQ|NAS)\\b') AND regexp_matches(source, '[0-9]')"
GAP = f"(?:{WS}|⟦BR(?:LINE|COL|PAGE)_[0-9]+⟧)"
#: The pattern of a term, in which a sign that is no letter or digit stands for the edges that a term must not touch.
PATTERN = f"""CASE WHEN regexp_matches(term, '[A-Za-z0-9]') THEN '(?i)(?:^|[^A-Za-z0-9])' ELSE '(?i)' END
  || replace(replace(replace(regexp_replace(term, '([.()/+*?{{}}|^$\\[\\]])', '\\\\\\1', 'g'), '-', chr(2)), ' ', '{GAP}+'), chr(2), '{GAP}*-{GAP}*') || CASE WHEN regexp_matches(term, '[A-Za-z0-9]') THEN '(?:[^A-Za-z0-9]|$)' ELSE '' END"""
TERM = f"""term AS (SELECT *, {PATTERN} AS pattern_ FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, target, source) AS rn FROM (
  SELECT lower({strip('source')}) AS term, {strip('source')} AS source, {strip('target')} AS target, rank FROM glossary WHERE NOT ({STANDARD})) WHERE length(term) > 0 AND length(target) > 0) WHERE rn = 1))"""


def found(src: str) -> str:
    return f"SELECT s.segment_id AS key, t.term, t.source, t.target, t.rank FROM {src} s JOIN term t ON regexp_matches(s.source_plain, t.pattern_)"


LONGEST = "ORDER BY length(term) DESC, rank, term"


TAG = "tag AS (SELECT * FROM seg WHERE target_tagged IS NOT NULL)"


def minus(a: str, b: str) -> str:
    """Multiset difference of two lists, sorted and joined."""
    return f"array_to_string(list_sort(flatten(list_transform(list_distinct({a}), lambda x: list_transform(range(greatest(0, len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x)))), lambda i: x)))), ',')"


ST = r"⟦/?S_[0-9]+(?:\|[^⟧|]+)*⟧"


def style(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '{ST}')"


def holders(c: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({c}, ''), '⟦[A-Z][A-Z0-9]*_[0-9]+⟧'), lambda x: NOT starts_with(x, '⟦S_'))"


ALLOWED = "('amm','api','ata','cmm','docx','en','ipc','kg','kpa','mlg','mm','nlg','nm','oem','pdf','pn','psi','ru','safran','sb')"


def repeats(n: int) -> str:
    return f"list_transform(list_filter(range(1, greatest(1, len(cw) - {2 * n} + 2)), lambda i: cw[i : i + {n - 1}] = cw[i + {n} : i + {2 * n - 1}]), lambda i: array_to_string(cw[i : i + {n - 1}], ' '))"


def numbers(c: str) -> str:
    """Numbers without look-around: each run of capitals and digits is put between marks, so that a number is whole runs of digits; a sign behind a run is none."""
    wrapped = f"regexp_replace(regexp_replace({plain(c)}, '([A-Z0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1) || '[-+]' || chr(1), chr(1) || ' ' || chr(1), 'g')"
    run = "' || chr(1) || '[0-9]+' || chr(1) || '"
    one = f"[-+]?{run}(?:[.,]{run})?"
    return f"list_transform(regexp_extract_all({wrapped}, '{one}(?:\\s*±\\s*{one})?'), lambda x: regexp_replace(replace(replace(x, chr(1), ''), ',', '.'), '\\s+', ' ', 'g'))"


CONTROL = "DOC_SECTION|TABLE_CELL|TOC_ENTRY|MATCHED_GLOSSARY|DOCUMENT_GLOSSARY|TM_REFERENCES|RECENT_TRANSLATIONS"


def base(key: str, src: str, tgt: str, shielded: str, target_shielded: str, table: str) -> str:
    """What the rules look at. A word repeats directly where only blanks and light marks stand between it and itself, seen in the list of words and of what is between them."""
    pieces = f"regexp_extract_all({plain(tgt)}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    return f"""base AS (SELECT {key} AS key, length({strip(plain(src))}) AS ls, length({strip(plain(tgt))}) AS lt, length({plain(src)}) > 0 AS has_source, {holders(shielded)} AS ps, {holders(target_shielded)} AS pt, {style(shielded)} AS ss, {style(target_shielded)} AS sts,
  {numbers(src)} AS ns, {numbers(tgt)} AS nt, list_filter(regexp_extract_all({plain(tgt)}, '[A-Za-z][A-Za-z0-9/-]*'), lambda w: length(w) >= 3 AND lower(w) NOT IN {ALLOWED} AND NOT regexp_matches(w, '[0-9]') AND NOT (upper(w) = w AND length(w) <= 5)) AS odd,
  {count(plain(tgt), '[A-Za-zА-Яа-яЁё]+')} AS words, list_transform(regexp_extract_all({plain(tgt)}, '[А-Яа-яЁё]{{2,}}'), lambda w: lower(w)) AS cw, {pieces} AS pieces, upper({target_shielded}) AS up,
  list_transform(regexp_extract_all({plain(tgt)}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])((?:{CONTROL})(?:[^\\p{{L}}\\p{{N}}_]|$)|(?:PART|SECTION|PREV|NEXT)\\s*[:=])', 1), lambda x: regexp_replace(upper(x), '[^A-Z_]+$', '')) AS hits FROM {table}),
again AS (SELECT *, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(pieces) - 1), lambda i: regexp_full_match(pieces[i], '[А-Яа-яЁё]{{2,}}') AND lower(pieces[i]) = lower(pieces[i + 2]) AND regexp_full_match(pieces[i + 1], '(?:{WS}|[,;:()-])+')), lambda i: lower(pieces[i])))), ',') AS again,
  array_to_string(list_sort(list_distinct(list_concat({repeats(2)}, {repeats(3)}))), ',') AS phrases,
  array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ',') AS leaked, list_transform(odd, lambda x: lower(x)) AS low FROM base),
iss AS (
 SELECT key, 'placeholders_mismatch' AS code, 'error' AS severity, {minus('ps', 'pt')} || '/' || {minus('pt', 'ps')} AS details FROM again WHERE list_sort(ps) <> list_sort(pt)
 UNION ALL SELECT key, 'style_tags_mismatch', 'error', array_to_string(ss, ',') || '/' || array_to_string(sts, ',') FROM again WHERE ss <> sts
 UNION ALL SELECT key, 'numbers_mismatch', 'warn', array_to_string(ns, ',') || '/' || array_to_string(nt, ',') FROM again WHERE ns <> nt
 UNION ALL SELECT key, 'empty_translation', 'error', '' FROM again WHERE ls > 0 AND lt = 0
 UNION ALL SELECT key, 'length_ratio_high', 'warn', lt || '/' || ls FROM again WHERE ls > 0 AND lt > ls * 3.0
 UNION ALL SELECT key, 'short_translation', 'warn', lt || '/' || ls FROM again WHERE ls >= 24 AND lt::DOUBLE / ls < 0.35::DOUBLE
 UNION ALL SELECT key, 'untranslated_fragments', 'warn', array_to_string(list_filter(odd, lambda x, i: list_position(low, lower(x)) = i)[1:8], ',') FROM again WHERE has_source AND words > 0 AND len(odd) > 0 AND len(odd) / greatest(words, 1) >= 0.15::DOUBLE
 UNION ALL SELECT key, 'repeated_words', 'warn', again || '/' || phrases FROM again WHERE again <> '' OR phrases <> ''
 UNION ALL SELECT key, 'context_leakage', 'warn', leaked FROM again WHERE leaked <> ''
 UNION ALL SELECT key, 'repair_payload_leak', 'error', '' FROM again WHERE contains(up, 'TASK: REPAIR_MARKERS') OR contains(up, 'SOURCE:') AND contains(up, 'OUTPUT:'))"""


ISS = base("segment_id", "coalesce(source_plain, '')", "target_tagged", "coalesce(shielded_tagged, '')", "coalesce(target_shielded_tagged, '')", "tag")
DOCS = "docs AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id) AS rn FROM documents) WHERE rn = 1)"
DOC_ISS = base("doc_id", "''", "coalesce(text, '')", "''", "coalesce(text, '')", "docs")
TERM_ISS = f"""mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key {LONGEST}) AS pos FROM ({found('tag')})) WHERE pos <= 24),
tis AS (SELECT m.key, 'glossary_lemma_mismatch' AS code, 'warn' AS severity, string_agg(m.term || '=>' || m.target, ',' ORDER BY m.term, m.target) AS details FROM mt m JOIN tag s ON m.key = s.segment_id WHERE NOT contains(lower({plain('s.target_tagged')}), lower(m.target)) GROUP BY 1)"""

Q = f"""SELECT n.doc_id, n.segments, coalesce(q.issues, 0) AS issues, coalesce(q.errors, 0) AS errors, coalesce(q.warnings, 0) AS warnings, coalesce(q.infos, 0) AS infos, coalesce(q.mismatched, 0) AS mismatched, coalesce(q.layout_issues, 0) AS layout_issues,
  coalesce(q.fixes, 0) AS fixes, round(greatest(0.0, 1 - coalesce(q.mismatched, 0) / n.segments), 6) AS compliance FROM (SELECT doc_id, count(*) AS segments FROM seg GROUP BY 1) n LEFT JOIN (
  SELECT doc_id, count(*) AS issues, count_if(severity = 'error') AS errors, count_if(severity = 'warn') AS warnings, count_if(severity = 'info') AS infos, count(DISTINCT CASE WHEN code = 'glossary_lemma_mismatch' THEN key END) AS mismatched,
  count_if(code LIKE '%layout%' OR code LIKE '%overflow%' OR code = 'length_ratio_high') AS layout_issues, count_if(code = 'layout_auto_fix_applied') AS fixes FROM (FROM iss UNION ALL FROM tis) JOIN seg ON key = segment_id GROUP BY 1) q USING (doc_id)"""

USE = """use AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'model-s' WHEN user_id % 3 = 1 THEN 'MODEL-L ' ELSE 'unknown' END AS model, event_type AS phase, floor(value * 10)::BIGINT AS input_tokens, floor(value * 3)::BIGINT AS output_tokens,
  floor(value * 13)::BIGINT AS total_tokens, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN floor(value) / 100 END AS cost FROM events)"""
TOT = "count(*) AS requests, sum(greatest(0, input_tokens))::BIGINT AS input_tokens, sum(greatest(0, output_tokens))::BIGINT AS output_tokens, sum(greatest(0, total_tokens))::BIGINT AS total_tokens, round(sum(cost), 6) AS cost, count(cost) AS cost_records"

LATIN, CYR = "[A-Za-z]", "[А-Яа-яЁё]"


def todo(c: str) -> str:
    l, y, lw, yw = count(c, LATIN), count(c, CYR), count(c, "[A-Za-z]+"), count(c, "[А-Яа-яЁё]{2,}")
    return f"CASE WHEN {c} IS NULL OR {l} = 0 THEN false WHEN {y} = 0 THEN true WHEN ({y} >= 2 * {l} AND {lw} <= 14) OR {yw} >= greatest(3, 2 * {lw}) THEN false ELSE NOT ({y} >= 3 * {l} AND {l} <= 12) END"


def flat(c: str) -> str:
    return strip(f"regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g')")


def margin(c: str) -> str:
    return f"regexp_replace(lower({strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")}), '[^0-9A-Za-zА-Яа-яЁё:/()., -]+', '', 'g')"


MAR = f"""atm AS (SELECT doc_id, page_number, block_id, CASE WHEN y1 <= height_pt * 0.18::DOUBLE THEN 'header' WHEN y0 >= height_pt * 0.82::DOUBLE THEN 'footer' END AS kind, {margin('text')} AS norm FROM blk JOIN pag USING (doc_id, page_number)),
mar AS (SELECT doc_id, kind, norm, count(DISTINCT page_number) AS pages FROM atm WHERE kind IS NOT NULL AND length(norm) >= 8 GROUP BY ALL HAVING pages >= 3)"""
DRA = """dra AS (SELECT doc_id, page_number, d, width_pt, height_pt, width_pt * 0.05::DOUBLE AS rx0, height_pt * [0.1::DOUBLE, 0.1, 0.85][d + 1] AS ry0, width_pt * 0.95::DOUBLE AS rx1, height_pt * [0.8::DOUBLE, 0.45, 0.88][d + 1] AS ry1
  FROM (SELECT *, unnest([0, 1, 2]) AS d FROM pag WHERE page_number % 3 = 0))"""


def clusters(values: str, tolerance: str) -> str:
    """Clusters of a sorted list by a fold over ``[count, anchor]``."""
    return f"list_reduce(list_prepend([0.0::DOUBLE, NULL], list_transform(list_sort({values}), lambda v: [v])), lambda a, v: CASE WHEN abs(v[1] - a[2]) <= {tolerance} THEN [a[1], (a[2] + v[1]) / 2] ELSE [a[1] + 1, v[1]] END)[1]"


#: Frames that hold a table; of the two frames of a page the larger holds the smaller, and both become one where the smaller has 18 percent of it.
REG = f"""hit AS (SELECT r.doc_id, r.page_number, d, rx0, ry0, rx1, ry1, any_value(width_pt * height_pt) AS page, count(*) AS n, list((x0 + x1) / 2) AS xs, list((y0 + y1) / 2) AS ys, sum(greatest(0, x1 - x0) * greatest(0, y1 - y0)) AS area FROM dra r JOIN blk b ON r.doc_id = b.doc_id AND r.page_number = b.page_number AND rx0 < x1 AND x0 < rx1 AND ry0 < y1 AND y0 < ry1 GROUP BY ALL),
tab AS (SELECT *, (rx1 - rx0) * (ry1 - ry0) AS a FROM hit WHERE n >= 3 AND rx1 - rx0 >= 40 AND ry1 - ry0 >= 20 AND (rx1 - rx0) * (ry1 - ry0) / greatest(1.0, page) <= 0.68::DOUBLE AND greatest(rx1 - rx0, ry1 - ry0) / greatest(1.0, least(rx1 - rx0, ry1 - ry0)) <= 35
  AND {clusters('xs', 'greatest(14.0, (rx1 - rx0) * 0.04::DOUBLE)')} >= 2 AND {clusters('ys', 'greatest(10.0, (ry1 - ry0) * 0.03::DOUBLE)')} >= 2 AND area / greatest(1.0, (rx1 - rx0) * (ry1 - ry0)) >= 0.035::DOUBLE),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY a DESC, d) AS rn FROM tab) WHERE rn = 1),
reg AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY a DESC, d) - 1 AS region_id, rx0, ry0, rx1, ry1 FROM (FROM fst UNION ALL BY NAME
  SELECT t.*, 2 AS rn FROM tab t JOIN fst f USING (doc_id, page_number) WHERE t.d <> f.d AND NOT (t.rx0 < f.rx1 AND f.rx0 < t.rx1 AND t.ry0 < f.ry1 AND f.ry0 < t.ry1 AND least(t.a, f.a) / ((greatest(t.rx1, f.rx1) - least(t.rx0, f.rx0)) * (greatest(t.ry1, f.ry1) - least(t.ry0, f.ry0))) >= 0.18::DOUBLE)))"""
#: Columns of pages: candidates by the strict rule, by the loose one where there are fewer than four.
COLS = f"""can AS (SELECT *, {count('text', '[' + chr(92) + 'p{L}]')} AS letters, length({flat('text')}) AS chars, (x0 + x1) / 2 <= width_pt / 2 AS lft FROM blk JOIN pag USING (doc_id, page_number)),
can2 AS (SELECT *, letters >= 2 AND y0 >= height_pt * 0.08::DOUBLE AND y1 <= height_pt * 0.92::DOUBLE AND (x1 - x0 >= width_pt * 0.16::DOUBLE OR chars >= 18) AS strict, letters >= 1 AND (x1 - x0 >= width_pt * 0.12::DOUBLE OR chars >= 8) AS loose FROM can),
can3 AS (SELECT *, CASE WHEN count_if(strict) OVER (PARTITION BY doc_id, page_number) >= 4 THEN strict ELSE loose END AS cand FROM can2),
grp AS (SELECT doc_id, page_number, max(width_pt) AS w, min(x0) AS x0, max(x1) AS x1, count_if(cand) AS n, count_if(cand AND lft) AS nl, count_if(cand AND NOT lft) AS nr, median(x0) FILTER (cand AND lft) AS xl, median(x0) FILTER (cand AND NOT lft) AS xr, median(x1 - x0) FILTER (cand AND lft) AS wl, median(x1 - x0) FILTER (cand AND NOT lft) AS wr,
  min(x0) FILTER (cand AND lft) AS l0, max(x1) FILTER (cand AND lft) AS l1, min(x0) FILTER (cand AND NOT lft) AS r0, max(x1) FILTER (cand AND NOT lft) AS r1 FROM can3 GROUP BY ALL),
col AS (SELECT *, coalesce(n >= 4 AND least(nl, nr) >= 2 AND least(nl, nr) / n >= 0.2::DOUBLE AND xr - xl >= w * 0.24::DOUBLE AND least(wl, wr) >= w * 0.18::DOUBLE AND greatest(wl, wr) / greatest(1.0, least(wl, wr)) <= 2.4::DOUBLE AND r0 - l1 >= w * 0.03::DOUBLE, false) AS two FROM grp)"""
IDX = "coalesce(two AND abs((b.x0 + b.x1) / 2 - (r0 + r1) / 2) < abs((b.x0 + b.x1) / 2 - (l0 + l1) / 2), false)::INT"
TYP = f"""own AS (SELECT b.doc_id, b.page_number, b.block_id, min(region_id) AS region FROM blk b JOIN reg r ON r.doc_id = b.doc_id AND r.page_number = b.page_number AND rx0 < b.x1 AND b.x0 < rx1 AND ry0 < b.y1 AND b.y0 < ry1 GROUP BY ALL),
typ AS (SELECT b.*, {IDX} AS column_index, CASE WHEN m.pages IS NOT NULL THEN a.kind WHEN o.region IS NOT NULL THEN 'table_cell' WHEN b.y1 <= height_pt * 0.1::DOUBLE THEN 'header' WHEN b.y0 >= height_pt * 0.9::DOUBLE THEN 'footer' ELSE 'body' END AS block_type
  FROM blk b JOIN pag USING (doc_id, page_number) JOIN atm a ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.block_id = b.block_id LEFT JOIN mar m ON m.doc_id = b.doc_id AND m.kind = a.kind AND m.norm = a.norm
  LEFT JOIN own o ON o.doc_id = b.doc_id AND o.page_number = b.page_number AND o.block_id = b.block_id LEFT JOIN col c ON c.doc_id = b.doc_id AND c.page_number = b.page_number)"""
LAY = f"{BLK}, {PAG}, {MAR}, {DRA}, {REG}, {COLS}, {TYP}"

TOK = """tok AS (SELECT key, token, count(*) AS tf FROM (SELECT side, key, unnest(regexp_split_to_array(lower(text), '[^0-9A-Za-z\\x{0400}-\\x{04FF}]+')) AS token FROM (
  SELECT 'a' AS side, 'i' || item_id AS key, text FROM eval_items UNION ALL SELECT 'b', 'd' || doc_id, text FROM documents WHERE length(text) > 0))
  WHERE (length(token) > 1 OR regexp_matches(token, '^[0-9]$')) AND token NOT IN ('safran','landing','systems','uk','ltd','код','cage','k0654','руководство','техническому','обслуживанию','компонентов','стойка','основного','шасси','mar','2025','18') GROUP BY ALL)"""


def issues(codes: str) -> str:
    return f"WITH {SEG}, {TAG}, {ISS} SELECT key AS segment_id, code, details FROM iss WHERE code IN ({codes})"


SUMMED = ("chunks_total", "requests_total", "requests_succeeded", "requests_failed", "chunks_failed", "suggestions_total")
TRA = f"""tra AS (SELECT line_no, event, 'c' || user_id || CASE WHEN kind = 'request' THEN '' ELSE half END AS chunk_id, edits, {', '.join(f"CASE WHEN event = 'summary' AND line_no % {i + 2} = 0 THEN {100 + i} END AS {c}" for i, c in enumerate(SUMMED))}
  FROM (SELECT event_id AS line_no, user_id, ['request','response','error','split','failed_chunk'][(event_id % 5) + 1] AS kind,
  CASE WHEN event_id % 1999 = 0 THEN 'summary' ELSE ['request','response','error','split','failed_chunk'][(event_id % 5) + 1] END AS event, CASE event_id % 3 WHEN 0 THEN '.a' WHEN 1 THEN '.b' ELSE '' END AS half, floor(value)::INT AS edits FROM events))"""


def counter(name: str, event: str | None) -> str:
    """The counter of the last summary that carries it, and what came behind that line."""
    carried = name in SUMMED
    start = f"coalesce((SELECT max(line_no) FROM tra WHERE {name} IS NOT NULL), -1)" if carried else "-1"
    first = f"coalesce((SELECT arg_max({name}, line_no) FROM tra WHERE {name} IS NOT NULL), 0)" if carried else "0"
    gain = "greatest(0, coalesce(edits, 0))" if name == "suggestions_total" else "1"
    later = f"coalesce((SELECT sum({gain}) FROM tra WHERE event = '{event}' AND line_no > {start}), 0)" if event else "0"
    return f"({first} + {later})::BIGINT AS {name}"


REPLAY = {"chunks_total": None, "segments_checked": None, "translatable_segments": None, "requests_total": "request", "requests_succeeded": "response", "requests_failed": "error", "chunks_failed": "failed_chunk", "split_events": "split", "suggestions_total": "response"}


def spaced(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '{WS}+', ' ', 'g'), ' ?- ?', '-', 'g')"


VAR = f"""var AS (SELECT * FROM (SELECT f.term, CASE WHEN contains({spaced(flat(plain('s.target_tagged')))}, {spaced('f.target')}) THEN f.target WHEN regexp_replace(lower(s.source_plain), '[^\\p{{L}}\\p{{N}}]+', '', 'g') = regexp_replace(lower(f.term), '[^\\p{{L}}\\p{{N}}]+', '', 'g')
  THEN regexp_replace(regexp_replace({flat(plain('s.target_tagged'))}, '^[ .,:;!?]+', ''), '[ .,:;!?]+$', '') END AS variant, f.key FROM ({found('tag')}) f JOIN tag s ON f.key = s.segment_id) WHERE length(variant) > 0)"""
JAC = """qs AS (SELECT segment_id AS q, list_distinct(list_transform(regexp_extract_all(source_plain, '[A-Za-zА-Яа-яЁё0-9]{2,}'), lambda x: lower(x))) AS tq FROM seg WHERE seq % 20 = 0),
es AS (SELECT source_hash AS e, list_distinct(list_transform(regexp_extract_all(source_norm, '[A-Za-zА-Яа-яЁё0-9]{2,}'), lambda x: lower(x))) AS te FROM cur),
jac AS (SELECT q, e, len(list_intersect(tq, te)) / (len(tq) + len(te) - len(list_intersect(tq, te))) AS j FROM qs JOIN es ON len(tq) > 0 AND len(te) > 0 AND len(tq) >= 0.7 * len(te) - 1e-9 AND len(te) >= 0.7 * len(tq) - 1e-9)"""
EDI = """edi AS (SELECT h.segment_id, 'c' || substr(h.segment_id, 1, 1) AS chunk_id, CASE WHEN hit_rank % 2 = 0 THEN 'terminology' ELSE 'style' END AS issue_type, s.target_tagged AS cur_t, h.target_text AS sug, CASE WHEN hit_rank % 5 = 0 THEN 'No change needed.' WHEN hit_rank % 7 = 0 THEN '' ELSE 'use the memory' END AS ins,
  h.similarity AS conf, row_number() OVER (PARTITION BY h.segment_id ORDER BY hit_rank NULLS FIRST, h.source_hash NULLS FIRST, coalesce(similarity, -1), h.target_text NULLS FIRST) AS edit_no FROM fuzzy_hits h LEFT JOIN seg s USING (segment_id))"""


def rule(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN '{name}' END"


def why(cur: str, sug: str, ins: str, conf: str, least: float) -> str:
    """The reasons against an edit, in their order."""
    s, c, i = flat(sug), flat(cur), strip(f"coalesce({ins}, '')")
    both = f"{s} <> '' AND {c} <> ''"
    return (
        f"array_to_string(list_filter([{rule(s + " = ''", 'missing_suggested_target')}, {rule(i + " = ''", 'missing_instruction')}, {rule(f'{both} AND {s} = {c}', 'no_op')}, {rule(f"regexp_matches({i}, '(?i)\\bno\\s+change\\s+needed\\b|без\\s+изменени')", 'nochange_instruction')},"
        f" {rule(f'greatest(0, least(1, coalesce({conf}, 0))) < {least}::DOUBLE', 'low_confidence')}, {rule(f'{both} AND {style(s)} <> {style(c)}', 'style_tags_mismatch')}, {rule(f'{both} AND list_sort({holders(s)}) <> list_sort({holders(c)})', 'placeholders_mismatch')}], lambda x: x IS NOT NULL), ',')"
    )


#: Width and height of characters from the spans' fonts, averaged by their lengths.
MET = """spa AS (SELECT segment_id, unnest(spans) AS s FROM seg), siz AS (SELECT segment_id, s.style.font_size_pt AS size, greatest(1, length(coalesce(s.source_text, ''))) AS n, regexp_replace(lower(s.style.font_name), '[^a-z0-9]+', '', 'g') AS f FROM spa),
fac AS (SELECT *, CASE WHEN contains(f, 'arial') THEN 0.52 WHEN contains(f, 'calibri') THEN 0.50 WHEN contains(f, 'timesnewroman') THEN 0.50 WHEN contains(f, 'cambria') THEN 0.52 WHEN contains(f, 'segoeui') THEN 0.51 WHEN contains(f, 'notosans') THEN 0.50 WHEN contains(f, 'notoserif') THEN 0.52 WHEN contains(f, 'couriernew') THEN 0.60 ELSE 0 END::DOUBLE AS factor FROM siz),
met AS (SELECT segment_id, trunc(sum(n * CASE WHEN size IS NULL OR factor = 0 THEN 120.0::DOUBLE ELSE greatest(40.0, size * 20 * factor) END) / sum(n))::INT AS char_w, trunc(sum(n * CASE WHEN size IS NULL THEN 220.0::DOUBLE ELSE greatest(100.0, size * 20 * 1.2::DOUBLE) END) / sum(n))::INT AS char_h FROM fac GROUP BY 1)"""
AREA = "greatest(1, trunc(w::DOUBLE * h / greatest(1, cw * ch))::INT)"
CAP = f"""{MET}, cnt AS (SELECT s.segment_id, s.in_table, s.in_textbox, s.in_frame, coalesce(char_w, 120) AS cw, coalesce(char_h, 220) AS ch, CASE WHEN width_twips > 0 THEN width_twips END AS w, CASE WHEN height_twips > 0 THEN height_twips END AS h, length({flat(plain("coalesce(source_plain, '')"))}) AS ls, length({flat(plain("coalesce(target_tagged, '')"))}) AS lt FROM seg s LEFT JOIN met USING (segment_id)),
cap AS (SELECT *, CASE WHEN in_table AND w IS NOT NULL THEN greatest(1, trunc(w / greatest(1, cw))::INT) END AS tcap, CASE WHEN in_textbox AND w IS NOT NULL THEN CASE WHEN h IS NOT NULL THEN {AREA} ELSE greatest(1, trunc(w / greatest(1, cw))::INT) END END AS bcap, CASE WHEN in_frame AND w IS NOT NULL AND h IS NOT NULL THEN {AREA} END AS fcap FROM cnt)"""


def over() -> str:
    """The layout issues of a segment."""
    item = lambda cond, code, cap: f"CASE WHEN {cond} THEN struct_pack(code := '{code}', cap := {cap}) END"
    return (
        f"[{item('ls > 0 AND lt > 0 AND lt::DOUBLE / ls > 1.5', 'length_ratio_high', 'NULL::INT')}, {item('lt > trunc(tcap * 1.15::DOUBLE)', 'layout_table_overflow_risk', 'tcap')},"
        f" {item('in_textbox AND ls > 0 AND lt > 0 AND CASE WHEN bcap IS NOT NULL THEN lt > trunc(bcap * 1.1::DOUBLE) ELSE lt::DOUBLE / ls > 1.6::DOUBLE AND lt - ls >= 20 END', 'layout_textbox_overflow_risk', 'bcap')}, {item('lt > trunc(fcap * 1.15::DOUBLE)', 'layout_frame_overflow_risk', 'fcap')}]"
    )


COUNTED = """tok AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM (SELECT 'i' || item_id AS key, text FROM eval_items UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE length(text) > 0)) WHERE length(token) > 1 OR regexp_matches(token, '^[0-9]$') GROUP BY ALL)"""
NEAR = f"""nb AS (SELECT *, lag(source_plain) OVER w AS p_, lead(source_plain) OVER w AS n_ FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seq, segment_id)),
near AS (SELECT *, CASE WHEN regexp_matches(source_plain, '[A-Za-z]') THEN nullif(CASE WHEN in_table THEN {compact('p_', 100)} ELSE {compact('p_', 220)} END, '') END AS prev_text, CASE WHEN regexp_matches(source_plain, '[A-Za-z]') THEN nullif(CASE WHEN in_table THEN {compact('n_', 100)} ELSE {compact('n_', 220)} END, '') END AS next_text FROM nb)"""


def joined(parts: list[str]) -> str:
    return f"coalesce(nullif(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' | '), ''), '(no context)')"


#: What the markup made of a segment's marks holds.
XML = {"drawing": "⟦OBJ_", "pict": None, "br_any": "⟦BR", "br_column": "⟦BRCOL_", "hyperlink": None, "fldChar": None, "instrText": None, "sectPr": None}


def diff(name: str, mark: str | None) -> str:
    return f"{'sum(' + count('b', mark) + ' - ' + count('a', mark) + ')::BIGINT' if mark else '0::BIGINT'} AS {name}"


#: The sizes of the twelve configurations, with the models and lengths that the query gives them.
SIZED = """WITH m AS (SELECT *, ['gpt-5-mini','gpt-5','gpt-4o-mini','gpt-5.2',NULL,'gpt-4.1-mini'] AS names FROM llm_config), p(name, ctx, octx, bc, bs, oc, rs, ro, rp) AS (VALUES ('gpt-5.2', 400000, 128000, 60000, 24, 64000, 120, 8000, 4), ('gpt-5-mini', 400000, 128000, 60000, 24, 64000, 120, 8000, 4),
  ('gpt-5', 400000, 128000, 60000, 24, 64000, 120, 8000, 4), ('gpt-4.1-mini', 1047576, 32768, 18000, 10, 9000, 120, 3000, 3), ('gpt-4o-mini', 128000, 16384, 12000, 6, 6000, 80, 2200, 2)),
  r AS (SELECT config_id, batch_segments, batch_max_chars, max_output_tokens, config_id * 37 + 60 AS med, config_id * 500 AS pc, config_id % 5 <> 0 AS free, names[config_id % 6 + 1] AS tm, coalesce(names[(config_id + 3) % 6 + 1], names[config_id % 6 + 1]) AS rm FROM m),
  j AS (SELECT r.*, t.ctx, t.octx, t.bc, t.bs, t.oc, v.ctx AS rctx, v.octx AS roctx, v.rs, v.ro, v.rp FROM r LEFT JOIN p t ON r.tm = t.name LEFT JOIN p v ON r.rm = v.name),
  a AS (SELECT *, ctx IS NOT NULL AND free AND greatest(1, batch_segments) > 1 AS auto FROM j),
  b AS (SELECT *, CASE WHEN auto THEN greatest(6000, least(bc, trunc(greatest(900, trunc(ctx * CASE WHEN ctx >= 200000 THEN 0.15::DOUBLE WHEN ctx >= 100000 THEN 0.1::DOUBLE ELSE 0.08::DOUBLE END) - trunc((pc + 1200) / 3.2::DOUBLE)) * 3.2::DOUBLE)))::BIGINT ELSE greatest(1000, batch_max_chars) END AS chars FROM a),
  c AS (SELECT *, CASE WHEN auto THEN greatest(2, least(bs, trunc(chars / greatest(320, med + 180))))::BIGINT ELSE greatest(1, batch_segments) END AS segs FROM b),
  d AS (SELECT *, trunc(CASE WHEN segs <= 1 THEN greatest(1200, trunc(med * 1.8::DOUBLE)) ELSE chars END * 1.35::DOUBLE / 2.2::DOUBLE) + 420 AS est, CASE WHEN rctx IS NOT NULL THEN greatest(24, least(rs, trunc(trunc(greatest(700, trunc(rctx * 0.14::DOUBLE) - 437) * 3.2::DOUBLE) / greatest(260, trunc(med * 2.4::DOUBLE))))) ELSE 80 END AS rsegs FROM c)
  SELECT config_id, segs::BIGINT AS batch_segments, chars::BIGINT AS batch_chars, CASE WHEN ctx IS NOT NULL THEN greatest(256, max_output_tokens, greatest(1400, least(oc, greatest(1024, trunc(octx * 0.55::DOUBLE)), est))) ELSE greatest(256, max_output_tokens) END::BIGINT AS output_tokens, coalesce(rp, 3)::BIGINT AS review_pages, rsegs::BIGINT AS review_segments,
  CASE WHEN rctx IS NOT NULL THEN greatest(600, greatest(900, least(ro, greatest(1000, trunc(roctx * 0.2::DOUBLE)), 500 + greatest(4, rsegs // 8) * 55))) ELSE 600 END::BIGINT AS review_output FROM d"""


SQL = {
    "q01_segments": f"""SELECT doc_id, (k - 1)::BIGINT AS seq, 'doc' || doc_id || '/p' || (k - 1) AS location, substr(sha1('doc' || doc_id || '/p' || (k - 1) || chr(10) || line), 1, 16) AS segment_id,
      contains(lower(line), 'table of contents') OR regexp_matches(lower(line), '\\t[0-9]+\\s*$') OR regexp_matches(lower(line), '\\.{{6,}}\\s*[0-9]+\\s*$') AS is_toc
      FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length({strip('line')}) > 0""",
    "q02_normalize_hash": f"SELECT doc_id, sha256({normalize('text')}) AS hash, length({normalize('text')}) AS chars FROM documents",
    "q03_compact_text": f"WITH {SEG} SELECT segment_id, {compact('source_plain', 60)} AS snippet FROM seg",
    "q05_source_filter": f"WITH {SEG} SELECT segment_id, {todo(plain('target_tagged'))} AS needs_translation FROM seg",
    "q06_exact_hits": f"WITH {PRO}, {CUR} SELECT p.segment_id, c.source_hash IS NOT NULL AS hit, md5(c.target_text) AS target FROM pro p LEFT JOIN cur c ON p.source_hash = c.source_hash",
    "q07_memory_latest": f"WITH {CUR} SELECT source_hash, md5(target_text) AS target, f.created_at, c.updated_at FROM cur c JOIN (SELECT source_hash, min(created_at) AS created_at FROM tm_exact GROUP BY 1) f USING (source_hash)",
    "q08_resume_reuse": f"""WITH {SEG}, {PRO}, {CUR}, h AS (SELECT segment_id, min(source_hash) AS first FROM fuzzy_hits GROUP BY 1) SELECT s.segment_id, p.status, coalesce(p.status IN ('ok', 'tm'), false) AND c.source_hash IS NOT NULL
      AND coalesce(CASE WHEN length(s.source_plain) % 2 = 0 THEN h.first ELSE p.source_hash END = p.source_hash, false) AS reuse FROM seg s LEFT JOIN pro p USING (segment_id) LEFT JOIN cur c ON p.source_hash = c.source_hash LEFT JOIN h USING (segment_id)""",
    "q09_memory_search": f"WITH {CUR} SELECT source_hash, updated_at FROM cur WHERE contains(lower(source_norm), 'bearing race') OR contains(lower(target_text), 'bearing race') ORDER BY updated_at DESC, source_hash LIMIT 20",
    "q10_token_jaccard_topk": f"WITH {SEG}, {CUR}, {JAC} SELECT q AS segment_id, e AS source_hash, jaccard, hit_rank FROM (SELECT q, e, round(j, 6) AS jaccard, row_number() OVER (PARTITION BY q ORDER BY round(j, 6) DESC, e) AS hit_rank FROM jac WHERE j >= 0.7 - 1e-12) WHERE hit_rank <= 3",
    "q12_glossary_match": f"WITH {SEG}, {TERM}, f AS ({found('seg')}) SELECT key AS segment_id, term, pos FROM (SELECT *, row_number() OVER (PARTITION BY key {LONGEST}) AS pos FROM f) WHERE pos <= 24",
    "q13_glossary_priority_merge": f"""SELECT term, target, origin FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p, r, target) AS rn FROM (SELECT lower({strip('source')}) AS term, {strip('target')} AS target, origin, p, r FROM (
      SELECT p_name AS source, p_type AS target, 'domain' AS origin, 1 AS p, 0 AS r FROM part UNION ALL SELECT source, target, 'user', 0, -rank FROM glossary WHERE NOT ({STANDARD}))) WHERE regexp_matches(term, '\\S\\s+\\S') AND length(target) > 0) WHERE rn = 1""",
    "q14_placeholder_multiset": f"WITH {SEG}, {TAG} SELECT * FROM (SELECT segment_id, {minus(holders('shielded_tagged'), holders('target_shielded_tagged'))} AS missing, {minus(holders('target_shielded_tagged'), holders('shielded_tagged'))} AS extra FROM tag) WHERE missing <> '' OR extra <> ''",
    "q15_style_sequence": f"WITH {SEG}, {TAG} SELECT segment_id, len({style('source_tagged')}) AS source_tokens, len({style('target_tagged')}) AS target_tokens FROM tag WHERE {style('source_tagged')} <> {style('target_tagged')}",
    "q16_length_checks": issues("'empty_translation', 'length_ratio_high', 'short_translation'"),
    "q17_untranslated": issues("'untranslated_fragments'"),
    "q18_repeated_tokens": f"WITH {DOCS}, {DOC_ISS} SELECT key AS doc_id, details FROM iss WHERE code = 'repeated_words'",
    "q19_context_leak": f"""WITH {DOCS.replace('docs AS', 'd0 AS')}, docs AS (SELECT doc_id, ['PART: body ','see SECTION ','TABLE_CELL ','','','tm_references = ','PREVIOUS: ','next='][doc_id % 8 + 1] || text AS text FROM d0), {DOC_ISS}
      SELECT key AS doc_id, details FROM iss WHERE code = 'context_leakage'""",
    "q20_validate_all": f"WITH {SEG}, {TAG}, {ISS} SELECT key AS segment_id, code, severity FROM iss",
    "q21_issue_histogram": f"WITH {SEG}, {TAG}, {ISS} SELECT code, severity, count(*) AS n FROM iss GROUP BY ALL",
    "q22_usage_snapshot": f"WITH {USE}, u AS (SELECT * REPLACE (coalesce(nullif(lower(trim(phase)), ''), 'unknown') AS phase) FROM use) SELECT phase, {TOT} FROM u GROUP BY ROLLUP (phase)",
    "q23_usage_cost": f"""WITH {USE}, p(m, i, o) AS (VALUES ('model-s', 0.5::DOUBLE, 1.5::DOUBLE), ('model-l', 2.0, 8.0)) SELECT model, count(*) AS requests, round(sum(c), 4) AS cost, count(c) AS priced FROM (
      SELECT model, greatest(0, input_tokens) / 1e6 * i + greatest(0, output_tokens) / 1e6 * o AS c FROM use LEFT JOIN p ON lower(trim(model)) = m) GROUP BY 1""",
    "q24_model_profile": """WITH m AS (SELECT config_id, ['gpt-5-mini-2026','gpt-5','gpt-4o-mini','gpt-5.2-x','gpt-50','gpt-5-nano'][config_id % 6 + 1] AS model FROM llm_config),
      p(pos, prefix, ctx, tier) AS (VALUES (0, 'gpt-5.2', 400000, 'turbo'), (1, 'gpt-5-mini', 400000, 'turbo'), (2, 'gpt-5-nano', 400000, 'economy'), (3, 'gpt-5', 400000, 'turbo'), (4, 'gpt-4.1-mini', 1047576, 'balanced'), (5, 'gpt-4o-mini', 128000, 'economy'))
      SELECT config_id, model, prefix AS profile, tier, ctx AS input_context FROM (SELECT *, row_number() OVER (PARTITION BY config_id, model ORDER BY pos) AS rn FROM m LEFT JOIN p ON model = prefix OR starts_with(model, prefix || '-')) WHERE rn = 1""",
    "q25_document_quality": f"WITH {SEG}, {TAG}, {TERM}, {ISS}, {TERM_ISS} {Q}",
    "q26_quality_summary": f"""WITH {SEG}, {TAG}, {TERM}, {ISS}, {TERM_ISS}, q AS ({Q}) SELECT count(*) AS documents, sum(segments)::BIGINT AS segments, sum(issues)::BIGINT AS issues, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos,
      sum(layout_issues)::BIGINT AS layout_issues, sum(fixes)::BIGINT AS fixes, count_if(errors = 0) AS clean_documents, round(avg(compliance), 6) AS avg_compliance FROM q""",
    "q27_term_variants": f"WITH {SEG}, {TAG}, {TERM}, {VAR} SELECT term, variant, count(*) AS n, min(key) AS first_segment FROM var GROUP BY ALL",
    "q28_inconsistencies": f"""WITH {SEG}, {TAG}, {TERM}, {VAR}, v AS (SELECT term, regexp_replace(lower(variant), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS vk, min(variant) AS variant, count(*) AS n FROM var GROUP BY ALL HAVING length(vk) > 0),
      r AS (SELECT *, row_number() OVER w AS pos, lead(n) OVER w AS second FROM v WINDOW w AS (PARTITION BY term ORDER BY n DESC, lower(variant), variant)),
      t AS (SELECT term, count(*) AS variants, sum(n)::BIGINT AS total, max(CASE WHEN pos = 1 AND n > coalesce(second, 0) THEN variant END) AS majority, max(CASE WHEN pos = 1 AND n > coalesce(second, 0) THEN n END) AS majority_count FROM r GROUP BY 1)
      SELECT *, CASE WHEN majority IS NOT NULL THEN total - majority_count END AS minority_count FROM t WHERE variants >= 2""",
    "q29_neighbours": f"""WITH {SEG}, c AS (SELECT segment_id, coalesce(regexp_matches(source_plain, '[A-Za-z]'), false) AS gate, coalesce(in_table, false) AS t, lag(source_plain) OVER w AS p, lead(source_plain) OVER w AS n FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seq, segment_id))
      SELECT segment_id, CASE WHEN gate THEN nullif(CASE WHEN t THEN {compact('p', 100)} ELSE {compact('p', 220)} END, '') END AS prev_text, CASE WHEN gate THEN nullif(CASE WHEN t THEN {compact('n', 100)} ELSE {compact('n', 220)} END, '') END AS next_text FROM c""",
    "q30_recent_ring": f"WITH {SEG}, s AS (SELECT * FROM seg WHERE length({strip('target_tagged')}) > 0) SELECT segment_id, coalesce(array_to_string(list(segment_id) OVER (PARTITION BY doc_id ORDER BY seq, segment_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ','), '') AS recent FROM s",
    "q31_heading_carry": f"WITH {SEG} SELECT segment_id, last_value(CASE WHEN starts_with(lower(paragraph_style), 'heading') THEN source_plain END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM seg",
    "q32_greedy_pack": f"""WITH RECURSIVE {SEG}, i AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, coalesce(length(shielded_tagged), 0) + 128 AS cost FROM seg),
      f AS (SELECT doc_id, k, seq, 0::BIGINT AS group_no, 1 AS items, cost AS load FROM i WHERE k = 1 UNION ALL
        SELECT i.doc_id, i.k, i.seq, CASE WHEN f.items >= 6 OR f.load + i.cost > 1000 THEN f.group_no + 1 ELSE f.group_no END, CASE WHEN f.items >= 6 OR f.load + i.cost > 1000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= 6 OR f.load + i.cost > 1000 THEN i.cost ELSE f.load + i.cost END
        FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1) SELECT doc_id, seq, group_no FROM f""",
    "q33_page_chunks": f"""WITH {SEG}, p AS (SELECT doc_id, segment_id, seq, coalesce(page_number, try_cast(nullif(regexp_extract(location, '^pdf/p([0-9]+)(?:/|$)', 1), '') AS INT)) AS page FROM seg),
      s AS (SELECT doc_id, count(page) >= greatest(1, floor(count(*) * 0.7::DOUBLE)) AS by_page FROM p GROUP BY 1), d AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 3 AS c FROM (SELECT DISTINCT doc_id, page FROM p WHERE page IS NOT NULL)),
      l AS (SELECT doc_id, page, 'pages_' || min(page) OVER w || '_' || max(page) OVER w AS chunk_id FROM d WINDOW w AS (PARTITION BY doc_id, c)),
      f AS (SELECT p.*, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 40 AS k FROM p JOIN s USING (doc_id) WHERE NOT by_page)
      SELECT doc_id, chunk_id, count(*) AS n, min(seq) AS first_seq FROM (SELECT p.doc_id, chunk_id, seq FROM p JOIN s USING (doc_id) JOIN l ON l.doc_id = p.doc_id AND l.page = p.page WHERE by_page
      UNION ALL SELECT doc_id, 'segments_' || (k * 40 + 1) || '_' || (k * 40 + count(*) OVER (PARTITION BY doc_id, k)), seq FROM f) GROUP BY ALL""",
    "q34_batch_eligibility": f"""WITH {SEG}, r AS (SELECT unnest([{rule('is_toc_entry', 'toc_entry')}, {rule("regexp_matches(coalesce(shielded_tagged, ''), '⟦BRLINE_[0-9]+⟧')", 'contains_brline')}, {rule(count("coalesce(shielded_tagged, '')", '⟦S_[0-9]+(?:\\|[^⟧]*)?⟧') + ' > 16', 'too_many_style_tokens')}, {rule(f"len({holders('shielded_tagged')}) > 12", 'too_many_placeholders')}]) AS reason FROM seg)
      SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "q35_budget_prefix": f"""WITH h AS (SELECT DISTINCT segment_id, source_hash, similarity, hit_rank, source_norm, target_text, {compact(plain("coalesce(source_norm, '')"), 180)} AS s, {compact(plain("coalesce(target_text, '')"), 180)} AS t FROM fuzzy_hits WHERE similarity >= 0 AND similarity <= 1),
      r AS (SELECT *, sum(length(s || ' => ' || t) + 1) OVER (PARTITION BY segment_id ORDER BY similarity DESC, hit_rank NULLS FIRST, source_hash, source_norm NULLS FIRST, target_text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS running FROM h WHERE s <> '' AND t <> '')
      SELECT segment_id, source_hash, md5(s || ' => ' || t) AS line, running::BIGINT AS running FROM r WHERE running <= 500""",
    "q36_issue_filter": f"""WITH {SEG}, {TAG}, {ISS}, c AS (SELECT segment_id, concat_ws('/', doc_id, (seq // 20)::VARCHAR) AS chunk FROM seg), h AS (SELECT DISTINCT key FROM iss WHERE code = 'style_tags_mismatch'),
      m AS (SELECT c.*, h.key IS NOT NULL AS hit, bool_or(h.key IS NOT NULL) OVER (PARTITION BY chunk) AS any_hit FROM c LEFT JOIN h ON c.segment_id = h.key) SELECT segment_id, chunk FROM m WHERE hit OR NOT any_hit""",
    "q37_edit_reasons": f"""WITH {SEG}, {EDI}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, segment_id, issue_type, {normalize('sug')}, {normalize('ins')} ORDER BY edit_no) AS rn FROM edi WHERE segment_id IN (SELECT segment_id FROM seg)) WHERE rn = 1)
      SELECT segment_id, edit_no, {why('cur_t', 'sug', 'ins', 'conf', 0.7)} AS reasons FROM f""",
    "q39_location_alignment": f"""WITH {SEG}, l AS (SELECT concat_ws('#', doc_id, location) AS location, seq, source_plain, target_tagged FROM seg WHERE location IS NOT NULL), o AS (SELECT location, max_by(target_tagged, seq) AS t FROM l WHERE target_tagged IS NOT NULL GROUP BY 1), s AS (SELECT location, max_by(source_plain, seq) AS s FROM l WHERE seq % 50 <> 0 GROUP BY 1)
      SELECT count_if(t IS NOT NULL AND s IS NOT NULL AND {normalize('t')} <> {normalize('s')}) AS candidates, count_if({normalize('t')} = {normalize('s')}) AS equal, count_if(s IS NULL AND t IS NOT NULL) AS missing_source, count_if(t IS NULL AND s IS NOT NULL) AS missing_output FROM o FULL JOIN s USING (location)""",
    "q40_trace_replay": f"""WITH {TRA} SELECT {', '.join(counter(k, e) for k, e in REPLAY.items())}, (SELECT count_if(event = 'summary') > 0 FROM tra) AS summary_present""",
    "q41_split_completion": f"""WITH {TRA}, d0 AS (SELECT DISTINCT chunk_id FROM tra WHERE event IN ('response', 'failed_chunk')), sp AS (SELECT DISTINCT chunk_id FROM tra WHERE event = 'split'),
      d1 AS (SELECT chunk_id FROM d0 UNION SELECT chunk_id FROM sp WHERE chunk_id || '.a' IN (FROM d0) AND chunk_id || '.b' IN (FROM d0)), d2 AS (SELECT chunk_id FROM d1 UNION SELECT chunk_id FROM sp WHERE chunk_id || '.a' IN (FROM d1) AND chunk_id || '.b' IN (FROM d1))
      SELECT DISTINCT chunk_id FROM tra WHERE event = 'request' AND NOT contains(chunk_id, '.') AND chunk_id IN (FROM d2)""",
    "q42_margin_repeat": f"WITH {BLK}, {PAG}, {MAR} SELECT doc_id, kind, norm, pages FROM mar",
    "q43_block_types": f"WITH {LAY} SELECT doc_id, block_type, count(*) AS n FROM typ GROUP BY ALL",
    "q44_block_islands": f"""WITH {LAY}, f AS (SELECT *, CASE WHEN coalesce(block_type = lag(block_type) OVER w AND column_index = lag(column_index) OVER w AND abs(x0 - lag(x0) OVER w) <= 24 AND y0 - lag(y1) OVER w <= 18, false) THEN 0 ELSE 1 END AS brk FROM typ WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY column_index, y0, x0, block_id)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number ORDER BY column_index, y0, x0, block_id ROWS UNBOUNDED PRECEDING) AS island FROM f), g AS (SELECT doc_id, page_number, island, min(block_type) AS block_type, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, count(*) AS blocks, md5(string_agg(text, chr(10) ORDER BY y0, x0, block_id)) AS text FROM i GROUP BY ALL)
      SELECT doc_id, page_number, 'pdf-p' || page_number || '-s' || (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, island) - 1) AS segment_id, block_type, blocks, round(x0, 3) AS x0, round(y1, 3) AS y1, text FROM g""",
    "q45_bbox_join": f"WITH {BLK} SELECT a.doc_id, a.page_number, a.block_id AS a_id, b.block_id AS b_id FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.block_id < b.block_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1",
    "q46_two_columns": f"""WITH {BLK}, {PAG}, {COLS} SELECT doc_id, page_number, CASE WHEN two THEN 2 ELSE 1 END AS columns, CASE WHEN two THEN round((l1 + r0) / 2, 3) END AS split_x FROM col""",
    "q47_cluster_count": f"""WITH RECURSIVE {BLK}, v AS (SELECT doc_id, page_number, y0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0) AS k FROM blk),
      f AS (SELECT doc_id, page_number, k, 1 AS n, y0 AS anchor FROM v WHERE k = 1 UNION ALL SELECT v.doc_id, v.page_number, v.k, CASE WHEN abs(v.y0 - anchor) <= 12 THEN n ELSE n + 1 END, CASE WHEN abs(v.y0 - anchor) <= 12 THEN (anchor + v.y0) / 2 ELSE v.y0 END FROM f JOIN v ON v.doc_id = f.doc_id AND v.page_number = f.page_number AND v.k = f.k + 1)
      SELECT doc_id, page_number, max_by(n, k) AS clusters FROM f GROUP BY ALL""",
    "q48_overflow_risk": f"""WITH {SEG}, {CAP} SELECT segment_id, i.code AS code, lt AS target_chars, i.cap AS capacity FROM (SELECT segment_id, lt, unnest({over()}) AS i FROM cap) WHERE i IS NOT NULL""",
    "q49_tfidf_cosine": f"""WITH {TOK}, n AS (SELECT (SELECT count(*) FROM eval_items) + (SELECT count(*) FROM documents WHERE length(text) > 0) AS t), f AS (SELECT token, count(*) AS df FROM tok GROUP BY 1),
      iw AS (SELECT token, (ln((t + 1.0) / (df + 1.0)) + 1) * CASE WHEN starts_with(token, 'рисунок') OR starts_with(token, 'лист') THEN 2.0 WHEN regexp_matches(token, '^[0-9]{{1,9}}$') AND try_cast(token AS INT) BETWEEN 500 AND 999 THEN 1.5 ELSE 1.0 END AS w FROM f, n WHERE df <= 2 OR (df <= 0.25::DOUBLE * t AND length(token) >= 2)),
      x AS (SELECT key, tok.token, tf * w AS w FROM tok JOIN iw USING (token)), nn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1),
      c AS (SELECT a.key AS item, b.key AS document, sum(a.w * b.w) AS dot FROM x a JOIN x b ON a.token = b.token AND starts_with(a.key, 'i') AND starts_with(b.key, 'd') GROUP BY ALL)
      SELECT item, document, round(dot / (p.norm * q.norm), 6) AS cosine FROM c JOIN nn p ON p.key = item JOIN nn q ON q.key = document WHERE dot / (p.norm * q.norm) >= 0.2""",
    "q50_overlap_f1": f"""WITH {COUNTED}, s AS (SELECT key, sum(tf) AS n FROM tok GROUP BY 1), c AS (SELECT a.key AS item, b.key AS document, sum(least(a.tf, b.tf)) AS s FROM tok a JOIN tok b ON a.token = b.token AND starts_with(a.key, 'i') AND starts_with(b.key, 'd') GROUP BY ALL)
      SELECT item, document, round(2.0 * c.s / (p.n + q.n), 6) AS f1 FROM c JOIN s p ON p.key = item JOIN s q ON q.key = document WHERE 2.0 * c.s / (p.n + q.n) >= 0.25""",
    "q52_marker_patterns": f"""WITH {SEG}, t AS (SELECT doc_id, coalesce(source_tagged, '') AS t FROM seg) SELECT doc_id, sum({count('t', '⟦S_[0-9]+')})::BIGINT AS style_open, sum({count('t', '⟦/S_[0-9]+')})::BIGINT AS style_close, sum({count('t', '⟦BR')})::BIGINT AS breaks, sum({count('t', '⟦OBJ_')})::BIGINT AS objects FROM t GROUP BY 1""",
    "q54_sizing": """SELECT config_id, CASE WHEN batch_segments <= 1 THEN 60.0 ELSE greatest(60.0, CASE WHEN batch_max_chars >= 100000 THEN 360.0 WHEN batch_max_chars >= 60000 THEN 300.0 WHEN batch_max_chars >= 36000 THEN 180.0 ELSE 0.0 END) END AS timeout,
      greatest(90.0, CASE WHEN batch_segments * 8 >= 160 THEN 300.0 WHEN batch_segments * 8 >= 120 THEN 240.0 WHEN batch_segments * 8 >= 80 THEN 180.0 WHEN batch_segments * 8 >= 40 THEN 120.0 ELSE 0.0 END) AS review_timeout,
      CASE WHEN batch_segments > 1 THEN greatest(max_output_tokens, trunc(trunc(batch_max_chars * 1.35::DOUBLE) / 2.2::DOUBLE)::INT + 420) ELSE max_output_tokens END AS output_tokens, greatest(1, least(4, 10, CASE WHEN batch_max_chars >= 60000 THEN 2 WHEN batch_max_chars >= 36000 THEN 3 ELSE 999 END)) AS workers FROM llm_config""",
    "q55_estimate": f"""WITH RECURSIVE {SEG}, cfg AS (SELECT doc_id, c.* FROM (SELECT doc_id, max(config_id) AS config_id FROM seg GROUP BY 1) JOIN llm_config c USING (config_id)),
      k AS (SELECT *, CASE WHEN NOT coalesce({todo('source_plain')}, false) THEN 'skipped' WHEN coalesce(is_toc_entry, false) THEN 'toc' WHEN coalesce(in_textbox, false) THEN 'complex' ELSE 'todo' END AS kind FROM seg),
      n AS (SELECT doc_id, count(*) AS segments, count_if(kind = 'skipped') AS skipped, count_if(kind = 'toc') AS toc, count_if(kind = 'complex') AS complex, count_if(kind = 'todo') AS todo, trunc(coalesce(median(length(source_plain)) FILTER (kind = 'todo' AND length(source_plain) > 0), 420))::INT AS median_chars FROM k GROUP BY 1),
      i AS (SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY seq) AS k, coalesce(length(source_plain), 0) + 128 AS cost, batch_segments AS most, batch_max_chars AS lim FROM k JOIN cfg USING (doc_id) WHERE kind = 'todo' AND batch_segments > 1),
      f AS (SELECT doc_id, k, 1::BIGINT AS groups, 1 AS items, cost AS load FROM i WHERE k = 1 UNION ALL SELECT i.doc_id, i.k, f.groups + (CASE WHEN f.items >= i.most OR f.load + i.cost > i.lim THEN 1 ELSE 0 END), CASE WHEN f.items >= i.most OR f.load + i.cost > i.lim THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= i.most OR f.load + i.cost > i.lim THEN i.cost ELSE f.load + i.cost END
        FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1), g AS (SELECT doc_id, max(groups) AS packed FROM f GROUP BY 1),
      e AS (SELECT n.*, lower(trim(c.provider)) AS p, lower(trim(c.model)) AS m, lower(c.provider) IN ('openai', 'ollama') AND batch_segments > 1 AS grouped, batch_max_chars AS chars, CASE WHEN lower(c.provider) IN ('openai', 'ollama') AND batch_segments > 1 THEN coalesce(packed, 0) ELSE todo END AS requests, greatest(2.0, segments / 155) AS prep FROM n JOIN cfg c USING (doc_id) LEFT JOIN g USING (doc_id)),
      l AS (SELECT *, CASE WHEN p IN ('mock', 'google', 'ollama') OR NOT (grouped AND chars > 36000) THEN 1.0::DOUBLE ELSE least(4.0, chars / 36000) END AS sc FROM e)
      SELECT doc_id, segments, skipped, toc, complex, requests::BIGINT AS requests, median_chars, round(prep, 4) AS prepare_s, round(prep + requests * sc * CASE p WHEN 'mock' THEN 0.01::DOUBLE WHEN 'google' THEN 1.8::DOUBLE WHEN 'ollama' THEN CASE WHEN grouped THEN 3 ELSE 2 END WHEN 'openai' THEN CASE WHEN grouped THEN 10 ELSE 9 END + CASE WHEN starts_with(m, 'gpt-5') THEN 1 ELSE 0 END ELSE CASE WHEN grouped THEN 6 ELSE 4 END END, 4) AS eta_low,
      round(prep + requests * sc * CASE p WHEN 'mock' THEN 0.03::DOUBLE WHEN 'google' THEN 5 WHEN 'ollama' THEN CASE WHEN grouped THEN 18 ELSE 10 END WHEN 'openai' THEN CASE WHEN grouped THEN 24 ELSE 17 END + CASE WHEN starts_with(m, 'gpt-5') THEN 3 ELSE 0 END ELSE CASE WHEN grouped THEN 16 ELSE 12 END END, 4) AS eta_high FROM l""",
    "q56_page_spec": "SELECT DISTINCT unnest([5, 12, 100] || range(45, 51)) AS page",
    "q57_heartbeat_gaps": "WITH e AS (SELECT user_id, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 3600 AS stale FROM events) SELECT user_id, count(*) AS beats, count_if(stale) AS gaps FROM e GROUP BY 1",
    "q59_missing_terms": f"WITH {SEG}, {TAG}, {TERM}, f AS ({found('tag')}) SELECT f.key AS segment_id, f.term FROM f JOIN tag s ON f.key = s.segment_id WHERE NOT contains(lower({plain('s.target_tagged')}), lower(f.target))",
    "q60_document_terms": f"""WITH {SEG}, {TERM}, f AS ({found('seg')}), o AS (SELECT DISTINCT s.doc_id, f.term, s.seq FROM f JOIN seg s ON f.key = s.segment_id), l AS (SELECT s.segment_id, o.term, max(o.seq) AS last FROM seg s JOIN o ON o.doc_id = s.doc_id AND o.seq < s.seq GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY last DESC, term DESC) AS rn FROM l) SELECT segment_id, string_agg(term, '|' ORDER BY last, term) AS terms FROM r WHERE rn <= 5 GROUP BY 1""",
    "q61_rekey": f"WITH {CUR} SELECT sha256('v1' || chr(10) || 'new' || chr(10) || source_norm) AS source_hash, sha256('v1' || chr(10) || 'old' || chr(10) || source_norm) AS old_hash FROM cur WHERE length(source_norm) % 2 = 0",
    "q62_token_index": f"WITH {CUR}, t AS (SELECT source_hash, unnest(list_distinct(list_transform(regexp_extract_all(source_norm, '[A-Za-zА-Яа-яЁё0-9]{{2,}}'), lambda x: lower(x)))) AS token FROM cur) SELECT token, count(*) AS entries FROM t GROUP BY 1",
    "q63_progress_counts": f"WITH {PRO} SELECT status, count(*) AS segments, count(source_hash) AS with_hash, count_if(coalesce(regexp_matches(lower(error), 'timed out|timeout|time out|deadline exceeded'), false)) AS timeouts FROM pro GROUP BY 1",
    "q64_char_width": f"WITH {SEG}, {MET} SELECT segment_id, char_w, char_h FROM met",
    "q65_expansion": f"""WITH {SEG}, a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, segment_id) AS n, length({strip('source_plain')}) AS la FROM seg), b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, segment_id) AS n, length({strip(plain('target_tagged'))}) AS lb FROM seg WHERE target_tagged IS NOT NULL),
      r AS (SELECT doc_id, coalesce(lb, 0)::DOUBLE / la AS r FROM a JOIN b USING (doc_id, n) WHERE la > 0) SELECT doc_id, round(avg(r), 6) AS avg_ratio, round(max(r), 6) AS max_ratio, count_if(r > 1.5) AS over FROM r GROUP BY 1""",
    "q04_number_tokens": f"WITH {SEG} SELECT segment_id, array_to_string({numbers('source_plain')}, '|') AS numbers FROM seg",
    "q38_apply_edits": f"""WITH RECURSIVE {SEG}, {EDI}, o AS (SELECT e.*, row_number() OVER (PARTITION BY segment_id ORDER BY edit_no) AS k FROM edi e WHERE segment_id IN (SELECT segment_id FROM seg)),
      w AS (SELECT segment_id, 0::BIGINT AS k, 0::BIGINT AS edit_no, coalesce(target_tagged, '') AS now, '' AS reasons FROM seg
        UNION ALL SELECT segment_id, k, edit_no, CASE WHEN why = '' THEN sug ELSE now END, why FROM (SELECT o.segment_id, o.k, o.edit_no, o.sug, w.now, CASE WHEN {flat('o.cur_t')} <> '' AND {flat('w.now')} <> '' AND {flat('o.cur_t')} <> {flat('w.now')} THEN 'current_target_mismatch' ELSE {why('w.now', 'o.sug', 'o.ins', 'o.conf', 0.3)} END AS why
          FROM w JOIN o ON o.segment_id = w.segment_id AND o.k = w.k + 1))
      SELECT segment_id, edit_no, reasons = '' AS applied, reasons, md5(now) AS target FROM w WHERE k > 0
      UNION ALL SELECT NULL, edit_no, false, 'segment_not_found', NULL FROM edi WHERE segment_id IS NULL OR segment_id NOT IN (SELECT segment_id FROM seg)""",
    "q67_validate_all_rules": f"WITH {SEG}, {TAG}, {ISS} SELECT key AS segment_id, code, severity FROM iss",
    "q68_issue_histogram_all_rules": f"WITH {SEG}, {TAG}, {ISS} SELECT code, severity, count(*) AS n FROM iss GROUP BY ALL",
    "q72_xml_pattern_diff": f"""WITH {SEG}, {TAG}, t AS (SELECT doc_id, coalesce(source_tagged, '') AS a, coalesce(target_tagged, '') AS b FROM tag) SELECT doc_id AS doc, {', '.join(diff(k, x) for k, x in XML.items())} FROM t GROUP BY 1""",
    "q73_model_sizing": f"{SIZED}",
    "q74_container_limits": f"""WITH {SEG}, {CAP} SELECT segment_id, greatest(8, coalesce(tcap, bcap, fcap)) AS max_target_chars FROM cap WHERE ls > 0 AND greatest(ls, trunc(ls * 1.35::DOUBLE)) >= trunc(coalesce(tcap, bcap, fcap) * 0.9::DOUBLE)""",
    "q75_fix_choice": f"""WITH {SEG}, {CAP}, i AS (SELECT segment_id, in_table, in_textbox, in_frame, lt, i.code AS code, i.cap AS cap FROM (SELECT *, unnest({over()}) AS i FROM cap) WHERE i IS NOT NULL),
      t AS (SELECT *, CASE WHEN code = 'layout_table_overflow_risk' OR code = 'length_ratio_high' AND in_table THEN 'table' WHEN code = 'layout_textbox_overflow_risk' OR code = 'length_ratio_high' AND in_textbox THEN 'textbox' WHEN code = 'layout_frame_overflow_risk' OR code = 'length_ratio_high' AND in_frame THEN 'frame' END AS strategy FROM i),
      r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY code <> 'length_ratio_high', code) AS rn FROM t WHERE strategy IS NOT NULL) SELECT segment_id, code, strategy, round(CASE WHEN lt > 0 AND cap > 0 THEN greatest(1.0::DOUBLE, lt::DOUBLE / cap) ELSE 1.0 END, 6) AS overflow FROM r WHERE rn = 1""",
    "q76_nearest_columns": f"WITH {BLK}, {PAG}, {COLS} SELECT b.doc_id, b.page_number, b.block_id, {IDX} AS column_index FROM blk b LEFT JOIN col USING (doc_id, page_number)",
    "q77_fonts": f"""WITH {SEG}, s AS (SELECT DISTINCT st.font_name AS font, st.bold AS bold, st.italic AS italic FROM (SELECT unnest(spans).style AS st FROM seg) WHERE st.font_name IS NOT NULL), k AS (SELECT *, regexp_replace(lower(trim(font)), '[^a-z0-9]+', '', 'g') AS f FROM s),
      t AS (SELECT *, CASE WHEN regexp_matches(f, 'mono|courier|consolas|menlo') THEN 'mono' WHEN regexp_matches(f, 'serif|times|cambria|garamond|georgia') THEN 'serif' ELSE 'sans' END AS kind, CASE WHEN f = 'arial' THEN 'PT Sans.ttf' WHEN f = 'cambria' THEN 'PTSerif-Regular.ttf' WHEN contains(f, 'arial') THEN 'PT Sans.ttf' WHEN contains(f, 'cambria') THEN 'PTSerif-Regular.ttf' END AS mapped FROM k),
      b AS (SELECT *, coalesce(mapped, CASE kind WHEN 'serif' THEN 'NotoSerif-Regular.ttf' WHEN 'mono' THEN 'NotoSansMono-Regular.ttf' ELSE 'NotoSans-Regular.ttf' END) AS base, CASE WHEN coalesce(bold, false) AND coalesce(italic, false) THEN '-BoldItalic' WHEN coalesce(bold, false) THEN '-Bold' WHEN coalesce(italic, false) THEN '-Italic' END AS variant FROM t)
      SELECT font, bold, italic, kind, CASE WHEN mapped IS NOT NULL THEN regexp_replace(mapped, '\\.[^.]*$', '') ELSE CASE kind WHEN 'serif' THEN 'Noto Serif' WHEN 'mono' THEN 'Noto Sans Mono' ELSE 'Noto Sans' END END AS family, CASE WHEN variant IS NULL THEN base ELSE replace(split_part(base, '.', 1), '-Regular', '') || variant || '.ttf' END AS file FROM b""",
    "q78_contexts": f"""WITH {SEG}, {NEAR}, p AS (SELECT *, lower(trim(coalesce(part, ''))) AS pt FROM near)
      SELECT segment_id, {joined(["'SECTION: ' || nullif(section_header, '')", "CASE WHEN in_table THEN 'TABLE_CELL' END", "CASE WHEN pt NOT IN ('', 'body') THEN 'DOC_SECTION=' || pt END", "CASE WHEN is_toc_entry THEN 'TOC_ENTRY' END", "CASE WHEN max_target_chars > 0 THEN 'SPACE_LIMIT: ~' || max_target_chars || ' chars max, keep translation concise' END", "CASE WHEN NOT coalesce(in_table, false) THEN 'PREV: ' || prev_text END", "CASE WHEN NOT coalesce(in_table, false) THEN 'NEXT: ' || next_text END"])} AS context,
      {joined(["'SECTION=' || nullif(" + compact("coalesce(section_header, '')", 120) + ", '')", "CASE WHEN pt NOT IN ('', 'body') THEN 'DOC_SECTION=' || pt END", "CASE WHEN in_table THEN 'TABLE_CELL' END", "CASE WHEN in_textbox THEN 'TEXTBOX' END", "CASE WHEN is_toc_entry THEN 'TOC_ENTRY' END", "'PREV=' || " + compact('prev_text', 80), "'NEXT=' || " + compact('next_text', 80)])} AS item_context FROM p""",
    "q79_review_contexts": f"""WITH {SEG}, {TAG}, {ISS}, {NEAR}, c AS (SELECT key, array_to_string(list(code ORDER BY code, severity)[1:6], ',') AS issues FROM iss GROUP BY 1) SELECT segment_id, coalesce(part, '') AS part, {compact("coalesce(section_header, '')", 160)} AS section_header, {compact("coalesce(paragraph_style, '')", 80)} AS paragraph_style,
      regexp_matches(lower({compact("coalesce(paragraph_style, '')", 80)}), 'heading|title|toc|заголов|оглавл') AS heading_like, coalesce(in_table, false) AS in_table, coalesce(in_textbox, false) AS in_textbox, coalesce(is_toc_entry, false) AS is_toc_entry, coalesce(issues, '') AS issues, {compact('prev_text', 140)} AS prev_source, {compact('next_text', 140)} AS next_source, row_index, col_index FROM near LEFT JOIN c ON key = segment_id""",
    "q80_term_issues": f"WITH {SEG}, {TAG}, {TERM}, {TERM_ISS} SELECT key AS segment_id, code, details FROM tis",
    "q81_locked_terms": f"""WITH {SEG}, {TERM}, f AS ({found('seg')}), w AS (SELECT segment_id, coalesce(is_toc_entry, false) OR coalesce(in_table, false) AS fixed, {count('source_plain', '[A-Za-z]+')} AS n, coalesce({strip('source_plain')}, '') = '' AS blank, regexp_matches(source_plain, '[.!?;:]') AS marked FROM seg)
      SELECT DISTINCT f.key AS segment_id, f.term FROM f JOIN w ON f.key = w.segment_id WHERE fixed OR NOT blank AND (n <= 6 OR n < 14 AND NOT (n >= 8 AND marked))""",
    "q82_used_terms": f"""WITH {SEG}, {TERM}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key {LONGEST}) AS pos FROM ({found('seg')})) WHERE pos <= 24), t AS (SELECT s.doc_id, f.source, f.target, min(s.seq * 100 + f.pos) AS first_at FROM f JOIN seg s ON f.key = s.segment_id GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, source, target) AS rn FROM t) SELECT doc_id, string_agg(source, '|' ORDER BY rn) AS sources, string_agg(target, '|' ORDER BY rn) AS targets FROM r WHERE rn <= 20 GROUP BY 1""",
    "q84_edit_filter": f"""WITH {SEG}, {EDI} SELECT segment_id, edit_no, {why('cur_t', 'sug', 'ins', 'conf', 0.5)} AS reasons FROM edi""",
    "q85_top_codes": f"WITH {SEG}, {TAG}, {ISS} SELECT code, count(*) AS n FROM iss GROUP BY 1 ORDER BY n DESC, code LIMIT 5",
    "q86_token_counts": f"WITH {COUNTED} SELECT key AS item, token, tf FROM tok WHERE starts_with(key, 'i')",
    "q87_consistency": f"""WITH {SEG}, {TAG}, {TERM}, {VAR}, b AS (SELECT term FROM (SELECT DISTINCT term, regexp_replace(lower(variant), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS vk FROM var) WHERE length(vk) > 0 GROUP BY 1 HAVING count(*) >= 2)
      SELECT v.term, v.variant, count(*) AS n, min_by(v.key, (s.doc_id, s.seq, v.key)) AS first_segment, md5(string_agg(v.key, ',' ORDER BY s.doc_id, s.seq, v.key)) AS segments FROM var v JOIN b USING (term) JOIN seg s ON s.segment_id = v.key GROUP BY ALL""",
    "q88_migrated": f"WITH {CUR} SELECT count(*) AS segments FROM progress WHERE source_hash IN (SELECT source_hash FROM cur WHERE length(source_norm) % 2 = 0)",
    "q89_origins": f"""WITH {SEG}, s AS (SELECT doc_id, count(*) AS n, count_if(in_frame) AS f, count_if(in_textbox) AS b FROM seg GROUP BY 1), o AS (SELECT *, CASE WHEN contains(doc_id, '7') OR b > n * 0.05::DOUBLE OR f / n >= 0.3::DOUBLE THEN 'abbyy' ELSE 'native_docx' END AS origin FROM s)
      SELECT doc_id, origin, CASE WHEN n % 2 = 1 THEN 'off' WHEN origin = 'abbyy' THEN 'abbyy_standard' ELSE 'native_docx' END AS preset FROM o""",
    "q90_put_progress": f"""WITH {PRO}, e AS (SELECT segment_id, 'ok' AS status, source_hash, NULL AS error, row_number() OVER (PARTITION BY segment_id ORDER BY updated_at DESC NULLS LAST, source_hash DESC NULLS LAST) AS rn FROM progress WHERE status = 'error')
      SELECT segment_id, status, source_hash, error FROM e WHERE rn = 1 UNION ALL SELECT segment_id, status, source_hash, error FROM pro WHERE length(segment_id) > 0 AND segment_id NOT IN (SELECT segment_id FROM e)""",
    "q91_grouping": """WITH g AS (SELECT *, ['grouped_turbo','grouped_aggressive','sequential_context','grouped_fast','grouped_fast'][config_id % 5 + 1] AS mode, lower(trim(provider)) AS p FROM llm_config),
      h AS (SELECT *, mode <> 'sequential_context' AS grp, CASE WHEN mode = 'grouped_turbo' AND p NOT IN ('mock', 'google', 'ollama') THEN 60000 / 36000 ELSE 1.0 END::DOUBLE AS sc, CASE mode WHEN 'grouped_turbo' THEN 0.2 WHEN 'grouped_aggressive' THEN 0.12 WHEN 'grouped_fast' THEN 0.08 ELSE 0.03 END AS warn_at, CASE WHEN starts_with(lower(trim(model)), 'gpt-5') AND p = 'openai' THEN 1 ELSE 0 END AS more FROM g)
      SELECT config_id, mode, round(sc * (more + CASE p WHEN 'mock' THEN 0.01::DOUBLE WHEN 'google' THEN 1.8::DOUBLE WHEN 'ollama' THEN CASE WHEN grp THEN 3 ELSE 2 END WHEN 'openai' THEN CASE WHEN grp THEN 10 ELSE 9 END ELSE CASE WHEN grp THEN 6 ELSE 4 END END), 6) AS low,
      round(sc * (3 * more + CASE p WHEN 'mock' THEN 0.03::DOUBLE WHEN 'google' THEN 5 WHEN 'ollama' THEN CASE WHEN grp THEN 18 ELSE 10 END WHEN 'openai' THEN CASE WHEN grp THEN 24 ELSE 17 END ELSE CASE WHEN grp THEN 16 ELSE 12 END END), 6) AS high,
      CASE WHEN config_id > 0 THEN 0.1::DOUBLE ELSE 0.0 END AS ratio, config_id * 10 >= 20 AND 0.1::DOUBLE > warn_at AS warn FROM h""",
    "q94_table_regions": f"""WITH {BLK}, {PAG}, {DRA}, {REG} SELECT doc_id, page_number, region_id, round(rx0, 3) AS x0, round(ry0, 3) AS y0, round(rx1, 3) AS x1, round(ry1, 3) AS y1 FROM reg""",
}

SQL["q69_document_quality_all_rules"], SQL["q70_quality_summary_all_rules"] = SQL["q25_document_quality"], SQL["q26_quality_summary"]
SQL["q83_skipped_reasons"] = f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({SQL['q38_apply_edits']}) WHERE NOT applied) GROUP BY 1"
#: Blocks with the columns they come with, and their types without table regions.
GIVEN = f"""blk AS (SELECT doc_id, page_number, block_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.text AS text, b.c AS c FROM (SELECT doc_id, page_number, block_id, min(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, text := text, u := column_index IS NULL, c := coalesce(column_index, 0))) AS b FROM pdf_blocks GROUP BY ALL) WHERE length({strip('b.text')}) > 0),
{PAG}, {MAR}, typ AS (SELECT b.*, CASE WHEN m.pages IS NOT NULL THEN a.kind WHEN b.y1 <= height_pt * 0.1::DOUBLE THEN 'header' WHEN b.y0 >= height_pt * 0.9::DOUBLE THEN 'footer' ELSE 'body' END AS block_type FROM blk b JOIN pag USING (doc_id, page_number)
  JOIN atm a ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.block_id = b.block_id LEFT JOIN mar m ON m.doc_id = b.doc_id AND m.kind = a.kind AND m.norm = a.norm)"""
SQL["q71_column_block_islands"] = f"""WITH {GIVEN}, f AS (SELECT *, CASE WHEN coalesce(block_type = lag(block_type) OVER w AND c = lag(c) OVER w AND abs(x0 - lag(x0) OVER w) <= 24 AND y0 - lag(y1) OVER w <= 18, false) THEN 0 ELSE 1 END AS brk FROM typ WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY c, y0, x0, block_id)),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number ORDER BY c, y0, x0, block_id ROWS UNBOUNDED PRECEDING) AS island FROM f), g AS (SELECT doc_id, page_number, island, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, count(*) AS blocks, length(string_agg(text, chr(10) ORDER BY y0, x0, block_id)) AS chars FROM i GROUP BY ALL)
  SELECT doc_id, page_number, 'pdf-p' || page_number || '-s' || (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, island) - 1) AS segment_id, blocks, round(x0, 3) AS x0, round(y1, 3) AS y1, chars FROM g"""
