"""SQL for DuckDB that says again, in its own way, what the queries of details compute."""

from __future__ import annotations

from ..functions.constants import ABBREVIATIONS, COMPOUND_PREFIXES, COMPOUND_SUFFIXES, GENERAL_SECTION, LABEL_WORDS, LIST_MARKER, OVERVIEW_WORDS, SECTION_NAMES, TABLE_LINE
from .oracle import BM25, ORACLES, PLAIN, html, quoted, tokens

FILES = """f AS (
  SELECT doc_id, e, mime, source || '__my-file_' || doc_id AS stem, string_split(text, chr(10))[1] AS line FROM (
    SELECT *, ['pdf', 'docx', 'txt', 'md', 'markdown', 'csv', 'bin', ''][doc_id % 8 + 1] AS e,
      ['application/pdf', 'text/plain', 'text/html', 'application/octet-stream'][doc_id % 4 + 1] AS mime FROM documents))"""
TITLE = "trim(regexp_replace(regexp_replace(stem, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
SQUASH = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
PARTS = "regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]')"


def displayed(h: str) -> str:
    letters = f"regexp_replace({h}, '[^A-Za-z]', '', 'g')"
    soft = f"array_to_string(list_transform({PARTS.format(h)}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{{4,}}$') AND NOT regexp_matches(w, '^[IVXLC]+$') THEN left(w, 1) || lower(substr(w, 2)) ELSE w END), '')"
    return f"CASE WHEN length({letters}) >= 4 AND {letters} = upper({letters}) THEN {soft} ELSE {h} END"


def topic(h: str) -> str:
    """A subquery for the topic of a heading expression."""
    name = f"trim(regexp_replace({displayed(h)}, '^([IVXLC]+|[0-9]+(\\.[0-9]+)*|[A-Z])[.)]\\s+', ''))"
    low = f"array_to_string(list_transform({PARTS.format('n')}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z][a-z]+$') THEN lower(w) ELSE w END), '')"
    return f"(SELECT CASE WHEN length(n) BETWEEN 4 AND 40 AND NOT regexp_matches(n, '(?i){GENERAL_SECTION}') THEN {low} END FROM (SELECT {name} AS n))"


HEADED = "p AS (SELECT page_id, upper(regexp_extract(url, '://([^/]*)', 1)) AS host, regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS h FROM pages)"
QUESTIONS = """q AS (SELECT set_id, turn, question, row_number() OVER (PARTITION BY set_id ORDER BY turn) - 1 AS idx FROM (SELECT conv_id AS set_id, turn, min(text) AS question FROM conversations WHERE role = 'user' GROUP BY ALL)),
s AS (SELECT conv_id AS set_id, turn - 1 AS turn, min(text) AS answer FROM conversations WHERE role = 'assistant' GROUP BY ALL),
a AS (SELECT q.*, answer, coalesce(['DRAFT', 'APPROVED', 'REJECTED'][length(answer) % 3 + 1], 'PENDING') AS status FROM q LEFT JOIN s USING (set_id, turn))"""
QUOTED = f"q AS (SELECT item_id, text, {PLAIN.format('text')} AS q FROM benchmark), d AS (SELECT *, {PLAIN.format('text')} AS d FROM documents), h AS (SELECT item_id, doc_id, q.text AS quote, d.text, source, lang FROM q JOIN d ON contains(d, q) WHERE length(q) >= 3)"
REPLY = "CASE WHEN event_id % 4 < 3 THEN {0} END"

CLOSERS = """["''”’)\\]]*"""
ENDED = "([.!?]" + CLOSERS + ")\\s+([\"''“‘(\\[]?[A-Z0-9])"
LAST = "(?:^|[\\s(\\[])([A-Za-z][A-Za-z.]*)\\." + CLOSERS + "$"
LABELLED = "(?:^|[^\\p{L}\\p{N}_])(" + "|".join(LABEL_WORDS) + ") [a-z]\\." + CLOSERS + "$"



def positioned(per_page: int) -> str:
    return f"""r AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i // {per_page} + 1 AS INT) AS page, CAST(i AS INT) AS seq, t AS text, CASE WHEN i % 2 = 0 THEN 40.0 ELSE 320.0 END::DOUBLE AS x, (740 - 17 * ((i % {per_page}) // 2))::DOUBLE AS y,
    least(240, length(t) * 4.5)::DOUBLE AS w, CASE WHEN i = 0 THEN 16.0 WHEN i % 7 = 3 THEN 10.4 ELSE 10.0 END::DOUBLE AS size, CASE WHEN i % 9 = 4 THEN 'bold' ELSE 'body' END AS font
  FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(t) <> ''),
i AS (SELECT * FROM r UNION ALL SELECT DISTINCT doc_id, page, -1, 'Report ' || page, 280.0, 790.0, 40.0, 8.0, 'body' FROM r UNION ALL SELECT DISTINCT doc_id, page, 100000, CAST(page AS VARCHAR), 280.0, 10.0, 40.0, 8.0, 'body' FROM r),
bs AS (SELECT doc_id, v AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, q) AS k FROM (SELECT doc_id, round(size * 2) / 2 AS v, sum(length(text)) AS n, min(page) AS p, arg_min(seq, page * 1000000 + seq) AS q FROM i GROUP BY ALL)) WHERE k = 1),
bf AS (SELECT doc_id, font AS body_font FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM (SELECT doc_id, font, sum(length(text)) AS n, min(page * 1000000 + seq) AS p FROM i JOIN bs USING (doc_id) WHERE abs(size - body_size) <= 0.6 GROUP BY ALL)) WHERE k = 1)"""


COLUMNS = """ps AS (SELECT doc_id, page, v AS page_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, q) AS k FROM (SELECT doc_id, page, round(size * 2) / 2 AS v, sum(length(text)) AS n, min(seq) AS q FROM i WHERE length(trim(text)) >= 3 GROUP BY ALL)) WHERE k = 1),
u AS (SELECT i.*, x + w AS e, count(*) OVER (PARTITION BY i.doc_id, i.page) AS n FROM i JOIN ps ON i.doc_id = ps.doc_id AND i.page = ps.page WHERE length(trim(text)) >= 3 AND abs(size - page_size) <= 1),
c AS (SELECT doc_id, page, g, n, count(*) FILTER (x < g - 1 AND e > g + 1) AS cross_, count(*) FILTER (e <= g) AS l, count(*) FILTER (x >= g) AS r FROM u, (SELECT unnest(range(210, 391)) AS g) WHERE n >= 12 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cross_, abs(g - 300), g) AS k FROM c) WHERE k = 1 AND cross_ <= n * 0.08 AND l >= n * 0.2 AND r >= n * 0.2),
cols AS (SELECT u.doc_id, u.page, CAST(g AS INT) AS gutter, round(quantile_cont(e, 0.98) FILTER (e <= g), 3) AS left_edge, round(quantile_cont(x, 0.02) FILTER (x >= g), 3) AS right_edge FROM u JOIN best b ON u.doc_id = b.doc_id AND u.page = b.page GROUP BY ALL)"""
MARKED = """p AS (SELECT page_id, 10 + page_id % 5 AS size, ['', '2.1 ', 'III. ', 'A. ', '4) ', 'V. I NTRODUCTION TO A '][page_id % 6 + 1] || CASE WHEN page_id % 4 = 0 THEN 'Conclusions'
  ELSE regexp_replace(translate(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z ]', '', 'g') END AS t FROM pages),
s AS (SELECT *, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, regexp_replace(t, '^\\S+\\s*', '') AS rest FROM p)"""
ABOUT = tokens("'" + " ".join(OVERVIEW_WORDS) + "'")

REVIEWED = """e AS (SELECT user_id AS question_id, event_id AS seq, ['draft', 'review', 'edit', 'draft', 'review', 'edit', 'edit'][event_id % 7 + 1] AS kind,
        ['APPROVED', 'DRAFT', 'REJECTED', 'LOST'][(user_id + event_id) % 4 + 1] AS status, 'd' || event_id % 3 AS draft, [' e ', '', 'd1', 'd2'][event_id % 4 + 1] AS edit FROM events),
      v AS (SELECT * FROM e WHERE kind = 'draft' OR kind = 'review' AND status <> 'LOST' OR kind = 'edit' AND trim(edit) <> ''),
      b AS (SELECT *, last_value(CASE WHEN kind = 'review' THEN status END IGNORE NULLS) OVER (PARTITION BY question_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
      k AS (SELECT * FROM b WHERE NOT (kind = 'draft' AND coalesce(before = 'APPROVED', false)))"""

#: Sentences s (doc_id, ln, g, sentence) of lines l (doc_id, ln, line).
SPLIT = f"""p AS (SELECT doc_id, ln, unnest(range(len(ps))) AS pn, unnest(ps) AS part FROM (SELECT doc_id, ln, string_split(regexp_replace(line, '{ENDED}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM l WHERE line <> '')),
      ending AS (SELECT *, regexp_extract(part, '{LAST}', 1) AS w FROM p),
      a AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]$') THEN NOT regexp_matches(lower(part), '{LABELLED}') WHEN w = '' OR regexp_matches(w, '^[IVX]+$') THEN false ELSE lower(w) IN ({quoted(sorted(ABBREVIATIONS))}) OR rtrim(lower(w), '.') IN ({quoted(sorted(ABBREVIATIONS))}) END AS short FROM ending),
      g AS (SELECT *, coalesce(sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ln ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM a),
      s AS (SELECT doc_id, ln, g, string_agg(part, ' ' ORDER BY pn) AS sentence FROM g GROUP BY ALL)"""

DETAILS: dict[str, str] = {
    "layout_dehyphenated": f"""WITH c AS (SELECT doc_id, replace(text, chr(10), ' ') AS t, unnest(range(CAST(floor((length(text) - 1) / 40.0) AS INT) + 1)) AS n FROM documents WHERE length(text) > 0),
      l AS MATERIALIZED (SELECT doc_id, n, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM (SELECT doc_id, n, p || CASE WHEN regexp_matches(p, '\\p{{L}}$') AND regexp_matches(q, '\\p{{L}}') THEN '-' ELSE '' END AS x FROM (SELECT doc_id, n, substr(t, 40 * n + 1, 40) AS p, substr(t, 40 * n + 41, 1) AS q FROM c)) WHERE trim(x) <> ''),
      v AS MATERIALIZED (SELECT doc_id, list_distinct(flatten(list(regexp_extract_all(regexp_replace(lower(x), '\\p{{L}}+-$', ''), '\\p{{L}}+')))) AS words, list_distinct(flatten(list(regexp_extract_all(lower(x), '\\p{{L}}+(?:-\\p{{L}}+)+')))) AS two FROM l GROUP BY doc_id),
      b AS (SELECT *, coalesce(regexp_extract(lag(x) OVER (PARTITION BY doc_id ORDER BY n), '([\\p{{L}}0-9]+)-$', 1), '') AS a, regexp_extract(x, '^([\\p{{L}}0-9]+)', 1) AS z FROM l),
      k AS (SELECT doc_id, n, x, a <> '' AND z <> '' AS met, list_contains(words, lower(a || z)) OR regexp_matches(z, '^\\p{{Ll}}') AND regexp_matches(a, '\\p{{L}}$') AND NOT list_contains(two, lower(a || '-' || z))
        AND NOT (regexp_matches(a, '[A-Z].*[A-Z]|[0-9]') OR lower(a) IN ({quoted(COMPOUND_PREFIXES)}) OR lower(z) IN ({quoted(COMPOUND_SUFFIXES)})) AS one FROM b JOIN v USING (doc_id)),
      j AS (SELECT doc_id, n, CASE WHEN met OR row_number() OVER o = 1 THEN '' ELSE ' ' END || CASE WHEN coalesce(lead(met AND one) OVER o, false) THEN left(x, length(x) - 1) ELSE x END AS y FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY n))
      SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, string_agg(y, '' ORDER BY n) AS t FROM j GROUP BY doc_id)""",
    "layout_continuations": f"""WITH RECURSIVE b AS (SELECT doc_id, ord AS block, doc_id + ord AS n, text, ord // 2 AS region FROM ({ORACLES['text_blocks']})),
      k AS MATERIALIZED (SELECT doc_id, block, region, CASE WHEN n % 7 = 2 THEN 'caption' WHEN n % 11 = 4 THEN 'table' WHEN n % 13 = 5 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN n % 6 > 0 THEN lower(text) ELSE text END AS f, CASE WHEN n % 5 > 0 THEN regexp_replace(text, '[.!?:]+["'')\\]]*$', '') ELSE text END AS e FROM b),
      p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS s, row_number() OVER (PARTITION BY doc_id, region ORDER BY block) = 1 AS opens, row_number() OVER (PARTITION BY doc_id, region ORDER BY block DESC) = 1 AS closes FROM k WHERE kind IN ('paragraph', 'heading')),
      h AS MATERIALIZED (SELECT *, kind = 'paragraph' AND closes AND NOT regexp_matches(e, '[.!?:]["'')\\]]?$') AS hangs, kind = 'paragraph' AND opens AND regexp_matches(f, '^[\\p{{Ll}}0-9(\\[]') AND NOT regexp_matches(f, '{LIST_MARKER}') AS goes FROM p),
      r AS (SELECT doc_id, s, block, block AS head, s AS first_, hangs FROM h WHERE s = 1 UNION ALL
        SELECT h.doc_id, h.s, h.block, CASE WHEN m THEN r.head ELSE h.block END, CASE WHEN m THEN r.first_ ELSE h.s END, h.hangs FROM (SELECT h.*, r.head, r.first_, r.hangs AS hung, h.goes AND r.hangs AND (h.block - r.head) - (h.s - r.first_) <= 4 AS m FROM h JOIN r ON h.doc_id = r.doc_id AND h.s = r.s + 1) h JOIN r ON r.doc_id = h.doc_id AND r.s = h.s - 1)
      SELECT doc_id, CAST(block AS BIGINT) AS block, kind, CAST(coalesce(r.head, block) AS BIGINT) AS head FROM k LEFT JOIN r USING (doc_id, block)""",
    "standing_citations": f"""WITH {REVIEWED}, l AS (SELECT question_id, max(seq) FILTER (kind = 'draft') AS seq FROM k GROUP BY question_id)
      SELECT question_id, seq, CAST(unnest(range(0, seq % 3 + 2)) AS INT) AS ord FROM l WHERE seq IS NOT NULL""",
    "answer_views": f"""WITH {QUOTED}, c AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS ord, doc_id, source, lang, doc_id % 5 AS a, doc_id % 7 AS b FROM h),
      t AS (SELECT item_id, ord, CASE WHEN doc_id % 9 = 0 THEN ord || ' gone' ELSE ord || ' ' || source || ' ' || lang || ' ' || CASE WHEN a = 0 THEN '' WHEN b <> a AND b <> 0 THEN 'pp. ' || a || '–' || b ELSE 'p. ' || a END END AS x FROM c)
      SELECT item_id, CAST(count(ord) AS INT) AS n, coalesce(string_agg(x, '; ' ORDER BY ord), '') AS said FROM benchmark LEFT JOIN t USING (item_id) GROUP BY item_id""",
    "layout_fonts": f"WITH {positioned(16)} SELECT doc_id, body_size, body_font FROM bs LEFT JOIN bf USING (doc_id)",
    "layout_margins": f"""WITH {positioned(4)}, m AS (SELECT *, y > 736 OR y < 64 AS margin, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS k FROM i),
      n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM i GROUP BY doc_id), f AS (SELECT doc_id, k, count(DISTINCT page) AS o FROM m WHERE margin GROUP BY ALL)
      SELECT doc_id, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (starts_with(text, 'Report ')) AS headers FROM m JOIN n USING (doc_id) LEFT JOIN f USING (doc_id, k)
      WHERE NOT (margin AND (regexp_matches(trim(text), '(?i)^(page\\s*)?#?[0-9]{{1,4}}(\\s*(of|/)\\s*[0-9]{{1,4}})?$') OR (pages >= 3 AND coalesce(o, 0) >= greatest(2, ceil(pages * 0.4))))) GROUP BY doc_id""",
    "layout_titles": f"WITH {positioned(16)}, t AS (SELECT *, max(size) OVER (PARTITION BY doc_id) AS m FROM i JOIN bs USING (doc_id) WHERE page = 1 AND y > 440), j AS (SELECT doc_id, string_agg(text, ' ' ORDER BY -y, text) AS title FROM t WHERE m >= body_size * 1.4 AND abs(size - m) < 0.5 GROUP BY doc_id) SELECT * FROM j WHERE length(title) BETWEEN 10 AND 250",
    "layout_columns": f"WITH {positioned(24)}, {COLUMNS} SELECT * FROM cols",
    "layout_lines": f"""WITH {positioned(24)}, {COLUMNS}, z AS (SELECT i.*, gutter, left_edge, right_edge, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM i LEFT JOIN cols USING (doc_id, page)),
      w AS (SELECT *, max(CASE WHEN x + w / 2 < gutter THEN x + w END) OVER r AS le, min(CASE WHEN x + w / 2 >= gutter THEN x END) OVER r AS rs, max(CASE WHEN x < gutter - 3 AND x + w > gutter + 3 THEN 1 ELSE 0 END) OVER r AS over_ FROM z WINDOW r AS (PARTITION BY doc_id, page, y)),
      o AS (SELECT *, CASE WHEN gutter IS NULL OR over_ = 1 OR coalesce(le > left_edge + 2 OR rs < right_edge - 2, false) AND le IS NOT NULL AND rs IS NOT NULL THEN 'F' WHEN x + w / 2 < gutter THEN 'L' ELSE 'R' END AS side FROM w),
      b AS (SELECT doc_id, page, side, y, count(*) AS cells, sum(length(clean)) + 3 * (count(*) - 1) AS chars, count(DISTINCT font) = 1 AND min(font) <> coalesce(any_value(body_font), '') AS df FROM o LEFT JOIN bf USING (doc_id) GROUP BY ALL)
      SELECT doc_id, page, side, count(*) AS lines, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (df) AS distinct_font FROM b GROUP BY ALL""",
    "layout_headings": f"""WITH {MARKED} SELECT page_id, CAST(CASE WHEN regexp_matches(t, '^[0-9]{{1,2}}(\\.[0-9]{{1,2}})*[.)]?\\s') THEN least(3, len(string_split(regexp_extract(t, '^([0-9]{{1,2}}(?:\\.[0-9]{{1,2}})*)', 1), '.')))
      WHEN regexp_matches(t, '^[IVXLC]{{2,6}}\\.\\s') OR regexp_matches(t, '^[IVXLC]\\.\\s') AND length(regexp_replace(rest, '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(rest, '[^A-Za-z]', '', 'g')) THEN 1 WHEN regexp_matches(t, '^[A-Z]\\.\\s') THEN 2
      WHEN regexp_matches(trim(t), '{SECTION_NAMES}') OR size >= 13 THEN 1 ELSE 2 END AS INT) AS level,
      CASE WHEN n >= 4 AND up >= 0.8 * n THEN regexp_replace(t, '\\b([A-Z]) ([A-Z]{{2,}})\\b', '\\1\\2', 'g') ELSE t END AS fixed, trim(regexp_replace('fi' || t || '  ffl', '\\s+', ' ', 'g')) AS clean FROM s""",
    "overview_route": f"""WITH o AS (SELECT list_distinct({ABOUT}) AS o), d AS (SELECT CAST(p_partkey AS VARCHAR) AS document_id, p_size AS created, {tokens("p_name || ' of ' || p_brand")} AS t FROM part),
      q AS (SELECT p_name AS question_id, list_distinct(list_filter({tokens("'Give an overview of the ' || p_name")}, lambda x: NOT list_contains(o, x))) AS t FROM (SELECT DISTINCT p_name FROM part), o),
      r AS (SELECT question_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY created DESC, document_id) AS k FROM q, d WHERE len(q.t) = 0 OR list_has_all(d.t, q.t) UNION ALL SELECT 'all', document_id, row_number() OVER (ORDER BY created DESC, document_id) FROM d)
      SELECT question_id, document_id FROM r WHERE k <= 3""",
    "review_state": f"""WITH {REVIEWED},
      f AS (SELECT question_id, arg_max(draft, seq) FILTER (kind = 'draft') AS draft, arg_max(CASE WHEN kind = 'draft' THEN 'DRAFT' ELSE status END, seq) FILTER (kind <> 'edit') AS status, arg_max(trim(edit), seq) FILTER (kind = 'edit') AS edit,
        max(seq) FILTER (kind = 'edit') > max(seq) FILTER (kind = 'draft') AS later FROM k GROUP BY question_id),
      g AS (SELECT *, CASE WHEN coalesce(later, false) AND edit <> draft THEN edit END AS final_text FROM f) SELECT question_id, draft, final_text, coalesce(status, 'DRAFT') AS status, coalesce(final_text, draft) AS text FROM g""",
    "sentences": f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS ln, unnest(x) AS line FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS x FROM documents)),
      {SPLIT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln, g) - 1 AS INT) AS ord, sentence FROM s""",
    "page_blocks": f"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\\b[^>]*>.*?</(?:h[1-6]|p|li)>') AS m FROM pages),
      e AS (SELECT page_id, unnest(range(len(m))) AS n, unnest(m) AS e FROM m), t AS (SELECT page_id, n, lower(regexp_extract(e, '^<([a-zA-Z0-9]+)', 1)) AS tag, {html("e")} AS text FROM e)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS ord, CASE WHEN tag[1] = 'h' THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN tag[1] = 'h' THEN CAST(tag[2] AS INT) END AS level,
      CASE WHEN tag = 'li' THEN '- ' ELSE '' END || text AS text FROM t WHERE text <> ''""",
    "file_names": f"""WITH {FILES} SELECT doc_id,
      CASE e WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'csv' THEN 'csv'
        ELSE CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'text/plain' THEN 'text' END END AS kind,
      {TITLE} AS title, CASE WHEN length(trim(line)) BETWEEN 8 AND 200 AND len(regexp_extract_all(line, '\\S+')) >= 2 THEN trim(line) ELSE {TITLE} END AS chosen,
      CASE WHEN e <> '' THEN upper(e) ELSE mime END AS label,
      left(regexp_replace(stem || CASE WHEN e <> '' THEN '.' || e ELSE '' END || ' (copy)', '[^\\w.-]+', '_', 'g'), 60) AS safe,
      CASE WHEN mime IN ('application/pdf', 'text/plain') THEN 'inline' ELSE 'attachment' END AS disposition,
      CASE mime WHEN 'application/pdf' THEN mime WHEN 'text/plain' THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS type FROM f""",
    "normalised_texts": f"SELECT doc_id, md5({SQUASH.format('text')}) AS squashed, md5({PLAIN.format('text')}) AS normalised FROM documents",
    "headings_shown": f"""WITH {HEADED}, t AS (SELECT *, '2.1. ' || h AS numbered FROM p) SELECT page_id, nullif(h, '') AS last, {displayed('host')} AS shown,
      CASE WHEN host <> '' AND h <> '' THEN host || ' — ' || h ELSE host || h END || CASE WHEN host || h <> '' THEN chr(10) || chr(10) ELSE '' END || 'x' AS in_context,
      array_to_string(list_filter([host, CASE WHEN page_id % 2 = 0 THEN h ELSE '' END, 'x'], lambda x: x <> ''), chr(10)) AS keywords, {topic('numbered')} AS topic FROM t""",
    "topic_suggestions": f"""WITH {HEADED}, t AS (SELECT *, {topic('h')} AS topic FROM p), f AS (SELECT host, topic, min(page_id) AS page_id FROM t WHERE topic IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, topic) AS rank FROM f), l AS (SELECT host, list(topic ORDER BY rank) AS l FROM r WHERE rank <= 3 GROUP BY host)
      SELECT host, coalesce(array_to_string(l, '; '), '') AS topics, CASE WHEN n = 1 THEN 'Summarise this document' ELSE 'What are these documents about?' END || ' What are the key findings?'
        || coalesce(array_to_string(list_transform(l[1:2], lambda t: ' What does it say about ' || t || '?'), ''), '') AS suggested FROM (SELECT host, count(*) AS n FROM p GROUP BY host) LEFT JOIN l USING (host)""",
    "formats_shown": """WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS s, CAST(l_quantity AS BIGINT) % 3 AS m, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS b, CAST(floor(l_quantity * 100) AS BIGINT) AS t, l_discount FROM lineitem)
      SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN s = 0 THEN '' WHEN m > 0 THEN 'pp. ' || s || '–' || (s + m) ELSE 'p. ' || s END AS pages,
      '/api/documents/' || l_orderkey || '/file' || CASE WHEN s <> 0 THEN '#page=' || s ELSE '' END AS file, '/documents/' || l_orderkey || '#s' || (l_linenumber + 1) AS passage,
      CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', floor(b * 10 / 1024.0::DOUBLE + 0.5) / 10) ELSE format('{:.2f} MB', floor(b * 100 / 1048576.0::DOUBLE + 0.5) / 100) END AS bytes, format('{:,}', b) AS count,
      CASE WHEN t < 1000 THEN t || ' ms' ELSE format('{:.1f} s', t / 1000.0::DOUBLE) END AS ms, CAST(round(l_discount * 100) AS BIGINT) || '%' AS percent,
      l_linenumber || CASE WHEN l_linenumber = 1 THEN ' page' ELSE ' pages' END AS plural, m || CASE WHEN m = 1 THEN ' entry' ELSE ' entries' END AS entries FROM v""",
    "cited_numbers": "SELECT DISTINCT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS n, array_to_string(list_sort(list_distinct([1, 2, l_linenumber, CAST(floor(l_quantity) AS INT)])), ',') AS cited FROM lineitem",
    "question_checks": """WITH r AS (SELECT *, CASE WHEN turn % 5 = 0 THEN repeat(text, 12) WHEN turn % 7 = 0 THEN ' ' ELSE text END AS raw FROM conversations), c AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS c FROM r)
      SELECT conv_id, turn, role, md5(c) AS clean_md5, CASE WHEN length(c) = 0 THEN 'empty' WHEN length(c) > 2000 THEN 'too_long' END AS error FROM c""",
    "highlighted": f"WITH {QUOTED} SELECT item_id, doc_id, nullif(instr(lower(text), lower(left(quote, 10))), 0) - 1 AS at, length({PLAIN.format('left(quote, 10)')}) >= 3 AND contains({PLAIN.format('text')}, {PLAIN.format('left(quote, 10)')}) AS verified FROM h",
    "vector_codec": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, CAST(4 * len(e) AS INT) AS n_bytes, true AS same, 1.0::DOUBLE AS length, round(sqrt(list_dot_product(e, e)), 1) AS projected FROM v",
    "model_replies": f"""SELECT event_id, {REPLY.format('event_type')} AS answer, {REPLY.format("['high', 'low', 'medium'][event_id % 4 + 1]")} AS confidence, {REPLY.format('event_id % 4 < 2')} AS insufficient,
      {REPLY.format('CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END')} AS n_cited, {REPLY.format('CASE WHEN event_id % 3 <> 0 THEN event_id % 9 END')} AS source FROM events""",
    "stored_summaries": "SELECT p_partkey, p_partkey % 5 > 1 AS whole, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS point, CAST(CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 7 END AS INT) AS page FROM part",
    "mostly_tables": f"""WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, doc_id % 40 AS k FROM documents),
      n AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '{TABLE_LINE}'))) AS r, len(list_filter(l[-1:], lambda x: true)) AS last, k FROM t)
      SELECT doc_id, n > 0 AND 2 * r > n AS "plain", n + k > 0 AND 2 * (r + k) > n + k AS with_lines FROM n""",
    "table_lines": """WITH n AS (SELECT r_name, length(r_name) % 2 = 0 AS good, n_nationkey AS k, n_name AS n, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'open' END AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT r_name, CASE WHEN good THEN 'Key | Name | State' ELSE '1 | 2 | State' END || chr(10) || string_agg(CASE WHEN good THEN 'Key: ' || k || '; Name: ' || n || CASE WHEN s = '' THEN '' ELSE '; State: ' || s END ELSE k || ' | ' || n || CASE WHEN s = '' THEN '' ELSE ' | ' || s END END, chr(10) ORDER BY CAST(k AS VARCHAR)) AS lines
      FROM n GROUP BY r_name, good""",
    "document_texts": f"WITH {FILES}, b AS ({ORACLES['text_blocks']}), x AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS x, CAST(count(*) AS INT) AS n FROM b GROUP BY doc_id) SELECT doc_id, md5({TITLE} || chr(10) || chr(10) || x) AS text_md5, n AS n_blocks FROM x JOIN f USING (doc_id)",
    "question_sets": f"WITH {QUESTIONS} SELECT set_id, count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'DRAFT') AS drafted, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, CAST(round(100.0 * count(*) FILTER (status <> 'PENDING') / count(*)) AS INT) AS progress FROM a GROUP BY set_id",
    "question_set_view": f"WITH {QUESTIONS} SELECT set_id, CAST(idx AS INT) AS idx, md5(question) AS question_md5, CAST(length(answer) AS INT) AS answer_chars, status FROM a",
    "csv_import": f"""WITH {QUESTIONS} SELECT set_id, NULL AS error, CAST(idx AS INT) AS idx, md5(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS question_md5 FROM q WHERE set_id % 5 <> 0
      UNION ALL SELECT DISTINCT set_id, 'bad_name', NULL, NULL FROM q WHERE set_id % 5 = 0""",
    "csv_delimiters": "SELECT DISTINCT conv_id, turn, role, [',', ';', chr(9)][turn % 3 + 1] AS delimiter FROM conversations",
    "dashboard": f"WITH {QUESTIONS} SELECT *, CAST(round(100.0 * answers / greatest(1, questions)) AS INT) AS progress FROM (SELECT count(*) AS documents, count(*) FILTER (doc_id % 3 < 2 AND doc_id % 10 <> 0) AS outdated, count(*) FILTER ((doc_id % 3 < 2 OR (doc_id // 3) % 3 = 2) AND doc_id % 10 <> 0) AS stale FROM documents), (SELECT count(DISTINCT set_id) AS sets, count(*) AS questions, count(answer) AS answers FROM a)",
    "newest_first": "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O') WHERE rank <= 3",
    "document_with_passages": "SELECT o_orderkey, CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS said FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "answer_sources": f"WITH {QUOTED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS ord FROM h), f AS (SELECT item_id, source || ' §' || lang AS label, min(ord) AS ord, count(*) AS n FROM r GROUP BY ALL) SELECT item_id, string_agg(label, '; ' ORDER BY ord) AS sources, CAST(sum(n) AS BIGINT) AS citations FROM f GROUP BY item_id",
    "unverified_citations": f"""WITH q AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, {PLAIN.format('substr(text, 3, 60)')} AS q FROM documents)
      SELECT source, count(*) AS citations, count(*) FILTER (NOT coalesce(length(q) >= 3 AND contains({PLAIN.format('text')}, q), false)) AS unverified FROM q JOIN documents USING (doc_id) GROUP BY source""",
    "eval_answers": f"""WITH {BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm),
      t AS (SELECT r.item_id, rank, {SQUASH.format('d.text')} AS d FROM r JOIN documents d USING (doc_id) WHERE rank <= 8),
      b AS (SELECT item_id, item_id % 9 = 0 AS not_there, {SQUASH.format('left(text, 30)')} AS e, {SQUASH.format('substr(text, 5, 20)')} AS p FROM benchmark),
      h AS (SELECT b.item_id, min(rank) FILTER (contains(d, e)) AS rank, bool_or(rank = 1 AND contains(d, p)) AS holds, count(d) > 0 AS answered FROM b LEFT JOIN t USING (item_id) GROUP BY b.item_id),
      x AS (SELECT b.item_id, not_there, rank, CASE WHEN not_there THEN answered AND b.item_id % 18 = 0 ELSE answered AND b.item_id % 18 <> 0 AND coalesce(holds, false) END AS ok FROM b JOIN h USING (item_id)),
      c AS (SELECT count(*) AS n, count(*) FILTER (NOT not_there) AS retrievable, count(*) FILTER (NOT not_there AND rank = 1) AS hit1, count(*) FILTER (NOT not_there AND rank <= 3) AS hit3, count(*) FILTER (NOT not_there AND rank IS NOT NULL) AS hitk, count(*) FILTER (ok) AS answered FROM x)
      SELECT *, CAST(round(100.0 * hit1 / greatest(1, retrievable)) AS INT) AS hit1_percent, CAST(round(100.0 * hit3 / greatest(1, retrievable)) AS INT) AS hit3_percent, CAST(round(100.0 * hitk / greatest(1, retrievable)) AS INT) AS hitk_percent, CAST(round(100.0 * answered / greatest(1, n)) AS INT) AS answered_percent FROM c""",
}
