"""SQL for DuckDB that says again, in its own way, what the queries of answers compute."""

from __future__ import annotations

from ..functions.constants import ABSTRACT_HEADING, BACK_MATTER_PATH, CONCLUSION_HEADING, CUE_PHRASES, EXPLANATORY, FILLER_WORDS, FOCUS, INTRO_HEADING, NOT_FOUND, QUANTITATIVE, TABLE_LINE
from .answers import HEADINGS
from .details_sql import ABOUT, DETAILS
from .oracle import BM25, ORACLES, PLAIN, tokens


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {literal('(?i)' + pattern)}), false)"


N_WORDS = "len(regexp_extract_all({0}, '\\S+'))"

_ROUND = """b{1} AS (SELECT doc_id, arg_max(ord, (round(0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * near, 9), -ord)) AS ord FROM r{0} WHERE turn IS NULL GROUP BY doc_id),
s{1} AS (SELECT x.doc_id, x.ord, sum(x.u * y.u) AS sim FROM b{1} b JOIN u y ON y.doc_id = b.doc_id AND y.ord = b.ord JOIN u x ON x.doc_id = y.doc_id AND x.term = y.term GROUP BY ALL),
r{1} AS MATERIALIZED (SELECT r.doc_id, r.ord, rel, greatest(near, coalesce(sim, 0)) AS near, CASE WHEN turn IS NULL AND r.ord = b.ord THEN {1} ELSE turn END AS turn FROM r{0} r LEFT JOIN b{1} b ON b.doc_id = r.doc_id LEFT JOIN s{1} s ON s.doc_id = r.doc_id AND s.ord = r.ord)"""

#: Five rounds r0 to r5 of marginal relevance over the sentences c (doc_id, ord, sentence, bonus) of each document.
SALIENT = f"""tf AS (SELECT doc_id, ord, term, count(*) AS tf FROM (SELECT doc_id, ord, unnest({tokens('sentence')}) AS term FROM c) GROUP BY ALL),
      w AS MATERIALIZED (SELECT *, tf * idf AS w, sum(tf) OVER (PARTITION BY doc_id, term) * idf AS c FROM (
        SELECT tf.*, ln(1 + n / CAST(count(*) OVER (PARTITION BY doc_id, term) AS DOUBLE)) AS idf FROM tf JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id))),
      v AS (SELECT doc_id, ord, sum(w * c) AS toward, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
      u AS MATERIALIZED (SELECT doc_id, ord, term, w / length AS u FROM w JOIN v USING (doc_id, ord)),
      r0 AS MATERIALIZED (SELECT doc_id, ord, round(toward / (length * sqrt(sum(toward) OVER (PARTITION BY doc_id))) * bonus, 9) AS rel, 0.0::DOUBLE AS near, CAST(NULL AS INT) AS turn FROM v JOIN c USING (doc_id, ord)),
      {", ".join(_ROUND.format(n, n + 1) for n in range(5))}"""

SHOWN = f"{BM25}, top AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS source FROM bm)"

_PICK = """c{1} AS (
  SELECT k.item_id, k.source, k.local, any_value(k.own) AS own, round(coalesce(sum(w.w) FILTER (list_contains(k.own, w.term) AND NOT list_contains(p.covered, w.term)), 0) / any_value(w.total), 9) AS new
  FROM k JOIN w USING (item_id) JOIN p{0} p USING (item_id) GROUP BY ALL),
n{1} AS (SELECT c.item_id, c.source, c.local, c.own FROM c{1} c JOIN scored s USING (item_id, source, local) JOIN p{0} p USING (item_id)
  WHERE s.score > 0 AND c.new >= 0.15 AND s.direct >= 0.3 AND NOT list_contains(p.places, (c.source, c.local)) QUALIFY row_number() OVER (PARTITION BY c.item_id ORDER BY s.merit DESC, c.source, c.local) = 1),
p{1} AS MATERIALIZED (SELECT p.item_id, CASE WHEN n.item_id IS NULL THEN p.places ELSE list_append(p.places, (n.source, n.local)) END AS places, CASE WHEN n.item_id IS NULL THEN p.covered ELSE list_concat(p.covered, n.own) END AS covered FROM p{0} p LEFT JOIN n{1} n USING (item_id))"""

#: The sentences said in answer to the questions q0 (item_id, question), from the sentences sent (key, ord, sentence) of their sources src (item_id, source, key, heading).
EXTRACT = f"""q1 AS (SELECT *, list_distinct({tokens('question')}) AS every, {tokens("regexp_extract(question, " + literal('(?i)' + FOCUS) + ", 1)")}[1] AS focus FROM q0),
      q AS MATERIALIZED (SELECT *, CASE WHEN len(topic) > 0 THEN topic ELSE every END AS terms FROM (SELECT *, list_filter(every, lambda t: NOT list_contains({ABOUT}, t)) AS topic FROM q1)),
      own AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS local, sentence, {tokens('sentence')} AS t FROM sent WHERE {N_WORDS.format('sentence')} >= 3 AND key IN (SELECT key FROM src)),
      beside AS (SELECT *, list_concat(coalesce(lag(t) OVER o, []), coalesce(lead(t) OVER o, [])) AS near FROM own WINDOW o AS (PARTITION BY key ORDER BY local)),
      k AS MATERIALIZED (SELECT item_id, source, local, sentence AS text, list_intersect(terms, t) AS own, list_intersect(terms, {tokens("coalesce(heading, '')")}) AS head, list_intersect(terms, near) AS near
        FROM src JOIN q USING (item_id) JOIN beside USING (key) QUALIFY row_number() OVER (PARTITION BY item_id, sentence ORDER BY source, local) = 1),
      held AS (SELECT item_id, term, count(*) AS df FROM (SELECT item_id, unnest(list_distinct(list_concat(own, head))) AS term FROM k) GROUP BY ALL),
      known AS (SELECT item_id, term, focus, ln(1 + n / CAST(df AS DOUBLE)) AS known FROM (SELECT item_id, focus, unnest(terms) AS term FROM q) JOIN (SELECT item_id, count(*) AS n FROM k GROUP BY item_id) USING (item_id) LEFT JOIN held USING (item_id, term)),
      w0 AS (SELECT item_id, term, coalesce(known, avg(known) OVER (PARTITION BY item_id)) * CASE WHEN list_contains({tokens(literal(' '.join(FILLER_WORDS)))}, term) THEN 0.3 WHEN term = focus THEN 1.5 ELSE 1 END::DOUBLE AS w FROM known),
      w AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY item_id) AS total FROM w0 WHERE w IS NOT NULL),
      s AS (SELECT item_id, source, local, round(sum(w * CASE WHEN list_contains(own, term) THEN 1 WHEN list_contains(head, term) THEN 0.6 WHEN list_contains(near, term) THEN 0.4 ELSE 0 END::DOUBLE) / any_value(total), 9) AS score,
        round(coalesce(sum(w) FILTER (list_contains(own, term)), 0) / any_value(total), 9) AS direct FROM k JOIN w USING (item_id) GROUP BY ALL),
      scored AS MATERIALIZED (SELECT *, round(score * (1 + 0.08::DOUBLE * greatest(0, 3 - source)), 9) AS merit FROM s),
      best AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY merit DESC, source, local) = 1),
      p0 AS MATERIALIZED (SELECT item_id, [(source, local)] AS places, own AS covered FROM best JOIN k USING (item_id, source, local) WHERE score >= 0.5),
      {_PICK.format(0, 1)}, {_PICK.format(1, 2)},
      after AS (SELECT k.item_id, (k.source, k.local) AS place FROM p2 p JOIN best b USING (item_id) JOIN k ON k.item_id = b.item_id AND k.source = b.source AND k.local = b.local + 1 JOIN k kb ON kb.item_id = b.item_id AND kb.source = b.source AND kb.local = b.local JOIN q ON q.item_id = k.item_id
        WHERE len(places) < 3 AND NOT list_contains(places, (k.source, k.local)) AND {N_WORDS.format('k.text')} >= 4 AND ({found('question', EXPLANATORY)} OR {found('question', QUANTITATIVE)} AND NOT regexp_matches(kb.text, '[0-9]') AND regexp_matches(k.text, '[0-9]'))),
      picked AS (SELECT item_id, unnest(places) AS place FROM p2 UNION ALL SELECT item_id, place FROM after),
      said AS (SELECT k.item_id, string_agg(text || ' [' || source || ']', ' ' ORDER BY source, local) AS answer, count(*) AS n FROM picked p JOIN k ON k.item_id = p.item_id AND (k.source, k.local) = p.place GROUP BY k.item_id)"""

ANSWERS: dict[str, str] = {
    "salient_sentences": f"""WITH c AS MATERIALIZED (SELECT doc_id, ord, sentence, (CASE WHEN {found('sentence', CUE_PHRASES)} THEN 1.25 ELSE 1 END * CASE WHEN ord = 0 THEN 1.05 ELSE 1 END)::DOUBLE AS bonus
        FROM ({DETAILS['sentences']}) WHERE {N_WORDS.format('sentence')} BETWEEN 8 AND 45 AND NOT regexp_matches(sentence, 'https?://|^\\[[0-9]+\\]')),
      {SALIENT}
      SELECT doc_id, ord, turn, sentence FROM r5 JOIN c USING (doc_id, ord) WHERE turn IS NOT NULL""",
    "overview_picks": f"""WITH b AS (SELECT doc_id, ord AS i, CASE WHEN (doc_id * 7 + ord) % 5 = 0 THEN 'Name: x; Price: 3' ELSE text END AS content,
        [{", ".join("NULL" if h is None else literal(h) for h in HEADINGS)}][(doc_id + ord) % {len(HEADINGS)} + 1] AS heading, [8, 5, 4][doc_id % 3 + 1] AS most FROM ({ORACLES['text_blocks']})),
      body AS (SELECT *, {found('heading', ABSTRACT_HEADING)} AS abs, {found('heading', INTRO_HEADING)} AS intro, {found('heading', CONCLUSION_HEADING)} AS con FROM b WHERE NOT {found('heading', BACK_MATTER_PATH)}),
      roles AS (SELECT doc_id, i, rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM body WHERE abs) WHERE rank <= 2
        UNION ALL SELECT doc_id, min(i), 1 FROM body GROUP BY doc_id HAVING NOT bool_or(abs)
        UNION ALL SELECT doc_id, min(i), 3 FROM body WHERE intro GROUP BY doc_id UNION ALL SELECT doc_id, max(i), 4 FROM body WHERE con GROUP BY doc_id
        UNION ALL SELECT doc_id, i, 5 FROM body WHERE i = doc_id % 5 UNION ALL SELECT doc_id, i, 6 FROM body WHERE i = doc_id % 3 + 4),
      placed AS (SELECT doc_id, i, min(place) AS place FROM roles GROUP BY ALL),
      picked AS (SELECT doc_id, i FROM placed JOIN body USING (doc_id, i) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, i) <= most),
      room AS (SELECT doc_id, any_value(most) - (SELECT count(*) FROM picked p WHERE p.doc_id = body.doc_id) AS room FROM body GROUP BY doc_id),
      lines AS (SELECT doc_id, i, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS l FROM body),
      prose AS (SELECT doc_id, list(i ORDER BY i) AS spots FROM lines l WHERE NOT (len(l) > 0 AND 2 * len(list_filter(l, lambda x: regexp_matches(x, {literal(TABLE_LINE)}))) > len(l)) AND NOT EXISTS (FROM picked p WHERE p.doc_id = l.doc_id AND p.i = l.i) GROUP BY doc_id),
      even AS (SELECT doc_id, spots, len(spots) AS n, room, unnest(range(1, room + 1)) AS k FROM prose JOIN room USING (doc_id) WHERE room > 0)
      SELECT DISTINCT doc_id, i AS chunk_index, heading FROM (FROM picked UNION SELECT doc_id, spots[CAST(least(n - 1, floor(n / CAST(room + 1 AS DOUBLE) * k + 0.5::DOUBLE)) AS INT) + 1] FROM even) JOIN b USING (doc_id, i)""",
    "resolved_citations": f"""WITH {SHOWN}, q AS (SELECT item_id, text, left(text, 40) AS f FROM benchmark),
      raw AS (SELECT item_id, unnest(range(8)) AS pos, unnest([1, 1, 2, 2.5, 9, 3, 4, 0]) AS source, unnest([f, '  ' || translate(f, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ', left(text, 60), f, f, left(text, 2), substr(text, 10, 30), f]) AS quote FROM q),
      met AS (SELECT item_id, pos, t.source, doc_id, regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS quote, d.text FROM raw r JOIN top t USING (item_id) JOIN documents d USING (doc_id) WHERE t.source = r.source AND t.source <= 4),
      same AS (SELECT *, {PLAIN.format('quote')} AS p FROM met QUALIFY row_number() OVER (PARTITION BY item_id, source, {PLAIN.format('quote')} ORDER BY pos) = 1)
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS INT) AS ord, CAST(source AS INT) AS source, doc_id, quote, length(p) >= 3 AND contains({PLAIN.format('text')}, p) AS verified FROM same""",
    "extracted_answers": f"""WITH {SHOWN}, q0 AS (SELECT item_id, ['', 'How many ', 'Explain why '][item_id % 3 + 1] || text AS question FROM benchmark),
      src AS (SELECT item_id, top.source, doc_id AS key, d.source AS heading FROM top JOIN documents d USING (doc_id) WHERE top.source <= 3), sent AS (SELECT doc_id AS key, ord, sentence FROM ({DETAILS['sentences']})),
      {EXTRACT}
      SELECT item_id, coalesce(answer, {literal(NOT_FOUND)}) AS answer, CASE WHEN answer IS NULL THEN 'low' WHEN score >= 0.75 THEN 'high' ELSE 'medium' END AS confidence, answer IS NULL AS insufficient, CAST(coalesce(n, 0) AS INT) AS n_citations
      FROM benchmark LEFT JOIN said USING (item_id) LEFT JOIN best USING (item_id)""",
    "markdown_blocks": """WITH l AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
      c AS (SELECT doc_id, i, (i + doc_id) % 13 AS kind, coalesce(nullif(trim(left(trim(regexp_replace(regexp_replace(raw, '[^\\p{L}\\p{N} ]+', '', 'g'), ' +', ' ', 'g')), 60)), ''), 'x') AS c, i + 1 < count(*) OVER (PARTITION BY doc_id) AS more FROM l),
      p AS (SELECT *, count(*) FILTER (kind = 11) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced,
        CASE kind WHEN 2 THEN c || ' and code' WHEN 3 THEN '' WHEN 5 THEN '' WHEN 6 THEN '- ' || c WHEN 7 THEN '- item' WHEN 8 THEN '| Key | Word |' WHEN 9 THEN '|---|---|' WHEN 10 THEN '| ' || i || ' | ' || split_part(c, ' ', 1) || ' |' ELSE c END AS bare FROM c),
      k AS (SELECT *, CASE WHEN fenced THEN 'f' WHEN kind = 0 OR kind = 4 AND more THEN 'h' WHEN kind = 3 THEN 'b' WHEN kind IN (6, 7) THEN 'l' WHEN kind IN (8, 9, 10) THEN 't' ELSE 'p' END AS w FROM p WHERE kind <> 11 AND NOT (kind = 5 AND NOT fenced AND i > 0)),
      g AS (SELECT *, count(*) FILTER (w IN ('h', 't', 'b', 'l')) OVER o AS texts, count(*) FILTER (w IN ('h', 'b', 'l', 'p')) OVER o AS tables FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      e AS (SELECT doc_id, texts AS s, 'paragraph' AS kind, string_agg(bare, ' ' ORDER BY i) FILTER (bare <> '') AS text FROM g WHERE w IN ('p', 'f') GROUP BY ALL
        UNION ALL SELECT doc_id, tables, 'table', string_agg(CASE kind WHEN 8 THEN 'Key | Word' WHEN 10 THEN CASE WHEN headed THEN 'Key: ' || i || '; Word: ' || split_part(c, ' ', 1) ELSE i || ' | ' || split_part(c, ' ', 1) END END, chr(10) ORDER BY i)
          FROM (SELECT *, bool_or(kind = 8) OVER (PARTITION BY doc_id, tables) AS headed FROM g WHERE w = 't') GROUP BY doc_id, tables),
      z AS (SELECT e.doc_id, e.kind, e.text, CAST(NULL AS INT) AS level, coalesce(min(n.i), 1000000000) AS at_, coalesce(arg_min(n.w, n.i), 'h') = 'h' AS head FROM e LEFT JOIN g n ON n.doc_id = e.doc_id AND CASE WHEN e.kind = 'table' THEN n.tables ELSE n.texts END = e.s + 1 AND n.w IN ('h', 'b', 'l', CASE WHEN e.kind = 'table' THEN 'p' ELSE 't' END)
        GROUP BY e.doc_id, e.kind, e.text, e.s),
      u AS (SELECT doc_id, kind, text, level, at_, CASE WHEN (kind = 'table') = head THEN 1 ELSE 0 END AS sub FROM z
        UNION ALL SELECT doc_id, CASE WHEN w = 'h' THEN 'heading' ELSE 'paragraph' END, bare, CASE WHEN w = 'l' THEN NULL WHEN kind = 0 THEN 1 ELSE 2 END, i, 2 FROM g WHERE w IN ('h', 'l'))
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_, sub) - 1 AS INT) AS ord, kind, text, level FROM u WHERE text <> ''""",
}
