"""Passages of all documents in DuckDB's SQL: pieces of text in order, and a recursion over them that carries what is open."""

from __future__ import annotations

from ..functions.constants import BACK_MATTER_HEADING, BACK_MATTER_SECTION, CUE_PHRASES, NOT_FOUND, SUMMARY_SECTIONS
from .answers_sql import EXTRACT, N_WORDS, SALIENT, found, literal
from .details_sql import DETAILS, SPLIT
from .oracle import HYBRID, ORACLES

_LENGTH = "coalesce(list_sum(list_transform({0}, lambda x: length(x.t) + length(x.j))) - length({0}[1].j), 0)"
_PIECE = "STRUCT(t VARCHAR, j VARCHAR, p VARCHAR, h BOOLEAN)"

#: pieces (doc_id, seq, kind, level, n, text): headings, and sentences of paragraphs, those of more than 1,200 characters cut between words, and longer words cut.
SPLIT_UP = f"""l AS (SELECT doc_id, ord AS ln, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM b WHERE kind = 'paragraph'),
{SPLIT},
long_word AS (SELECT doc_id, ln, g, unnest(range(len(x))) AS wi, unnest(x) AS w FROM (SELECT doc_id, ln, g, string_split(sentence, ' ') AS x FROM s WHERE length(sentence) > 1200)),
part AS (SELECT doc_id, ln, g, row_number() OVER (PARTITION BY doc_id, ln, g ORDER BY wi, si) AS k, substr(w, 1200 * si + 1, 1200) AS w FROM (SELECT *, unnest(range(CAST(ceil(length(w) / 1200.0) AS INT))) AS si FROM long_word)),
cum AS MATERIALIZED (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id, ln, g ORDER BY k) AS upto, max(k) OVER (PARTITION BY doc_id, ln, g) AS most FROM part),
nxt AS MATERIALIZED (SELECT x.doc_id, x.ln, x.g, x.k AS a, coalesce(min(y.k) FILTER (y.k > x.k AND y.upto - (x.upto - length(x.w) - 1) - 1 > 1200), any_value(x.most) + 1) AS z FROM cum x JOIN cum y ON x.doc_id = y.doc_id AND x.ln = y.ln AND x.g = y.g GROUP BY ALL),
rows_ AS (SELECT doc_id, ln, g, a, z FROM nxt WHERE a = 1 UNION ALL SELECT n.doc_id, n.ln, n.g, n.a, n.z FROM rows_ r JOIN nxt n ON n.doc_id = r.doc_id AND n.ln = r.ln AND n.g = r.g AND n.a = r.z),
unit AS (SELECT doc_id, ln, g, 0 AS a, sentence AS text FROM s WHERE length(sentence) <= 1200
  UNION ALL SELECT r.doc_id, r.ln, r.g, r.a, string_agg(c.w, ' ' ORDER BY c.k) FROM rows_ r JOIN cum c ON c.doc_id = r.doc_id AND c.ln = r.ln AND c.g = r.g AND c.k >= r.a AND c.k < r.z GROUP BY ALL),
every AS (SELECT doc_id, ord AS ln, -1 AS g, 0 AS a, kind, level, text FROM b WHERE kind = 'heading' UNION ALL SELECT doc_id, ln, g, a, 'paragraph', NULL, text FROM unit),
pieces AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, g, a) AS seq, kind, level, row_number() OVER (PARTITION BY doc_id, ln ORDER BY g, a) - 1 AS n, text FROM every)"""

PIECES = f"b AS MATERIALIZED ({ORACLES['text_blocks']}), {SPLIT_UP}"

#: What is open after each piece, and what the piece closed: a heading closes a passage of 350 characters and more, a sentence one that it doesn't fit in, of which the last sentence is carried over.
FOLD = f"""start_ AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, []::{_PIECE}[] AS open_, 0::BIGINT AS carried, '' AS p1, '' AS p2, NULL::{_PIECE}[] AS closed FROM pieces),
fold AS (
  SELECT * FROM start_ UNION ALL
  SELECT doc_id, seq, CASE WHEN kind = 'heading' AND len(kept) = 0 THEN kept ELSE list_append(kept, {{'t': text, 'j': CASE WHEN kind = 'heading' OR n = 0 THEN chr(10) || chr(10) ELSE ' ' END, 'p': nullif(concat_ws(' › ', nullif(q1, ''), nullif(q2, '')), ''), 'h': kind = 'heading'}}) END,
    CASE WHEN kind = 'heading' THEN CASE WHEN closes OR fresh THEN 0 ELSE carried END WHEN closes THEN len(kept) ELSE carried END, q1, q2, CASE WHEN closes THEN before END
  FROM (
    SELECT *, CASE WHEN kind = 'heading' THEN CASE WHEN closes THEN [] ELSE before END WHEN NOT closes THEN before WHEN before[-1].h OR length(before[-1].t) > 320 OR length(before[-1].t) + 2 + length(text) > 1200 THEN []
        ELSE [{{'t': before[-1].t, 'j': chr(10) || chr(10), 'p': before[-1].p, 'h': false}}] END AS kept
    FROM (
      SELECT *, CASE WHEN kind = 'heading' THEN {_LENGTH.format('before')} >= 350 OR len(before) > 0 AND regexp_matches(text, {literal('(?i)' + BACK_MATTER_HEADING)}) ELSE len(before) > 0 AND {_LENGTH.format('before')} + CASE WHEN n = 0 THEN 2 ELSE 1 END + length(text) > 1200 END AS closes
      FROM (
        SELECT f.doc_id, p.seq, p.kind, p.n, p.text, f.carried, len(f.open_) = f.carried AS fresh, CASE WHEN p.kind = 'heading' AND len(f.open_) = f.carried THEN [] ELSE f.open_ END AS before,
          CASE WHEN p.kind = 'heading' AND p.level = 1 THEN p.text ELSE f.p1 END AS q1, CASE WHEN p.kind <> 'heading' THEN f.p2 WHEN p.level = 1 THEN '' ELSE p.text END AS q2
        FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.seq = f.seq + 1)))),
done AS (SELECT doc_id, seq, closed AS c FROM fold WHERE closed IS NOT NULL
  UNION ALL SELECT doc_id, seq + 1, open_ FROM fold WHERE len(open_) > carried QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1 AND seq = (SELECT max(seq) FROM pieces p WHERE p.doc_id = fold.doc_id)),
weight AS (SELECT doc_id, seq, p, sum(length(t)) AS n, min(i) AS i FROM (SELECT doc_id, seq, unnest(range(len(c))) AS i, unnest(list_transform(c, lambda x: x.p)) AS p, unnest(list_transform(c, lambda x: x.t)) AS t FROM done) GROUP BY ALL),
named AS (SELECT doc_id, seq, p FROM weight QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY n DESC, i) = 1),
passage AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INT) AS chunk_index, substr(array_to_string(list_transform(c, lambda x: x.j || x.t), ''), length(c[1].j) + 1) AS content, p AS heading FROM done JOIN named USING (doc_id, seq))"""

#: Key points of the blocks b, their characters, and how many passages there are.
SUMMARY = f"""section AS (SELECT doc_id, ord AS ln, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), '') AS section FROM b),
      bare AS (SELECT doc_id, ln, g, section, regexp_replace(sentence, {literal(r'(?i)^\(?([ivx]{1,4}|[0-9]{1,2}|[a-h])\)\s+')}, '') AS sentence FROM s JOIN section USING (doc_id, ln) WHERE NOT {found('trim(section)', BACK_MATTER_SECTION)}),
      c AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, g) - 1 AS ord, sentence,
        (CASE WHEN {found('section', SUMMARY_SECTIONS)} THEN 1.2 ELSE 1 END * CASE WHEN {found('sentence', CUE_PHRASES)} THEN 1.25 ELSE 1 END * CASE WHEN g = 0 THEN 1.05 ELSE 1 END)::DOUBLE AS bonus
        FROM bare WHERE {N_WORDS.format('sentence')} BETWEEN 8 AND 45 AND NOT regexp_matches(sentence, 'https?://|^\\[[0-9]+\\]')),
      {SALIENT},
      points AS (SELECT doc_id, string_agg(sentence, ' | ' ORDER BY ord) AS points FROM r5 JOIN c USING (doc_id, ord) WHERE turn IS NOT NULL GROUP BY doc_id),
      size AS (SELECT doc_id, sum(length(text)) AS chars FROM b GROUP BY doc_id), held AS (SELECT doc_id, count(*) AS n FROM passage GROUP BY doc_id)"""

PASSAGES = {
    "chunks": f"WITH RECURSIVE {PIECES}, {FOLD} SELECT doc_id, chunk_index, content, heading, CAST(NULL AS INT) AS page_start, CAST(NULL AS INT) AS page_end FROM passage",
    "chunk_pages": f"WITH RECURSIVE {PIECES}, {FOLD} SELECT doc_id, count(*) AS passages, CAST(sum(length(content)) AS BIGINT) AS chars FROM passage GROUP BY doc_id",
    "doc_summary": f"""WITH RECURSIVE {PIECES}, {FOLD}, {SUMMARY}
      SELECT doc_id, CASE WHEN coalesce(chars, 0) < 20 THEN 'the file holds almost no text' END AS error, CAST(CASE WHEN chars >= 20 THEN chars ELSE 0 END AS INT) AS char_count, CAST(CASE WHEN chars >= 20 THEN n ELSE 0 END AS INT) AS passages,
        CASE WHEN chars >= 20 THEN coalesce(points, '') END AS key_points, CAST(NULL AS VARCHAR) AS abstract FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN points USING (doc_id)""",
    "page_summaries": f"""WITH RECURSIVE every_block AS MATERIALIZED (SELECT page_id AS doc_id, ord, kind, text, level, count(*) OVER p AS n, count(*) FILTER (kind = 'heading' AND level = 1) OVER p AS tops FROM ({DETAILS['page_blocks']}) WINDOW p AS (PARTITION BY page_id)),
      title AS (SELECT doc_id, text AS title FROM every_block WHERE ord = 0 AND kind = 'heading' AND level = 1 AND tops = 1 AND n > 1),
      b AS MATERIALIZED (SELECT doc_id, ord, kind, text, level FROM every_block LEFT JOIN title USING (doc_id) WHERE title IS NULL OR ord > 0), {SPLIT_UP}, {FOLD}, {SUMMARY}
      SELECT page_id, CASE WHEN chars >= 20 THEN title END AS detected, CASE WHEN coalesce(chars, 0) < 20 THEN 'the file holds almost no text' END AS error, CAST(CASE WHEN chars >= 20 THEN chars ELSE 0 END AS INT) AS char_count,
        CAST(CASE WHEN chars >= 20 THEN n ELSE 0 END AS INT) AS passages, CASE WHEN chars >= 20 THEN coalesce(points, '') END AS key_points
      FROM pages LEFT JOIN title ON title.doc_id = page_id LEFT JOIN size ON size.doc_id = page_id LEFT JOIN held ON held.doc_id = page_id LEFT JOIN points ON points.doc_id = page_id""",
    # the passages of all documents take the documents' place
    "offline_answers": f"""WITH documents AS (SELECT doc_id || '#' || chunk_index AS doc_id, 'document ' || doc_id || coalesce(' — ' || heading, '') || chr(10) || chr(10) || content AS text, content, heading FROM (WITH RECURSIVE {PIECES}, {FOLD} SELECT * FROM passage)),
      {HYBRID}, q0 AS (SELECT item_id, text AS question FROM benchmark),
      src AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS source, doc_id AS key, heading FROM top JOIN documents USING (doc_id) WHERE rank <= 8 AND (vector_score >= 0.05 OR coverage >= 0.5)),
      sent AS (FROM (WITH l AS (SELECT doc_id, unnest(range(len(x))) AS ln, unnest(x) AS line FROM (SELECT doc_id, list_transform(string_split(content, chr(10)), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS x FROM documents)),
        {SPLIT} SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY ln, g) - 1 AS ord, sentence FROM s)),
      {EXTRACT}
      SELECT item_id AS question_id, 'answer' AS mode, CASE WHEN answer IS NULL THEN 'low' WHEN score >= 0.75 THEN 'high' ELSE 'medium' END AS confidence, answer IS NULL AS insufficient, coalesce(answer, {literal(NOT_FOUND)}) AS answer,
        CAST(coalesce(n, 0) AS INT) AS n_citations, CAST(coalesce(n, 0) AS INT) AS n_verified FROM benchmark LEFT JOIN said USING (item_id) LEFT JOIN best USING (item_id)""",
}
