"""SQL for DuckDB that says again, in its own way, what the queries compute."""

from __future__ import annotations

from ..functions.constants import ASKS_ABOUT_REFERENCES, IRREGULAR, OVERVIEW_PATTERN, OVERVIEW_WORDS, STOPWORDS


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def tokens(text: str) -> str:
    """An expression for the token list of a text expression."""
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({quoted(STOPWORDS)}))"
    base = "list_transform({0}, lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + " ELSE w END)"
    fixed = "length(w) <= 3 OR regexp_matches(w, '[0-9]')"
    singular = (
        f"list_transform({{0}}, lambda w: CASE WHEN {fixed} THEN w WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' "
        "WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND right(w, 2) NOT IN ('ss', 'us', 'is') THEN left(w, length(w) - 1) ELSE w END)"
    )

    def single(v: str) -> str:
        return f"CASE WHEN right({v}, 1) = substr({v}, length({v}) - 1, 1) AND right({v}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 's', 'l', 'z') THEN left({v}, length({v}) - 1) ELSE {v} END"

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def ends(s: str, n: int) -> str:
        return f"ends_with(w, '{s}') AND length(w) >= {n + len(s)} AND regexp_matches({cut(len(s))}, '[aeiouy]')"

    endings = (
        f"list_transform({{0}}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN w WHEN {ends('ation', 3)} THEN {cut(5)} || 'at' "
        f"WHEN {ends('ing', 3)} THEN {single(cut(3))} WHEN {ends('ed', 4)} THEN {single(cut(2))} ELSE w END)"
    )
    last = "list_transform({0}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 'e') AND NOT regexp_matches(w, '[0-9]') THEN left(w, length(w) - 1) ELSE w END)"
    for rule in (base, singular, endings, last):
        words = rule.format(words)
    compounds = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+(?:[-./][\\p{{L}}\\p{{N}}]+)+'), lambda c: regexp_replace(c, '[-./]', '', 'g'))"
    return f"list_concat({words}, {compounds})"


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"

TOK = f"tok AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS t FROM documents), ask AS MATERIALIZED (SELECT item_id, list_distinct({tokens('text')}) AS t, {tokens('text')} AS every FROM benchmark)"

BM25 = f"""{TOK},
wanted AS (SELECT item_id, unnest(t) AS term FROM ask),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT w.item_id, w.term, ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM wanted w LEFT JOIN df USING (term), st),
total AS (SELECT item_id, sum(idf) AS total FROM idf GROUP BY item_id),
bm AS (
  SELECT item_id, doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS bm25, sum(idf) / any_value(total) AS coverage
  FROM idf JOIN post USING (term) JOIN total USING (item_id), st GROUP BY item_id, doc_id)"""


def features(key: str, source: str, column: str) -> str:
    pairs = f"list_transform(list_zip({column}[1:-2], {column}[2:]), lambda p: p[1] || '_' || p[2])"
    return f"""SELECT {key}, bucket, sum(weight) AS w FROM (
      SELECT {key}, {FNV.format('term')} % 512 AS bucket, 1.0::DOUBLE AS weight FROM (SELECT {key}, unnest({column}) AS term FROM {source})
      UNION ALL SELECT {key}, {FNV.format('term')} % 512, 0.5::DOUBLE FROM (SELECT {key}, unnest({pairs}) AS term FROM {source})) GROUP BY ALL"""


HYBRID = f"""{BM25},
fd AS ({features('doc_id', 'tok', 't')}), fq AS ({features('item_id', 'ask', 'every')}),
nd AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM fd GROUP BY 1), nq AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM fq GROUP BY 1),
vec AS (SELECT item_id, doc_id, least(1.0, sum(fq.w / nq.n * (fd.w / nd.n))) AS vector_score FROM fq JOIN nq USING (item_id) JOIN fd ON fd.bucket = fq.bucket JOIN nd USING (doc_id) GROUP BY ALL),
pairs AS (SELECT item_id, doc_id, round(coalesce(vector_score, 0), 6) AS vector_score, round(coalesce(bm25, 0), 6) AS bm25, round(coalesce(coverage, 0), 6) AS coverage FROM (SELECT item_id, doc_id FROM ask, tok) LEFT JOIN vec USING (item_id, doc_id) LEFT JOIN bm USING (item_id, doc_id)),
lists AS (
  SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY vector_score DESC, doc_id) AS rank FROM pairs
  UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) FROM pairs WHERE bm25 > 0),
fused AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) / (2 / 61.0::DOUBLE) AS score FROM lists WHERE rank <= 50 GROUP BY ALL),
top AS (
  SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vector_score DESC, doc_id) AS INT) AS rank, round(score, 6) AS score, vector_score, coverage
  FROM (SELECT item_id, doc_id, round(score, 9) AS score FROM fused) JOIN pairs USING (item_id, doc_id))"""

CURLY, STRAIGHT = "‘’‚‛“”„‟‐‑‒–—―−\u00a0\ufeff", "''''" + '"' * 4 + "-" * 7 + "  "
PLAIN = "trim(regexp_replace(translate(lower({0}), '" + CURLY + "', '" + STRAIGHT.replace("'", "''") + "'), '\\s+', ' ', 'g'))"
CELL = """CASE WHEN regexp_matches(x, '["\\r\\n,]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END"""


def cell(c: str) -> str:
    raw = f"coalesce(CAST({c} AS VARCHAR), '')"
    safe = f"CASE WHEN regexp_matches({raw}, '^[=+\\-@\\t\\r]') THEN '''' || {raw} ELSE {raw} END"
    return "(" + CELL.replace("x,", f"{safe},").replace("(x", f"({safe}").replace("ELSE x", f"ELSE {safe}") + ")"


COSINE = "greatest(-1.0, least(1.0, coalesce(list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0), 0)))"
DENSE = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
STATUS = "CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'APPROVED' WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 'DRAFT' ELSE 'PENDING' END"
ENTITY = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def html(fragment: str) -> str:
    stripped = f"regexp_replace(regexp_replace({fragment}, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g')"
    return f"trim(regexp_replace({ENTITY.format(stripped)}, '\\s+', ' ', 'g'))"


def element(tag: str, prefix: str = "") -> str:
    return f"""SELECT page_id, CAST(ord - 1 AS INT) AS ord, '{prefix}' || text AS text FROM (
      SELECT page_id, unnest(range(1, len(m) + 1)) AS ord, {html('unnest(m)')} AS text FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1) AS m FROM pages)) WHERE text <> ''"""


NOW = 1_767_225_600  # 2026-01-01 UTC

ORACLES: dict[str, str] = {
    "bm25_topk": f"WITH {BM25} SELECT item_id, doc_id, CAST(rank AS INT) AS rank, bm25 FROM (SELECT item_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 8",
    "bm25_coverage": f"WITH {BM25} SELECT item_id, doc_id, CAST(rank AS INT) AS rank, coverage FROM (SELECT item_id, doc_id, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY item_id ORDER BY round(coverage, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 8",
    "hybrid_rank": f"WITH {HYBRID} SELECT * FROM top WHERE rank <= 8",
    "references_penalty": f"""WITH {HYBRID},
      p AS (SELECT f.item_id, f.doc_id, f.score * CASE WHEN f.doc_id % 10 = 0 AND NOT (f.item_id % 4 = 0 OR regexp_matches(lower(b.text), '{ASKS_ABOUT_REFERENCES}')) THEN 0.5::DOUBLE ELSE 1 END AS score FROM fused f JOIN benchmark b USING (item_id)),
      r AS (SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, vector_score DESC, doc_id) AS INT) AS rank FROM p JOIN pairs USING (item_id, doc_id)) SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 8""",
    "relevance_gate": f"WITH {HYBRID} SELECT * FROM top WHERE rank <= 8 AND (vector_score >= 0.05 OR coverage >= 0.5)",
    "rrf_fusion": f"WITH {HYBRID} SELECT item_id, doc_id, round(score, 6) AS score FROM fused",
    "tokenize_terms": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_unique, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "stem_vocab": f"SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM documents) GROUP BY t",
    "token_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_approx FROM documents",
    "doc_frequency": f"WITH tok AS (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM tok GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d, (SELECT count(*) AS n FROM documents)",
    "tf_idf_centroid": f"WITH tok AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents), d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY term) SELECT term, round(tf * ln(1 + n / CAST(df AS DOUBLE)), 6) AS weight FROM d, (SELECT count(*) AS n FROM documents)",
    "hash_bucket_embedding": f"WITH {TOK}, f AS ({features('doc_id', 'tok', 't')}), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM f GROUP BY 1) SELECT CAST(bucket AS INT) AS bucket, count(*) AS docs, round(sum(w / n), 6) AS weight FROM f JOIN n USING (doc_id) GROUP BY bucket",
    "cosine_topk": f"WITH {DENSE} SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE.format('a.e', 'b.e')}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10",
    "cosine_scoped_topk": f"WITH {DENSE} SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE.format('a.e', 'b.e')}, 6) AS score FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10",
    "nearest_per_label": f"WITH {DENSE}, p AS (SELECT vec_id, label, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x, e FROM v), c AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM p GROUP BY ALL) GROUP BY label) SELECT label, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT v.label, vec_id, round({COSINE.format('e', 'c')}, 6) AS score FROM v JOIN c USING (label))) WHERE rank <= 3",
    "text_blocks": """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
      e AS (SELECT doc_id, len(p) AS n, unnest(range(0, len(p))) AS ord, unnest(p) AS p FROM p),
      h AS (SELECT *, length(p) <= 80 AND ord < n - 1 AND NOT regexp_matches(p, '[.!?,;:]$') AND regexp_matches(p, '^[\\p{Lu}0-9]') AND len(string_split_regex(p, '\\s+')) <= 10 AND NOT contains(p, chr(10)) AS head FROM e)
      SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, p AS text, CASE WHEN head THEN CASE WHEN p = upper(p) THEN 1 ELSE 2 END END AS level FROM h""",
    "html_headings": element("h1"),
    "html_paragraphs": element("p"),
    "html_list_items": element("li", "- "),
    "html_text": f"SELECT page_id, md5({html('html')}) AS text_md5, length({html('html')}) AS n_chars FROM pages",
    "labelled_rows": "SELECT c_custkey, 'Customer: ' || c_name || '; Segment: ' || c_mktsegment || '; Nation: ' || c_nationkey AS line FROM customer",
    "quote_verify": f"WITH q AS (SELECT item_id, {PLAIN.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {PLAIN.format('text')} AS d FROM documents) SELECT item_id, doc_id FROM q JOIN d ON contains(d, q) WHERE length(q) >= 3",
    "quote_first_match": f"WITH q AS (SELECT item_id, {PLAIN.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {PLAIN.format('text')} AS d FROM documents) SELECT item_id, min(doc_id) AS doc_id, count(*) AS matches FROM q JOIN d ON contains(d, q) WHERE length(q) >= 3 GROUP BY item_id",
    "eval_hit_at_k": f"""WITH {BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm),
      hit AS (SELECT r.item_id, min(rank) AS rank FROM r JOIN (SELECT item_id, {PLAIN.format('text')} AS q FROM benchmark) b USING (item_id) JOIN (SELECT doc_id, {PLAIN.format('text')} AS d FROM documents) USING (doc_id) WHERE rank <= 8 AND contains(d, q) GROUP BY 1)
      SELECT count(*) AS questions, count(*) FILTER (rank = 1) AS hit1, count(*) FILTER (rank <= 3) AS hit3, count(rank) AS hitk FROM benchmark LEFT JOIN hit USING (item_id)""",
    "exact_dup_docs": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "question_plan": f"""WITH q AS (SELECT conv_id, turn, text, {tokens('text')} AS t FROM conversations WHERE role = 'user'), o AS (SELECT list_distinct({tokens("'" + ' '.join(OVERVIEW_WORDS) + "'")}) AS o)
      SELECT conv_id, turn, CAST(len(list_distinct(list_filter(t, lambda x: NOT list_contains(o, x)))) AS INT) AS n_topic, len(list_filter(t, lambda x: NOT list_contains(o, x))) = 0 AS overview, regexp_matches(lower(text), '{OVERVIEW_PATTERN.replace("'", "''")}') OR list_has_any(t, o) AS asks FROM q, o""",
    "review_stats": f"SELECT count(*) AS total, count(*) FILTER (s = 'PENDING') AS pending, count(*) FILTER (s = 'DRAFT') AS drafted, count(*) FILTER (s = 'APPROVED') AS approved, count(*) FILTER (s = 'REJECTED') AS rejected FROM (SELECT {STATUS} AS s FROM documents LEFT JOIN labels USING (doc_id))",
    "review_buckets": f"SELECT source, {STATUS} AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "pending_first_n": "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS turn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25",
    "document_list_counts": "SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "nested_set_export": "SELECT conv_id, count(*) FILTER (role = 'user') AS questions, string_agg(role || ': ' || text, ' | ' ORDER BY turn, role, text) AS thread FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "multi_hop_join": "SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "scope_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "scope_in": "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)",
    "dedup_first_occurrence": "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, role) AS n FROM conversations) WHERE n = 1",
    "neighbour_context": "SELECT conv_id, turn, role, coalesce(length(lag(text) OVER w), 0) AS before_chars, coalesce(length(lead(text) OVER w), 0) AS after_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "csv_export_lines": f"SELECT c_custkey, {cell('c_custkey')} || ',' || {cell('c_name')} || ',' || {cell('c_mktsegment')} || ',' || {cell('CAST(floor(c_acctbal) AS BIGINT)')} AS line FROM customer",
    "format_relative": f"""WITH s AS (SELECT event_id, {NOW} - CAST(epoch(ts) AS BIGINT) AS s, ts FROM events), m AS (SELECT *, CAST(round(s / 60.0) AS BIGINT) AS m FROM s), h AS (SELECT *, CAST(round(m / 60.0) AS BIGINT) AS h FROM m), d AS (SELECT *, CAST(round(h / 24.0) AS BIGINT) AS d FROM h)
      SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN h < 24 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(ts, '%-d %b %Y') END AS said FROM d""",
    "activity_windows": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
