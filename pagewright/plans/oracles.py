"""DuckDB SQL for the queries of the registry, written apart from the operators it checks."""

from __future__ import annotations

from pagewright.functions import numbering as num
from pagewright.operators.headings import MAX_LEVEL
from pagewright.sources import rendered

ELEMENTS = f"WITH RECURSIVE elements AS ({rendered.SQL})"
SQUASH = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


def squash(c: str) -> str:
    return SQUASH.format(c)


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ANY_MARKER = "|".join(f"(?:{p})" for _, p, _ in num.MARKERS)
CLAUSE_MARKER = "|".join(f"(?:{p})" for name, p, _ in num.MARKERS if name in num.CLAUSE)
PLAIN = f"lower(trim(regexp_replace(regexp_replace(trim(content), {_re(ANY_MARKER)}, ''), '\\s+', ' ', 'g')))"
RANK = (
    "CASE WHEN " + " OR ".join(f"starts_with(regexp_replace(trim(content), '[·.ㆍ・∙•\\s]', '', 'g'), '{w}')" for w in num.ANNEX) + " THEN 1"
    + f" WHEN regexp_matches(trim(content), {_re(num.DECIMAL)}) THEN 31 "
    + " ".join(f"WHEN regexp_matches(trim(content), {_re(p)}) THEN {r}" for _, p, r in num.MARKERS)
    + " WHEN kind = 'heading_1' THEN 90 WHEN kind = 'heading_2' THEN 92 ELSE 94 END"
)
TITLE = "coalesce(nullif(regexp_extract(trim(content), '^제\\s*\\d+\\s*(조(의\\s*\\d+)?\\s*(\\([^)]*\\))?|[편장절관부](\\s*\\([^)]*\\))?)'), ''), trim(content))"

FURNITURE = f"""
flat AS (SELECT * FROM elements WHERE type <> 'toc_entry'),
titled AS (SELECT *, CASE WHEN starts_with(type, 'heading') THEN {PLAIN} END AS plain FROM flat),
running AS (SELECT t.doc_id, plain FROM titled t JOIN (SELECT doc_id, count(DISTINCT page_no) AS n FROM flat GROUP BY 1) p ON t.doc_id = p.doc_id
  WHERE plain <> '' AND length(plain) <= 40 AND n >= 5 GROUP BY t.doc_id, plain, n HAVING count(DISTINCT page_no) >= greatest(3, floor(n * 0.6))),
unfurnished AS (SELECT * FROM (SELECT t.*, r.plain IS NOT NULL AS runs, row_number() OVER (PARTITION BY t.doc_id, t.plain ORDER BY page_no, pos) AS nth
  FROM titled t LEFT JOIN running r ON t.doc_id = r.doc_id AND t.plain = r.plain) WHERE NOT runs OR nth = 1)"""


def continued(source: str) -> str:
    return f"""
turned AS (SELECT *, coalesce(lag(page_no) OVER (PARTITION BY doc_id ORDER BY page_no, pos) <> page_no, FALSE) AS turn FROM {source}),
heads AS (SELECT doc_id, page_no, pos, turn, CAST(substr(type, 9, 1) AS INT) AS lvl, {PLAIN} AS plain2,
  regexp_matches(content, '(?i)\\(\\s*(계\\s*속|이어서|이어짐|cont(inued|[''’]?d)?)\\s*\\)') AS marked,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS k FROM turned WHERE regexp_matches(type, '^heading_[1-6]$')),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(l INT, t VARCHAR)[]) AS open, FALSE AS gone, -1 AS page_no, -1 AS pos FROM (SELECT DISTINCT doc_id FROM heads)
  UNION ALL
  SELECT h.doc_id, h.k,
    CASE WHEN h.marked OR (h.turn AND h.plain2 <> '' AND len(list_filter(w.open, lambda o: o.t = h.plain2)) > 0) THEN w.open
         ELSE list_append(list_filter(w.open, lambda o: o.l < h.lvl), {{'l': h.lvl, 't': h.plain2}}) END,
    h.marked OR (h.turn AND h.plain2 <> '' AND len(list_filter(w.open, lambda o: o.t = h.plain2)) > 0), h.page_no, h.pos
  FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.k = w.k + 1),
merged AS (SELECT t.* FROM turned t WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.gone AND w.doc_id = t.doc_id AND w.page_no = t.page_no AND w.pos = t.pos))"""


_UNIT = "'^제\\s*\\d+\\s*(조|[편장절관부])'"
_AFTER = f"ltrim(regexp_replace(content, {_UNIT}, ''))"
NORMALISED = f"""
kinds AS (SELECT doc_id, page_no, pos, content, caption, type, CASE WHEN type = 'text' AND regexp_matches(content, {_UNIT}) AND (starts_with({_AFTER}, '(') OR (NOT starts_with({_AFTER}, '제') AND NOT regexp_matches(substr({_AFTER}, 1, 20), '참조|준용') AND length(trim(content)) <= 25)) THEN 'heading_1' ELSE type END AS kind,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS ord FROM merged),
ranked AS (SELECT *, {RANK} AS r0, starts_with(kind, 'heading') AND NOT (regexp_matches(content, {_re(CLAUSE_MARKER)}) AND (regexp_matches(content, '^[①-⑳]') OR length(trim(content)) > 40)) AS may,
  coalesce(lag(kind) OVER d IN ('text', 'paragraph') OR starts_with(lag(kind) OVER d, 'heading'), FALSE) AND regexp_matches(coalesce(lag(content) OVER d, ''), '(및|또는|하고|[와과의에를을로])\\s*$') AS open_before
  FROM kinds WINDOW d AS (PARTITION BY doc_id ORDER BY ord)),
firsts AS (SELECT doc_id, min(ord) AS first_ord FROM ranked WHERE may GROUP BY 1),
judged AS (SELECT r.*, coalesce(may AND NOT (ord > first_ord AND open_before AND r0 >= 90), FALSE) AS head,
  CASE WHEN ord = first_ord AND NOT regexp_matches(content, {_re(ANY_MARKER)}) AND r0 >= 10 THEN 1 ELSE r0 END AS r FROM ranked r LEFT JOIN firsts f ON r.doc_id = f.doc_id),
sectioned AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS section FROM judged),
h AS (SELECT doc_id, section, r, {TITLE} AS title FROM sectioned WHERE head),
levels AS (SELECT i.doc_id, i.section, i.title, CAST(least({MAX_LEVEL}, 1 + count(j.section)) AS INT) AS level FROM h i LEFT JOIN h j
  ON j.doc_id = i.doc_id AND j.section < i.section AND NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = i.doc_id AND k.section > j.section AND k.section <= i.section AND k.r <= j.r)
  GROUP BY 1, 2, 3),
paths AS (SELECT i.doc_id, i.section, i.level, coalesce(string_agg(j.title, ' > ' ORDER BY j.section) || ' > ', '') || i.title AS path FROM levels i LEFT JOIN levels j
  ON j.doc_id = i.doc_id AND j.section < i.section AND NOT EXISTS (SELECT 1 FROM levels k WHERE k.doc_id = i.doc_id AND k.section > j.section AND k.section <= i.section AND k.level <= j.level)
  GROUP BY i.doc_id, i.section, i.level, i.title),
final AS (SELECT s.*, p.level, p.path FROM sectioned s LEFT JOIN paths p ON s.doc_id = p.doc_id AND s.section = p.section)"""

FLOW = ELEMENTS + "," + FURNITURE + "," + continued("unfurnished") + "," + NORMALISED
SECTIONS = "SELECT doc_id, section, max(level) AS level, coalesce(max(path), '') AS path, count(*) AS n_elements, sum(length(coalesce(content, '')) + length(coalesce(caption, '')))::BIGINT AS n_chars, min(page_no) AS page_lo, max(page_no) AS page_hi FROM final GROUP BY 1, 2"

CHUNK_TOC = f"{FLOW} SELECT doc_id, printf('toc_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY section)) AS chunk_id, path AS heading_path, n_elements, n_chars, page_lo, page_hi FROM ({SECTIONS})"
CHUNK_TREE = f"{FLOW} SELECT doc_id, printf('tree_%04d', section) AS chunk_id, coalesce(level, 0) AS depth, path AS heading_path, n_elements, n_chars, page_lo, page_hi FROM ({SECTIONS})"
_ANNEX = " OR ".join(f"starts_with(regexp_replace(content, '[·.ㆍ・∙•\\s]', '', 'g'), '{w}')" for w in num.ANNEX)
CHUNK_PAGE = f"""{FLOW},
pg AS (SELECT doc_id, page_no, count(*) AS n_elements, sum(length(coalesce(content, '')) + length(coalesce(caption, '')))::BIGINT AS n_chars,
  arg_max(path, section) FILTER (WHERE head) AS own, bool_or(NOT head AND kind IN ('text') AND (regexp_matches(content, '^제\\s*\\d+\\s*[편부장]') OR {_ANNEX})) AS opens FROM final GROUP BY 1, 2),
held AS (SELECT *, last_value(coalesce(own, CASE WHEN opens THEN '' END) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS path FROM pg)
SELECT doc_id, printf('page_%04d', page_no) AS chunk_id, coalesce(path, '') AS heading_path, own IS NULL AND coalesce(path, '') <> '' AS inherited, n_elements, n_chars, page_no AS page_lo, page_no AS page_hi FROM held"""
HEADING_LEVELS = f"{FLOW} SELECT doc_id, page_no, pos, level, {TITLE} AS title FROM final WHERE head"
HEADING_FURNITURE = f"{ELEMENTS},{FURNITURE} SELECT doc_id, page_no, pos, type, content FROM unfurnished"
HEADING_CONTINUED = f"{ELEMENTS},{continued('elements')} SELECT doc_id, page_no, pos, type, content FROM merged"

SPLIT_TEXT = r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?。\n])\s+', '\1' || chr(1), 'g'), chr(1)) AS sents FROM documents),
packed AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE
  list_reduce(list_prepend('', sents), lambda acc, s:
    CASE WHEN length(s) > 1000 THEN acc || chr(2) || array_to_string(list_transform(range((length(s) - 1) // 1000 + 1), lambda i: substr(s, i * 1000 + 1, 1000)), chr(2)) || chr(2)
         WHEN string_split(acc, chr(2))[-1] = '' THEN acc || s
         WHEN length(string_split(acc, chr(2))[-1]) + length(s) + 1 > 1000 THEN acc || chr(2) || s
         ELSE array_to_string(list_append(string_split(acc, chr(2))[:-2], regexp_replace(string_split(acc, chr(2))[-1] || ' ' || s, '^\s+|\s+$', '', 'g')), chr(2)) END) END AS p FROM s),
parts AS (SELECT doc_id, CASE WHEN p = '' THEN [''] ELSE list_filter(string_split(p, chr(2)), lambda x: x <> '') END AS l FROM packed)
SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS part, unnest(l) AS piece FROM parts"""

HTML_TEXT = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
  '(?i)</(h[1-6]|table|li|tr|div|p)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
  '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages"""

_CARD = r"'(^|[^0-9])([0-9]{4})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?([0-9]{4})($|[^0-9])', '\1\2-****-****-\3\4', 'g'"
_BIZ = r"'(^|[^0-9])([0-9]{3})[-\s]?[0-9]{2}[-\s]?[0-9]{5}($|[^0-9])', '\1\2-**-*****\3', 'g'"
_PHONE = r"'(^|[^0-9])(01[016789])[-\s]?[0-9]{3,4}[-\s]?([0-9]{4})($|[^0-9])', '\1\2-****-\3\4', 'g'"
_MAIL = r"'\b([A-Za-z0-9_.%+-])[A-Za-z0-9_.%+-]*@([A-Za-z0-9.-]+[.][A-Za-z]{2,})\b', '\1***@\2', 'g'"
PII_MASK = f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {_CARD}), {_CARD}), {_BIZ}), {_BIZ}), {_PHONE}), {_PHONE}), {_MAIL}) AS masked FROM documents"

COMPACT = r"SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS compact FROM documents"
TEXT_STATS = r"""SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) AS hangul, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
  CAST(length(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS INT) AS meaning,
  len(regexp_extract_all(text, '[^가-힣a-zA-Z0-9\s]')) * 2 >= length(text) AS blanked FROM documents"""
_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
LINE_DEDUP = f"WITH {_LINES} SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {squash('content')} ORDER BY pos) AS r FROM lines) WHERE r = 1 OR {squash('content')} = ''"
LINE_CONTAINED = f"""WITH {_LINES}, t AS (SELECT *, {squash('content')} AS t FROM lines)
SELECT doc_id, pos, content FROM t a WHERE length(a.t) < 12 OR NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.pos <> a.pos AND length(b.t) >= 12 AND contains(b.t, a.t) AND (length(b.t) > length(a.t) OR b.pos < a.pos))"""
EXACT_DUPLICATES = r"SELECT md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"

PAGE_ARTIFACTS = f"{ELEMENTS} SELECT doc_id, page_no, pos, type, content FROM elements WHERE NOT (type = 'text' AND regexp_matches({squash('content')}, '^[–—-]\\s*\\d{{1,4}}\\s*[–—-]?$'))"
CAPTIONS = f"""{ELEMENTS}, said AS (SELECT *, lag(type) OVER w AS k, lag({squash('content')}) OVER w AS t FROM elements WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos))
SELECT doc_id, page_no, pos, CASE WHEN length(t) <= 90 AND (starts_with(k, 'heading') OR (k = 'text' AND regexp_matches(t, '표|등급|현황|내역|태도|산정|평가|위험|요약'))) THEN t ELSE '' END AS caption FROM said WHERE type = 'table'"""
UNIT_CAPTIONS = f"""{ELEMENTS}, n AS (SELECT *, lead({squash('content')}) OVER w AS after, lead(type) OVER w AS after_type, lag(type) OVER w AS before FROM elements WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos))
SELECT doc_id, page_no, pos, type, content, CASE WHEN type = 'table' AND after = '(단위: 천원)' THEN after ELSE caption END AS caption FROM n
WHERE NOT coalesce(type = 'text' AND {squash('content')} = '(단위: 천원)' AND before = 'table', FALSE)"""
TOC_ENTRIES = f"""{ELEMENTS}, t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM elements WHERE type = 'toc_entry'),
f AS (SELECT *, page_no - k = min(page_no - k) OVER (PARTITION BY doc_id) AS first_run FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS INT) AS seq, split_part(content, '::', 1) AS title, split_part(content, '::', 2) AS page FROM f WHERE first_run"""
TRAILING = f"{ELEMENTS} SELECT doc_id, page_no, pos, type, content FROM elements"
TEXT_RUNS = f"""{ELEMENTS}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, page_no, type = 'text' ORDER BY pos) AS island FROM elements)
SELECT doc_id, page_no, coalesce(max(n) FILTER (WHERE is_text), 0) AS longest FROM (SELECT doc_id, page_no, type = 'text' AS is_text, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1, 2"""

MARKED = f"""{ELEMENTS}, m AS (SELECT *, CASE type WHEN 'table' THEN 'native' WHEN 'toc_entry' THEN 'toc' ELSE 'model' END AS source,
  CASE WHEN length(content) % 7 = 0 THEN 0.6 WHEN length(content) % 5 = 0 THEN 0.72 ELSE 0.88 END AS confidence, CASE WHEN type = 'text' AND length(content) % 3 = 0 THEN 'short' END AS issue FROM elements)"""
PROVENANCE = f"""{MARKED} SELECT doc_id, 'source' AS fact, source AS name, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT doc_id, 'issue', issue, count(*) FROM m WHERE issue IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, 'low_confidence', '', count(*) FILTER (WHERE confidence < 0.75) FROM m GROUP BY ALL"""
ELEMENT_SUMMARY = f"""{MARKED} SELECT doc_id, page_no, count(*) AS n_elements, count(*) FILTER (WHERE starts_with(type, 'heading')) AS n_headings, count(*) FILTER (WHERE type = 'table') AS n_tables,
  count(*) FILTER (WHERE type = 'text') AS n_texts, round_even(avg(CAST(confidence AS DOUBLE)), 3) AS mean_confidence, round_even(CAST(min(confidence) AS DOUBLE), 3) AS least_confidence, count(*) FILTER (WHERE confidence < 0.7) AS n_low FROM m GROUP BY 1, 2"""
ROLLUP = f"""{MARKED}, p AS (SELECT doc_id, page_no, count(*) AS n, bool_or(confidence < 0.75) AS low FROM m GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_pages, sum(n)::BIGINT AS n_elements, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (WHERE low), '') AS low_pages FROM p GROUP BY 1"""
RULES = [("0", 1, "required_text", "REGION_0"), ("0", 1, "forbidden_text", "REGION_3"), ("regex:^[12]$", 2, "min_elements", "9"), ("regex:.*", 3, "required_type", "table=1"), ("regex:.*", 5, "required_text", "Supplier line"), ("9", 1, "required_text", "x"), ("4", 9, "min_elements", "1")]
_RULES = ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in RULES)
GOLDEN_RULES = f"""{ELEMENTS}, rules(doc_pattern, page_no, kind, value) AS (VALUES {_RULES}),
wanted AS (SELECT d.doc_id, r.* FROM rules r JOIN (SELECT DISTINCT doc_id FROM elements) d ON CASE WHEN starts_with(doc_pattern, 'regex:') THEN regexp_matches(CAST(d.doc_id AS VARCHAR), substr(doc_pattern, 7)) ELSE doc_pattern = CAST(d.doc_id AS VARCHAR) END)
SELECT w.doc_id, w.page_no, w.kind, w.value, coalesce(CASE w.kind WHEN 'required_text' THEN bool_or(contains({squash('e.content')}, w.value)) WHEN 'forbidden_text' THEN NOT coalesce(bool_or(contains({squash('e.content')}, w.value)), FALSE)
  WHEN 'min_elements' THEN count(e.pos) >= TRY_CAST(w.value AS INT) ELSE count(*) FILTER (WHERE e.type = split_part(w.value, '=', 1)) >= TRY_CAST(split_part(w.value, '=', 2) AS INT) END, FALSE) AS ok
FROM wanted w LEFT JOIN elements e ON e.doc_id = w.doc_id AND e.page_no = w.page_no GROUP BY w.doc_id, w.page_no, w.kind, w.value"""
AUDIT = f"""{MARKED}, found AS (SELECT doc_id, page_no, 'warning' AS severity, 'residual_artifact' AS issue FROM m WHERE type = 'text' AND regexp_matches({squash('content')}, '^[–—-]\\s*\\d{{1,4}}\\s*[–—-]?$')
UNION ALL SELECT doc_id, page_no, 'warning', 'low_confidence' FROM m WHERE confidence < 0.75 UNION ALL SELECT doc_id, page_no, 'hard', 'empty_element' FROM m WHERE trim(content || caption) = '')
SELECT *, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT doc_id, page_no, 'warning', 'duplicate_text', sum(x)::BIGINT FROM (SELECT doc_id, page_no, count(*) - 1 AS x FROM m WHERE length({squash("content || ' ' || caption")}) >= 40
  GROUP BY doc_id, page_no, lower({squash("content || ' ' || caption")})) WHERE x > 0 GROUP BY 1, 2"""
_N = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')"
SUPPORT = f"""WITH a AS (SELECT item_id AS needle_id, {_N} AS a FROM benchmark), b AS (SELECT doc_id AS source_id, {_N} AS b FROM documents)
SELECT needle_id, source_id, CAST((length(b) - length(replace(b, a, ''))) // length(a) AS BIGINT) AS n FROM a JOIN b ON contains(b, a) WHERE a <> ''"""
VERDICTS = """SELECT source AS "group", count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS passed, count(*) FILTER (WHERE NOT (quality = 1 AND toxic = 0)) AS failed,
  round_even(avg(CAST(quality AS DOUBLE)), 3) AS mean_score FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
CONSERVED = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word, 1 AS side FROM documents UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '(^|\n)[^\n]*$', '')), '[\p{L}\p{N}]+')), 2 FROM documents),
c AS (SELECT doc_id, word, count(*) FILTER (WHERE side = 1) - count(*) FILTER (WHERE side = 2) AS d FROM w GROUP BY 1, 2)
SELECT doc_id, sum(greatest(d, 0))::BIGINT AS lost, sum(greatest(-d, 0))::BIGINT AS added FROM c GROUP BY 1"""
MARKDOWN = f"""{ELEMENTS} SELECT doc_id, page_no, string_agg(CASE WHEN starts_with(type, 'heading') THEN repeat('#', CAST(substr(type, 9, 1) AS INT)) || ' ' || content
  WHEN type = 'toc_entry' THEN '- ' || split_part(content, '::', 1) || ' (' || split_part(content, '::', 2) || ')' WHEN type = 'figure' THEN '![]()' ELSE content END, chr(10) || chr(10) ORDER BY pos) AS markdown FROM elements GROUP BY 1, 2"""
XML = f"""{ELEMENTS} SELECT doc_id, page_no, '<document><page_number>' || page_no || '</page_number><elements>' || string_agg('<element type="' || type || '">' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</element>', '' ORDER BY pos)
  || '</elements></document>' AS xml FROM elements GROUP BY 1, 2"""
TABLE_FACTS = f"""{ELEMENTS}, t AS (SELECT doc_id, page_no, pos, list_transform(string_split(content, '<tr>')[2:], lambda r: len(regexp_extract_all(r, '<td>'))) AS w FROM elements WHERE type = 'table')
SELECT doc_id, page_no, pos, CAST(len(w) AS INT) AS n_rows, CAST(list_max(w) AS INT) AS n_cols, CASE WHEN list_min(w) < list_max(w) THEN 0.65 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN list_min(w) < list_max(w) THEN 'ragged_rows' ELSE '' END AS issues FROM t"""
CARRIED = """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations"""
PAGE_RANGES = """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS idx, o_orderpriority AS name, 1 + CAST(count(*) AS BIGINT) // 3 AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS page_end FROM o) SELECT doc_id, name, page_end - n + 1 AS page_start, page_end FROM e"""
MISSING = """SELECT doc_id, CAST(0 AS INT) AS page_no, 'image_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 0, 'structured_only' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
NATIVE_MATCH = f"""{ELEMENTS}, c AS (SELECT DISTINCT doc_id, page_no, pos, unnest(regexp_extract_all(content, '<td>([^<]*)</td>', 1)) AS k FROM elements WHERE type = 'table'),
n AS (SELECT doc_id, page_no, count(*) AS n FROM c GROUP BY 1, 2),
m AS (SELECT a.doc_id, a.page_no, a.pos, b.page_no AS idx, count(*) AS met FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY ALL),
s AS (SELECT m.*, met / n.n AS score, row_number() OVER (PARTITION BY m.doc_id, m.page_no, m.pos ORDER BY met DESC, idx) AS r FROM m JOIN n ON m.doc_id = n.doc_id AND m.page_no = n.page_no WHERE n.n >= 4)
SELECT doc_id, page_no, pos, idx, round_even(score, 4) AS score FROM s WHERE r = 1 AND score >= 0.6"""
REASSIGNED = f"{ELEMENTS} SELECT doc_id, page_no, count(DISTINCT content) FILTER (WHERE type = 'text') > 1 AS ok FROM elements GROUP BY 1, 2"
_LETTERS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
PROSE_NEAR_TABLES = f"""{ELEMENTS}, c AS (SELECT doc_id, page_no, pos, {_LETTERS.format("regexp_replace(content, '<[^>]*>', ' ', 'g')")} AS seen, list_transform(regexp_extract_all(content, '<td>([^<]*)</td>', 1), lambda x: {_LETTERS.format('x')}) AS cells FROM elements WHERE type = 'table')
SELECT doc_id, page_no, pos, type, content FROM elements e WHERE NOT EXISTS (SELECT 1 FROM c WHERE e.type = 'text' AND c.doc_id = e.doc_id AND c.page_no = e.page_no AND abs(c.pos - e.pos) <= 3
  AND length({_LETTERS.format('e.content')}) >= 4 AND (list_contains(c.cells, {_LETTERS.format('e.content')}) OR (length({_LETTERS.format('e.content')}) >= 12 AND contains(c.seen, {_LETTERS.format('e.content')}))))"""

NATIVE_CLEAN = r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(text), '[\x{e000}-\x{f8ff}]', '', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents"""
_MEANING = "length(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '\"(content|caption|description|elements|page_number|type)\"\\s*:', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
EXCESSIVE = f"SELECT doc_id, {_MEANING.format('substr(text, 1, 400)')} >= 256 AND {_MEANING.format('text')} > greatest(8000, 8 * {_MEANING.format('substr(text, 1, 400)')}) AS excessive FROM documents"
ALT_STRIPPED = r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))),
  lambda x: x <> '' AND NOT starts_with(x, '그림입니다') AND NOT starts_with(x, '원본 그림의') AND x <> '원본'), ' ') AS body FROM documents"""
#: Words that say nothing about what a picture shows.
STOP_WORDS = "사진 그림 이미지 그래프 도식 차트 캡처 로고 표시 내용 문구 제품 광고 보여준다 보여주는 나타낸다 나타내는 담은 담긴 관련 효과 정보 이다 있다 한다 대한 위한".split()
_WORDS = "list_filter(list_distinct(regexp_extract_all(coalesce({0}, ''), '[가-힣A-Za-z0-9]{{2,}}')), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], x))"
WORD_OVERLAP = f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), w AS (SELECT conv_id, turn, {_WORDS.format('before')} AS a, {_WORDS.format('text')} AS b FROM c)
SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a, b)) >= 3 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 4) AS overlap FROM w"""
ANNEXES = f"""{ELEMENTS}, heads AS (SELECT doc_id, page_no, min(pos) AS first, arg_min(trim(content), pos) AS said FROM elements GROUP BY 1, 2)
SELECT doc_id, page_no, pos, type, content FROM elements UNION ALL
SELECT doc_id, page_no, first - 1, 'heading_1', '별표 ' || page_no || ' schedule' FROM heads WHERE page_no % 4 = 0 AND NOT starts_with(said, left('별표 ' || page_no || ' schedule', 10))"""
HARD_SIGNALS = f"""{MARKED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1 AS nth FROM m)
SELECT doc_id, page_no, 'element_' || nth || '_low_confidence' AS failure FROM n WHERE confidence < 0.75 UNION ALL SELECT doc_id, page_no, 'element_' || nth || '_ragged_rows' FROM n WHERE type = 'table' AND length(content) % 4 = 0
UNION ALL SELECT DISTINCT doc_id, page_no, 'page_low_confidence' FROM n WHERE page_no % 10 = 0"""
REPEATS = f"""{ELEMENTS}, e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) - 1 AS i, type, lower({squash("regexp_replace(content || ' ' || caption, '<[^>]+>', ' ', 'g')")}) AS key FROM elements),
t AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, key ORDER BY i) + 1, greatest(i - 4, 0)) AS lower_end FROM e WHERE type = 'text'),
h AS (SELECT doc_id, i, key FROM e WHERE starts_with(type, 'heading_')),
c AS (SELECT t.doc_id, t.key, t.i, CASE WHEN h.i >= t.lower_end THEN h.key END AS context FROM t ASOF LEFT JOIN h ON t.doc_id = h.doc_id AND t.i > h.i)
SELECT doc_id, key, count(*) AS n, count(DISTINCT context) = count(*) AS distinct FROM c GROUP BY 1, 2 HAVING count(*) > 1"""
STRUCTURE = f"""{ELEMENTS}, t AS (SELECT *, list_transform(string_split(content, '<tr>')[2:], lambda r: len(regexp_extract_all(r, '<td>'))) AS w FROM elements WHERE type = 'table')
SELECT doc_id, page_no, pos, CAST(len(w) AS INT) AS n_rows, 0 AS header_rows, CAST(list_max(w) AS INT) AS n_columns, 1 AS table_tags, 0 AS caption_rows FROM t"""
LISTING = f"""WITH pages_ AS ({ELEMENT_SUMMARY}), low AS ({MARKED} SELECT doc_id, page_no, count(*) FILTER (WHERE confidence < 0.75) AS n_low FROM m GROUP BY 1, 2), f AS ({AUDIT})
SELECT p.doc_id, p.page_no, p.n_elements, p.n_tables, l.n_low, coalesce(string_agg(DISTINCT f.issue, ',' ORDER BY f.issue), '') AS findings
FROM pages_ p JOIN low l ON p.doc_id = l.doc_id AND p.page_no = l.page_no LEFT JOIN f ON f.doc_id = p.doc_id AND f.page_no = p.page_no GROUP BY ALL"""
MANIFEST = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, count(*) AS n, sum(pages)::BIGINT AS pages, round(count(*) * 0.5, 3)::DOUBLE AS seconds
FROM orders JOIN (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"""
ORPHANS = f"{ELEMENTS}, a AS (SELECT *, lead(type) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS after FROM elements) SELECT doc_id, page_no, count(*) FILTER (WHERE starts_with(type, 'heading') AND type = after) AS n FROM a GROUP BY 1, 2"
SAFE_NAMES = r"""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/|?*\\]', '_', 'g'), '^\.+', '') AS name, CAST(page_id AS INT) AS page FROM pages"""
PREPROCESSED = r"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^가-힣a-zA-Z0-9\s]')) AS special, len(regexp_extract_all(text, '[가-힣]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, CASE WHEN special >= length(text) * 0.5 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\x{e000}-\x{f8ff}]', '', 'g'), chr(160), ' '), '\n+', chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS clean,
  round(CASE WHEN h + l > 0 THEN h / (h + l) ELSE 0 END, 6) AS hangul FROM t"""
_TABLES = f"""{ELEMENTS}, t AS (SELECT *, list_transform(string_split(content, '<tr>')[2:], lambda r: len(regexp_extract_all(r, '<td>'))) AS w FROM elements WHERE type = 'table'),
r AS (SELECT *, list_min(w) < list_max(w) AS ragged, replace(content, '<td>total</td></tr>', '<td>total</td>' || repeat('<td></td>', list_max(w) - 1) || '</tr>') AS whole FROM t)"""
REPAIRED = f"{_TABLES} SELECT doc_id, page_no, pos, 0 AS part, CASE WHEN ragged THEN whole ELSE content END AS content, CASE WHEN ragged THEN 'ragged_row:' || (len(w) - 1) || ':' || (1 - list_max(w)) ELSE '' END AS issues FROM r"
GRAFTED = f"{_TABLES} SELECT doc_id, page_no, pos, CASE WHEN ragged THEN whole ELSE content END AS content FROM r"
IMPROVED = f"""{_TABLES}, a AS (SELECT *, lead(type) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS after FROM elements),
p AS (SELECT a.doc_id, a.page_no, count(*) FILTER (WHERE regexp_matches(type, '^heading_[123]$') AND type = after) AS orphans FROM a GROUP BY 1, 2), b AS (SELECT doc_id, page_no, count(*) FILTER (WHERE ragged) AS bad FROM r GROUP BY 1, 2)
SELECT p.doc_id, p.page_no, CAST(coalesce(bad, 0) AS INT) AS old_problems, 0 AS new_problems, 1.0::DOUBLE AS coverage, 1.0::DOUBLE AS char_ratio, 1.0::DOUBLE AS order_similarity, TRUE AS sequence_kept, coalesce(bad, 0) > 0 AND orphans = 0 AS accepted
FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND p.page_no = b.page_no"""
TABLE_PAGES = f"""{ELEMENTS}, c AS (SELECT DISTINCT doc_id, page_no, unnest(regexp_extract_all(content, '<td>([^<]+)</td>', 1)) AS k FROM elements WHERE type = 'table'), n AS (SELECT doc_id, page_no, count(*) AS n FROM c GROUP BY 1, 2),
m AS (SELECT a.doc_id, a.page_no AS table_id, b.page_no, count(*) / any_value(n.n) AS share FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = b.k JOIN n ON n.doc_id = a.doc_id AND n.page_no = a.page_no GROUP BY ALL),
top AS (SELECT *, max(share) OVER (PARTITION BY doc_id, table_id) AS best FROM m)
SELECT doc_id, table_id, min(page_no) AS page_no, round(max(share), 4) AS share FROM top WHERE share = best AND best >= 0.6 GROUP BY 1, 2 HAVING count(*) = 1"""
FALLBACK = f"""{ELEMENTS} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1 AS INT) AS pos, 'text' AS type, trim(content) AS content, '' AS caption, 'text_layer_fallback' AS source, 0.45::DOUBLE AS confidence FROM elements WHERE type <> 'table' AND trim(content) <> ''"""
