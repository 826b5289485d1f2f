"""DuckDB twins of the queries, written apart from them, on the same tables.

Fixed values (stop words, patterns of questions and paper rows) are the engine's own lists; tests hold some of them as literals.
"""

from __future__ import annotations

import re

from lumora.functions.text import STOP_WORDS
from lumora.operators.lexical import ENGLISH_STOP
from lumora.operators.paper import CHALLENGE, CLASSIC, OR_LINE, ROW, TOTALS
from lumora.operators.segment import NOISE_LINE, PAGE_HEADERS, QUESTION, any_of


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _clean(keep: str, by: str, c: str = "text") -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '{keep}', '{by}', 'g'), '\s+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({c}, ''), '\s+'), lambda w: w <> '')"


def _keywords(c: str) -> str:
    bare = rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return f"list_filter({_tokens(bare)}, lambda w: length(w) > 3 AND NOT list_contains({_list(STOP_WORDS)}, w))"


def _noise(c: str) -> str:
    letters, digits = (rf"len(regexp_extract_all(w, '\p{{{k}}}'))" for k in ("L", "Nd"))
    return f"coalesce(len(list_filter({_tokens(c)}, lambda w: (length(w) >= 2 AND {letters} = 0) OR ({digits} > 0 AND {letters} > 0 AND {digits} >= {letters}))) / nullif(len({_tokens(c)}), 0), 0.0)"


def _docs(expr: str, name: str) -> str:
    return f"SELECT doc_id, {expr} AS {name} FROM documents"


_READABLE = "len(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z]{{3,}}'))"
_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"
_COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"

PAIRS = """pairs AS (
  SELECT concat_ws('-', u.conv_id, m.turn) AS pair_id, u.text AS student, m.text AS model
  FROM conversations u JOIN conversations m ON u.conv_id = m.conv_id AND u.turn + 1 = m.turn AND u.role = 'user' AND m.role = 'assistant')"""

EXAM = """li AS (
  SELECT l_orderkey AS exam_id, l_linenumber AS num, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' ELSE '' END AS part, l_quantity AS q, l_discount, l_tax, l_partkey FROM lineitem),
models AS (SELECT DISTINCT exam_id, num || part AS q_key FROM li),
students AS (SELECT exam_id, 1 AS student_id, q_key, min(t) AS text FROM (
  SELECT exam_id, CASE WHEN q > 40 THEN num::VARCHAR WHEN q > 30 THEN num || 'a' WHEN q < 5 THEN NULL ELSE num || part END AS q_key, l_partkey::VARCHAR AS t FROM li)
  WHERE q_key IS NOT NULL GROUP BY ALL),
rubric0 AS (SELECT exam_id, CASE WHEN l_discount < 0.05 THEN num::VARCHAR ELSE num || part END AS q_key, max((1 + round(l_tax * 100))::INT) AS max_marks,
  max(CASE WHEN num = 7 THEN 'challenge' WHEN num > 2 THEN 'optional' ELSE 'mandatory' END) AS q_type, max(((num + 1) // 2)::VARCHAR) AS group_id FROM li GROUP BY 1, 2),
exams AS (SELECT o_orderkey AS exam_id, max(CASE WHEN o_orderpriority < '3' THEN (20 + floor(o_totalprice)::BIGINT % 60)::INT END) AS total_marks FROM orders GROUP BY 1),
bad AS (SELECT exam_id FROM rubric0 LEFT JOIN exams USING (exam_id) GROUP BY exam_id
  HAVING bool_or(regexp_replace(q_key, '[a-z]', '', 'g')::INT > 50) OR (max(total_marks) > 0 AND count(*) <= 2 AND sum(max_marks) >= max(total_marks))),
rubric AS (SELECT * FROM rubric0 WHERE exam_id NOT IN (SELECT exam_id FROM bad)),
defaults AS (SELECT m.exam_id, CASE WHEN coalesce(any_value(e.total_marks), 0) = 0 THEN 5 ELSE greatest(1, round_even(any_value(e.total_marks) / coalesce(any_value(g.n), count(*)), 0)::INT) END AS default_marks
  FROM models m LEFT JOIN exams e USING (exam_id) LEFT JOIN (SELECT exam_id, count(DISTINCT group_id) AS n FROM rubric GROUP BY 1) g USING (exam_id) GROUP BY m.exam_id),
exact AS (SELECT m.exam_id, s.student_id, m.q_key AS m_key, s.q_key AS s_key FROM models m JOIN students s USING (exam_id, q_key)),
based AS (SELECT exam_id, student_id, min(m_key) AS m_key, s_key FROM (
  SELECT s.exam_id, s.student_id, m.q_key AS m_key, s.q_key AS s_key FROM students s JOIN models m ON s.exam_id = m.exam_id AND s.q_key = regexp_replace(m.q_key, '[a-z]', '', 'g') AND m.q_key <> s.q_key
  WHERE NOT EXISTS (FROM exact x WHERE x.exam_id = s.exam_id AND x.s_key = s.q_key) AND NOT EXISTS (FROM exact x WHERE x.exam_id = m.exam_id AND x.m_key = m.q_key)) GROUP BY exam_id, student_id, s_key),
taken AS (FROM exact UNION ALL SELECT exam_id, student_id, m_key, s_key FROM based),
parts AS (SELECT s.exam_id, s.student_id, m.q_key AS m_key, s.q_key AS s_key, s.text FROM students s JOIN models m ON s.exam_id = m.exam_id AND regexp_matches(s.q_key, '^' || m.q_key || '[a-z]') AND regexp_full_match(m.q_key, '\\d+')
  WHERE NOT EXISTS (FROM taken x WHERE x.exam_id = s.exam_id AND x.s_key = s.q_key) AND NOT EXISTS (FROM taken x WHERE x.exam_id = m.exam_id AND x.m_key = m.q_key))"""

SCORES = """scores AS (
  SELECT l_orderkey AS exam_id, 1 AS student_id, l_linenumber || CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' ELSE '' END AS q_key, l_linenumber::VARCHAR AS base_key,
    CASE WHEN l_linenumber < 3 THEN l_linenumber ELSE (l_linenumber + 1) // 2 + 1 END::VARCHAR AS group_id, CASE WHEN l_linenumber = 7 THEN 'challenge' WHEN l_linenumber < 3 THEN 'mandatory' ELSE 'optional' END AS q_type, max(round_even(l_quantity / 5, 1)) AS score, 10 AS max_marks
  FROM lineitem GROUP BY ALL),
bases AS (SELECT exam_id, group_id, base_key, round(sum(score), 6) AS s, min(q_key) AS first FROM scores GROUP BY ALL),
best AS (SELECT exam_id, group_id, base_key AS winner FROM bases QUALIFY row_number() OVER (PARTITION BY exam_id, group_id ORDER BY s DESC, first) = 1),
won AS (SELECT s.*, s.base_key = b.winner AS selected FROM scores s JOIN best b USING (exam_id, group_id)),
exams AS (SELECT o_orderkey AS exam_id, max(CASE WHEN o_orderpriority < '3' THEN (20 + floor(o_totalprice)::BIGINT % 60)::INT END) AS total_marks FROM orders GROUP BY 1),
sums AS (SELECT exam_id, student_id, coalesce(sum(score) FILTER (selected AND q_type <> 'challenge'), 0.0) AS obtained, coalesce(sum(max_marks) FILTER (selected AND q_type <> 'challenge'), 0)::BIGINT AS possible FROM won GROUP BY ALL),
scaled AS (SELECT s.*, e.total_marks, coalesce(e.total_marks, 0) > 0 AND possible > 0 AND possible <> e.total_marks AS sc FROM sums s LEFT JOIN exams e USING (exam_id))"""

BAND = """p AS (
  SELECT a.vec_id // 2 AS pair_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
e AS (SELECT *, CASE WHEN pair_id % 3 = 0 THEN similarity * 1.15 ELSE similarity END AS es, (pair_id % 9) / 8.0 AS coverage, pair_id % 4 AS hits, pair_id % 12 AS n_words FROM p),
b AS (SELECT *, CASE WHEN es >= 0.55 THEN 1.0 WHEN es >= 0.40 THEN 0.70 + 0.30 * ((es - 0.40) / 0.15) WHEN es >= 0.20 THEN 0.25 + 0.45 * ((es - 0.20) / 0.20) ELSE 0.0 END AS base FROM e),
f AS (SELECT *, round(greatest(0.0, least(1.0, greatest(base * 0.85 + coverage * 0.15, CASE WHEN hits >= 2 AND n_words > 5 THEN 0.35 WHEN hits >= 1 AND n_words > 5 THEN 0.15 ELSE 0.0 END, CASE WHEN n_words >= 8 AND es > 0.25 THEN 0.20 ELSE 0.0 END))), 6) AS final FROM b)"""

_TERMS = f"""w AS (SELECT pair_id, list_filter({_WORDS.format('model')}, lambda t: NOT list_contains({_list(ENGLISH_STOP)}, t)) AS w FROM pairs),
grams AS (SELECT pair_id, unnest(w) AS term FROM w UNION ALL SELECT pair_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
top AS (SELECT pair_id, term, count(*) AS n FROM grams GROUP BY pair_id, term QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, term) <= 15),
lists AS (SELECT pair_id, list(term ORDER BY term) AS keywords FROM top GROUP BY ALL)"""


def _tfidf(stop: str) -> str:
    return f"""each AS (SELECT pair_id, unnest({_WORDS.format('student')}) AS term, 1 AS s, 0 AS m FROM pairs UNION ALL SELECT pair_id, unnest({_WORDS.format('model')}), 0, 1 FROM pairs),
tf AS (SELECT pair_id, term, sum(s) AS s, sum(m) AS m FROM each WHERE NOT list_contains({stop}::VARCHAR[], term) GROUP BY ALL),
wt AS (SELECT pair_id, s * (ln(3.0 / (1 + (s > 0)::INT + (m > 0)::INT)) + 1) AS s, m * (ln(3.0 / (1 + (s > 0)::INT + (m > 0)::INT)) + 1) AS m FROM tf),
cosines AS (SELECT pairs.pair_id, coalesce(sum(s * m) / nullif(sqrt(sum(s * s)) * sqrt(sum(m * m)), 0), 0.0) AS tfidf FROM pairs LEFT JOIN wt USING (pair_id) GROUP BY ALL)"""


NUMBERED = """sheets AS (
  SELECT conv_id AS doc_id, 'Sheet of answers' || string_agg(line, '' ORDER BY turn, role, line) AS text FROM (
    SELECT conv_id, turn, role, coalesce(CASE WHEN role = 'user' THEN chr(10) || ((turn * 5) % 9 + 1) || '. ' || text ELSE chr(10) || 'a) ' || text || chr(10) || 'b) ' || role || ' part' END, '') AS line FROM conversations) GROUP BY conv_id),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(?:^|\\n)\\s*(?:Q(?:uestion|\\.)?\\s*|Ans(?:wer)?\\s*\\.?\\s*)?[(\\[]?0?(\\d{1,2}[a-z]?)[)\\]./:\\-_ \\\\]', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM sheets),
heads AS (SELECT doc_id, regexp_replace(ps[1], '^\\s+|\\s+$', '', 'g') AS head FROM cut WHERE len(ps) > 1),
raw AS (SELECT doc_id, unnest(ps[2:]) AS piece, generate_subscripts(ps[2:], 1) AS pos FROM cut),
p0 AS (SELECT doc_id, pos, lower(split_part(piece, chr(2), 1)) AS key_raw, regexp_replace(split_part(piece, chr(2), 2), '^\\s+|\\s+$', '', 'g') AS content FROM raw),
p1 AS (SELECT *, regexp_replace(key_raw, '[a-z]', '', 'g')::INT AS num, regexp_replace(key_raw, '\\d', '', 'g') AS suffix FROM p0),
p2 AS (SELECT *, max(num) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM p1 WHERE num BETWEEN 1 AND 50),
p3 AS (SELECT *, coalesce(highest >= 4 AND num <= 3 AND num < highest, false) AS guarded FROM p2),
pieces AS (SELECT *, last_value(CASE WHEN NOT guarded AND suffix = '' THEN num END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM p3),
sub0 AS (SELECT *, string_split(regexp_replace(content, '(?i)(?:^|\\n)\\s*([a-h]|[ivx]+)\\s*[).\\-]\\s*', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ss FROM pieces),
sub1 AS (SELECT * EXCLUDE (ss), len(ss) > 1 AS found, CASE WHEN len(ss) > 1 THEN regexp_replace(ss[1], '^\\s+|\\s+$', '', 'g') END AS intro,
  list_filter(list_transform(ss[2:], lambda x: {'letter': lower(split_part(x, chr(2), 1)), 'text': regexp_replace(split_part(x, chr(2), 2), '^\\s+|\\s+$', '', 'g')}), lambda x: regexp_full_match(x.letter, '[a-h]') AND length(x.text) >= 3) AS good FROM sub0),
subs AS (SELECT doc_id, pos, x.letter AS letter, min(i) AS i, arg_max(x.text, i) AS text FROM (SELECT doc_id, pos, unnest(good) AS x, generate_subscripts(good, 1) AS i FROM sub1) GROUP BY ALL),
state AS (SELECT s.*, num || suffix AS key, coalesce(parent, num)::VARCHAR AS pk, l.last, coalesce(found AND (intro <> '' OR l.last IS NOT NULL), false) AS split FROM sub1 s LEFT JOIN (SELECT doc_id, pos, arg_max(letter, i) AS last FROM subs GROUP BY ALL) l USING (doc_id, pos)),
told AS (SELECT *, CASE WHEN guarded THEN NULL WHEN split AND last IS NOT NULL THEN {'k': pk || last} WHEN NOT split THEN {'k': CASE WHEN suffix <> '' THEN key END} END AS say FROM state),
aimed AS (SELECT *, coalesce((last_value(say IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).k, parent::VARCHAR) AS target FROM told),
written AS (
  SELECT doc_id, pos * 100 AS ord, target AS q_key, key_raw || ' ' || content AS text FROM aimed WHERE guarded AND target IS NOT NULL
  UNION ALL SELECT doc_id, pos * 100, key, intro FROM aimed WHERE NOT guarded AND split AND intro <> ''
  UNION ALL SELECT a.doc_id, a.pos * 100 + s.i, pk || s.letter, s.text FROM aimed a JOIN subs s USING (doc_id, pos) WHERE NOT guarded AND split
  UNION ALL SELECT doc_id, pos * 100, key, content FROM aimed WHERE NOT guarded AND NOT split),
merged AS (SELECT doc_id, q_key, min(ord) AS ord, string_agg(text, ' ' ORDER BY ord, text) AS text FROM written GROUP BY ALL),
firsts AS (SELECT h.doc_id, '1' AS q_key, CASE WHEN length(head) > 10 AND o.text IS NULL THEN head WHEN length(head) > 10 AND length(o.text) < length(head) THEN head || ' ' || o.text ELSE o.text END AS text FROM heads h LEFT JOIN (FROM merged WHERE q_key = '1') o USING (doc_id)),
wholes AS (SELECT c.doc_id, '1' AS q_key, regexp_replace(ps[1], '^\\s+|\\s+$', '', 'g') AS text FROM cut c WHERE len(ps) = 1),
segments AS (SELECT doc_id, q_key, text FROM merged WHERE q_key <> '1' UNION ALL SELECT * FROM firsts WHERE text IS NOT NULL UNION ALL SELECT * FROM wholes WHERE text <> '')"""

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

_HEADER = any_of(PAGE_HEADERS)


def _unheaded(t: str) -> str:
    """The text without header lines, the two lines after each, and noise lines: a fold over its lines."""
    line = "{'line': l, 'skip': 0, 'kept': []::VARCHAR[]}"
    return f"""array_to_string(list_reduce(list_prepend({line.replace(': l,', ": '',")}, list_transform(string_split({t}, chr(10)), lambda l: {line})), lambda a, x: {{'line': '',
  'skip': CASE WHEN a.skip > 0 THEN a.skip - 1 WHEN regexp_matches(x.line, '{_HEADER}') THEN 2 ELSE 0 END,
  'kept': CASE WHEN a.skip > 0 OR regexp_matches(x.line, '{_HEADER}') OR regexp_matches(x.line, '{NOISE_LINE}') THEN a.kept ELSE list_append(a.kept, x.line) END}}).kept, chr(10))"""


HEADED = """headed AS (SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 3 = 0 THEN 'Additional Sheet of roll ' || conv_id || chr(10) || 'name' || chr(10) || 'date' || chr(10) ELSE '' END
  || coalesce(text, '') || CASE WHEN turn % 2 = 1 THEN chr(10) || 'Sub Total' || chr(10) || 'CO 3' ELSE '' END, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1)"""

PAGED = f"""spots AS (SELECT doc_id, text, list_reduce(list_prepend({{'line': '', 'spot': 0::BIGINT, 'kept': []::BIGINT[]}}, list_transform(string_split(text, chr(10)), lambda l: {{'line': l, 'spot': 0::BIGINT, 'kept': []::BIGINT[]}})), lambda a, x: {{'line': '',
  'spot': a.spot + length(x.line) + 1, 'kept': CASE WHEN regexp_matches(x.line, '{_HEADER}') AND (len(a.kept) = 0 OR a.spot - a.kept[-1] > 100) THEN list_append(a.kept, a.spot) ELSE a.kept END}}).kept AS spots_ FROM headed),
cuts AS (SELECT doc_id, text, spots_, list_filter(list_transform(range(1, len(spots_) + 1), lambda i: {_STRIP.format("substr(text, spots_[i] + 1, coalesce(spots_[i + 1], length(text)) - spots_[i])")}), lambda p: length(p) > 20) AS ps FROM spots),
sheets_ AS (SELECT doc_id, CASE WHEN len(spots_) > 1 AND len(ps) > 1 THEN ps ELSE [text] END AS ps FROM cuts)"""

# parts against the expected keys: those not expected join what stands before them
_KEYS = "['1', '2', '2a', '6', '6a', '6b', '7', '12', '13', '14']"
_ACC = "{{'letter': '', 'text': '', 'intro': {intro}, 'done': {done}}}"
_ONE = "{'letter': x.letter, 'text': x.text}"
_CHAIN = NUMBERED[NUMBERED.index("state AS ("):]
for _name in ("state", "told", "aimed", "written", "merged", "firsts", "segments", "sub1", "subs"):
    _CHAIN = re.sub(rf"\b{_name}\b", f"{_name}_e", _CHAIN)
EXPECTED = NUMBERED[:NUMBERED.index("state AS (")] + f"""kept_e AS (SELECT doc_id, pos, list({{'letter': letter, 'text': text, 'intro': '', 'done': []::STRUCT(letter VARCHAR, text VARCHAR)[]}} ORDER BY i) AS ks FROM subs GROUP BY ALL),
asked_e AS (SELECT s.*, coalesce(ks, []) AS ks, coalesce(parent, num)::VARCHAR AS pkey FROM sub1 s LEFT JOIN kept_e USING (doc_id, pos)),
fold_e AS (SELECT *, len(list_filter(ks, lambda x: list_contains({_KEYS}, pkey || x.letter))) > 0 AS any_e, list_reduce(list_prepend({_ACC.format(intro="coalesce(intro, '')", done='[]::STRUCT(letter VARCHAR, text VARCHAR)[]')}, ks), lambda a, x:
  CASE WHEN list_contains({_KEYS}, pkey || x.letter) THEN {_ACC.format(intro='a.intro', done=f'list_append(a.done, {_ONE})')}
  WHEN len(a.done) = 0 THEN {_ACC.format(intro="CASE WHEN a.intro = '' THEN x.text ELSE a.intro || ' ' || x.text END", done='a.done')}
  ELSE {_ACC.format(intro='a.intro', done="list_append(a.done[1:len(a.done) - 1], {'letter': a.done[-1].letter, 'text': a.done[-1].text || ' ' || x.text})")} END) AS f FROM asked_e),
sub1_e AS (SELECT * EXCLUDE (ks, pkey, f, any_e, found, intro, good), found AND any_e AS found, CASE WHEN any_e THEN f.intro END AS intro, CASE WHEN found AND any_e THEN f.done ELSE [] END AS good FROM fold_e),
subs_e AS (SELECT doc_id, pos, x.letter AS letter, i, x.text AS text FROM (SELECT doc_id, pos, unnest(good) AS x, generate_subscripts(good, 1) AS i FROM sub1_e)),
{_CHAIN},
have AS (SELECT doc_id, list(q_key) AS ks, max(CASE WHEN length({_STRIP.format('text[1:30]')}) >= 10 THEN CASE WHEN strpos(body, {_STRIP.format('text[1:30]')}) > 0 THEN strpos(body, {_STRIP.format('text[1:30]')}) - 1 + length(text) ELSE 0 END ELSE 0 END) AS used, any_value(body) AS body
  FROM (SELECT g.doc_id, q_key, g.text, s.text AS body FROM segments_e g JOIN sheets s USING (doc_id)) GROUP BY 1),
few AS (SELECT s.doc_id, s.text AS body, coalesce(used, 0) AS used, length(s.text) AS n, list_filter({_KEYS}, lambda k: NOT list_contains(coalesce(ks, []) || list_transform(coalesce(ks, []), lambda q: regexp_replace(q, '[a-z]', '', 'g')), k)
    AND NOT list_contains(coalesce(ks, []) || list_transform(coalesce(ks, []), lambda q: regexp_replace(q, '[a-z]', '', 'g')), regexp_replace(k, '[a-z]', '', 'g'))) AS missing FROM sheets s LEFT JOIN have USING (doc_id) WHERE len(coalesce(ks, [])) < 4),
tails AS (SELECT doc_id, missing, CASE WHEN used > 0 AND used < n - 50 THEN substr(body, used + 1) WHEN used >= n * 0.9 THEN body ELSE substr(body, (n * 0.3)::DOUBLE::DECIMAL(18, 6)::BIGINT + 1) END AS tail FROM few),
bare AS (SELECT doc_id, missing, len(missing) AS want, {_unheaded('tail')} AS t FROM tails WHERE length({_STRIP.format('tail')}) >= 30 AND len(missing) > 0),
paras AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n\\s*\\n'), lambda p: {_STRIP.format('p')}), lambda p: length(p) > 15) AS wide, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: {_STRIP.format('p')}), lambda p: length(p) > 15) AS near FROM bare),
picked AS (SELECT *, CASE WHEN len(wide) >= want THEN wide WHEN len(near) >= want THEN near END AS ps FROM paras),
per_e AS (SELECT *, greatest(1, len(ps) // want) AS per FROM picked),
dealt AS (SELECT doc_id, missing, CASE WHEN want = 1 THEN [t] WHEN ps IS NOT NULL THEN list_transform(range(0, (len(ps) - 1) // per + 1), lambda i: array_to_string(ps[i * per + 1:(i + 1) * per], chr(10) || chr(10))) WHEN {_STRIP.format('t')} <> '' THEN [{_STRIP.format('t')}] ELSE [] END AS cs FROM per_e),
more AS (SELECT doc_id, missing[i] AS q_key, CASE WHEN i = least(len(missing), len(cs)) THEN array_to_string(cs[i:], ' ') ELSE cs[i] END AS text FROM (SELECT *, unnest(range(1, least(len(missing), len(cs)) + 1)) AS i FROM dealt))"""

PAPERS = """li AS (SELECT l_orderkey AS exam_id, (l_linenumber * 2 + l_partkey % 2)::VARCHAR AS num, (1 + l_suppkey % 22)::VARCHAR AS marks, l_partkey::VARCHAR AS topic, * FROM lineitem),
bodies AS (SELECT exam_id, string_agg(
    CASE WHEN exam_id % 4 = 0 THEN 'Q' || num || '. Describe topic ' || topic || CASE l_partkey % 4 WHEN 0 THEN ' in short [' || marks || ' marks]' WHEN 1 THEN ' in short (' || marks || ' Marks)' WHEN 2 THEN ' in short, Marks: ' || marks ELSE ' in short ' || marks || ' marks' END
    ELSE num || CASE l_returnflag WHEN 'A' THEN '.a) |' WHEN 'R' THEN ') b) ' ELSE '. |' END || 'Explain topic ' || topic || ' of the unit  ' || marks || ' |CO' || (l_suppkey % 5 + 1) END
    || CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN chr(10) || 'OR' ELSE '' END || CASE WHEN l_quantity > 48 THEN chr(10) || 'Bonus questions' ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS body FROM li GROUP BY exam_id),
papers AS (SELECT exam_id, CASE exam_id % 3 WHEN 0 THEN 'Max. Marks: ' || (15 + exam_id % 100) || chr(10) WHEN 1 THEN 'Total marks = ' || (15 + exam_id % 100) || chr(10) ELSE '' END || body AS text FROM bodies),
lines AS MATERIALIZED (SELECT exam_id, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT exam_id, string_split(text, chr(10)) AS ls FROM papers)),
""" + f"""hits AS MATERIALIZED (SELECT exam_id, line_no, regexp_extract(s, '{ROW}', 1)::INT AS num, regexp_extract(s, '{ROW}', 2) AS m2, regexp_extract(s, '{ROW}', 3) AS m3, regexp_extract(s, '{ROW}', 4)::INT AS marks
  FROM (SELECT *, {_STRIP.format('line')} AS s FROM lines) WHERE regexp_matches(s, '{ROW}')),
parted AS (SELECT *, CASE WHEN regexp_matches(m2, '[)}}\\]]') THEN regexp_replace(lower(m2), '[^a-z]', '', 'g') ELSE '' END AS part, regexp_replace(lower(m2), '[^a-z]', '', 'g') AS letter FROM hits WHERE num BETWEEN 1 AND 15 AND marks BETWEEN 1 AND 20),
table_rows AS (SELECT exam_id, num || part AS q_key, line_no, marks, {_STRIP.format("CASE WHEN part = '' AND letter <> '' THEN " + _STRIP.format('m2') + " || m3 ELSE m3 END")} AS q_text FROM parted QUALIFY row_number() OVER (PARTITION BY exam_id, num || part ORDER BY line_no) = 1),
running AS (SELECT exam_id, line_no, lower(regexp_extract(line, '{CLASSIC}', 1)) AS q_key,
  coalesce(try_cast(nullif(regexp_extract(line, '{CLASSIC}', 3), '') AS INT), try_cast(nullif(regexp_extract(line, '{CLASSIC}', 4), '') AS INT), try_cast(nullif(regexp_extract(line, '{CLASSIC}', 5), '') AS INT), try_cast(nullif(regexp_extract(line, '{CLASSIC}', 6), '') AS INT)) AS marks
  FROM lines WHERE regexp_matches(line, '{CLASSIC}') AND exam_id NOT IN (SELECT exam_id FROM table_rows)),
running_rows AS (SELECT exam_id, q_key, line_no, marks, '' AS q_text FROM running WHERE marks BETWEEN 1 AND 20 AND regexp_replace(q_key, '[a-z]', '', 'g')::INT BETWEEN 1 AND 20 QUALIFY row_number() OVER (PARTITION BY exam_id, q_key ORDER BY line_no) = 1),
qrows AS MATERIALIZED (SELECT *, regexp_replace(q_key, '[a-z]', '', 'g')::INT AS base FROM (FROM table_rows UNION ALL FROM running_rows)),
ors AS MATERIALIZED (SELECT exam_id, line_no AS o FROM lines WHERE regexp_matches(line, '{OR_LINE}')),
near AS (SELECT exam_id, line_no, max(base) AS hi, min(base) AS lo FROM qrows GROUP BY ALL),
sides AS (SELECT o.exam_id, o, p.hi AS a, n.lo AS b FROM ors o ASOF LEFT JOIN near p ON o.exam_id = p.exam_id AND o.o > p.line_no ASOF LEFT JOIN near n ON o.exam_id = n.exam_id AND o.o < n.line_no),
shared AS (SELECT exam_id, base, arg_max(g, (o, g)) AS g FROM (SELECT exam_id, o, least(a, b) AS g, unnest([a, b]) AS base FROM sides WHERE a <> b) GROUP BY ALL),
groups AS (SELECT q.exam_id, q_key, base, marks, coalesce(g::VARCHAR, q_key) AS group_id FROM qrows q LEFT JOIN shared USING (exam_id, base)),
heads AS (SELECT exam_id, min(line_no) AS head FROM lines WHERE regexp_matches(line, '{CHALLENGE}') GROUP BY 1),
hard AS (SELECT exam_id, coalesce(max(base) FILTER (line_no > head), max(base))::VARCHAR AS base FROM heads JOIN qrows USING (exam_id) GROUP BY 1),
totals AS (SELECT exam_id, coalesce({", ".join(f"list_filter(list_transform(regexp_extract_all(text, '{p}', 1), lambda v: try_cast(v AS INT)), lambda v: v BETWEEN 20 AND 100)[1]" for p in TOTALS)}) AS total_marks FROM papers)"""

FILES = r"""files AS (SELECT conv_id AS doc_id, count(*) AS n_pages, CASE WHEN bool_or(text IS NULL) THEN '' ELSE string_agg(text || chr(10) || '---PAGE_BREAK---' || chr(10), '' ORDER BY turn, role, text) END AS text FROM conversations GROUP BY 1)"""

_MISMATCH = "list_sum(list_transform(range(1, greatest(length(a.w), length(b.w)) + 1), lambda i: (a.w[i] <> b.w[i])::INT))"

_FINAL = """round(greatest(0.0, least(1.0, greatest(base * 0.85 + coverage * 0.15, CASE WHEN hits >= 2 AND n_words > 5 THEN 0.35 WHEN hits >= 1 AND n_words > 5 THEN 0.15 ELSE 0.0 END, CASE WHEN n_words >= 8 AND es > 0.25 THEN 0.20 ELSE 0.0 END))), 12)"""

_PLACE = "(961 * unicode(w[i]) + 31 * unicode(w[i + 1]) + unicode(w[i + 2])) % 256"


def _vectors(words: str, name: str) -> str:
    """name(t, v): counts of the trigrams of the marked words (t, w) of a CTE, in 256 places."""
    return f"""{name} AS MATERIALIZED (SELECT t, list_transform(range(0, 256), lambda p: coalesce(h[p], 0)::DOUBLE) AS v FROM (
  SELECT t, histogram(place) AS h FROM (SELECT t, unnest(list_transform(range(1, length(w) - 1), lambda i: {_PLACE})) AS place FROM {words}) GROUP BY t))"""


def _cosine(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}, {b}), 0.0)"


# scores of answers(answer_id, student, model)
SCORED = f"""a_ AS (SELECT answer_id, replace(student, chr(10), ' ') AS s, replace(model, chr(10), ' ') AS m FROM answers),
full_ AS MATERIALIZED (SELECT *, {_noise('s')} > 0.30 AS noisy FROM a_ WHERE coalesce(length(s), 0) > 0 AND coalesce(length(m), 0) > 0),
mw AS (SELECT m, list_filter({_WORDS.format('m')}, lambda t: NOT list_contains({_list(STOP_WORDS)}, t)) AS w FROM (SELECT DISTINCT m FROM full_)),
mc AS MATERIALIZED (SELECT DISTINCT m, unnest(CASE WHEN len(w) = 0 THEN [m] ELSE w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS concept FROM mw),
st AS (SELECT answer_id, s, {_tokens('s')} AS w FROM full_),
wins AS MATERIALIZED (SELECT DISTINCT answer_id, unnest(CASE WHEN len(w) <= 30 THEN [s] ELSE list_transform(range(1, len(w) - 4, 3), lambda i: array_to_string(w[i:i + 5], ' ')) || CASE WHEN len(w) % 3 <> 0 THEN [array_to_string(w[len(w) - 5:], ' ')] ELSE [] END END) AS win FROM st),
texts_ AS (SELECT concept AS t FROM mc UNION SELECT win FROM wins UNION SELECT s FROM full_ UNION SELECT m FROM full_),
tw AS (SELECT t, '^' || unnest({_tokens('lower(t)')}) || '$' AS w FROM texts_),
tc AS MATERIALIZED (SELECT t, place, count(*) AS n FROM (SELECT t, unnest(list_transform(range(1, length(w) - 1), lambda i: {_PLACE})) AS place FROM tw) GROUP BY ALL),
tn AS MATERIALIZED (SELECT t, sqrt(sum(n * n)::DOUBLE) AS norm FROM tc GROUP BY t),
cx AS MATERIALIZED (SELECT m, concept, place, n FROM mc JOIN tc ON tc.t = concept),
cd AS MATERIALIZED (SELECT cx.m, concept, sum(cx.n * y.n)::DOUBLE AS dots FROM cx JOIN tc y ON y.t = cx.m AND y.place = cx.place GROUP BY ALL),
cm AS (SELECT mc.m, mc.concept, coalesce(dots / (a.norm * b.norm), 0.0) AS sim FROM mc LEFT JOIN cd ON cd.m = mc.m AND cd.concept = mc.concept LEFT JOIN tn a ON a.t = mc.concept LEFT JOIN tn b ON b.t = mc.m),
top_ AS MATERIALIZED (SELECT m, concept, row_number() OVER (PARTITION BY m ORDER BY round(sim, 9) DESC, concept) AS rank FROM cm QUALIFY rank <= 8),
asked_ AS MATERIALIZED (SELECT f.answer_id, f.s, f.noisy, rank, concept FROM full_ f JOIN top_ USING (m)),
vw AS (SELECT t, w FROM tw WHERE t IN (SELECT concept FROM top_ UNION SELECT win FROM wins UNION SELECT s FROM full_ UNION SELECT m FROM full_)),
{_vectors('vw', 'tv')},
near_ AS (SELECT q.answer_id, q.rank, max({_cosine('a.v', 'b.v')}) AS best FROM asked_ q JOIN wins w USING (answer_id) LEFT JOIN tv a ON a.t = q.concept LEFT JOIN tv b ON b.t = w.win GROUP BY ALL),
sk AS MATERIALIZED (SELECT DISTINCT answer_id, unnest({_keywords('s')}) AS word FROM full_),
ck AS MATERIALIZED (SELECT DISTINCT answer_id, rank, unnest({_keywords('concept')}) AS target FROM asked_),
mk AS MATERIALIZED (SELECT answer_id, s, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS target FROM (SELECT answer_id, s, list_filter({_keywords('m')}, lambda k: length(k) > 5) AS k FROM full_)),
fz AS MATERIALIZED (SELECT a.w AS target, b.w AS word FROM (SELECT DISTINCT target AS w FROM (SELECT target FROM ck UNION SELECT target FROM mk)) a JOIN (SELECT DISTINCT word AS w FROM sk) b ON a.w[1] = b.w[1] AND abs(length(a.w) - length(b.w)) <= 2 AND length(a.w) >= 4
  WHERE {_MISMATCH} <= CASE WHEN length(a.w) <= 5 THEN 1 ELSE 2 END),
cf AS (SELECT DISTINCT ck.answer_id, rank FROM ck JOIN fz USING (target) JOIN sk ON sk.answer_id = ck.answer_id AND sk.word = fz.word),
mf AS (SELECT DISTINCT mk.answer_id, i FROM mk JOIN fz USING (target) JOIN sk ON sk.answer_id = mk.answer_id AND sk.word = fz.word),
resc AS (SELECT answer_id, count(*) FILTER (contains(lower(s), target) OR mf.i IS NOT NULL) AS hits FROM mk LEFT JOIN mf USING (answer_id, i) GROUP BY answer_id),
hit_ AS (SELECT q.answer_id, q.rank, q.concept, coalesce(best, 0) > CASE WHEN noisy THEN 0.40 ELSE 0.55 END OR contains(lower(s), lower(concept)) OR cf.rank IS NOT NULL AS hit FROM asked_ q LEFT JOIN near_ n USING (answer_id, rank) LEFT JOIN cf USING (answer_id, rank)),
cov AS (SELECT answer_id, count(*) FILTER (hit) / count(*) AS coverage, coalesce(list(concept ORDER BY rank) FILTER (NOT hit), []) AS missing FROM hit_ GROUP BY 1),
sm AS (SELECT f.answer_id, noisy, {_cosine('a.v', 'b.v')} AS similarity, len({_tokens('f.s')}) AS n_words, coalesce(hits, 0) AS hits, coverage, missing
  FROM full_ f JOIN cov USING (answer_id) LEFT JOIN resc USING (answer_id) LEFT JOIN tv a ON a.t = f.s LEFT JOIN tv b ON b.t = f.m),
se AS (SELECT *, CASE WHEN noisy THEN similarity * 1.15 ELSE similarity END AS es FROM sm),
sb AS (SELECT *, CASE WHEN es >= 0.55 THEN 1.0 WHEN es >= 0.40 THEN 0.70 + 0.30 * ((es - 0.40) / 0.15) WHEN es >= 0.20 THEN 0.25 + 0.45 * ((es - 0.20) / 0.20) ELSE 0.0 END AS base FROM se),
sf AS (SELECT *, {_FINAL} AS final FROM sb),
scored AS (SELECT answer_id, round_even(final * 10, 1) AS score, round_even(similarity, 2) AS similarity, round_even(coverage, 2) AS coverage,
  CASE WHEN final >= 0.85 THEN 'Excellent understanding of the concept.' WHEN final >= 0.60 THEN 'Good conceptual grasp, but slightly brief or missing some details.' WHEN final >= 0.35 THEN 'Partial understanding shown.' ELSE 'Incorrect or insufficient concept.' END
  || CASE WHEN final < 0.85 AND len(missing) > 0 THEN ' Consider adding details like: ' || array_to_string(list_transform(missing[1:2], lambda c: chr(39) || c || chr(39)), ', ') || '.' ELSE '' END AS feedback FROM sf)"""


def _greedy(pairs: str) -> str:
    """keys and served: the greedy assignment of a CTE (exam, m_key, s_key, ord, sim), one model key of each exam a round."""
    return f"""keys_g AS MATERIALIZED (SELECT exam, m_key, row_number() OVER (PARTITION BY exam ORDER BY m_key) AS no FROM (SELECT DISTINCT exam, m_key FROM {pairs})),
served(exam, no, m_key, s_key, used) AS (
  SELECT DISTINCT exam, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] FROM keys_g
  UNION ALL
  SELECT exam, no + 1, mk, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (
    SELECT r.exam, r.no, any_value(k.m_key) AS mk, any_value(r.used) AS used, arg_max(p.s_key, (p.sim, -p.ord)) FILTER (p.sim > 0.2 AND NOT list_contains(r.used, p.s_key)) AS best
    FROM served r JOIN keys_g k ON k.exam = r.exam AND k.no = r.no + 1 JOIN {pairs} p ON p.exam = k.exam AND p.m_key = k.m_key GROUP BY r.exam, r.no))"""


GRADED = f"""{NUMBERED},
gs AS MATERIALIZED (SELECT s.doc_id AS exam_id, s.q_key, coalesce(o.ord, 2000000000) AS ord, s.text FROM segments s LEFT JOIN merged o ON o.doc_id = s.doc_id AND o.q_key = s.q_key),
gm AS MATERIALIZED (SELECT conv_id AS exam_id, ((turn * 5) % 9 + 1)::VARCHAR AS q_key, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
gd AS (SELECT exam_id, greatest(1, round_even(50 / CASE WHEN bool_or(q_key = '1') THEN 1 ELSE count(*) END, 0)::INT) AS default_marks FROM gm GROUP BY 1),
people AS (SELECT DISTINCT exam_id FROM gs),
gx AS MATERIALIZED (SELECT m.exam_id, m.q_key AS m_key, s.q_key AS s_key FROM gm m JOIN gs s USING (exam_id, q_key)),
gp AS MATERIALIZED (SELECT m.exam_id, m.q_key AS m_key, s.q_key AS s_key, s.text FROM gm m JOIN gs s ON s.exam_id = m.exam_id AND regexp_extract(s.q_key, '^\\d+') = m.q_key AND s.q_key <> m.q_key
  WHERE NOT EXISTS (FROM gx x WHERE x.exam_id = m.exam_id AND x.m_key = m.q_key) AND NOT EXISTS (FROM gx x WHERE x.exam_id = s.exam_id AND x.s_key = s.q_key)),
used_ AS (SELECT exam_id, m_key, s_key FROM gx UNION ALL SELECT exam_id, m_key, s_key FROM gp),
om AS (SELECT m.exam_id, q_key AS m_key, text AS t FROM gm m JOIN people USING (exam_id) WHERE NOT EXISTS (FROM used_ x WHERE x.exam_id = m.exam_id AND x.m_key = q_key)),
os AS (SELECT exam_id, q_key AS s_key, ord, text AS t FROM gs WHERE length(trim(text)) >= 10 AND NOT EXISTS (FROM used_ x WHERE x.exam_id = gs.exam_id AND x.s_key = gs.q_key)),
ow AS (SELECT t, '^' || unnest({_tokens('lower(t)')}) || '$' AS w FROM (SELECT t FROM om UNION SELECT t FROM os)),
{_vectors('ow', 'ov')},
gpairs AS MATERIALIZED (SELECT m.exam_id AS exam, m.m_key, s.s_key, s.ord, round({_cosine('a.v', 'b.v')}, 9) AS sim FROM om m JOIN os s USING (exam_id) LEFT JOIN ov a ON a.t = m.t LEFT JOIN ov b ON b.t = s.t),
{_greedy('gpairs')},
given AS (SELECT x.exam_id, x.m_key, s.text, '' AS note FROM gx x JOIN gs s ON s.exam_id = x.exam_id AND s.q_key = x.s_key
  UNION ALL SELECT v.exam, v.m_key, s.text, ' (matched to Q' || v.s_key || ')' FROM served v JOIN gs s ON s.exam_id = v.exam AND s.q_key = v.s_key
  UNION ALL SELECT exam_id, m_key, string_agg(text, ' ' ORDER BY s_key), ' (aggregated from student Q' || string_agg(s_key, ', Q' ORDER BY s_key) || ')' FROM gp GROUP BY ALL),
answers AS MATERIALIZED (SELECT g.exam_id || chr(1) || g.m_key AS answer_id, g.exam_id, g.m_key, note, g.text AS student, m.text AS model FROM given g JOIN gm m ON m.exam_id = g.exam_id AND m.q_key = g.m_key),
{SCORED},
marked AS (SELECT m.exam_id, 1 AS student_id, m.q_key, CASE WHEN m.q_key = '1' THEN 5 ELSE default_marks END AS mm,
  CASE WHEN a.answer_id IS NULL THEN 0.0 ELSE round_even(round_even(coalesce(score, 0.0), 1) / 10 * (CASE WHEN m.q_key = '1' THEN 5 ELSE default_marks END), 1) END AS sc,
  CASE WHEN a.answer_id IS NULL THEN 'Not Attempted' ELSE coalesce(feedback, 'Empty answer') || note END AS feedback
  FROM gm m JOIN people USING (exam_id) JOIN gd USING (exam_id) LEFT JOIN answers a ON a.exam_id = m.exam_id AND a.m_key = m.q_key LEFT JOIN scored USING (answer_id)),
sums_ AS (SELECT *, sum(mm) OVER (PARTITION BY exam_id) AS possible FROM marked),
grades AS (SELECT *, CASE WHEN possible <> 50 THEN 50 / possible END AS factor FROM sums_)"""

ORACLES = {
    "clean_text": _docs(_clean(r"[^a-z0-9\s\-,.]", ""), "cleaned"),
    "clean_text_strict": _docs(_clean(r"[^a-z0-9\s]", ""), "cleaned"),
    "clean_ocr_alpha": _docs(_clean(r"[^a-z\s]", " "), "cleaned"),
    "tokenize_count": _docs(f"len({_tokens('text')})::INT", "n_tokens"),
    "keywords_simple": _docs(f"array_to_string({_keywords('text')}, ' ')", "keywords"),
    "noise_ratio": _docs(f"round({_noise('text')}, 6)", "noise"),
    "readable_words": _docs(_READABLE.format("text") + "::INT", "n_words"),
    "ocr_choice": f"""WITH e AS (SELECT doc_id, text AS a, regexp_replace(text, '[a-z]{{6,}}', '#', 'g') AS b FROM documents),
n AS (SELECT *, {_READABLE.format('a')}::INT AS n_a, {_READABLE.format('b')}::INT AS n_b FROM e)
SELECT doc_id, n_a, n_b, length(CASE WHEN n_a = 0 AND n_b = 0 THEN a || chr(10) || b WHEN n_b > n_a * 1.3 THEN b WHEN n_a > n_b * 1.3 THEN a ELSE a || chr(10) || b END)::INT AS n_chars FROM n""",
    "word_windows": f"""WITH t AS (SELECT doc_id, text, {_tokens('text')} AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) <= 30 THEN [text] ELSE list_transform(range(1, len(w) - 4, 3), lambda i: array_to_string(w[i:i + 5], ' ')) || CASE WHEN len(w) % 3 <> 0 THEN [array_to_string(w[len(w) - 5:], ' ')] ELSE [] END END AS ws FROM t)
SELECT doc_id, (generate_subscripts(ws, 1) - 1)::INT AS w_no, unnest(ws) AS w FROM l""",
    "fuzzy_positional": f"""WITH k AS (SELECT DISTINCT unnest({_keywords('text')}) AS w FROM benchmark)
SELECT a.w AS target, b.w AS word FROM k a JOIN k b ON a.w <> b.w AND a.w[1] = b.w[1] AND abs(length(a.w) - length(b.w)) <= 2
WHERE {_MISMATCH} <= CASE WHEN length(a.w) <= 5 THEN 1 ELSE 2 END""",
    "overlap_best": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_tokens(_clean('[^a-z0-9' + chr(92) + 's]', ''))}) AS word FROM documents),
i AS (SELECT DISTINCT item_id, unnest({_tokens(_clean('[^a-z0-9' + chr(92) + 's]', ''))}) AS word FROM benchmark), n AS (SELECT item_id, count(*) AS n_model FROM i GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (word) GROUP BY ALL)
SELECT item_id, doc_id, n_common, round(n_common / n_model, 6) AS overlap, round(n_common / n_model * 10, 4) AS marks FROM c JOIN n USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n_common DESC, doc_id) = 1""",
    "overlap_pairs": f"WITH {PAIRS}, s AS (SELECT pair_id, list_distinct({_tokens('student')}) AS s, list_distinct({_tokens('model')}) AS m FROM pairs) SELECT pair_id, round(coalesce(len(list_intersect(s, m)) / nullif(len(m), 0), 0.0), 6) AS overlap FROM s",
    "tfidf_cosine": f"WITH {PAIRS}, {_tfidf('[]')} SELECT pair_id, round(tfidf, 6) AS tfidf FROM cosines",
    "tfidf_keywords": f"WITH {PAIRS}, {_TERMS} SELECT pair_id, array_to_string(keywords, '|') AS keywords FROM lists",
    "missing_keywords": f"WITH {PAIRS}, {_TERMS} SELECT pair_id, array_to_string(list_filter(keywords, lambda k: NOT list_contains({_tokens('student')}, k)), '|') AS missing FROM pairs JOIN lists USING (pair_id)",
    "hybrid_score": f"""WITH {PAIRS}, {_TERMS}, {_tfidf(_list(ENGLISH_STOP))},
k AS (SELECT pair_id, coalesce(len(list_filter(string_split(array_to_string(keywords, ' '), ' '), lambda w: list_contains({_tokens('student')}, w))) / len(string_split(array_to_string(keywords, ' '), ' ')), 0.0) AS keyword FROM pairs LEFT JOIN lists USING (pair_id))
SELECT pair_id, round(tfidf, 6) AS tfidf, round(keyword, 6) AS keyword, round(least(1.0, 0.6 * tfidf + 0.4 * keyword), 6) AS final, round(least(1.0, 0.6 * tfidf + 0.4 * keyword) * 10, 5) AS marks FROM k JOIN cosines USING (pair_id)""",
    "vector_cosine": f"WITH {BAND} SELECT pair_id, similarity FROM p",
    "semantic_top1": f"""SELECT q.vec_id AS query_id, w.vec_id AS window_id, {_COS.format('q.embedding', 'w.embedding')} AS similarity FROM embeddings q JOIN embeddings w ON q.vec_id // 40 = w.vec_id // 40 AND q.vec_id % 2 = 1 AND w.vec_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], w.embedding::DOUBLE[]) DESC, w.vec_id) = 1""",
    "semantic_topk_per_label": f"""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(s ORDER BY i) AS centre FROM (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL) GROUP BY label),
s AS (SELECT label, vec_id, {_COS.format('embedding', 'centre')} AS similarity FROM embeddings JOIN c USING (label))
SELECT label, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS rank, vec_id, similarity FROM s QUALIFY rank <= 3""",
    "ngram_candidates": f"""WITH w AS (SELECT item_id, list_filter({_WORDS.format('text')}, lambda t: NOT list_contains({_list(STOP_WORDS)}, t)) AS w FROM benchmark)
SELECT DISTINCT item_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM w""",
    "semantic_band": f"WITH {BAND} SELECT pair_id, similarity, round(base, 6) AS base FROM f",
    "blend_floor": f"WITH {BAND} SELECT pair_id, final FROM f",
    "feedback_tier": f"""WITH {BAND} SELECT pair_id, round_even(final * 10, 1) AS score,
CASE WHEN final >= 0.85 THEN 'Excellent understanding of the concept.' WHEN final >= 0.60 THEN 'Good conceptual grasp, but slightly brief or missing some details.' WHEN final >= 0.35 THEN 'Partial understanding shown.' ELSE 'Incorrect or insufficient concept.' END
|| CASE WHEN final < 0.85 AND coverage < 1 THEN ' Consider adding details like: ''alpha'', ''beta''.' ELSE '' END AS feedback FROM f""",
    "garbage_schema": f"WITH {EXAM} SELECT exam_id, q_key, max_marks, q_type, group_id FROM rubric",
    "default_marks": f"WITH {EXAM} SELECT exam_id, default_marks FROM defaults",
    "rubric_resolve": f"""WITH {EXAM}, m AS (SELECT *, regexp_replace(q_key, '[a-z]', '', 'g') AS base_key FROM models)
SELECT m.exam_id, m.q_key, m.base_key, coalesce(a.max_marks, b.max_marks, default_marks) AS max_marks, coalesce(a.group_id, b.group_id, m.q_key) AS group_id, coalesce(a.q_type, b.q_type, 'mandatory') AS q_type
FROM m LEFT JOIN rubric a ON a.exam_id = m.exam_id AND a.q_key = m.q_key LEFT JOIN rubric b ON b.exam_id = m.exam_id AND b.q_key = m.base_key JOIN defaults d ON d.exam_id = m.exam_id""",
    "align_exact": f"WITH {EXAM} SELECT * FROM exact",
    "align_base": f"WITH {EXAM} SELECT exam_id, student_id, m_key, s_key FROM based",
    "align_subparts": f"WITH {EXAM} SELECT exam_id, student_id, m_key, string_agg(s_key, ',' ORDER BY s_key) AS s_keys, string_agg(text, ' ' ORDER BY s_key) AS text FROM parts GROUP BY ALL",
    "not_attempted": f"""WITH {EXAM} SELECT DISTINCT m.exam_id, s.student_id, m.q_key AS m_key FROM models m JOIN students s USING (exam_id)
WHERE NOT EXISTS (FROM taken x WHERE x.exam_id = m.exam_id AND x.m_key = m.q_key) AND NOT EXISTS (FROM parts x WHERE x.exam_id = m.exam_id AND x.m_key = m.q_key)""",
    "or_winner": f"WITH {SCORES} SELECT exam_id, student_id, q_key, group_id, score, selected FROM won",
    "exam_totals": f"""WITH {SCORES} SELECT exam_id, student_id, round(obtained, 6) AS obtained, possible, CASE WHEN sc THEN round_even(round(obtained * total_marks / possible, 6), 1) ELSE round_even(round(obtained, 6), 1) END AS total_score,
CASE WHEN sc THEN total_marks ELSE possible END AS max_score FROM scaled""",
    "rescale_totals": f"""WITH {SCORES} SELECT exam_id, student_id, q_key, round(CASE WHEN sc THEN round_even(round(score * (total_marks / possible), 6), 1) ELSE score END, 4) AS score,
CASE WHEN sc THEN round_even(round(max_marks * (total_marks / possible), 6), 0)::INT ELSE max_marks END AS max_marks, selected FROM won JOIN scaled USING (exam_id, student_id)""",
    "report_rows": f"""WITH {SCORES} SELECT exam_id, student_id, q_key, base_key::INT AS num, regexp_replace(q_key, '^\\d+', '') AS part, round(score / max_marks * 100, 4) AS percent,
CASE WHEN score / max_marks >= 0.8 THEN 'green' WHEN score / max_marks >= 0.5 THEN 'amber' ELSE 'red' END AS color, CASE WHEN q_type = 'challenge' THEN 'challenge' WHEN NOT selected THEN 'not counted' WHEN q_type = 'optional' THEN 'chosen' ELSE '' END AS badge FROM won""",
    "natural_sort": f"WITH {EXAM} SELECT exam_id, q_key, row_number() OVER (PARTITION BY exam_id ORDER BY regexp_extract(q_key, '^\\d+')::INT, regexp_replace(q_key, '^\\d+', ''))::INT AS place FROM models",
    "vocabulary": f"SELECT DISTINCT item_id % 5 AS exam_id, unnest({_tokens(_clean('[^a-z0-9' + chr(92) + 's' + chr(92) + '-,.]', ''))}) AS term FROM benchmark",
    "expected_union": f"WITH {EXAM} SELECT exam_id, q_key FROM models UNION SELECT exam_id, q_key FROM rubric0",
    "key_alignment": f"""WITH {EXAM}, s AS (SELECT DISTINCT exam_id, q_key FROM students), j AS (SELECT coalesce(m.exam_id, s.exam_id) AS exam_id, m.q_key AS m, s.q_key AS s FROM models m FULL JOIN s ON m.exam_id = s.exam_id AND m.q_key = s.q_key)
SELECT exam_id, count(*) FILTER (m IS NOT NULL AND s IS NOT NULL) AS n_common, count(*) FILTER (s IS NULL) AS n_model_only, count(*) FILTER (m IS NULL) AS n_student_only, round(coalesce(count(*) FILTER (m IS NOT NULL AND s IS NOT NULL) / nullif(count(m), 0), 0.0), 6) AS match_rate FROM j GROUP BY 1""",
    "monotonic_guard": f"WITH {NUMBERED} SELECT doc_id, key_raw, num, guarded, parent, length(content)::INT AS n_chars FROM pieces",
    "segment_subparts": f"WITH {NUMBERED} SELECT doc_id, key_raw, intro, letter, text FROM sub1 JOIN subs USING (doc_id, pos)".replace("letter, text FROM", "subs.letter, subs.text FROM"),
    "merge_keys": f"WITH {NUMBERED} SELECT doc_id, q_key, text FROM merged",
    "segment_questions": f"WITH {NUMBERED} SELECT doc_id, q_key, regexp_extract(q_key, '^\\d+')::INT AS num, regexp_replace(q_key, '^\\d+', '') AS part, text FROM segments",
    "segment_profile": f"WITH {NUMBERED} SELECT doc_id, q_key, length(text)::INT AS n_chars, replace(text[1:60], chr(10), ' ') AS preview FROM segments",
    "paper_rows": f"WITH {PAPERS} SELECT exam_id, q_key, line_no, marks, q_text FROM qrows",
    "total_marks": f"WITH {PAPERS} SELECT exam_id, total_marks FROM totals",
    "or_groups": f"WITH {PAPERS} SELECT exam_id, q_key, group_id FROM groups",
    "challenge_type": f"WITH {PAPERS} SELECT exam_id, base FROM hard",
    "paper_rubric": f"""WITH {PAPERS} SELECT g.exam_id, q_key, marks AS max_marks, CASE WHEN h.base IS NOT NULL THEN 'challenge' WHEN count(*) OVER (PARTITION BY g.exam_id, group_id) = 1 THEN 'mandatory' ELSE 'optional' END AS q_type, group_id
FROM groups g LEFT JOIN hard h ON h.exam_id = g.exam_id AND h.base = g.base::VARCHAR""",
    "paper_schema": f"""WITH {PAPERS}, ok AS (SELECT exam_id, count(*) AS n, bool_or(q_key IN ('7a', '7b', '8a', '8b', '9a', '9b')) AS p FROM qrows GROUP BY 1 HAVING max(base) <= 20)
SELECT exam_id, coalesce(n, 0) AS n_keys, total_marks, CASE WHEN n > 0 THEN 'rubric' WHEN total_marks IS NOT NULL THEN 'total' ELSE 'none' END AS kind, coalesce(p, false) AS has_parts FROM totals LEFT JOIN ok USING (exam_id)""",
    "line_grep": f"WITH {PAPERS} SELECT exam_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)(CO\\s*4|PART\\s*[AB]|max)')",
    "segment_expected": f"""WITH {EXPECTED}, all_ AS (SELECT doc_id, q_key, text FROM segments_e UNION ALL FROM more)
SELECT doc_id, q_key, regexp_extract(q_key, '^\\d+')::INT AS num, regexp_replace(q_key, '^\\d+', '') AS part, text FROM all_""",
    "header_strip": f"WITH {HEADED}, k AS (SELECT doc_id, {_unheaded('text')} AS kept FROM headed) SELECT doc_id, length(kept)::INT AS n_chars, md5(kept) AS digest FROM k",
    "page_headers": f"WITH {HEADED}, {PAGED} SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS page_no, length(unnest(ps))::INT AS n_chars, md5(unnest(ps)) AS digest FROM sheets_",
    "page_concat": f"WITH {FILES} SELECT doc_id, n_pages, length(text)::INT AS n_chars, md5(text) AS digest FROM files",
    "page_split": f"""WITH {FILES}, cut AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, '---PAGE_BREAK---'), lambda p: {_STRIP.format('p')}), lambda p: length(p) > 20) AS ps FROM files),
p AS (SELECT doc_id, CASE WHEN len(ps) > 1 THEN ps ELSE [text] END AS ps FROM cut)
SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS page_no, md5(unnest(ps)) AS digest FROM p""",
    "preamble_rescue": f"WITH {NUMBERED} SELECT doc_id, text FROM segments WHERE q_key = '1'",
    "chunk_paragraphs": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
y AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n\\s*\\n'), lambda p: {_STRIP.format('p')}), lambda p: length(p) > 15) AS wide, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: {_STRIP.format('p')}), lambda p: length(p) > 15) AS near FROM x),
z AS (SELECT doc_id, t, CASE WHEN len(wide) >= 3 THEN wide WHEN len(near) >= 3 THEN near END AS ps FROM y),
g AS (SELECT *, greatest(1, len(ps) // 3) AS per FROM z),
c AS (SELECT doc_id, CASE WHEN ps IS NOT NULL THEN list_transform(range(0, (len(ps) - 1) // per + 1), lambda i: array_to_string(ps[i * per + 1:(i + 1) * per], chr(10) || chr(10))) WHEN {_STRIP.format('t')} <> '' THEN [{_STRIP.format('t')}] ELSE [] END AS cs FROM g)
SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INT AS no, length(unnest(cs))::INT AS n_chars, md5(unnest(cs)) AS digest FROM c""",
    "marker_kwic": f"""WITH {NUMBERED}, k AS (SELECT doc_id, text, string_split(regexp_replace(text, '({QUESTION})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM sheets),
m AS (SELECT doc_id, text, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM k),
n AS (SELECT doc_id, text, i, split_part(p, chr(2), 1) AS found, sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM m)
SELECT doc_id, (i - 2)::INT AS no, lower(regexp_extract(found, '{QUESTION}', 1)) AS marker, translate(substr(text, greatest(start - 10, 0)::INT + 1, (start + length(found) + 30 - greatest(start - 10, 0))::INT), chr(10), ' ') AS context FROM n WHERE i > 1""",
    "latest_per_status": "SELECT user_id, event_id, event_type AS status, value, n_events FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "job_progress": """WITH c AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, ts AS moment, (event_id % 7)::INT AS step, 6 AS total, event_type AS message,
    CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status FROM events),
g AS (SELECT job_id, list({'step': step, 'status': status, 'message': message, 'total': total, 'n': 0, 'bad': 0} ORDER BY moment, step, status, total, message) AS cs FROM c GROUP BY job_id),
f AS (SELECT job_id, list_reduce(list_prepend({'step': NULL, 'status': 'idle', 'message': NULL, 'total': NULL, 'n': 0, 'bad': 0}, cs), lambda s, x:
    CASE WHEN (s.status = 'idle' AND x.status IN ('idle', 'processing', 'error')) OR (s.status = 'processing' AND x.status IN ('processing', 'done', 'error'))
    THEN {'step': x.step, 'status': x.status, 'message': x.message, 'total': x.total, 'n': s.n + 1, 'bad': s.bad}
    ELSE {'step': s.step, 'status': s.status, 'message': s.message, 'total': s.total, 'n': s.n, 'bad': s.bad + 1} END) AS x FROM g)
SELECT job_id, x.step AS step, x.status AS status, x.message AS message, x.n::BIGINT AS changes, x.bad::BIGINT AS ignored,
  CASE WHEN x.status = 'done' THEN 100.0 WHEN x.total > 0 THEN round(100.0 * coalesce(x.step, 0) / x.total, 1) ELSE 0.0 END AS percent FROM f""",
    "answer_scores": f"""WITH {PAIRS}, answers AS (SELECT pair_id AS answer_id, student, model FROM pairs), {SCORED}
SELECT a.answer_id, coalesce(score, 0.0) AS score, coalesce(feedback, 'Empty answer') AS feedback, similarity, coverage FROM answers a LEFT JOIN scored USING (answer_id)""",
    "grade_rows": f"""WITH RECURSIVE {GRADED} SELECT exam_id, student_id, q_key, CASE WHEN factor IS NULL THEN sc ELSE round_even(round(sc * factor, 6), 1) END AS score,
CASE WHEN factor IS NULL THEN mm ELSE round_even(round(mm * factor, 6), 0)::INT END AS max_marks, true AS selected, feedback FROM grades""",
    "grade_totals": f"""WITH RECURSIVE {GRADED} SELECT exam_id, student_id, round(sum(sc), 6) AS obtained, any_value(possible)::BIGINT AS possible,
CASE WHEN any_value(possible) <> 50 THEN round_even(round(sum(sc) * 50 / any_value(possible), 6), 1) ELSE round_even(round(sum(sc), 6), 1) END AS total_score, 50::BIGINT AS max_score FROM grades GROUP BY 1, 2""",
    "greedy_semantic": f"""WITH RECURSIVE e AS (SELECT vec_id // 40 AS exam, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS MATERIALIZED (SELECT m.exam, m.vec_id::VARCHAR AS m_key, s.vec_id::VARCHAR AS s_key, s.vec_id AS ord, round(list_cosine_similarity(m.v, s.v), 9) AS sim FROM e m JOIN e s ON m.exam = s.exam AND m.vec_id % 2 = 1 AND s.vec_id % 2 = 0),
{_greedy('p')} SELECT exam AS exam_id, 1 AS student_id, m_key, s_key FROM served WHERE s_key IS NOT NULL""",
    "page_count": "SELECT conv_id AS doc_id, count(*) AS n_pages FROM conversations GROUP BY 1",
    "term_recovery": None,
}
ORACLES["label_agreement"] = f"WITH n AS ({ORACLES['noise_ratio']}) SELECT quality, noise > 0.30 AS noisy, count(*) AS n FROM n JOIN labels USING (doc_id) GROUP BY ALL"
ORACLES["term_recovery"] = f"""WITH best AS ({ORACLES['overlap_best']}), x AS (SELECT b.item_id, best.doc_id, list_distinct({_keywords('b.text')}) AS terms, lower(d.text) AS body FROM benchmark b JOIN best USING (item_id) JOIN documents d ON d.doc_id = best.doc_id)
SELECT item_id, doc_id, len(terms)::INT AS n_terms, len(list_filter(terms, lambda k: contains(body, k)))::INT AS n_found FROM x"""
ORACLES = {k: v for k, v in ORACLES.items() if v}
