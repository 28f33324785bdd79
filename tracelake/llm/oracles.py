"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import re

from tracelake.llm.chat import END, HEAD
from tracelake.llm.license_scan import CONTAINMENT, SHINGLE
from tracelake.llm.license_texts import TEMPLATES
from tracelake.llm.quality_rules import ANY, CLASSES, COMMON_WORDS, MAX_CHARS, MAX_COMMON, MAX_SUM, MIN_WORDS_CHARS, MIN_WORDS_COMMON

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql() -> str:
    """Windows of every template length, with the distinct template shingles that each holds."""
    rows = ", ".join(f"('{k}', {_quoted(re.findall('[a-z0-9]+', v.lower()))})" for k, v in sorted(TEMPLATES.items()))
    return f"""WITH t AS (SELECT license, w, len(w) AS m, greatest(1, len(w) // 4) AS stride, least({SHINGLE}, len(w)) AS k FROM (VALUES {rows}) v(license, w)),
ts AS (SELECT DISTINCT license, m, stride, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM t, LATERAL (SELECT unnest(range(1, m - k + 2)) AS i)), total AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM d), r AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS s, k FROM p, (SELECT DISTINCT k FROM t) WHERE i + k - 1 <= n),
h AS (SELECT doc_id, license, m, stride, n, ts.k, pos, s FROM r JOIN ts USING (k, s)),
x AS (SELECT doc_id, license, s, unnest(range(greatest(0, CAST(ceil((pos - (m + stride - 1 - k)) / stride) AS BIGINT)), least(pos // stride, (greatest(n - m, 0) + stride - 1) // stride) + 1)) * stride AS start FROM h),
c AS (SELECT doc_id, license, start, count(DISTINCT s) / any_value(total.n) AS share FROM x JOIN total USING (license) GROUP BY doc_id, license, start)
SELECT doc_id, license, max(share) AS containment, arg_min(start, (-share, start)) AS first_word, count(*) AS n_windows FROM c WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY doc_id, license"""


def quality_sql() -> str:
    longest = max(map(len, COMMON_WORDS.values()))
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in COMMON_WORDS.items()) + " ELSE [] END"
    keys = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    count = lambda c: f"length(regexp_replace(rest, '[^{c}]', '', 'g'))"
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents), n AS (SELECT *, row_number() OVER () AS row, len(w) AS n_words, array_to_string(w, '') AS glued FROM w),
g AS (SELECT row, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS g FROM n, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)), again AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY row),
l AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM n) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
b AS (SELECT n.*, length(glued) AS word_chars, length(regexp_replace(glued, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, regexp_replace(glued, '[a-z]+', '', 'g') AS rest, CASE WHEN lang IN ({keys}) THEN lang ELSE '{ANY}' END AS key, list_transform(w, lambda x: lower(x)) AS low, {lists} AS common FROM n LEFT JOIN l USING (row) LEFT JOIN rep USING (row)),
a AS (SELECT *, [word_chars - length(rest), {count('A-Z')}, {count('0-9')}, length(regexp_replace(rest, '[^.,;:!?''"()-]', '', 'g')), n_symbols, 0, n_words] AS cnt, list_transform(common, lambda x: len(list_filter(low, lambda y: y = x))) AS hits FROM b),
s AS (SELECT *, list_transform(range(1, {len(CLASSES) + 1}), lambda i: CASE WHEN word_chars + n_words = 0 THEN 0 WHEN i = 6 THEN (length(rest) - cnt[2] - cnt[3] - cnt[4] - cnt[5]) / (word_chars + n_words) ELSE cnt[i] / (word_chars + n_words) END) AS chars,
list_transform(list_append(hits, n_words - coalesce(list_sum(hits), 0)), lambda x: CASE WHEN n_words = 0 THEN 0 ELSE x / n_words END) AS words FROM a),
f AS (SELECT key, {', '.join(f'avg(chars[{i + 1}]) AS c{i}' for i in range(len(CLASSES)))}, {', '.join(f'avg(words[{i + 1}]) AS w{i}' for i in range(longest + 1))} FROM s WHERE n_words >= {MIN_WORDS_CHARS} GROUP BY key),
j AS (SELECT s.*, [{', '.join(f'c{i}' for i in range(len(CLASSES)))}] AS rc, [{', '.join(f'w{i}' for i in range(longest + 1))}] AS rw FROM s LEFT JOIN f USING (key)),
e AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS_CHARS} THEN sqrt(greatest(0, list_sum(list_transform(range(1, len(chars) + 1), lambda i: (CASE WHEN chars[i] > 0 THEN chars[i] * log2(2 * chars[i] / (chars[i] + rc[i])) ELSE 0 END + CASE WHEN rc[i] > 0 THEN rc[i] * log2(2 * rc[i] / (chars[i] + rc[i])) ELSE 0 END) / 2)))) END AS jc,
CASE WHEN n_words >= {MIN_WORDS_COMMON} AND key <> '{ANY}' THEN sqrt(greatest(0, list_sum(list_transform(range(1, len(words) + 1), lambda i: (CASE WHEN words[i] > 0 THEN words[i] * log2(2 * words[i] / (words[i] + rw[i])) ELSE 0 END + CASE WHEN rw[i] > 0 THEN rw[i] * log2(2 * rw[i] / (words[i] + rw[i])) ELSE 0 END) / 2)))) END AS jw, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(jc, 0) > {MAX_CHARS} OR coalesce(jw, 0) > {MAX_COMMON} OR coalesce(jc, 0) + coalesce(jw, 0) > {MAX_SUM}) AS kept, round(jc, 6) AS js_chars, round(jw, 6) AS js_common FROM e"""


def chat_sql() -> str:
    escaped = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '##', '#\\#'), '</', '<\\/')"
    control = r"\### Assistant: </turn> ok"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{control}' UNION ALL SELECT -7, 1, 'assistant', '{control}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum({len(HEAD) + 2 + len(END)} + length(replace({escaped('role')}, ': ', ':\\/ ')) + length({escaped('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def decontaminate_sql() -> str:
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL), v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS row, doc_id, {words("coalesce(text, '')")} AS w FROM documents), p AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM v) WHERE i + n - 1 <= len(w)),
h AS (SELECT row, i, n, item_id FROM p JOIN v USING (n, win)), k AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS q FROM h) GROUP BY row), o AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN k USING (row) LEFT JOIN o USING (row)"""


def search_sql() -> str:
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH q AS (SELECT DISTINCT item_id, unnest({words('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL), d AS (SELECT row_number() OVER () AS row, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
c AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0), t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, n_all), m AS (SELECT row, doc_id, 100 - 90 + (90 * len(w) * n_all) // l_all AS m FROM d, c),
s AS (SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""


def exact_sql() -> str:
    return """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


def runs_sql() -> str:
    """Stretches of equal five-word runs at one distance within a text; the CRC-32 bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: " + step + ")), 4294967295)"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {crc} AS h FROM documents), e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM e),
f AS (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS k FROM p, LATERAL (SELECT unnest(range(n - 4)) AS i) WHERE n >= 6),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i JOIN p ON p.doc_id = x.doc_id AND 4 * (y.i - x.i) <= p.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, start, length, period FROM r x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r), c AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS t FROM (SELECT doc_id, i, w[i + 1] AS x FROM p, LATERAL (SELECT unnest(range(n)) AS i)) t ANTI JOIN o ON o.doc_id = t.doc_id AND o.i = t.i GROUP BY t.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256 FROM p LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""


ORACLE_SQL = {"op1_license_scan": license_sql(), "op7_quality_rules": quality_sql(), "op8_chat": chat_sql(), "op9_decontaminate": decontaminate_sql(), "op11_periodic_runs": runs_sql(), "op12_lexical_search": search_sql(), "op13_exact_dedup": exact_sql()}
