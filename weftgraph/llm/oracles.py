"""DuckDB SQL for the rows of those queries that SQL can state, written from their definitions and not from the operators."""

from __future__ import annotations

from weftgraph.llm.licenses import ALL, NOTICE, TEXT, THRESHOLD, TITLE, WINDOW, longest_run


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Sufficient cosines of the rows of a table (doc_id, line_no, span, most, terms).
_COSINES = f"""
  SELECT doc_id, line_no, span, license, score FROM (
    SELECT v.doc_id, v.line_no, v.span, t.license, t.template, round(sum(v.w * t.w) / max(v.norm), 6) AS score
    FROM (SELECT doc_id, line_no, span, most, term, tf * coalesce(idf, ln(n + 1) + 1) AS w, sqrt(sum((tf * coalesce(idf, ln(n + 1) + 1)) ** 2) OVER (PARTITION BY doc_id, line_no, span)) AS norm
          FROM (SELECT doc_id, line_no, span, most, term, count(*) AS tf FROM (SELECT doc_id, line_no, span, most, unnest(terms) AS term FROM {{}}) GROUP BY ALL) LEFT JOIN idf USING (term), n) v
    JOIN t_vec t ON t.term = v.term AND t.kind <= v.most GROUP BY ALL) WHERE score >= {THRESHOLD}
"""
_SPLIT = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"

LICENSES = f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({i}, {k}, {_quoted(a)}, {_quoted(b)})" for i, (k, a, b) in enumerate(ALL))}) t(template, kind, license, body)),
t_terms AS (SELECT template, kind, license, term, count(*) AS tf FROM (SELECT template, kind, license, unnest({_SPLIT.format("body")}) AS term FROM templates) GROUP BY ALL),
docs AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 8 = 0 THEN concat_ws('/', source, 'LICENSE') WHEN doc_id % 8 = 4 THEN concat_ws('/', source, lang, 'LICENSE') ELSE concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') END AS path, doc_id % 4 = 0 AS is_file FROM documents),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_SPLIT.format("text")}) AS term FROM docs) WHERE term IN (SELECT term FROM t_terms) GROUP BY term),
n AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT DISTINCT t.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM t_terms t LEFT JOIN df USING (term), n),
t_vec AS (SELECT template, kind, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM t_terms JOIN idf USING (term)),
lines AS (SELECT doc_id, is_file, line_no, terms, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM (SELECT doc_id, is_file, line_no, {_SPLIT.format("line")} AS terms FROM (SELECT doc_id, is_file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs)) WHERE len(terms) > 0),
first_units AS (SELECT doc_id, line_no, 1 AS span, CASE WHEN is_file THEN {TITLE} ELSE {NOTICE} END AS most, terms FROM lines UNION ALL SELECT doc_id, -1, 1, {TEXT}, {_SPLIT.format("text")} FROM docs WHERE is_file),
first_cos AS ({_COSINES.format("first_units")}),
run_units AS (SELECT a.doc_id, a.line_no, s.span, CASE WHEN a.is_file THEN {TITLE} ELSE {NOTICE} END AS most, (SELECT flatten(list(b.terms ORDER BY b.k)) FROM lines b WHERE b.doc_id = a.doc_id AND b.k BETWEEN a.k AND a.k + s.span - 1) AS terms FROM lines a JOIN (SELECT doc_id, max(k) AS k FROM lines GROUP BY doc_id) z ON z.doc_id = a.doc_id, (SELECT unnest(range(2, {WINDOW} + 1)) AS span) s WHERE a.k + s.span - 1 <= z.k AND a.doc_id NOT IN (SELECT doc_id FROM first_cos)),
few AS (SELECT * FROM run_units WHERE len(terms) <= {longest_run()}),
run_cos AS ({_COSINES.format("few")}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no, license, span) AS r FROM (SELECT * FROM first_cos UNION ALL SELECT * FROM run_cos)),
own AS (SELECT docs.doc_id, path, is_file, regexp_replace(path, '(^|/)[^/]*$', '') AS folder, license, score, line_no FROM docs LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)),
places AS (SELECT folder, arg_min(license, (-score, license)) AS license FROM own WHERE is_file AND license IS NOT NULL GROUP BY folder),
above AS (SELECT o.folder, arg_max(p.license, length(p.folder)) AS license FROM (SELECT DISTINCT folder FROM own) o JOIN places p ON p.folder = '' OR o.folder = p.folder OR starts_with(o.folder, p.folder || '/') GROUP BY o.folder)
SELECT doc_id, path, coalesce(own.license, above.license) AS license, score, line_no::INTEGER AS line_no, CASE WHEN own.license IS NOT NULL THEN CASE WHEN is_file THEN 'licence file' ELSE 'header' END WHEN above.license IS NOT NULL THEN 'inherited' END AS basis FROM own LEFT JOIN above USING (folder)
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE=|\[/ROLE\]"

CHATS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE WHEN regexp_matches(text, '{_CONTROL}') THEN regexp_replace(text, '(\\*(?:{_CONTROL}))', '\\\1', 'g') ELSE text END AS body,
  CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prior, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS k, sum(b - a) AS removed, count(*) AS spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, line FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
norm AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM lines),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
hot AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT text) AS n_docs FROM norm GROUP BY ALL) JOIN hosts USING (host) WHERE n_docs > 10 AND n_docs > 0.005 * n),
lost AS (SELECT doc_id, sum(len({_WORDS.format("line")})) AS n FROM norm JOIN hot USING (host, key) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_lost_words <= 0.7 * n_words AS kept FROM m
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
runs AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM runs GROUP BY ALL),
g AS (SELECT lang, source, v, coalesce(sums.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(runs.n, 0) AS n, 1 + (1000000000 * (coalesce(runs.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000 * (kept.n + 5)) // (langs.total + 5 * langs.v) AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN runs ON runs.lang = g.lang AND runs.source = g.source AND runs.term = kept.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""

TRIE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, {'role': role, 'text': text} AS turn, octet_length(encode(text)) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (SELECT DISTINCT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM t UNION ALL
  SELECT c, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM bits WHERE k < 8 * length(s))),
h AS (SELECT c, c - c % 5 AS base, xor(v, 4294967295::BIGINT) % 9 AS h FROM bits WHERE k = 8 * length(s)),
r AS (SELECT h.c, t.i AS k, turn, bytes FROM h JOIN t ON t.c = h.base WHERE t.i < h.h UNION ALL SELECT t.c, 1000000 + t.i, turn, bytes FROM t JOIN h USING (c) WHERE t.i >= h.h),
l AS (SELECT c, list(turn ORDER BY k) AS turns, list(bytes ORDER BY k) AS sizes FROM (SELECT h.c, k, turn, bytes FROM r RIGHT JOIN h USING (c)) WHERE turn IS NOT NULL GROUP BY c),
seq AS (SELECT h.c, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM h LEFT JOIN l USING (c)),
m AS (SELECT c, d, turns[1:d] AS prefix, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM seq)),
node AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.prefix = node.prefix),
sub AS (SELECT a.d, a.prefix, sum(b.saved) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM full_node a JOIN (SELECT *, unnest(range(0, d + 1)) AS up FROM full_node) b ON b.up = a.d AND b.prefix[1:a.d] = a.prefix GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sub ON sub.d = n.d AND sub.prefix = n.prefix LEFT JOIN node p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
"""
