"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .mixing_settings import BUDGET_PERCENT, DOMAINS, EPOCHS, SEED, WEIGHTS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"


def _weight(column: str, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.get(level, {}).items())
    return f"CASE {column} {cases} ELSE 1 END" if cases else "1"


def _level(parents: list[str], name: str, from_: str) -> str:
    """Shares each parent's budget; from_ has the parents, name, cap and budget."""
    by = f"PARTITION BY {', '.join(parents)} " if parents else ""
    keys = ", ".join([*parents, name])
    return f"""(SELECT {keys}, CASE WHEN whole OR open_w = 0 THEN cap ELSE w * (budget - given) // open_w END AS budget FROM (
SELECT *, coalesce(sum(CASE WHEN whole THEN cap END) OVER ({by}), 0) AS given, coalesce(sum(CASE WHEN NOT whole THEN w END) OVER ({by}), 0) AS open_w FROM (
SELECT *, cap * rest_w <= w * (budget - caps) AS whole FROM (
SELECT *, coalesce(sum(cap) OVER ({by}ORDER BY CASE WHEN w > 0 THEN cap / w::DOUBLE ELSE 0 END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER ({by}ORDER BY CASE WHEN w > 0 THEN cap / w::DOUBLE ELSE 0 END, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM (
SELECT *, {_weight(name, name)} AS w FROM {from_})))))"""


_NUMBER = "coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT), 0) % 3"
OP2 = f"""
WITH d AS (SELECT doc_id, CASE {_NUMBER} WHEN 0 THEN '{DOMAINS[0]}' WHEN 1 THEN '{DOMAINS[1]}' ELSE '{DOMAINS[2]}' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
c3 AS (SELECT domain, lang, source, CASE WHEN {_weight("source", "source")} > 0 THEN tokens * {EPOCHS} ELSE 0 END AS cap FROM leaf),
c2 AS (SELECT domain, lang, CASE WHEN {_weight("lang", "lang")} > 0 THEN CAST(sum(cap) AS BIGINT) ELSE 0 END AS cap FROM c3 GROUP BY domain, lang),
c1 AS (SELECT domain, CASE WHEN {_weight("domain", "domain")} > 0 THEN CAST(sum(cap) AS BIGINT) ELSE 0 END AS cap FROM c2 GROUP BY domain),
one AS (SELECT domain, cap, (SELECT least(CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT} // 100, CAST(sum(tokens) AS BIGINT) * {EPOCHS}) FROM leaf) AS budget FROM c1),
b1 AS {_level([], "domain", "one")},
two AS (SELECT domain, lang, cap, b1.budget FROM c2 JOIN b1 USING (domain)),
b2 AS {_level(["domain"], "lang", "two")},
three AS (SELECT domain, lang, source, cap, b2.budget FROM c3 JOIN b2 USING (domain, lang)),
b3 AS {_level(["domain", "lang"], "source", "three")},
split AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
p AS (SELECT d.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', CAST(whole AS BIGINT), ':', doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS in_prefix FROM d JOIN split USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, in_prefix, CAST(whole + CAST(in_prefix AS BIGINT) AS BIGINT) AS copies FROM p
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS phrase FROM b WHERE len(w) > 0),
kinds AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM d, kinds WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.phrase = x.phrase),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LOWERED", _LOWER)

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS i, x FROM d WHERE length(x) >= 200),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM p),
f AS (SELECT s, min(doc_id * 1000000000 + i) AS earliest FROM s GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM s JOIN f USING (s) WHERE doc_id * 1000000000 + i > earliest),
g AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM r) GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS nth FROM g),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN nth = 1 THEN substr(x, 1, 2 * a) ELSE '' END || CASE WHEN next_a IS NULL THEN substr(x, 2 * b + 1) ELSE substr(x, 2 * b + 1, 2 * (next_a - b)) END, '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) m USING (doc_id)
"""

_MARKS = r"'^(?:[ \t]{0,3}>)+'"
OP10 = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
l AS (SELECT *, string_split(t, chr(10)) AS lines, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_MARKS}))) > 0 AS quotes FROM m),
o AS (SELECT *, CASE WHEN quotes THEN regexp_replace(regexp_replace(array_to_string(list_filter(lines, lambda x, i: NOT regexp_matches(x, {_MARKS}) AND NOT (regexp_matches(x, '(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$') AND coalesce(regexp_matches(lines[i + 1], {_MARKS}), false))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE t END AS own FROM l),
q AS (SELECT r, conv_id, turn, unnest(range(1, len(lines) + 1)) AS p, unnest(lines) AS x FROM o WHERE quotes AND turn IS NOT NULL),
v AS (SELECT *, length(regexp_replace(regexp_extract(x, {_MARKS}), '[^>]', '', 'g')) AS level, substr(x, length(regexp_extract(x, {_MARKS})) + 1) AS body FROM q),
w AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run, sum(CASE WHEN regexp_matches(body, '\S') THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY p) THEN 1 ELSE 0 END AS fresh FROM v)),
u AS (SELECT r, conv_id, turn, level, string_agg(body, chr(10) ORDER BY p) AS unit FROM w WHERE level > 0 GROUP BY r, conv_id, turn, level, run UNION ALL SELECT r, conv_id, turn, level, string_agg(body, chr(10) ORDER BY p) AS unit FROM w WHERE level > 0 AND regexp_matches(body, '\S') GROUP BY r, conv_id, turn, level, run, part UNION ALL SELECT r, conv_id, turn, level, body FROM w WHERE level > 0),
passage AS (SELECT DISTINCT r, conv_id, turn, level, unit FROM (SELECT r, conv_id, turn, level, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM u) WHERE unit <> ''),
source AS (SELECT DISTINCT conv_id, turn, unit FROM (SELECT conv_id, turn, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM (SELECT conv_id, turn, unnest([own] || regexp_split_to_array(own, '\n\s*\n') || string_split(own, chr(10))) AS unit FROM o WHERE turn IS NOT NULL)) WHERE unit <> ''),
linked AS (SELECT p.r, p.conv_id, p.turn, p.level, max(s.turn) AS source FROM passage p LEFT JOIN source s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.unit = s.unit AND s.turn < p.turn GROUP BY p.r, p.conv_id, p.turn, p.level, p.unit),
link AS (SELECT r, conv_id, turn, max(CASE WHEN source IS NOT NULL THEN {{'near': -level, 'source': source}} END).source AS reply_to, count(*) AS n_quotes, count(source) AS n_linked FROM linked GROUP BY r, conv_id, turn),
up AS (SELECT conv_id, turn, max(reply_to) AS parent FROM link WHERE reply_to IS NOT NULL GROUP BY conv_id, turn),
way(conv_id, turn, root, depth, path) AS (SELECT conv_id, turn, parent, 1, [turn] FROM up UNION ALL SELECT way.conv_id, way.turn, up.parent, depth + 1, [way.root] || path FROM way JOIN up ON way.conv_id IS NOT DISTINCT FROM up.conv_id AND way.root = up.turn),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) AS place FROM (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth, arg_max(path, depth) AS path FROM way GROUP BY conv_id, turn))
SELECT o.conv_id, o.turn, o.role, link.reply_to, coalesce(top.root, o.turn) AS root, CAST(coalesce(top.depth, 0) AS BIGINT) AS depth, CAST(coalesce(top.place, 0) AS BIGINT) AS place, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, own, concat('<|', coalesce(role, ''), '|>', chr(10), own, chr(10)) AS chat
FROM o LEFT JOIN link USING (r) LEFT JOIN top ON o.conv_id IS NOT DISTINCT FROM top.conv_id AND o.turn = top.turn AND link.reply_to IS NOT NULL
"""

#: Every message but a conversation's first quotes the one two turns before it, if there is one, else the one before it.
QUOTED = """(SELECT c.conv_id, c.turn, c.role, CASE WHEN s.text IS NULL THEN c.text ELSE concat('> ', replace(s.text, chr(10), chr(10) || '> '), chr(10), coalesce(c.text, '')) END AS text
FROM conversations c LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) s ON c.conv_id = s.conv_id AND s.turn = CASE WHEN c.turn >= 2 THEN c.turn - 2 WHEN c.turn = 1 THEN 0 END)"""
OP10_QUOTED = OP10.replace("FROM conversations)", f"FROM {QUOTED} planted)")
