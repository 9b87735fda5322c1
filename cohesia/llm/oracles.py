"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reach(nodes: str, links: str) -> str:
    """CTE comp(id, component): the smallest id that each node reaches over links(x, y), both ways."""
    return f"""
reach AS (SELECT id, id AS c FROM {nodes} UNION SELECT r.id, l.y FROM reach r JOIN {links} l ON l.x = r.c),
comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * k >= 80 * (a.n + b.n - k)), {_reach("t", "l")}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, id = component AS kept FROM comp LEFT JOIN n USING (id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS MATERIALIZED (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM t WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(v, v) > 0),
l AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98), {_reach("t", "l")},
d AS (SELECT x AS id, count(*) AS n FROM l GROUP BY x)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept FROM comp LEFT JOIN d USING (id)"""

_MARK = "'^ {0,3}(?:> ?)+'"
_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_PARTS = r"unnest(list_concat([text], list_concat(string_split_regex(text, '\n\s*\n'), string_split(text, chr(10)))))"
QUOTES = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS ls FROM conversations),
raw AS (SELECT conv_id, turn, role, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM m),
ln AS MATERIALIZED (SELECT conv_id, turn, role, i, length(regexp_replace(regexp_extract(line, {_MARK}), '[^>]', '', 'g')) AS level, regexp_replace(line, {_MARK}, '') AS body FROM raw),
nx AS MATERIALIZED (SELECT *, coalesce(lead(level) OVER w, 0) AS after, coalesce(lag(level) OVER w, -1) AS before FROM ln WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
own AS MATERIALIZED (SELECT conv_id, turn, any_value(role) AS role, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (after > 0 AND regexp_matches(body, '\\bwrote:\\s*$'))), ''), '^\\s+|\\s+$', '', 'g') AS text,
  count(*) FILTER (level > 0 AND level <> before) AS n_quotes, max(level) AS max_level FROM nx GROUP BY conv_id, turn),
un AS (SELECT conv_id, turn, {_NORMAL.format(_PARTS)} AS u FROM own),
ow AS MATERIALIZED (SELECT conv_id, u, min(turn) AS owner FROM un WHERE length(u) >= 8 GROUP BY ALL),
qs AS (SELECT conv_id, turn, i, level, body, sum(CASE WHEN level <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS no FROM nx WHERE level > 0),
qu AS (SELECT DISTINCT conv_id, turn, no, level, u FROM (SELECT conv_id, turn, no, level, {_NORMAL.format('body')} AS u FROM qs
  UNION ALL SELECT conv_id, turn, no, any_value(level), {_NORMAL.format("string_agg(body, ' ' ORDER BY i)")} FROM qs GROUP BY conv_id, turn, no) WHERE length(u) >= 8),
hit AS (SELECT q.conv_id, q.turn, level, owner, sum(length(q.u)) AS chars FROM qu q JOIN ow o ON o.conv_id = q.conv_id AND o.u = q.u AND owner < q.turn GROUP BY ALL),
par AS MATERIALIZED (SELECT conv_id, turn, arg_max(owner, (-level, chars, owner)) AS parent_turn FROM hit GROUP BY ALL),
up AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM own UNION ALL SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN par p ON p.conv_id = u.conv_id AND p.turn = u.thread),
top AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT o.conv_id, o.turn, role, text, n_quotes, max_level, coalesce(parent_turn, -1) AS parent_turn, thread, CAST(depth AS BIGINT) AS depth FROM own o JOIN top USING (conv_id, turn) LEFT JOIN par USING (conv_id, turn)"""

HARD_NEGATIVES = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5"""
