"""DuckDB SQL for the queries of this subpackage that it can state."""

from __future__ import annotations

_PLAIN = r"trim(regexp_replace(lower(substring(line, length(marks) + 1)), '[^\p{L}\p{N}]+', ' ', 'g'))"

#: The definition itself: every string of 100 bytes (200 hexadecimal digits) and the first place where it starts.
#: Runs of removed bytes are the gaps and islands of the strings' starts; doc_id is unique in the table.
OP9_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, unnest(range(greatest(n_bytes - 99, 0))) AS place, h FROM n),
s AS (SELECT doc_id, place, substr(h, 2 * place + 1, 200) AS string FROM w),
f AS (SELECT string, min({'doc_id': doc_id, 'place': place}) AS first FROM s GROUP BY string HAVING count(*) > 1),
g AS (SELECT s.doc_id, s.place FROM s JOIN f ON s.string = f.string WHERE s.doc_id <> f.first.doc_id OR s.place <> f.first.place),
m AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) <= 100 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM m),
spans AS (SELECT doc_id, run, min(place) AS lo, max(place) + 100 AS hi FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(n.h, 2 * lo + 1, 2 * (coalesce(hi, n_bytes) - lo)), '' ORDER BY lo) AS h FROM gaps JOIN n ON n.doc_id = gaps.doc_id GROUP BY gaps.doc_id),
told AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN told ON told.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

#: Every line of every message, its passages, the messages that say them, votes by level, and the chain of replies.
OP2_QUOTES = rf"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
mail AS (SELECT conv_id AS thread, turn AS seq, role, concat_ws(chr(10), '>> ' || replace(two, chr(10), chr(10) || '>> '), '> ' || replace(one, chr(10), chr(10) || '> '), text) AS text FROM turns),
m AS (SELECT *, row_number() OVER (PARTITION BY thread, seq ORDER BY text NULLS FIRST, role NULLS FIRST) - 1 AS tie, row_number() OVER (PARTITION BY thread ORDER BY seq, text NULLS FIRST, role NULLS FIRST) - 1 AS p,
  string_split_regex(coalesce(text, ''), '\r?\n|\r') AS parts FROM (SELECT DISTINCT thread, seq, role, text FROM mail WHERE thread IS NOT NULL AND seq IS NOT NULL)),
cells AS (SELECT thread, p, seq, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM m),
marked AS (SELECT *, regexp_extract(line, '^(\s*>[\s>]*)', 1) AS marks FROM cells),
l AS (SELECT * FROM (SELECT thread, p, seq, pos, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, {_PLAIN} AS plain FROM marked) WHERE plain <> ''),
q AS (SELECT DISTINCT thread, p, seq, level, plain, length(plain) AS size FROM l WHERE level > 0),
o AS (SELECT DISTINCT thread, p, seq, plain FROM l WHERE level = 0),
direct AS (SELECT q.thread, q.p, q.level, q.plain, q.size, o.p AS h FROM q JOIN o ON o.thread = q.thread AND o.plain = q.plain AND o.seq < q.seq),
fresh AS (SELECT *, CASE WHEN pos - lag(pos) OVER w = 1 AND level = lag(level) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY thread, p ORDER BY pos)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY thread, p ORDER BY pos) AS run FROM fresh),
runs AS (SELECT thread, p, seq, run, level, string_agg(plain, ' ' ORDER BY pos) AS whole FROM numbered GROUP BY ALL),
held AS (SELECT a.thread, a.p, a.run, max(b.p) AS h FROM runs a JOIN runs b ON a.thread = b.thread AND a.whole = b.whole AND b.level = 0 AND b.seq < a.seq WHERE a.level > 0 GROUP BY ALL),
passage AS (SELECT n.thread, n.p, n.level, n.plain, length(n.plain) AS size, max(held.h) AS h FROM numbered n JOIN held ON n.thread = held.thread AND n.p = held.p AND n.run = held.run
  WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.thread = n.thread AND d.p = n.p AND d.level = n.level AND d.plain = n.plain) GROUP BY ALL),
f AS (SELECT * FROM direct UNION ALL SELECT * FROM passage),
votes AS (SELECT thread, p, level, h, sum(size) AS held FROM f GROUP BY ALL),
best AS (SELECT thread, p, level, h FROM (SELECT *, row_number() OVER (PARTITION BY thread, p, level ORDER BY held DESC, h DESC) AS n FROM votes) WHERE n = 1),
named AS (SELECT best.*, level || ':' || m.seq || '/' || m.tie AS link FROM best JOIN m ON m.thread = best.thread AND m.p = best.h),
x AS (SELECT m.thread, m.p, (SELECT h FROM best b WHERE b.thread = m.thread AND b.p = m.p AND level = 1) AS parent,
  coalesce((SELECT string_agg(link, ' ' ORDER BY level) FROM named b WHERE b.thread = m.thread AND b.p = m.p), '') AS links,
  (SELECT count(*) FROM q WHERE q.thread = m.thread AND q.p = m.p) AS n_quoted, (SELECT count(*) FROM (SELECT DISTINCT level, plain FROM f WHERE f.thread = m.thread AND f.p = m.p)) AS n_linked FROM m),
d AS (SELECT thread, p, p AS root, 0 AS depth FROM x WHERE parent IS NULL UNION ALL SELECT x.thread, x.p, d.root, d.depth + 1 FROM x JOIN d ON x.thread = d.thread AND x.parent = d.p),
own AS (SELECT thread, seq, role, text, regexp_replace(coalesce(array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\r?\n|\r'), lambda y: NOT regexp_matches(y, '^\s*>')), chr(10)), ''), '^\s+|\s+$', '', 'g') AS clean FROM mail)
SELECT m.thread AS conv_id, m.seq AS turn, CAST(m.tie AS INTEGER) AS tie, m.p AS position, pa.seq AS parent, CAST(pa.tie AS INTEGER) AS parent_tie, r.seq AS root, CAST(r.tie AS INTEGER) AS root_tie, CAST(d.depth AS BIGINT) AS depth,
  x.links, x.n_quoted, x.n_linked, m.role, (SELECT any_value(clean) FROM own WHERE own.thread = m.thread AND own.seq = m.seq AND own.text IS NOT DISTINCT FROM m.text) AS text
FROM m JOIN x ON x.thread = m.thread AND x.p = m.p JOIN d ON d.thread = m.thread AND d.p = m.p JOIN m r ON r.thread = m.thread AND r.p = d.root LEFT JOIN m pa ON pa.thread = m.thread AND pa.p = x.parent
UNION ALL SELECT thread, seq, 0, NULL, NULL, NULL, seq, 0, 0, '', 0, 0, role, clean FROM own WHERE thread IS NULL OR seq IS NULL
"""

#: CRC-32 of UTF-8 bytes by the usual table, which is worked out first: a table named `crc` and an expression on a column.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def _crc32(column: str) -> str:
    hexed = f"hex(encode({column}))"
    octets = f"list_transform(range(length({hexed}) // 2), lambda j: CAST('0x' || substr({hexed}, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295)"


#: Every prefix of every conversation, rebuilt; a node is a list of turns, and a subtree all nodes that begin with it.
OP11_PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, turns FROM t),
hashed AS (SELECT conv_id, turns, CAST({_crc32('name')} % 4 AS BIGINT) AS h FROM k, crc),
s AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, length(a.turns))) AS turns FROM hashed a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, turns, unnest(range(length(turns) + 1)) AS depth FROM s),
m AS (SELECT conv_id, depth, list_slice(turns, 1, depth) AS node, depth = length(turns) AS ends FROM p),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
c AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[n.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n LEFT JOIN c ON c.node = n.node),
up AS (SELECT node, n_children, saved, unnest(range(depth + 1)) AS depth FROM w),
sub AS (SELECT list_slice(node, 1, depth) AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1)
SELECT w.conv_id, w.depth, par.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves, sub.saved_tokens, w.ends_sha256
FROM w JOIN sub ON sub.node = w.node LEFT JOIN n par ON w.depth > 0 AND par.node = list_slice(w.node, 1, w.depth - 1)
"""

#: Buckets are worked out once for each distinct word; ids are unique in the table.
OP12_RESAMPLING = f"""
WITH {_CRC_TABLE},
w AS (SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
b AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc),
f AS (SELECT side, doc_id, bucket FROM w JOIN b ON b.word = w.word),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
v AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g ON g.bucket = f.bucket WHERE side = 0 GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS fit FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS total FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * total // 100 THEN place END AS rank FROM z
"""

#: Sets of distinct shingles, one of each; every two that share a shingle are compared, and links are followed to their least id.
OP13_MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN length(words) = 0 THEN [] WHEN length(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, length(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))) END AS shingles FROM w),
k AS (SELECT doc_id, length(shingles) AS n, sha256(array_to_string(shingles, chr(10))) AS name, shingles FROM s),
one AS (SELECT name, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM k WHERE n > 0 GROUP BY name),
g AS (SELECT id, n, unnest(shingles) AS shingle FROM one),
p AS (SELECT a.id AS u, b.id AS v, a.n + b.n AS both_sizes, count(*) AS inter FROM g a JOIN g b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT u, v FROM p WHERE 100 * inter >= 85 * (both_sizes - inter)),
links AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT id AS node, id AS seen FROM one UNION SELECT links.v, r.seen FROM r JOIN links ON links.u = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id, coalesce(c.component_id, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN one ON one.name = k.name AND k.n > 0 LEFT JOIN c ON c.node = one.id
"""
