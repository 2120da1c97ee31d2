"""SQL twins, in DuckDB's dialect, of the queries that SQL can express."""

from __future__ import annotations

from ebbline.llm.chat import SYSTEM, TURNS_PER_PART
from ebbline.llm.common import LOWER, UPPER
from ebbline.llm.licenses import CONFIDENCE, _spaced, build_rules


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses() -> str:
    rules = ",\n".join(
        f"({i}, {_quoted(r.label)}, {_quoted(' ' + _spaced(r.keyword))}, {_quoted(' (' + _spaced(r.pattern) + ') ')}, {r.priority}, {r.base})"
        for i, r in enumerate(build_rules())
    )
    confidence = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())
    return rf"""
WITH rules(number, label, keyword, pattern, priority, base) AS (VALUES {rules}),
gapped AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS gap FROM documents),
normal AS (SELECT row_id, doc_id, CASE WHEN gap = '' THEN '' ELSE ' ' || gap || ' ' END AS words FROM gapped),
marked AS (
  SELECT n.row_id, r.*, string_split(trim(regexp_replace(n.words, r.pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS parts
  FROM normal n JOIN rules r ON contains(n.words, r.keyword)),
places AS (
  SELECT row_id, number, label, priority, base,
    unnest(list_filter(list_transform(range(len(parts)), lambda i: CASE WHEN parts[i + 1][1] = chr(1) THEN i END), lambda x: x IS NOT NULL)) AS first,
    unnest(list_filter(list_transform(range(len(parts)), lambda i: CASE WHEN parts[i + 1][-1] = chr(2) THEN i END), lambda x: x IS NOT NULL)) AS last
  FROM marked),
kept AS (
  SELECT * FROM places d WHERE NOT EXISTS (
    SELECT 1 FROM places e WHERE e.row_id = d.row_id AND e.last >= d.last AND e.priority >= d.priority
      AND (e.first, -e.last, -e.priority, e.number) < (d.first, -d.last, -d.priority, d.number))),
based AS (
  SELECT row_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places WHERE base GROUP BY row_id),
labelled AS (
  SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row_id, label FROM kept UNION ALL SELECT row_id, label FROM places WHERE base) GROUP BY row_id),
scored AS (SELECT row_id, max(CAST(CASE priority {confidence} END AS DOUBLE)) AS score FROM kept GROUP BY row_id)
SELECT doc_id, (length(words) - length(replace(words, ' ', ''))) // 2 AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM normal LEFT JOIN based USING (row_id) LEFT JOIN labelled USING (row_id) LEFT JOIN scored USING (row_id)
"""


def _components(width: int) -> str:
    """The sets of shingles of so many words, and the smallest id reachable from each by links."""
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
    ELSE list_transform(range(1, greatest(len(words) - {width - 1}, 1) + 1), lambda i: array_to_string(words[i:i + {width - 1}], ' ')) END) AS shingles FROM split),
tokens AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
placed AS (
  SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id
  FROM sets s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) c ON c.x = s.doc_id)
"""


NGRAM_JOIN = f"{_components(5)} SELECT * FROM placed"
MINHASH_DEDUP = f"{_components(4)} SELECT *, doc_id = component_id AS kept FROM placed"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM turns),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> '{SYSTEM}'),
views AS (
  SELECT p.conv_id, speaker, place // {TURNS_PER_PART} AS part, place, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text, role = speaker AS own,
    CASE WHEN role = '{SYSTEM}' THEN '<|{SYSTEM}|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' ||
      replace(replace(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g'), chr(10), '\n'), chr(13), '\r') || '|>' END || chr(10) AS header
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
lines AS (
  SELECT *, header || text || chr(10) || '<|end|>' || chr(10) AS line,
    sum(length(header) + length(text) + 9) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) - length(text) - 9 AS begin FROM views)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(line, '' ORDER BY place) AS rendered,
  string_agg(CAST(CAST(begin AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin AS BIGINT) + length(text) AS VARCHAR), ',' ORDER BY place) FILTER (own) AS masked
FROM lines GROUP BY conv_id, speaker, part
"""

TOP_K = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM sound WHERE vec_id % 50 = 0) q JOIN sound c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, four bits at a time; entry k of the table is the remainder of k (fixed values)."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    half = "xor([" + ", ".join(f"{v}::BIGINT" for v in table) + "][(xor({c}, {b}) & 15) + 1], ({c}) >> 4)"
    low = half.format(c="c", b="b")
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {half.format(c=low, b='(b >> 4)')}))"


PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
members AS (
  SELECT conv_id, conv_id - conv_id % 20 AS founder, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
joined AS (
  SELECT m.conv_id, 0 AS part, t.place, t.role, t.text FROM members m JOIN turns t ON t.conv_id = m.founder AND t.place < m.h
  UNION ALL
  SELECT m.conv_id, 1 AS part, t.place, t.role, t.text FROM members m JOIN turns t ON t.conv_id = m.conv_id AND t.place >= m.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM joined),
prefixes AS (
  SELECT conv_id, depth, array_agg([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM placed
  UNION ALL SELECT conv_id, 0, [], 0 FROM members),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM prefixes),
nodes AS (SELECT node, depth, count(*) AS n_convs, any_value(words) AS words FROM named GROUP BY node, depth),
ends AS (
  SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM named) WHERE depth = last GROUP BY node, depth),
parents AS (
  SELECT n.node, n.depth, p.node AS parent FROM nodes n JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY parent, depth),
totals AS (
  SELECT a.node, a.depth, sum(CAST(k.n_children IS NULL AS BIGINT)) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN named a ON a.conv_id = n.node AND a.depth <= n.depth
  LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth GROUP BY a.node, a.depth)
SELECT n.node AS conv_id, n.depth, p.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN totals t USING (node, depth) LEFT JOIN parents p USING (node, depth) LEFT JOIN kids k USING (node, depth) LEFT JOIN ends e USING (node, depth)
"""


def _draw(k: int) -> str:
    return f"CAST('0x' || substr(digest, {8 * k - 7}, 8) AS BIGINT)"


FILL_MIDDLE = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, {_draw(1)} % (len(tokens) + 1) AS one, {_draw(2)} % (len(tokens) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_draw(3)} % 100 >= 90 THEN 'plain'
      WHEN {_draw(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM split),
parted AS (
  SELECT *, array_to_string(tokens[1:least(one, two)], '') AS prefix, array_to_string(tokens[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(tokens[greatest(one, two) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parted
"""
