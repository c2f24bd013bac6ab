"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

from lumenfold.llm.chat_format import CLOSE, CONTROL, OPEN

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS words FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS words FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, least(13, len(words)) AS n, array_to_string(words[k:k + least(13, len(words)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS k FROM i WHERE len(words) > 0)),
p AS (SELECT r, n, k, array_to_string(words[k:k + n - 1], ' ') AS g
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
h AS (SELECT DISTINCT r, item, k, n FROM p JOIN w USING (n, g)),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

NEAR_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared_pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM shared_pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (WITH RECURSIVE q(a, b) AS (SELECT a, b FROM e UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a) SELECT a, min(b) AS least FROM q GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""


def _escaped(column: str) -> str:
    """Length of an escaped text: one more for each backslash and each control string."""
    more = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL)]
    return f"(length({column}) + {' + '.join(more)})"


CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum({len(OPEN) + len(CLOSE) + 2} + {_escaped('role')} + {_escaped('text')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""

VECTOR_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM p
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
"""
