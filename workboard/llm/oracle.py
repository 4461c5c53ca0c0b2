"""DuckDB SQL for the queries that SQL can express.

The others are beyond it: XXH64 (4, 10), trained models (2, 7), patterns with
lookarounds (3, 6) and merged diagonals (1). Tests compare them with brute force.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda x: x <> '')"


SPACE = r"[\x20\x09-\x0D]+"
PLAIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_OR_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_words('t', SPACE)} AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT *, len(ws) AS n, greatest(100, CAST(floor(0.2 * len(ws)) AS BIGINT)) + 1 AS too_long FROM w),
three AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS places
          FROM (SELECT r, i, array_to_string(ws[i + 1:i + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(n - 2)) AS i FROM n) x) y),
eight AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS places
          FROM (SELECT r, i, array_to_string(ws[i + 1:i + 8], ' ') AS g FROM (SELECT r, ws, unnest(range(n - 7)) AS i FROM n) x) y),
c3 AS (SELECT r, count(DISTINCT i + j) AS n FROM three, range(3) k(j) WHERE places > 1 GROUP BY r),
c8 AS (SELECT r, count(DISTINCT i + j) AS n FROM eight, range(8) k(j) WHERE places > 1 GROUP BY r),
long AS (SELECT DISTINCT r FROM (
           SELECT r, md5(array_to_string(ws[i + 1:i + too_long], ' ')) AS g
           FROM (SELECT r, ws, too_long, unnest(range(n - too_long + 1)) AS i FROM n SEMI JOIN c8 USING (r)) x) y
         GROUP BY r, g HAVING count(*) > 1)
SELECT doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
       n.n < 50 OR 100 * coalesce(c3.n, 0) > 50 * n.n AS base_failed,
       NOT (n.n < 50 OR 100 * coalesce(c3.n, 0) > 50 * n.n) AND 2 * coalesce(c8.n, 0) <= n.n
         AND n.r NOT IN (SELECT r FROM long) AS kept,
       CAST(coalesce(c8.n, 0) AS BIGINT) AS n_covered
FROM n LEFT JOIN c3 ON c3.r = n.r LEFT JOIN c8 ON c8.r = n.r"""

TOKENS = rf"""
WITH labelled AS (
  SELECT d.doc_id, d.source, d.lang, coalesce(d.text, '') AS t,
         d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic,
         d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0 AND doc_id IS NOT NULL) AS low
  FROM documents d),
final AS (SELECT source, lang, CASE WHEN low THEN regexp_replace(t, '[#*$%&|<>!]', '', 'g') ELSE t END AS t
          FROM labelled WHERE coalesce(low, false) OR NOT coalesce(toxic, false))
SELECT source, lang, 'space-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len({_words('t', SPACE)})) AS BIGINT) AS n_tokens,
       CAST(sum(length(t)) AS BIGINT) AS n_chars FROM final GROUP BY source, lang
UNION ALL
SELECT source, lang, 'plain-1', count(*),
       CAST(sum(len({_words('t', PLAIN_OR_UPPER)})) AS BIGINT), CAST(sum(length(t)) AS BIGINT)
FROM final GROUP BY source, lang"""

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", PLAIN)} AS ws
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(f"translate(text, '{UPPER}', '{LOWER}')", PLAIN)} AS ws FROM benchmark),
items AS (SELECT DISTINCT item, size, array_to_string(ws[i + 1:i + size], ' ') AS g
          FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS i
                FROM b WHERE len(ws) > 0) x),
sizes AS (SELECT DISTINCT size FROM items),
hits AS (SELECT DISTINCT y.r, y.i, y.size, t.item
         FROM (SELECT r, size, i, array_to_string(ws[i + 1:i + size], ' ') AS g
               FROM (SELECT d.r, d.ws, s.size, unnest(range(len(d.ws) - s.size + 1)) AS i FROM d, sizes s) x) y
         JOIN items t ON t.size = y.size AND t.g = y.g),
words AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(size)) AS j FROM hits) z GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS joined FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.joined, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN found ON found.r = d.r"""

def _escaped(text: str) -> str:
    text = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]", "<|endoftext|>"):
        text = f"replace({text}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return text


CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped('text')}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                ELSE 19 + length({_escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

ORACLE: dict[str, str] = {
    "op5_quality_rules": QUALITY,
    "op8_token_counts": TOKENS,
    "op9_benchmark_decontamination": CONTAMINATION,
    "op11_chat_formatting": CHAT,
}
