"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
u AS (SELECT rid, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i, len(w) AS m FROM d),
x AS (SELECT rid, n, i, string_agg(v, ' ') OVER (PARTITION BY rid, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS k, m FROM u, s WHERE m >= n),
h AS (SELECT rid, i, n, item FROM x JOIN p USING (n, k) WHERE i + n - 1 <= m),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS at FROM h) GROUP BY 1),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SPACE = "[\\x20\\x09-\\x0D]"
_STOCK = "all rights reserved|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|this site uses cookies|subscribe to our|sign up for our|enable javascript|click here to|skip to (?:main )?content|lorem ipsum|powered by|back to top|share on (?:facebook|twitter)"

_QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS v, unnest(range(len(ws))) AS i FROM (SELECT rid, {_WORDS.format("text")} AS ws FROM d)),
g AS (SELECT *, CASE WHEN lead(v, 2) OVER o IS NOT NULL THEN v || ' ' || lead(v) OVER o || ' ' || lead(v, 2) OVER o END AS win FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1 AS twice FROM g),
h AS (SELECT rid, length(v) AS chars, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS 2 PRECEDING) AS hit FROM f),
c AS (SELECT rid, count(*) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) FILTER (hit) AS n_repeat_words FROM h GROUP BY 1),
l AS (SELECT rid, line, array_to_string({_WORDS.format("line")}, '') AS joined, len({_WORDS.format("line")}) AS m, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS again
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
j AS (SELECT rid, again, length(joined) AS chars, again
  OR NOT regexp_matches(joined, '[A-Za-z]|[^\\x00-\\x7F]')
  OR 10 * (length(joined) - length(translate(joined, '#*$%&|<>{{}}~^=_\\', ''))) > strlen(joined)
  OR len(regexp_extract_all(line, '{_SPACE}(?:\\||/|»|›|·|>){_SPACE}')) >= 3
  OR (m >= 4 AND 2 * (length(line) - length(replace(line, '!', ''))) > m)
  OR (m >= 8 AND NOT regexp_matches(joined, '[a-z]') AND regexp_matches(joined, '[A-Z]'))
  OR regexp_matches(line, '(?i)\\b(?:{_STOCK})\\b') AS bad FROM l WHERE m > 0),
k AS (SELECT rid, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM j GROUP BY 1),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= CAST(0.3 AS DOUBLE) * word_chars AS kept FROM a
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) JOIN v USING (term) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, s GROUP BY term, docs),
p AS (SELECT rid, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w) * docs) // terms)))) AS share FROM t JOIN f USING (term) JOIN d USING (rid), s),
r AS (SELECT item_id, rid, doc_id, CAST(sum(share) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN d USING (rid) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""

_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"

_CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
h AS (SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### Other ' || replace({_ESCAPED.format("role")}, ': ', '\\: ') || ': ' END AS head,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS last FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length({_ESCAPED.format("text")}) + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL OR before NOT IN ('system', 'user', 'assistant') WHEN 'user' THEN before IS NULL OR before <> 'user' WHEN 'assistant' THEN coalesce(before = 'user', FALSE) ELSE FALSE END AND (NOT last OR role = 'assistant')) AS legal
FROM h GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op7_decontamination": _DECONTAMINATION, "op9_quality_rules": _QUALITY_RULES, "op11_ranked_search": _RANKED_SEARCH, "op13_chat_format": _CHAT_FORMAT}
