"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def decontaminate_sql(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM {documents}),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, w[s:s + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM d, (SELECT DISTINCT len(win) AS n FROM wins)),
met AS (SELECT doc_id, s, n, item_id FROM places JOIN wins ON w[s:s + n - 1] = win),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


URL_LISTS_SQL = r"""
WITH split AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(((page_id % 525600) * 7919 % 525600)::BIGINT) AS fetched_at,
         nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.$', ''), '^www\.', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS path
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS x,
                 regexp_extract(host, '^[^.]*\.(.*\..*)$', 1) AS parent
          FROM (SELECT DISTINCT host FROM split WHERE host IS NOT NULL)),
log AS (
  SELECT 'host' AS kind, host AS pattern, 'block' AS action, x % 200 AS day FROM hosts WHERE x % 5 = 0
  UNION SELECT 'host', host, 'remove', x % 200 + 60 FROM hosts WHERE x % 5 = 0
  UNION SELECT 'host', host, 'block', x % 200 + 120 FROM hosts WHERE x % 10 = 0
  UNION SELECT 'domain', parent, 'block', x % 300 FROM hosts WHERE x % 7 = 0 AND parent <> ''
  UNION SELECT 'path', host || '/en', 'allow', 100 FROM hosts WHERE x % 3 = 0
  UNION SELECT 'word', unnest(['cheap', 'pills']), 'block', 30),
entries AS (SELECT kind, pattern, action, TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS begins,
                   lead(TIMESTAMP '2024-01-01' + to_days(day::INTEGER)) OVER (PARTITION BY kind, pattern ORDER BY day) AS ends FROM log),
hits AS (
  SELECT s.page_id, s.url, e.kind, e.pattern, e.action,
         CASE e.kind WHEN 'path' THEN 4000 WHEN 'host' THEN 3000 WHEN 'domain' THEN 1000 ELSE 0 END + length(e.pattern) AS rank
  FROM split s JOIN entries e ON s.fetched_at >= e.begins AND s.fetched_at < coalesce(e.ends, TIMESTAMP '9999-12-31') AND e.action <> 'remove'
   AND CASE e.kind WHEN 'host' THEN s.host = e.pattern
                   WHEN 'domain' THEN s.host = e.pattern OR ends_with(s.host, '.' || e.pattern)
                   WHEN 'path' THEN s.path <> '' AND s.host || '/' || s.path = e.pattern
                   ELSE list_contains(regexp_extract_all(lower(s.host || '/' || s.path), '[a-z0-9]+'), e.pattern) END),
decided AS (
  SELECT page_id, url, count(*) AS n_active,
         arg_max(struct_pack(kind := kind, pattern := pattern, action := action), struct_pack(r := rank, a := action = 'allow', k := kind, p := pattern)) AS best
  FROM hits GROUP BY page_id, url)
SELECT s.page_id, s.url, s.host, s.fetched_at, coalesce(best.action, '') <> 'block' AS kept,
       CASE WHEN best IS NULL THEN 'unlisted' WHEN best.action = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict,
       best.kind AS kind, best.pattern AS pattern, coalesce(n_active, 0)::BIGINT AS n_active
FROM split s LEFT JOIN decided d ON s.page_id = d.page_id AND s.url = d.url"""


#: The characters that count as blank, as a DuckDB expression.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
told AS (SELECT k.*, first IS NOT NULL AND k.doc_id <> first AS gone FROM keyed k LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""


def _conversation_sql() -> str:
    """Left to right over a conversation's rows: the least ``cost || audit`` per automaton state (0 start, 1 after s,
    2 after u, 3 after a), six digits of cost before the audit so that texts order like pairs."""
    def add(v: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(left({v}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({v}, 7) || '{letter}')"

    def edit(states: str, letter: str) -> list[str]:
        out = []
        for x in states:
            out.append(f"CASE WHEN what IN ('k', 't') AND who = '{letter}' THEN {add('c' + x, '(what = chr(116))::INTEGER', 'K')} END")
            if letter != "s":
                out.append(f"CASE WHEN what IN ('k', 't') THEN {add('c' + x, '2 + (what = chr(116))::INTEGER', 'R')} END")
        return out

    steps = {"0": [], "1": edit("0", "s"), "2": edit("013", "u"), "3": edit("2", "a")}
    stepped = ", ".join(f"list_min([{', '.join([add('c' + q, '3', 'D'), *ways])}]) AS c{q}" for q, ways in steps.items())
    inserted = (f"c0, c1, list_min([c2, {add('c0', '2', 'I')}, {add('c1', '2', 'I')}, {add('c3', '2', 'I')}]) AS c2, "
                f"list_min([c3, {add('c2', '2', 'I')}, {add('c0', '4', 'II')}, {add('c1', '4', 'II')}]) AS c3")
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256))) % 20 AS fate FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, trim(text, {BLANKS}) AS core FROM damaged),
told AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS who,
    CASE WHEN core = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(core, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS what,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (what = 'b') AS blank, count(*) FILTER (what = 'd') AS duplicate, count(*) FILTER (what = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || who NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
least_edits AS (
  SELECT conv_id, 0::BIGINT AS i, '000000' AS c0, NULL::VARCHAR AS c1, '000002I' AS c2, '000004II' AS c3 FROM counted
  UNION ALL
  SELECT conv_id, i, {inserted} FROM (
    SELECT e.conv_id, t.i, {stepped} FROM least_edits e JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i + 1)),
best AS (SELECT c.*, list_min([c0, c3]) AS v FROM least_edits e JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.i),
letters AS (SELECT conv_id, unnest(string_split(substr(v, 7), '')) AS letter, generate_subscripts(string_split(substr(v, 7), ''), 1) AS p FROM best),
spelt AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o
          FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
kept AS (SELECT s.conv_id, s.p, s.letter, s.o, t.role, CASE WHEN s.letter = 'I' THEN '' ELSE t.text END AS text,
           max(CASE WHEN s.o = 1 AND s.letter = 'K' AND t.who = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS system
         FROM spelt s LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i WHERE s.letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                        || ':' || text, chr(10) ORDER BY p) AS text FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(CAST(left(v, 6) AS BIGINT), 0)::BIGINT AS cost, coalesce(substr(v, 7), '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLES: dict[str, str] = {
    "op12_conversation_repair": _conversation_sql(),
    "op13_line_dedup": LINE_DEDUP_SQL,
    "op2_url_lists": URL_LISTS_SQL,
    "op3_decontaminate": decontaminate_sql(),
}
