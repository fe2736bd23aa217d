"""SQL for the repair of conversations: the same costs by going through the rows with the best result for each state of the roles."""

from __future__ import annotations

from phylospark.llm.merkle_sql import crc32

_SPACE = r"[\x20\x09-\x0D]"


def _with(x: str, cost: str, edit: str, line: str = "''") -> str:
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {line}}}"


def _least(*xs: str) -> str:
    return f"least({', '.join(xs)})"


_ASK, _ANSWER = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
#: Insertions before a row: two at most are of use.
_U = _least("u", _with("n", "2", "I", _ASK), _with("s", "2", "I", _ASK), _with("a", "2", "I", _ASK))
_A = _least("a", _with("u", "2", "I", _ANSWER), _with("n", "4", "II", f"{_ASK} || {_ANSWER}"), _with("s", "4", "II", f"{_ASK} || {_ANSWER}"))
_FROM = "least(n, s, ai)"
_KEEP = "chr(10) || role || ':' || text"


def _when(condition: str, x: str) -> str:
    return f"CASE WHEN {condition} THEN {x} ELSE {{'c': 1000000000, 'a': '', 't': ''}} END"


SQL = rf"""
    WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
    e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d, (SELECT unnest(range(2)) AS i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM e),
    g AS (SELECT *, left(role, 1) AS x, regexp_replace(text, '{_SPACE}', '', 'g') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
    h AS (SELECT *, bare = '' AS blank, again AND bare <> '' AS duplicate, bare <> '' AND NOT again AND NOT regexp_matches(bare, '[.!?]$') AS truncated FROM g),
    k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (before IS NOT NULL AND (before || x) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM h GROUP BY conv_id),
    p AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': ''}} AS n, {{'c': 1000000000, 'a': '', 't': ''}} AS s, {{'c': 1000000000, 'a': '', 't': ''}} AS u, {{'c': 1000000000, 'a': '', 't': ''}} AS a FROM k
        UNION ALL
        SELECT conv_id, i, {_with("n", "3", "D")}, {_least(_with("s", "3", "D"), _when("not gone AND x = 's'", _with("n", "more", "K", _KEEP)))},
            {_least(_with("ui", "3", "D"), _when("not gone AND x = 'u'", _with(_FROM, "more", "K", _KEEP)), _when("not gone", _with(_FROM, "2 + more", "R", f"{_ASK} || text")))},
            {_least(_with("ai", "3", "D"), _when("not gone AND x = 'a'", _with("ui", "more", "K", _KEEP)), _when("not gone", _with("ui", "2 + more", "R", f"{_ANSWER} || text")))}
        FROM (SELECT p.conv_id, h.i, n, s, {_U} AS ui, {_A} AS ai, h.x, h.role, h.text, h.blank OR h.duplicate AS gone, CASE WHEN h.truncated THEN 1 ELSE 0 END AS more
            FROM p JOIN h ON h.conv_id IS NOT DISTINCT FROM p.conv_id AND h.i = p.i + 1)),
    z AS (SELECT p.conv_id, {_least("n", _with("s", "4", "II", f"{_ASK} || {_ANSWER}"), _with("u", "2", "I", _ANSWER), "a")} AS b FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.rows)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
