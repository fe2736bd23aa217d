"""SQL for the fingerprints of documents and of their edited texts."""

from __future__ import annotations

from phylospark.llm.imatch import DIGITS, LEAST, LIMITS, MARK, MOST, NONE, OF

_LIMITS = "[" + ", ".join(f"{{'a': {at}, 'l': '{limit}'}}" for at, limit in LIMITS) + "]"
_PARTS = f"list_transform(range({len(LIMITS)}), lambda k: {{{{'x': substr({{a}}, CAST(k * {DIGITS} + 1 AS INT), {DIGITS}), 'y': substr({{b}}, CAST(k * {DIGITS} + 1 AS INT), {DIGITS})}}}})"


def _likeness(a: str, b: str) -> str:
    pairs = _PARTS.format(a=a, b=b)
    some = f"list_filter({pairs}, lambda p: p.x <> '{NONE}' OR p.y <> '{NONE}')"
    return f"len(list_filter({some}, lambda p: p.x = p.y))::DOUBLE / len({some})"


SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS pos FROM documents),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS words FROM d),
    f AS (SELECT term FROM (SELECT unnest(words) AS term FROM w) GROUP BY term
        HAVING count(*) * {OF} BETWEEN (SELECT count(*) FROM d) * {LEAST} AND (SELECT count(*) FROM d) * {MOST}),
    lex AS (SELECT term, sha256(term) AS digest FROM f),
    e AS (SELECT a.pos, left(a.text, a.n_chars - a.n_chars // 2) || left(b.text, a.n_chars // 2) AS text FROM d a JOIN d b ON b.pos = (a.pos + 1) % (SELECT count(*) FROM d)),
    t AS (SELECT pos, 0 AS which, text, words FROM w UNION ALL SELECT pos, 1, text, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM e),
    u AS (SELECT pos, which, list({{'t': u.term, 'd': digest}} ORDER BY u.term) AS used FROM (SELECT pos, which, unnest(words) AS term FROM t) u JOIN lex ON lex.term = u.term GROUP BY ALL),
    v AS (SELECT t.pos, t.which, t.text, coalesce(used, [{{'t': '{MARK}' || md5(CASE WHEN len(words) > 0 THEN array_to_string(list_sort(words), ' ') ELSE '{MARK}' || t.text END), 'd': ''}}]) AS used
        FROM t LEFT JOIN u ON u.pos = t.pos AND u.which = t.which),
    h AS (SELECT pos, which, text, list_transform({_LIMITS}, lambda p: array_to_string(list_transform(list_filter(used, lambda x: substr(x.d, p.a, 4) < p.l), lambda x: x.t), ' ')) AS parts FROM v),
    g AS (SELECT pos, which, text, array_to_string(list_transform(parts, lambda x: CASE WHEN x = '' THEN '{NONE}' ELSE left(md5(x), {DIGITS}) END), '') AS fp FROM h)
    SELECT d.doc_id, d.n_chars, sha256(b.text) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, {_likeness("a.fp", "b.fp")} AS near_edited, {_likeness("a.fp", "c.fp")} AS near_next
    FROM d JOIN g a ON a.pos = d.pos AND a.which = 0 JOIN g b ON b.pos = d.pos AND b.which = 1 JOIN g c ON c.pos = (d.pos + 1) % (SELECT count(*) FROM d) AND c.which = 0
"""
