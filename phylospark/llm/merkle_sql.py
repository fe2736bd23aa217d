"""SQL for the Merkle manifest: levels one by one, for trees of up to 16 ** 6 leaves and 16 ** 3 sources."""

from __future__ import annotations

#: CRC-32 of an ASCII text: a code is xored in, and each of the eight -1 after it shifts one bit out.
CRC = """list_reduce(list_concat([4294967295], flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, c: CASE WHEN c >= 0 THEN xor(a, c) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""


def crc32(text: str) -> str:
    return f"xor({CRC.format(x=text)}, 4294967295)"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen({x}), ':', {x}) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + "))"


def _tree(name: str, levels: int) -> str:
    """``<name>0`` is given; then its runs and next levels."""
    made = ""
    for j in range(levels):
        made += f"""{name}r{j} AS (SELECT tree, pos // 16 AS run, n, list(hash ORDER BY pos) AS hs FROM {name}{j} GROUP BY tree, pos // 16, n),
        {name}{j + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS hash, (n + 15) // 16 AS n FROM {name}r{j}),
        """
    return made


def _folds(start: str, name: str, levels: int, out: str) -> str:
    made, now = "", start
    for j in range(levels):
        left, right = "array_to_string(r.hs[1 : f.p % 16], '')", "array_to_string(r.hs[f.p % 16 + 2 :], '')"
        made += f"""{out}{j} AS (SELECT f.* REPLACE (f.p // 16 AS p, CASE WHEN r.n > 1 THEN sha256({left} || f.h || {right}) ELSE f.h END AS h, CASE WHEN r.n > 1 THEN f.proof || {left} || {right} ELSE f.proof END AS proof)
            FROM {now} f JOIN {name}r{j} r ON r.tree = f.{"tree" if out == "f" else "every"} AND r.run = f.p // 16),
        """
        now = f"{out}{j}"
    return made


LEVELS, SOURCE_LEVELS = 6, 3
SQL = f"""
    WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
        CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
    l0 AS (SELECT tree, pos, leaf AS hash, n FROM k),
    {_tree("l", LEVELS)}
    t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, hash, count(*) OVER () AS n, tree AS source_key FROM l{LEVELS}),
    {_tree("t", SOURCE_LEVELS)}
    a AS (SELECT doc_id, leaf, k.tree, '' AS every, k.pos AS p, t0.pos AS source_pos, coalesce(altered, leaf) AS h, '' AS proof, t0.hash AS subroot FROM k JOIN t0 ON t0.source_key = k.tree),
    {_folds("a", "l", LEVELS, "f")}
    b AS (SELECT * REPLACE (source_pos AS p) FROM f{LEVELS - 1}),
    {_folds("b", "t", SOURCE_LEVELS, "g")}
    z AS (SELECT doc_id, leaf, subroot, (SELECT hash FROM t{SOURCE_LEVELS}) AS root, sha256(proof) AS proof_sha256, h AS folded_root FROM g{SOURCE_LEVELS - 1})
    SELECT *, folded_root = root AS verified FROM z
"""
