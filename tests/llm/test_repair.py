"""Repair of conversations against a plain version that goes through all states."""

import hashlib
import random
import re
import zlib

from phylospark.llm import queries, repair
from tests.test_queries import compare

SPACE = re.compile(r"[\x20\x09-\x0D]")


def plain(codes, entry):
    """Least (cost, audit) for each state, insertions behind the last row included."""

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for q, (c, a) in list(states.items()):
                for role in "ua":
                    to = repair.after(q, role)
                    if to is not None:
                        states[to] = min(states.get(to, (10**9, "")), (c + 2, a + "I"))
        return states

    states = {entry: (0, "")}
    for code in codes:
        now = {}
        for q, (c, a) in inserted(states).items():
            for to, more, letter in [(q, 3, "D")] + [(repair.after(q, role), p, x) for x, p, role in repair.moves(code)]:
                if to is not None:
                    now[to] = min(now.get(to, (10**9, "")), (c + more, a + letter))
        states = now
    return inserted(states)


def test_branch_and_bound_is_least():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice(rng.choice(["suaoxSUAO", "uaUA", "uuua", "ssa", "x"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 12, 40])))
        for entry in range(4):
            states = plain(codes, entry)
            assert repair.solve(codes, entry, False) == states
        closed = min((c + repair.CLOSING[q][0], a + repair.CLOSING[q][1]) for q, (c, a) in plain(codes, 0).items())
        assert repair.solve(codes, 0, True) == {repair.ASSISTANT: closed}


def brute(rows):
    made = []
    for conv in {r[0] for r in rows}:
        seen = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            seen += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        seen = [(t if known else None, role, text) for known, t, role, _, text in sorted(seen)]
        codes, counts, before = "", [0, 0, 0], set()
        for _, role, text in seen:
            bare, letter = SPACE.sub("", text), role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = 0 if not bare else 1 if (role, text) in before else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            codes += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
            before.add((role, text))
        turns = [t for t, *_ in seen if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(seen, seen[1:]))
        cost, audit = min((c + repair.CLOSING[q][0], a + repair.CLOSING[q][1]) for q, (c, a) in plain(codes, 0).items())
        lines = repair.apply_audit(audit, [r for _, r, _ in seen], [t for *_, t in seen], 0)
        made.append((conv, gaps, *counts, illegal, cost, audit.replace("L", "K"), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, made))


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, tree string").repartition(3)
    return sorted(repr(tuple(r)) for r in repair.damage_and_repair(table).collect())


def test_repair_matches_brute_force(spark):
    """Nulls everywhere, ties, other roles, blank and long texts, and conversations of many runs."""
    rng = random.Random(2)
    words = ["Yes.", "no", "Why?", " \t", "", None, "É wow!", "x" * 50_000 + "."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(words) if rng.random() < 0.6 else f"t{rng.random()}.") for c in [None, *range(40)] for _ in range(rng.randrange(1, 9))]
    for conv, n in ((100, 129), (101, 700), (102, 128 * 40)):
        rows += [(conv, i, rng.choice(["user", "assistant"]), f"{conv} {i}{rng.choice(['.', '!', ''])}" if rng.random() < 0.9 else "Yes.") for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_repair_small_tables(spark):
    assert found(spark, []) == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found(spark, [(5, dropped, "user", "Gone.")]) == [repr((5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]


def test_repair_matches_sql(spark, sf_dir, duck):
    compare(queries.QUERIES["op12_conversation_repair"](spark, sf_dir), duck, queries.ORACLES["op12_conversation_repair"])
