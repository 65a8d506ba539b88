import hashlib
import itertools
import random

import duckdb
import pytest

from peptora.llm import dialogue
from peptora.llm.queries import ORACLE_SQL

SCHEMA = "conv_id long, turn long, role string, text string, edit string, n int, `odd name` struct<`a b`: int>"
MARKS = {"none": dialogue.SOUND, "gone": dialogue.GONE, "cut": dialogue.TRUNCATED}
SPACE = " \t\n\x0b\x0c\r"


def enumerated(rows):
    """Cost and letters of the cheapest edits of (initial, mark) rows, from all sequences of edits."""
    best = None

    def legal(roles):
        rest = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))

    def walk(i, roles, letters, cost, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and legal(roles):
            best = min(best or (cost, letters), (cost, letters))
        if inserted < 3:
            for r in "ua":
                walk(i, roles + r, letters + "I", cost + 5, inserted + 1)
        if i < len(rows):
            role, mark = rows[i]
            walk(i + 1, roles, letters + "D", cost + 2, 0)
            if mark != "gone":
                more = 5 * (mark == "cut")
                walk(i + 1, roles + role, letters + "K", cost + more, 0)
                for r in "ua":
                    walk(i + 1, roles + r, letters + "R", cost + 1 + more, 0)

    walk(0, "", "", 0, 0)
    return best


def symbols(rows):
    return bytes(3 * (dialogue.INITIALS.find(r) if r in dialogue.INITIALS else dialogue.OTHER) + MARKS[m] for r, m in rows)


def audit(acts):
    return "".join(acts).translate(str.maketrans("uaUA", "IIRR"))


def test_edits_are_the_least_of_all():
    kinds = list(itertools.product("suax", MARKS))
    rng = random.Random(3)
    cases = [[k] for k in kinds] + list(map(list, itertools.product(kinds, repeat=2))) + [[rng.choice(kinds) for _ in range(rng.choice([3, 3, 4]))] for _ in range(150)]
    for rows in cases:
        acts, cost = dialogue.repair(symbols(rows))
        assert (cost, audit(acts)) == enumerated(rows), rows


def test_powers_equal_single_steps():
    rng = random.Random(4)
    for _ in range(50):
        codes = bytes(c for _ in range(5) for c in [rng.randrange(12)] * rng.choice([1, 2, 7, 100]))
        m = dialogue.step(codes[0])
        for c in codes[1:]:
            m = dialogue.times(m, dialogue.step(c))
        assert dialogue.chunk_matrix(codes) == m
        ends = [dialogue.FINISH]
        for c in reversed(codes):
            ends.append(dialogue.before(dialogue.step(c), ends[-1]))
        acts, cost = dialogue.repair(codes)
        assert cost == ends[-1][0]
        assert len(acts) == len(codes)


def plain(rows):
    """Report and repaired lines of one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    seen, marks = set(), []
    for _, r, x in rows:
        bare = x.rstrip(SPACE)
        marks.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    mark = {"": "none", "truncated": "cut"}
    acts, cost = dialogue.repair(symbols([(r[:1] or "x", mark.get(m, "gone")) for (_, r, _), m in zip(rows, marks)])) if rows else ([], 0)
    lines = []
    for (_, r, x), act in zip(rows, acts):
        lines += [{"u": "user:", "a": "assistant:", "K": f"{r}:{x}", "U": f"user:{x}", "A": f"assistant:{x}"}[c] for c in act if c != "D"]
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    report = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs)]
    return (*report, cost, audit(acts)), lines


@pytest.fixture(scope="module")
def convs():
    rng = random.Random(9)
    text = ["Hi.", "Well?", "no end", "", " \t\n", "Yes! ", "日本。", "ok.\n", None, "x" * 5000 + "."]
    role = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    out = {k: [(t, rng.choice(role), rng.choice(text)) for t in range(rng.choice([1, 2, 5, 9]))] for k in range(40)}
    out[None] = [(0, "user", "No id."), (1, "assistant", "None.")]
    out[50] = [(None, "user", "a."), (None, "user", "a."), (3, "assistant", "b."), (9, "user", "c")]
    out[51] = [(None, None, None)] * 3
    out[52] = [(t, "user" if t % 7 else "assistant", f"t{t % 50}.") for t in range(150)]
    out[53] = [(0, "user", "Same.")] * 90 + [(1, "assistant", "Same.")] * 90
    return out


@pytest.mark.parametrize(("chunk", "fan"), [(4096, 4096), (4, 8)])
def test_repair_equals_one_conversation_at_a_time(spark, convs, chunk, fan):
    rows = [(c, t, r, x, "e", 1, (2,)) for c, conv in convs.items() for t, r, x in conv]
    random.Random(1).shuffle(rows)
    repaired, report = dialogue.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk, fan)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in report.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["n"], r["k"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, conv in convs.items():
        want, said = plain(conv)
        assert got[c] == want, c
        assert lines.get(c, []) == said, c
    digest = {r["conv_id"]: r["sha"] for r in dialogue.digests(repaired).collect()}
    assert digest == {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}


def test_query_equals_its_sql(spark, convs, tmp_path):
    rows = [(c, t, r, x) for c, conv in convs.items() for t, r, x in conv] + [(c, 0, "user", "Left alone.") for c in range(100, 180)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = dialogue.op12_dialogue(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op12_dialogue"])
    key = lambda r: str(r[0])
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    assert any(r[want.columns.index("audit")] == "" for r in rows)


def test_empty_table(spark):
    repaired, report = dialogue.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert not repaired.collect()
    assert not report.collect()
