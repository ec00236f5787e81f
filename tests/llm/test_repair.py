"""Conversation repair against a plain recursion over rows and states."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from clarion.llm import repair

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = "user" if k == 4 else one(role), one(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, role, text, copy) for copy in range({0: 0, 3: 2}.get(k, 1))]
    return out


def plain(rows):
    """The row of one conversation, from its damaged rows."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, sha(f"{len(r[2])}:{r[2]}{r[3]}"), r[4]))
    seen, faults = set(), []
    for _, _, role, text, _ in rows:
        body = text.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, put=0):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if put < 3:
            c, a, t = best(i, due[state], put + 1)
            ways.append((c + 3, "I" + a, (("user" if due[state] == "u" else "assistant", ""), *t)))
        if i < len(rows):
            _, _, role, text, _ = rows[i]
            c, a, t = best(i + 1, state)
            ways.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] == "s" and state == "" or role[:1] in ("u", "a") and due[state] == role[:1]:
                    c, a, t = best(i + 1, role[:1])
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = best(i + 1, due[state])
                ways.append((c + more + 3, "R" + a, (("user" if due[state] == "u" else "assistant", text), *t)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, turns = best(0, "")
    at = [r[1] for r in rows if r[1] is not None]
    first = [r[2][:1] for r in rows]
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns)))


def compare(spark, rows, damage=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = repair.damage(df) if damage else repair.as_rows(df)
    got = {r[0]: tuple(r[1:]) for r in repair.digest(repair.repair(made)).collect()}
    one = lambda x: " " if x is None else x
    flat = damaged(rows) if damage else [(c, t, one(r), one(x), 0) for c, t, r, x in rows]
    want = {c: plain([r for r in flat if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    return got


ROLES = ["user", "assistant", "system", "tool", "", None]


def random_rows(rng, convs, longest):
    rows = []
    for conv in convs:
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES)
            text = rng.choice(["yes.", "no", "Why?", "", " \n", None, "a ", "ok! ", "tail ", str(rng.random()) + "."])
            rows.append((conv, rng.choice([None, *range(9)]) if rng.random() < 0.3 else rng.randrange(200), role, text))
    return rows


def test_matches_the_plain_recursion(spark):
    rng = random.Random(5)
    compare(spark, random_rows(rng, [*range(250), None], 9))
    compare(spark, random_rows(rng, range(40), 12), damage=False)


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    # workers import the module anew, so the segments' length is tested on tables, the cut on one long conversation
    rng = random.Random(6)
    rows = [(1, i, rng.choice(ROLES[:3]), rng.choice(["a.", "b", f"{i}.", ""])) for i in range(600)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(9_000)]
    got = {r[0]: tuple(r[1:]) for r in repair.digest(repair.repair(repair.as_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[2][:7] == (0, 0, 0, 0, 0, 0, "K" * 9_000)
    import sys
    sys.setrecursionlimit(10_000)
    assert got[1] == plain([(*r, 0) for r in rows if r[0] == 1])


def test_segments_chain_to_the_whole():
    t = repair.tables()
    rng = random.Random(7)
    for _ in range(200):
        s = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 30)))
        cut = rng.randrange(len(s) + 1)
        whole_v, whole_c = t.across(s)
        back_v, back_c = t.across(s[cut:])
        front_v, front_c = t.across(s[:cut])
        assert whole_v == [front_v[v] for v in back_v]
        assert whole_c == [c + front_c[v] for v, c in zip(back_v, back_c)]
        (all_,), (end,) = t.trace(s, 0, (0,))
        (one,), (mid,) = t.trace(s[:cut], back_v[0], (0,)) if cut else ([""], [0])
        (two,), (stop,) = t.trace(s[cut:], 0, (mid,)) if cut < len(s) else ([""], [mid])
        assert (one + two, stop) == (all_, end)


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame(random_rows(random.Random(8), range(60), 9), "conv_id long, turn long, role string, text string")
    rows = repair.repair(repair.damage(df)).where("position > 0").collect()
    for conv in {r.conv_id for r in rows}:
        turns = "".join(r.role[0] for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position))
        assert turns.removeprefix("s").replace("ua", "") == "" and turns != "s"


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3)], "conv_id long, turn long, role string, text string, digest string, copy int")
    assert repair.digest(repair.repair(repair.damage(df))).count() == 1
    assert repair.digest(repair.repair(repair.damage(df.limit(0)))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_the_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(spark, rows)
