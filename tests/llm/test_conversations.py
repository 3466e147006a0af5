"""Conversation repair against a plain search over whole edit strings, with blocks of every size, and the damage rule."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidelog.llm import conversations

BLANKS = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows, faults):
    """(cost, audit, repaired lines) over all edits; what has been put out is one of '', s, u, a."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 4:
            c, e = best(i, follow[state], inserts + 1)
            found.append((c + 2, "I" + e))
        if i < len(rows):
            c, e = best(i + 1, state, 0)
            found.append((c + 3, "D" + e))
            if faults[i] not in ("b", "d"):
                extra, r = faults[i] == "t", rows[i][0][:1]
                if r == follow[state] or (state == "" and r == "s"):
                    c, e = best(i + 1, r, 0)
                    found.append((c + extra, "K" + e))
                c, e = best(i + 1, follow[state], 0)
                found.append((c + 2 + extra, "R" + e))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    names, out, i = {"u": "user", "a": "assistant"}, [], 0
    size = len(audit.replace("D", ""))
    for letter in audit:
        want = names["ua"[(len(out) - size % 2) % 2]]
        if letter != "D":
            out.append((rows[i][0] if letter == "K" else want) + ":" + ("" if letter == "I" else rows[i][1]))
        i += letter != "I"
    return cost, audit, out


def plain(rows):
    """rows of one conversation after damage -> the result without conv_id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(tuple(r[1:] for r in rows), tuple(faults))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(conv, turn, role, text):
    role, text = role if role is not None else " ", text if text is not None else " "
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows):
    convs = {}
    for conv, *rest in rows:
        convs.setdefault(conv, []).extend(damaged(conv, *rest))
    return {c: plain(r) for c, r in convs.items()}


def random_rows(rng, convs, longest):
    words = ["yes.", "no", "Well!", "", " ", "why?", "it is.\n", "l'été", "a b c. "]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            turn = rng.choice([t, t, t, t + 1, None])
            out.append((c if c else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*words, None, f"turn {rng.randrange(9)}."])))
    return out


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_against_search(spark, block):
    rows = random_rows(random.Random(block), 40, 30)
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table), block=block).collect()}
    assert got == expected(rows)


def test_long_conversation_and_equal_rows(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", f"t{t}."])) for t in range(1500)] + [(2, 5, "user", "same.")] * 60 + [(3, 0, "user", "hi.")]
    table = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table), block=64).collect()}
    whole = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table.coalesce(1))).collect()}
    assert got == whole
    want = expected(rows[1500:])
    assert got[2] == want[2] and got[3] == want[3]


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table)).collect()}
    assert got == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_lost_conversation_clashing_columns_and_no_rows(spark):
    lost = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(*lost, "user", "gone.", "k", "m"), (500, None, None, None, None, None)], ROWS + ", key string, copies string")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table)).collect()}
    assert got[lost[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == expected([(*lost, "user", "gone."), (500, None, None, None)])
    assert conversations.repair(conversations.damage(table.filter("false"))).count() == 0


def test_auction_prices_are_exact():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 40)
        roles, faults = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)], [rng.choice(["", "", "t", "b", "d"]) for _ in range(n)]
        border = [rng.randrange(9) for _ in range(4)]
        p = conversations.prices(roles, faults, border, stretch=rng.choice([1, 5, 16, 64]))
        for i in reversed(range(n)):  # Bellman's equation at every node
            for q in range(4):
                assert p[i][q] == min(c + p[j][s] for c, _, j, s in conversations.arcs(roles, faults, i, q))
