"""Conversation repair against a search over all edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseweave.llm import turnrepair
from caseweave.llm.turnrepair import Node, damage, op12_turn_repair, precedes, repair_conversations, solve

BLANKS = " \t\n\x0b\x0c\r"


def outcomes(rows, most_inserts=2):
    """(cost, edits, repaired) of every string of edits with at most ``most_inserts`` insertions in a row that gives legal roles. rows: (role, text, fault)."""
    found = []

    def grow(i, inserts, cost, edits, said):
        roles = "".join(r[:1] if r and r[0] in "sua" else "x" for r, _ in said)
        if not re.fullmatch(r"(s?(ua)*u?)?", roles) and said:
            return
        if inserts < most_inserts:
            for role in ("user", "assistant"):
                grow(i, inserts + 1, cost + 5, edits + "I", [*said, (role, "")])
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles):
                found.append((cost, edits, said))
            return
        role, text, fault = rows[i]
        grow(i + 1, 0, cost + 2, edits + "D", said)
        if fault not in "bd":
            extra = 5 * (fault == "t")
            grow(i + 1, 0, cost + extra, edits + "K", [*said, (role, text)])
            for new in ("user", "assistant"):
                grow(i + 1, 0, cost + extra + 1, edits + "R", [*said, (new, text)])

    grow(0, 0, 0, "", [])
    return found


def brute(rows, ids):
    """rows: (conv, turn, role, text) after damage, in the operator's order within a conversation."""
    out = []
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        seen, marked, counts = set(), [], {"b": 0, "d": 0, "t": 0, "k": 0}
        for _, _, role, text in mine:
            end = text.rstrip(BLANKS)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "k"
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, said = min(outcomes(marked), key=lambda x: x[:2])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def fixture():
    rnd = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 5)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""])
            rows.append((conv, turn if rnd.random() < 0.9 else turn + 3, role, rnd.choice(["Yes.", "No", "Ä! \n", " ", None, "Why? ", "Of?f", "End.\x0b\x0c\r", "long. " * 50])))
    unique = {}
    for r in rows:  # ties within a turn have an order of their own, tested apart
        unique.setdefault(r[:2], r)
    return list(unique.values())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [4_096, 2])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(turnrepair, "BLOCK", block)
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted([tuple(r) for r in repair_conversations(damage(df), ids=df).collect()], key=str)
    assert got == brute(in_order(damaged(rows)), {r[0] for r in rows})


def test_long_conversation_in_blocks_equals_one_block(spark, monkeypatch):
    rnd = random.Random(9)
    initials = "".join(rnd.choice("sua" * 3 + "x") for _ in range(900))
    rows = [(7, i if i % 50 else None, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c], f"{i % 400 if i % 3 else i} t{'.' if i % 4 else ''}") for i, c in enumerate(initials)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = [tuple(r) for r in repair_conversations(df).collect()]
    monkeypatch.setattr(turnrepair, "BLOCK", 16)
    assert [tuple(r) for r in repair_conversations(df.repartition(7)).collect()] == whole
    assert whole[0][3] > 50 and len(whole[0][7]) >= 900


def test_edits_of_all_short_conversations():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("kbt", repeat=n):
                rows = [(c, "", f) for c, f in zip(initials, faults)]
                assert solve("".join(initials), "".join(faults)) == min(outcomes(rows), key=lambda x: x[:2])[:2]


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(turnrepair, "_MOD", 3)
    rnd = random.Random(1)
    root = Node(None, "")
    for _ in range(300):
        a = b = root
        for _ in range(rnd.randint(1, 12)):
            a, b = Node(a, rnd.choice(["K", "R", "IK", "D"])), Node(b, rnd.choice(["K", "R", "IK", "D"]))
        assert precedes(a, b) == (a.text() < b.text())


def test_no_rows_ties_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty, ids=empty).collect() == []
    row = (1, 0, "user", "Hi.", 5)
    df = spark.createDataFrame([row] * 40 + [(2, 0, "x", "y", 6)], SCHEMA + ", h1 int")
    got = {r.conv_id: r for r in repair_conversations(df).collect()}
    assert (got[1].duplicate, got[1].audit, got[1].cost) == (39, "D" * 40, 80)
    assert (got[2].audit, got[2].repaired_sha256) == ("D", hashlib.sha256(b"").hexdigest())


def test_query_returns_every_conversation(spark):
    path = "/root/testdata/sf0.001"
    want = {r[0] for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id").distinct().collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in op12_turn_repair(spark, path).collect()]
    assert {r[0] for r in got} == want and len(got) == len(want)
    fast = brute_solve(in_order(damaged(rows)), want)
    assert sorted(got, key=str) == fast


def brute_solve(rows, ids):
    """As ``brute``, over conversations too long to search: without insertions in a row, and only the best few edits kept a row and state."""
    out = []
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        seen, counts, states = set(), {"b": 0, "d": 0, "t": 0, "k": 0}, {"": (0, "", [])}
        step = lambda state, c: c if (state, c) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None

        def inserted(states):
            best = dict(states)
            for _ in range(2):
                for s, (cost, edits, said) in list(best.items()):
                    role = "assistant" if s == "u" else "user"
                    new = (cost + 5, edits + "I", [*said, (role, "")])
                    if role[0] not in best or new[:2] < best[role[0]][:2]:
                        best[role[0]] = new
            return best

        for _, _, role, text in mine:
            end = text.rstrip(BLANKS)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "k"
            seen.add((role, text))
            counts[fault] += 1
            following = {}
            for s, (cost, edits, said) in inserted(states).items():
                options = [(s, (cost + 2, edits + "D", said))]
                if fault not in "bd":
                    extra = cost + 5 * (fault == "t")
                    options += [(role[:1], (extra, edits + "K", [*said, (role, text)]))] if step(s, role[:1]) else []
                    options += [(r[0], (extra + 1, edits + "R", [*said, (r, text)])) for r in ("user", "assistant") if step(s, r[0])]
                for t, new in options:
                    if t not in following or new[:2] < following[t][:2]:
                        following[t] = new
            states = following
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, said = min((v for s, v in inserted(states).items() if s in ("", "a")), key=lambda x: x[:2])
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=str)
