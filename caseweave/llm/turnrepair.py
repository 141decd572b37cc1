"""Repair of conversations: the cheapest edits that make roles alternate, by a dynamic program over persistent edit strings.

A state's edits are a linked node: the edits of the node before it and its own, so that all states share their prefixes. Nodes know their ancestors at
distances of powers of two and a rolling hash of their whole string; strings of equal cost are told apart at the end of their longest common
prefix, which a search over those ancestors finds, and equal hashes are trusted only where the nodes are the same or their strings are.

The program over a block of rows is a 4 x 4 table (state before, state after) of costs and edits, and tables of neighbouring blocks combine. So a
conversation of any length is solved in blocks of bounded size in many tasks, and only block tables meet in one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.scratch import Scratch

BLOCK = 4_096  # rows of one table
LEGAL = {"su", "ua", "au"}
# States: what the roles so far end in. Nothing, a first system turn, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """The edits up to a row or block: those of ``parent``, then ``edits``. Nodes of one level hold edits of the same rows."""

    __slots__ = ("parent", "edits", "hash", "ups")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.ups = parent, edits, []
        h, up = (parent.hash if parent else 0), parent
        for c in edits:
            h = (h * _BASE + ord(c)) % _MOD
        self.hash = h
        while up is not None:
            self.ups.append(up)
            k = len(self.ups) - 1
            up = up.ups[k] if k < len(up.ups) else None

    def text(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.edits)
            at = at.parent
        return "".join(reversed(parts))


def precedes(a: Node, b: Node) -> bool:
    """Whether the string of ``a`` is ASCII-less than that of ``b``, a node of the same level.

    Each level's edits end with the first letter that is no insertion, and hold as many such letters on either side, so where two strings part no edits are a prefix of the other's.
    """
    x, y = a, b
    for k in range(len(a.ups) - 1, -1, -1):
        if k < len(x.ups) and x.ups[k] is not y.ups[k] and x.ups[k].hash != y.ups[k].hash:
            x, y = x.ups[k], y.ups[k]
    p, q = x.parent, y.parent
    if x.edits == y.edits or p is not q and p.text() != q.text():  # two strings had one hash
        return a.text() < b.text()
    return x.edits < y.edits


@lru_cache(maxsize=64)
def row_steps(initial: str, fault: str) -> tuple:
    """For each state after a row: (state before, cost, edits), insertions before the row's own edit; the cheapest, then ASCII-least, of each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        at = start
        for inserted in range(3):
            options = [("D", DELETE, at)]
            if fault not in "bd":
                extra = TRUNCATED if fault == "t" else 0
                options += [("K", KEEP + extra, AFTER[initial][at])] if at in AFTER.get(initial, ()) else []
                options += [("R", REROLE + extra, AFTER[r][at]) for r in "ua" if at in AFTER[r]]
            for letter, cost, end in options:
                found = (cost + INSERT * inserted, "I" * inserted + letter)
                best[start, end] = min(best.get((start, end), found), found)
            at = USER if at in AFTER["u"] else ASSISTANT
    return tuple(tuple((s, *best[s, t]) for s in STATES if (s, t) in best) for t in STATES)


def advance(now: list, steps) -> list:
    """(cost, node) of each state after one more row or block, ``now`` being those before it; None where a state can't be."""
    out: list = [None] * 4
    for t in STATES:
        best = None
        for s, cost, edits in steps[t]:
            if now[s] is None:
                continue
            total = now[s][0] + cost
            if best is None or total < best[0]:
                best = (total, s, edits, None)
            elif total == best[0]:
                mine, other = Node(now[s][1], edits), best[3] or Node(now[best[1]][1], best[2])
                best = (total, s, edits, mine) if precedes(mine, other) else (total, best[1], best[2], other)
        if best is not None:
            out[t] = (best[0], best[3] or Node(now[best[1]][1], best[2]))
    return out


def finish(now: list) -> tuple[int, str]:
    """(cost, edits) of the best legal end: nothing at all or an assistant turn, which may be inserted."""
    tails = ((NOTHING, 0, ""), (ASSISTANT, 0, ""), (USER, INSERT, "I"), (SYSTEM, 2 * INSERT, "II"))
    return min((now[s][0] + cost, now[s][1].text() + tail) for s, cost, tail in tails if now[s] is not None)


def block_table(initials: str, faults: str, start: int) -> list:
    now: list = [None] * 4
    now[start] = (0, Node(None, ""))
    for initial, fault in zip(initials, faults, strict=True):
        now = advance(now, row_steps(initial, fault))
    return now


@lru_cache(maxsize=1 << 14)
def _short(initials: str, faults: str) -> tuple[int, str]:
    return finish(block_table(initials, faults, NOTHING))


def solve(initials: str, faults: str) -> tuple[int, str]:
    """Cheapest cost and ASCII-least edits of a conversation: an initial (s, u, a or x) and a fault (k none, b blank, d duplicate, t truncated) a row."""
    return _short(initials, faults) if len(initials) <= 64 else finish(block_table(initials, faults, NOTHING))


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in, by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user.

    In strings, a null is one space; null conversation ids and turns stay null as columns.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), fault.alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return base.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_ORDER = ["turn", "role", "h1", "h2"]
_PIECE = pa.schema([(n, pa.int64()) for n in ("conv_id", "part", "seq", "lo", "hi", "turns")] + [("whole", pa.bool_()), ("initials", pa.string()), ("faults", pa.string()), ("keys", pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("i", pa.int64())])))])
_PIECE_DDL = "conv_id long, part long, seq long, lo long, hi long, turns long, whole boolean, initials string, faults string, keys array<struct<h1:long,h2:long,i:long>>"
_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DONE = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in _STATS] + [("audit", pa.string())])
_DONE_DDL = "conv_id long, " + ", ".join(f"{n} long" for n in _STATS) + ", audit string"


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _cut_in_pieces(batches):
    """Sorted rows to pieces: a conversation's rows in this task, at most ``BLOCK`` of them. A piece that the tasks before or after may go on with keeps the keys of its turns."""
    from pyspark import TaskContext

    part, seq, out = TaskContext.get().partitionId(), 0, []
    conv, rows, first, cut = None, [], True, False  # conversation at hand, its rows, whether it is the task's first, whether it went on from a full block

    def piece(last: bool):
        nonlocal seq
        seen, faults, keys = set(), [], []
        for i, (_, h1, h2, fault) in enumerate((r[1:] for r in rows)):
            if fault != "b":
                fault = "d" if (h1, h2) in seen else fault
                if fault != "d":
                    keys.append({"h1": h1, "h2": h2, "i": i})
                seen.add((h1, h2))
            faults.append(fault)
        turns = [r[0] for r in rows if r[0] is not None]
        whole = not (first or last or cut)
        seq += 1
        return (conv, part, seq, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), whole, "".join(r[1] for r in rows), "".join(faults), [] if whole else keys)

    for batch in batches:
        for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if rows and c != conv:
                out.append(piece(False))
                rows, first, cut = [], False, False
            elif len(rows) == BLOCK:
                cut = True
                out.append(piece(False))
                rows = []
            conv = c
            rows.append(row)
        if len(out) > 2_000:
            yield _batch(out, _PIECE)
            out = []
    if rows:
        out.append(piece(True))
    if out:
        yield _batch(out, _PIECE)


def _solve_whole(batches):
    for batch in batches:
        out = []
        for conv, lo, hi, turns, initials, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lo", "hi", "turns", "initials", "faults")), strict=True):
            cost, audit = solve(initials, faults)
            gaps = 0 if lo is None else hi - lo + 1 - turns
            out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs(initials), cost, audit))
        yield _batch(out, _DONE)


_TABLES = pa.schema([(n, pa.int64()) for n in ("conv_id", "part", "seq", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal")] + [("ends", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])
_TABLES_DDL = "conv_id long, part long, seq long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, ends string, costs array<long>, edits array<string>"


def _tables(batches):
    """The table of each piece: 16 costs and edits, by state before and state after; null where a state can't be. ``later`` are places of turns that an earlier piece has."""
    for batch in batches:
        for k in range(0, batch.num_rows, 20):
            out, some = [], batch.slice(k, 20)
            for conv, part, seq, lo, hi, turns, initials, faults, later in zip(*(some.column(c).to_pylist() for c in ("conv_id", "part", "seq", "lo", "hi", "turns", "initials", "faults", "later")), strict=True):
                marks = list(faults)
                for i in later or ():
                    marks[i] = "d"
                faults = "".join(marks)
                cells = [cell for s in STATES for cell in block_table(initials, faults, s)]
                costs, edits = [c and c[0] for c in cells], [c and c[1].text() for c in cells]
                out.append((conv, part, seq, lo, hi, turns, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs(initials), initials[0] + initials[-1], costs, edits))
            yield _batch(out, _TABLES)


def _fold(batches):
    """Tables of one conversation after the other, in order."""
    at, out = None, []

    def done():
        cost, audit = finish(at["now"])
        gaps = 0 if at["lo"] is None else at["hi"] - at["lo"] + 1 - at["turns"]
        return (at["conv"], gaps, at["blank"], at["duplicate"], at["truncated"], at["illegal"], cost, audit)

    for batch in batches:
        for r in batch.to_pylist():
            if at is None or r["conv_id"] != at["conv"]:
                if at is not None:
                    out.append(done())
                at = {"conv": r["conv_id"], "lo": None, "hi": None, "turns": 0, "last": None, "now": [(0, Node(None, "")), None, None, None]} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            if r["lo"] is not None:
                at["turns"] += r["turns"] - (at["hi"] == r["lo"])
                at["lo"], at["hi"] = r["lo"] if at["lo"] is None else at["lo"], r["hi"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                at[name] += r[name]
            at["illegal"] += at["last"] is not None and at["last"] + r["ends"][0] not in LEGAL
            at["last"] = r["ends"][1]
            at["now"] = advance(at["now"], [[(s, r["costs"][4 * s + t], r["edits"][4 * s + t]) for s in STATES if r["costs"][4 * s + t] is not None] for t in STATES])
    if at is not None:
        out.append(done())
    for k in range(0, len(out), 1_000):
        yield _batch(out[k : k + 1_000], _DONE)


class _Writer:
    """The repaired turns of one conversation, fed in order: ``role:text`` joined by newlines goes into a hash, and nothing is held."""

    def __init__(self, audit: str):
        self.audit, self.at, self.hash, self.any, self.state = audit, 0, hashlib.sha256(), False, NOTHING

    def _put(self, role: str, text: str):
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _next_role(self) -> str:
        self.state = USER if self.state in AFTER["u"] else ASSISTANT
        return "user" if self.state == USER else "assistant"

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._next_role(), "")
            self.at += 1

    def row(self, role: str, text: str):
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[role[:1]][self.state]
            self._put(role, text)
        elif edit == "R":
            self._put(self._next_role(), text)


_OUT = pa.schema([*_DONE, pa.field("repaired_sha256", pa.string())])
_OUT_DDL = _DONE_DDL + ", repaired_sha256 string"


def _write(batches):
    """Sorted rows, those with the edits (kind 0) before the turns (kind 1) of a conversation: a result row each."""
    at, stats, writer = None, None, None
    empty = (0,) * len(_STATS) + ("",)

    def done():
        writer.inserts()
        return (at[0], *stats, writer.hash.hexdigest())

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", *_STATS, "audit", "role", "text")]
        for conv, kind, *found, role, text in zip(*columns, strict=True):
            if at is None or conv != at[0]:
                if at is not None:
                    out.append(done())
                at, stats, writer = (conv,), empty, _Writer("")
            if kind == 0 and found[-1] is not None:
                stats, writer = tuple(found), _Writer(found[-1])
            elif kind == 1:
                writer.row(role, text)
        if out:
            yield _batch(out, _OUT)
    if at is not None:
        yield _batch([done()], _OUT)


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    return base.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


def _fault(text: Column) -> Column:
    end = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(end == "", "b").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")


def repair_conversations(rows: DataFrame, *, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation roles of the form ``(s?(ua)+)?`` by their initials, and a digest of what they give.

    Turns go in order of turn (null first), then role, then a hash of the text. A turn's first fault counts: blank (white space only), duplicate (role and text stood
    earlier), truncated (doesn't end in ``.!?``). Keep costs 0, Rerole to user or assistant 1, Delete 2 (forced on blank and duplicate turns), Insert 5 for an empty turn;
    a truncated turn that stays costs 5 more. Returns conv_id, gaps (turn numbers missing between least and greatest), blank, duplicate, truncated, illegal (neighbouring
    initials other than su, ua, au), cost, audit (initials of the edits, ASCII-least among the cheapest) and repaired_sha256 (``role:text`` by newlines).

    Null roles and texts count as one space; a role without a letter s, u or a in front, an empty one too, is in no legal place; a null conversation id is a conversation. Rows repeated as a whole are duplicates. Conversations in ``ids`` (column ``conv_col``)
    without rows give zeros, no edits and the hash of nothing; no rows and no ids give no rows. Texts of any length pass once through one shuffle; other columns aren't read.
    A conversation's hash reads its turns in one task, in order and without holding them, as SHA-256 has no other way; its edits are found in blocks.
    """
    scratch = Scratch(rows.sparkSession)
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    marks = turns.select("conv_id", "turn", initial.alias("initial"), "h1", "h2", _fault(F.col("text")).alias("fault"), "role", F.monotonically_increasing_id().alias("tie"))
    marks = marks.repartitionByRange("conv_id", *_ORDER, "tie").sortWithinPartitions("conv_id", *_ORDER, "tie")
    pieces = scratch.write(marks.select("conv_id", "turn", "initial", "h1", "h2", "fault").mapInArrow(_cut_in_pieces, _PIECE_DDL))

    cut = pieces.where("NOT whole")
    keys = cut.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "part", "seq", F.explode("keys").alias("k")).select("conv", "part", "seq", "k.*")
    firsts = keys.groupBy("conv", "h1", "h2").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = keys.join(firsts.hint("shuffle_merge"), ["conv", "h1", "h2"]).where(F.struct("part", "seq") > F.col("first"))
    later = later.groupBy("part", "seq").agg(F.collect_list("i").alias("later"))
    tables = cut.join(later.hint("shuffle_merge"), ["part", "seq"], "left").mapInArrow(_tables, _TABLES_DDL)
    folded = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_fold, _DONE_DDL)
    audits = pieces.where("whole").mapInArrow(_solve_whole, _DONE_DDL).unionByName(folded)

    none = {c: F.lit(None).cast("long") for c in _STATS} | {"audit": F.lit(None).cast("string")}
    gone = {"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "text": F.lit(None).cast("string"), "kind": F.lit(0)}
    fed = turns.withColumns(none | {"kind": F.lit(1)}).unionByName(audits.withColumns(gone))
    if ids is not None:
        fed = fed.unionByName(ids.select(F.col(conv_col).cast("long").alias("conv_id")).distinct().withColumns(none | gone))
    return fed.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).mapInArrow(_write, _OUT_DDL)


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations with faults put in, and the cheapest edits that mend them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damage(rows), ids=rows)
