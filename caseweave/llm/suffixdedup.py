"""Repeated passages of bytes: sampled suffixes, sorted and scanned as a tree of common-prefix intervals.

Every window of ``WINDOW`` bytes has one anchor: the start of its ``GRAM``-byte substring with the smallest hash. Equal windows have their
anchors at the same place, so a window occurs twice only if two anchors with equal grams have equal bytes around them. Anchors are the
suffixes that the enhanced suffix array holds; a gram's suffixes are sorted by what follows, and the stack scan over the common prefixes gives the intervals
whose members are then compared by what precedes them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.textkernels import BASES, SEGMENT, U, Prefix
from caseweave.plans.scratch import Scratch

WINDOW, GRAM = 200, 64
BEFORE = WINDOW - GRAM  # bytes before an anchor that its windows can hold
#: Suffixes of one gram that one task sorts; a gram with more is settled by counting windows.
IN_TASK = 20_000
#: Left ends of repeats that go together where a gram is split; divides ``BEFORE``.
PART = 8


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key, the leftmost among equal ones, in each run of ``width`` keys."""
    n = len(keys) - width + 1
    low = U((1 << 21) - 1)  # places in a segment; the same for all texts, so that equal windows choose alike
    tagged = (keys & ~low) | np.arange(len(keys), dtype=U)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(keys)] = tagged
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & low).astype(np.int64)


def anchors(text: bytes, before: int = BEFORE, reach: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, hashes of the ``before`` and ``reach`` bytes around) of a text's anchors; none below ``WINDOW`` bytes. Very long texts go in segments."""
    n, found = len(text), []
    for at in range(0, n - WINDOW + 1, SEGMENT):
        lo, hi = max(0, at - before), min(n, at + SEGMENT + WINDOW + reach)
        data = np.frombuffer(text, np.uint8)[lo:hi]
        first, last = at - lo, min(at + SEGMENT, n - WINDOW + 1) - lo  # window starts
        starts = np.arange(first, last + BEFORE)
        grams = Prefix(data).at(starts, starts + GRAM)
        places = sliding_argmin(grams, BEFORE + 1)
        places = np.unique(places)
        pos = places + first
        left, right = np.minimum(pos + lo, before), np.minimum(n - lo - pos, reach)
        around = Prefix(data, BASES[1]).at(pos - left, pos + right) + left.astype(U) * U(0x9E3779B97F4A7C15)
        found.append((pos + lo, grams[places], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    pos, grams, around = (np.concatenate(x) for x in zip(*found, strict=True))
    pos, once = np.unique(pos, return_index=True)  # windows of two segments may have one anchor
    return pos, grams[once], around[once]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(suffixes: list[bytes]):
    """Common-prefix intervals (length, first, last) of sorted suffixes, children before their parents, by one scan with a stack."""
    stack = [(0, 0)]
    for i in range(1, len(suffixes) + 1):
        common = _common(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else -1
        first = i - 1
        while stack and stack[-1][0] > common:
            length, first = stack.pop()
            yield length, first, i - 1
        if common >= 0 and (not stack or stack[-1][0] < common):
            stack.append((common, first))


def repeats_of(after: list[bytes], before: list[bytes]) -> list[tuple[int, int, int]]:
    """(member, left, right): bytes to the left and right of each member's anchor that a repeated window covers, for members of one gram.

    ``before`` is reversed. In each interval of the tree, members are sorted by what precedes them and neighbours give the longest left extension
    that any other member of the interval shares. An interval without left diversity, whose members all continue to the left alike as far as
    windows reach, is settled without comparing neighbours. A window counts when left and right together reach ``WINDOW``.
    """
    order = sorted(range(len(after)), key=lambda k: after[k])
    best: dict[int, tuple[int, int]] = {}
    for length, first, last in intervals([after[k] for k in order]):
        if length < GRAM:
            continue
        members = sorted(order[first : last + 1], key=lambda k: before[k])
        low, high = before[members[0]], before[members[-1]]
        shared = [len(low)] * (len(members) - 1) if low == high else [_common(before[a], before[b]) for a, b in zip(members, members[1:])]
        for i, k in enumerate(members):
            left = max(shared[i - 1] if i else 0, shared[i] if i < len(shared) else 0)
            if left + length >= WINDOW:
                was = best.get(k, (0, 0))
                best[k] = max(was[0], left), max(was[1], length)
    return [(k, left, right) for k, (left, right) in best.items()]


def maximal_groups(after: list[bytes], before: list[bytes]):
    """(left, right, members) of each maximal repeat of at least ``WINDOW`` bytes whose first window is anchored at these members of one gram.

    ``before`` is reversed and one byte longer than windows reach. The members of an interval of the tree, all alike for ``right`` bytes, are put in a tree of what
    precedes them: an interval of that tree is left-diverse by its length, and its members are right-diverse if they lie in more than one child of the first.
    Those that go on alike to the left past the reach of windows belong to an earlier anchor.
    """
    order = sorted(range(len(after)), key=lambda k: after[k])
    common = [0] + [_common(after[a], after[b]) for a, b in zip(order, order[1:])]
    for right, first, last in intervals([after[k] for k in order]):
        if right < GRAM:
            continue
        child, held = [0], range(first, last + 1)
        for i in held[1:]:
            child.append(child[-1] + (common[i] == right))
        by_left = sorted(held, key=lambda i: before[order[i]])
        for left, low, high in intervals([before[order[i]] for i in by_left]):
            members = by_left[low : high + 1]
            if left > BEFORE or left + right < WINDOW or _common(before[order[members[0]]], before[order[members[-1]]]) > left:  # the root stands for 0 even if all are alike
                continue
            if len({child[i - first] for i in members}) > 1:
                k = order[members[0]]
                if anchors((before[k][:left][::-1] + after[k])[:WINDOW])[0][0] == left:
                    yield left, right, sorted({order[i] for i in members})


_SPANS = "rid long, a long, b long"


def _anchor_rows(batches, before: int = BEFORE, reach: int = WINDOW):
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("gram", pa.int64()), ("around", pa.int64())])
    for batch in batches:
        held, size = [], 0
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pos, gram, around = anchors(text.as_py().encode(), before, reach)
            if len(pos):
                held.append((np.full(len(pos), rid), pos, gram.view(np.int64), around.view(np.int64)))
                size += len(pos)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)


def _context_rows(batches):
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("gram", pa.int64()), ("single", pa.bool_()), ("after", pa.binary()), ("before", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            out = []
            part = batch.slice(at, 200)
            for rid, text, wanted in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for w in wanted:
                    p = w["pos"]
                    out.append((rid, p, w["gram"], w["single"], raw[p : p + WINDOW], raw[max(0, p - BEFORE) : p][::-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _tree_rows(batches):
    """Rows sorted by gram: the groups are settled one after the other."""
    schema = pa.schema([("rid", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple] = []

    def settle(out):
        if sum(1 for _ in held) > 1:
            for k, left, right in repeats_of([x[4] for x in held], [x[5] for x in held]):
                if held[k][3]:
                    out.append((held[k][0], held[k][1] - left, held[k][1] + right))
        held.clear()

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][2] != row[2]:
                settle(out)
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)
    out = []
    settle(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)


def _window_rows(batches):
    """All windows around each suffix: (hash, hash, gram, rid, pos, bytes to the left, single)."""
    names = ["h1", "h2", "gram", "rid", "pos", "left"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("single", pa.bool_())])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            parts = []
            for rid, pos, gram, single, after, before in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                data = np.frombuffer(before[::-1] + after, np.uint8)
                starts = np.arange(max(0, len(before) - BEFORE), min(len(before), len(data) - WINDOW) + 1)
                if len(starts):
                    h = [Prefix(data, base).at(starts, starts + WINDOW).view(np.int64) for base in BASES]
                    same = [np.full(len(starts), x) for x in (gram, rid, pos)]
                    parts.append((*h, *same, len(before) - starts, np.full(len(starts), single)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, a, b): stretches of bytes a..b of the row ``rid`` covered by repeated windows, from rows of (rid, text); they may overlap.

    Equal surroundings of an anchor (``GRAM`` to the left limit of its windows and ``WINDOW`` to the right) are settled by counting hashes;
    only anchors whose surroundings occur once, yet whose gram occurs again, carry bytes to the interval tree,
    with one row for each repeated surrounding of that gram.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(docs.mapInArrow(_anchor_rows, "rid long, pos long, gram long, around long"))
    often = scratch.write(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))  # written, so that adaptive execution can split a frequent gram in the join
    twice = scratch.write(found.join(often.hint("shuffle_merge"), "gram"))
    scratch.drop(found)
    kinds = scratch.write(twice.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one")))
    grams = scratch.write(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("kinds > 1 AND singles > 0"))
    open_ = kinds.join(grams.hint("shuffle_merge"), "gram")
    open_ = scratch.write(open_.select("gram", "kinds", "one.rid", "one.pos", (F.col("n") == 1).alias("single")))
    equal = twice.join(kinds.where("n > 1").select("gram", "around").hint("shuffle_merge"), ["gram", "around"])
    equal = scratch.write(equal.select("rid", (F.col("pos") - F.least(F.col("pos"), F.lit(BEFORE))).alias("a"), (F.col("pos") + WINDOW).alias("b")))
    wanted = open_.groupBy("rid").agg(F.collect_set(F.struct("pos", "gram", "single")).alias("wanted"))
    contexts = docs.join(wanted.hint("shuffle_merge"), "rid").select("rid", "text", "wanted").mapInArrow(_context_rows, "rid long, pos long, gram long, single boolean, after binary, before binary")
    contexts = scratch.write(contexts.dropDuplicates(["rid", "pos"]))
    scratch.drop(twice, kinds, often, grams)
    hot = scratch.write(open_.where(F.col("kinds") > IN_TASK).select("gram").distinct())
    bounded = contexts.join(hot.hint("shuffle_hash"), "gram", "left_anti").select("rid", "pos", "gram", "single", "after", "before")
    spans = bounded.repartition("gram").sortWithinPartitions("gram").mapInArrow(_tree_rows, _SPANS)
    if not hot.isEmpty():
        windows = contexts.join(hot.hint("shuffle_hash"), "gram").select("rid", "pos", "gram", "single", "after", "before")
        windows = windows.mapInArrow(_window_rows, "h1 long, h2 long, gram long, rid long, pos long, left long, single boolean")
        again = windows.groupBy("gram", "left", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        met = windows.where("single").join(again.hint("shuffle_merge"), ["gram", "left", "h1", "h2"])
        met = met.groupBy("rid", "pos").agg(F.max("left").alias("most"), F.min("left").alias("least"))
        spans = spans.unionByName(met.select("rid", (F.col("pos") - F.col("most")).alias("a"), (F.col("pos") - F.col("least") + WINDOW).alias("b")))
    spans = scratch.write(spans)
    scratch.drop(contexts, open_, hot)
    return equal.unionByName(spans)


def _group_rows(batches):
    """Rows (key, gram, around, many, part, after, before) sorted by key: each maximal group as (gram, repeat, left, right, around), one row for each surrounding in it."""
    schema = pa.schema([("gram", pa.int64()), ("repeat", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("around", pa.int64())])
    held: list[tuple] = []

    def settle(out):
        kinds = [k for k, row in enumerate(held) for _ in range(2 if row[3] else 1)]
        if len(kinds) > 1:
            for left, right, members in maximal_groups([held[k][5] for k in kinds], [held[k][6] for k in kinds]):
                if held[0][4] in (None, min(left // PART, BEFORE // PART - 1)):
                    k = kinds[members[0]]
                    repeat = hashlib.sha256(held[k][6][:left][::-1] + held[k][5][:right]).hexdigest()
                    out.extend((held[k][1], repeat, left, right, around) for around in {held[kinds[m]][2] for m in members})
        held.clear()

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                settle(out)
            held.append(row)
        if out:
            yield batch_of(out)
    out = []
    settle(out)
    if out:
        yield batch_of(out)


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = WINDOW) -> DataFrame:
    """Maximal repeats of at least ``WINDOW`` bytes with all their occurrences: (repeat, length, occurrences, open_right, doc_id, start), one row for each occurrence.

    A repeat is a string that starts at two places or more, not all of which go on alike to the left or to the right; the end of a text is unlike anything. ``repeat`` is the SHA-256 of its bytes.
    Each is found once, at the anchor of its first window, where its left end is always in sight; to the right, ``reach`` bytes (``WINDOW`` at least) from that anchor on are compared. Members that are alike
    that far are one group with ``open_right``: its length is what was compared, and repeats that part beyond are not told apart. With a reach of the longest text nothing is open.

    Surroundings that occur more than once take part in the trees as one row with its count, and get their occurrences back by a join. A gram with over ``IN_TASK`` surroundings is split into parts by the left end
    of its repeats, and each part by ``WINDOW`` - ``PART`` shared bytes, so that a task holds the different surroundings of one such string.
    Null texts count as empty, texts below ``WINDOW`` bytes have no repeats, repeated rows are occurrences each, null ids are ids, other columns are ignored, no rows give no rows.
    """
    if reach < WINDOW:
        raise ValueError(f"reach is {WINDOW} bytes at least")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text")).where(F.octet_length("text") >= WINDOW)
    found = base.select("rid", "text").mapInArrow(lambda batches: _anchor_rows(batches, BEFORE + 1, reach), "rid long, pos long, gram long, around long")
    found = scratch.write(found)
    often = scratch.write(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))  # written, so that adaptive execution can split a frequent gram in the join
    twice = scratch.write(found.join(often.hint("shuffle_merge"), "gram"))
    scratch.drop(found)
    kinds = scratch.write(twice.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one")))
    wanted = kinds.groupBy("one.rid").agg(F.collect_list(F.struct("one.pos", "gram", "around", (F.col("n") > 1).alias("many"))).alias("wanted"))

    def contexts_of(batches):
        schema = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("many", pa.bool_()), ("after", pa.binary()), ("before", pa.binary())])
        for batch in batches:
            for texts, places in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = texts.as_py().encode()
                for at in range(0, len(places), 1000):
                    part = places[at : at + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([w[c] for w in part], schema.field(c).type) for c in ("gram", "around", "many")), pa.array([raw[w["pos"] : w["pos"] + reach] for w in part], pa.binary()),
                         pa.array([raw[max(0, w["pos"] - BEFORE - 1) : w["pos"]][::-1] for w in part], pa.binary())], schema=schema,
                    )

    texts = base.dropDuplicates(["rid"]).select("rid", "text")
    contexts = scratch.write(texts.join(wanted.hint("shuffle_merge"), "rid").select("text", "wanted").mapInArrow(contexts_of, "gram long, around long, many boolean, after binary, before binary"))
    hot = scratch.write(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > IN_TASK).select("gram"))
    whole = contexts.join(hot.hint("shuffle_merge"), "gram", "left_anti").withColumns({"key": F.col("gram"), "part": F.lit(None).cast("int")})
    parted = contexts.join(hot.hint("shuffle_merge"), "gram").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(BEFORE // PART - 1))))
    parted = parted.where(f"octet_length(before) >= {PART} * part AND octet_length(after) >= {WINDOW - PART} - {PART} * part")
    shared = [F.expr(f"substring(after, 1, {WINDOW - PART} - {PART} * part)"), F.expr(f"substring(before, 1, {PART} * part)")]
    rows = whole.unionByName(parted.withColumn("key", F.xxhash64("gram", "part", *shared)))
    rows = rows.select("key", "gram", "around", "many", "part", "after", "before").repartition("key").sortWithinPartitions("key", "part", "gram")
    groups = scratch.write(rows.mapInArrow(_group_rows, "gram long, repeat string, left long, right long, around long"))
    met = groups.join(twice.hint("shuffle_merge"), ["gram", "around"])
    met = scratch.write(met.select("rid", "repeat", (F.col("left") + F.col("right")).alias("length"), (F.col("right") == reach).alias("open_right"), (F.col("pos") - F.col("left")).alias("start")).distinct())
    scratch.drop(twice, kinds, contexts, hot, groups, often)
    ids = base.select("rid", "doc_id")
    placed = scratch.write(met.join(ids.hint("shuffle_merge"), "rid").select("repeat", "length", "open_right", "doc_id", "start"))
    scratch.drop(met)
    sizes = placed.groupBy("repeat").agg(F.count("*").alias("occurrences"))
    return placed.join(sizes.hint("shuffle_merge"), "repeat").select("repeat", "length", "occurrences", "open_right", "doc_id", "start")


def _merged(spans, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"], size)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Cuts every byte that lies in a ``WINDOW``-byte string which starts anywhere else too, in this text or another.

    Texts are UTF-8; matches never cross texts; what is cut is judged on the input. Returns the rows' ids as doc_id with n_bytes, n_removed,
    n_spans (runs cut), kept_sha256 (of the bytes left) and spans array<struct<a, b>>; with ``keep_columns`` instead all columns of ``docs``,
    the text cut at the same spans (a character cut in half goes).
    Null texts count as empty and stay null; texts below ``WINDOW`` bytes are kept whole; repeated rows are copies of each other and
    are cut whole; null ids are ids. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))
    spans = repeated_spans(base.where(F.octet_length("text") >= WINDOW))
    spans = scratch.write(spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)] if keep_columns else []
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[c for c in kept])
    if keep_columns:
        rows = rows.drop(f"c{docs.columns.index(text_col)}")
    out = rows.join(spans.hint("shuffle_merge"), "rid", "left").drop("rid")
    carried = [c for c in out.columns if c not in ("spans", "text", "doc_id")]
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}

    def results(batches):
        for batch in batches:
            cols: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            spans_out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                cut = _merged(spans, len(raw))
                at, left = 0, []
                for a, b in cut:
                    left.append(raw[at:a])
                    at = b
                left = b"".join([*left, raw[at:]])
                for name, value in zip(cols, (len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if text.is_valid else None), strict=True):
                    cols[name].append(value)
                spans_out.append([{"a": a, "b": b} for a, b in cut])
            if keep_columns:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(cols["kept"], pa.string())], [*carried, "text"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(cols[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(cols["kept_sha256"], pa.string()), pa.array(spans_out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    if keep_columns:
        from pyspark.sql.types import StringType, StructType

        schema = StructType([*(out.schema[c] for c in carried)]).add("text", StringType())
        cut = out.mapInArrow(results, schema)
        return cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.mapInArrow(results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
