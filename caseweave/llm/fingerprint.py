"""Document fingerprints: invertible Bloom lookup tables over hashed paragraphs, subtracted and peeled.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.plans.scratch import Scratch

CELLS = 9  # of one table: three parts of three cells, a digest has one cell in each part
#: A paragraph: a piece of a line, at least 160 characters long unless the line ends, up to the end of a sentence.
PARAGRAPH = r"[^\n]{1,160}[^\n.!?]*[.!?]*"
_CELL = ["pmod(d, 3)", "3 + pmod(shiftright(d, 9), 3)", "6 + pmod(shiftright(d, 18), 3)"]
_CHECK = "xxhash64(d, 77)"
_NONE = ", 'digests', CAST(array() AS array<struct<d:bigint,n:bigint>>)"


def paragraph_digests(text: str) -> str:
    """SQL for the sorted distinct 64-bit digests of a text's paragraphs."""
    return f"array_sort(array_distinct(transform(regexp_extract_all({text}, r'{PARAGRAPH}', 0), p -> xxhash64(p))))"


def first_table(digests: str) -> str:
    """SQL for a fingerprint: struct of the number of digests and of ``CELLS`` cells, each the count, key sum and check sum of its digests."""
    cells = []
    for c in range(CELLS):
        mine = f"filter({digests}, d -> {_CELL[c // 3]} = {c})"
        # a lambda over a one-element array names the cell's digests
        cells.append(f"transform(array({mine}), m -> named_struct('n', size(m), 'key', aggregate(m, 0L, (s, d) -> s ^ d), 'chk', aggregate(m, 0L, (s, d) -> s ^ {_CHECK})))[0]")
    return f"named_struct('size', size({digests}), 'cells', array({', '.join(cells)}))"


def printed_table(table: str) -> str:
    """SQL for a fingerprint as a string: the number of digests, then count, key sum and check sum of each cell in hex."""
    return f"concat({table}.size, ':', concat_ws(',', transform({table}.cells, c -> concat(hex(c.n), '.', hex(c.key), '.', hex(c.chk)))))"


def subtracted(one: str, other: str) -> str:
    """SQL for the cells of two fingerprints, subtracted: struct of cnt, key and chk arrays."""
    each = lambda value: f"zip_with({one}.cells, {other}.cells, (a, b) -> {value})"
    return f"named_struct('cnt', {each('a.n - b.n')}, 'key', {each('a.key ^ b.key')}, 'chk', {each('a.chk ^ b.chk')})"


def _peeled(cnt: str = "cnt", key: str = "key", chk: str = "chk", digests: bool = False) -> str:
    """SQL that peels a table of cnt, key and chk arrays: struct of what is left and the number of digests found; with ``digests`` also these, each with its side, 1 or -1.

    A cell is pure when its count is 1 or -1 and its check sum is that of its key; each step takes the digest of one pure cell out of all its cells.
    """
    pure = "filter(sequence(0, 8), c -> abs(s.cnt[c]) = 1 AND s.chk[c] = xxhash64(s.key[c], 77))"
    take = (
        "named_struct("
        "'cnt', transform(s.cnt, (x, c) -> IF(c IN (u.c0, u.c1, u.c2), x - u.n, x)), "
        "'key', transform(s.key, (x, c) -> IF(c IN (u.c0, u.c1, u.c2), x ^ u.d, x)), "
        "'chk', transform(s.chk, (x, c) -> IF(c IN (u.c0, u.c1, u.c2), x ^ u.k, x)), 'found', s.found + 1" + (", 'digests', concat(s.digests, array(named_struct('d', u.d, 'n', u.n))))" if digests else ")")
    )
    # lambdas over one-element arrays name a value that is used more than once
    hit = f"transform(slice({pure}, 1, 1), c -> named_struct('d', s.key[c], 'n', s.cnt[c], 'k', s.chk[c]))"
    placed = f"transform({hit}, h -> named_struct('d', h.d, 'n', h.n, 'k', h.k, 'c0', {_CELL[0].replace('d,', 'h.d,')}, 'c1', {_CELL[1].replace('d,', 'h.d,')}, 'c2', {_CELL[2].replace('d,', 'h.d,')}))"
    step = f"coalesce(get(transform({placed}, u -> {take}), 0), s)"
    start = f"named_struct('cnt', {cnt}, 'key', {key}, 'chk', {chk}, 'found', 0{_NONE if digests else ''})"
    return f"aggregate(sequence(1, {CELLS}), {start}, (s, i) -> {step})"


def set_differences(pairs: DataFrame, load: int = 3, digests: bool = False) -> DataFrame:
    """(id, kind, differing): digests in only one of two sets, from rows (id, kind, x array<long>, y array<long>, guess): ``guess`` is an estimate of that number.

    Both sets are hashed into tables of ``CELLS`` cells, as many tables as the guess asks for at ``load`` digests a table (a power of two; a digest's table is
    chosen by its own bits), subtracted cell by cell and peeled. A table that can't be peeled is tried again as four smaller ones,
    until none is left. Every row's tables are built where the row lies; nothing is shuffled but the rows once. With ``digests`` the rows are (id, kind, digest, side)
    instead, one for each recovered digest: side 1 stands in x only, -1 in y only.
    """
    scratch = Scratch(pairs.sparkSession)
    sized = pairs.withColumn("tables", F.expr(f"CAST(pow(2, ceil(log2(greatest(1, guess / {load})))) AS BIGINT)")).drop("guess")
    flat = "explode(concat(transform(x, d -> named_struct('d', d, 'n', 1)), transform(y, d -> named_struct('d', d, 'n', -1)))) AS e"
    todo = scratch.write(sized.repartition("id"))
    rows = todo.repartition("id").selectExpr("id", "kind", "tables", flat).selectExpr("id", "kind", "tables", "e.d AS d", "e.n AS n")
    parts, recovered = [], []
    while True:
        rows = rows.withColumn("part", F.expr("pmod(xxhash64(d, 5), tables)"))
        for j in range(3):
            rows = rows.withColumn(f"c{j}", F.expr(_CELL[j]))
        rows = rows.withColumn("k", F.expr(_CHECK))
        cells = []
        for c in range(CELLS):
            here = F.col(f"c{c // 3}") == c
            cells += [F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"n{c}"), F.expr(f"bit_xor(IF(c{c // 3} = {c}, d, 0L)) AS d{c}"), F.expr(f"bit_xor(IF(c{c // 3} = {c}, k, 0L)) AS k{c}")]
        built = rows.groupBy("id", "kind", "tables", "part").agg(*cells)
        array = lambda x: "array(" + ", ".join(f"{x}{c}" for c in range(CELLS)) + ")"
        # equal sides cancel to empty cells, which need no peeling
        empty = " AND ".join(f"n{c} = 0 AND d{c} = 0" for c in range(CELLS))
        tables = built.selectExpr("id", "kind", "tables", "part", f"{array('n')} AS cnt", f"{array('d')} AS key", f"{array('k')} AS chk", f"({empty}) AS empty")
        tables = tables.selectExpr("id", "kind", "tables", "part", f"IF(empty, named_struct('cnt', cnt, 'key', key, 'chk', chk, 'found', 0{_NONE if digests else ''}), {_peeled(digests=digests)}) AS p")
        listed = ["p.digests AS digests"] if digests else []
        done = tables.selectExpr("id", "kind", "tables", "part", "p.found AS found", "NOT exists(p.key, x -> x <> 0) AND NOT exists(p.cnt, x -> x <> 0) AS ok", *listed)
        if digests:
            done = scratch.write(done)
            recovered.append(done.where("ok").selectExpr("id", "kind", "explode(digests) AS e").selectExpr("id", "kind", "e.d AS digest", "e.n AS side"))
        done = done.groupBy("id", "kind", "tables").agg(F.sum(F.when(F.col("ok"), F.col("found")).otherwise(0)).alias("found"), F.collect_list(F.when(~F.col("ok"), F.col("part"))).alias("failed"))
        done = scratch.write(done)
        parts.append(done.select("id", "kind", "found"))
        failed = done.where("size(failed) > 0").select("id", "kind", "tables", "failed")
        if failed.isEmpty():
            break
        again = scratch.write(todo.drop("tables").join(failed.hint("shuffle_merge"), ["id", "kind"]))
        rows = again.repartition("id").selectExpr("id", "kind", "tables", "failed", flat).where("array_contains(failed, pmod(xxhash64(e.d, 5), tables))")
        rows = rows.selectExpr("id", "kind", "tables * 4 AS tables", "e.d AS d", "e.n AS n")
    scratch.drop(todo)
    tables = recovered if digests else parts
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out if digests else out.groupBy("id", "kind").agg(F.sum("found").alias("differing"))


def differing_paragraphs(versions: DataFrame, *, id_col: str = "doc_id", old_col: str = "text", new_col: str = "new_text") -> DataFrame:
    """(id, digest, side) of the paragraphs in which two versions of a text differ: side -1 stands in the old one only, 1 in the new one only.

    The digests are recovered from the versions' subtracted tables alone. A paragraph that only moves or repeats makes no difference. Null texts are empty, null ids are
    ids, very long texts count whole, rows equal in id and both texts give their differences once; of further columns none is read. No rows give no rows.
    """
    rows = versions.select(F.col(id_col).alias("key"), F.coalesce(old_col, F.lit("")).alias("old"), F.coalesce(new_col, F.lit("")).alias("new")).where("old <> new").distinct()
    sets = rows.selectExpr("struct(key, xxhash64(old, new) AS h) AS id", "'' AS kind", f"{paragraph_digests('new')} AS x", f"{paragraph_digests('old')} AS y")
    found = set_differences(sets.withColumn("guess", F.expr("greatest(4, abs(size(x) - size(y)))").cast("long")), digests=True)
    return found.select(F.col("id.key").alias(id_col), "digest", "side")


def range_number(column: str, bounds: list) -> Column:
    """How many of the sorted bounds are above the column's value, by two steps of a square root's length each."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    falling = sorted(bounds, reverse=True)
    groups = [falling[i : i + width] for i in range(0, len(falling), width)]
    above = lambda values: F.size(F.filter(values, lambda b: b > F.col(column)))
    whole = above(F.lit([g[-1] for g in groups]))  # groups that lie above altogether
    inside = above(F.get(F.array(*[F.lit(g) for g in groups]), whole))
    # the last group may be shorter, but nothing lies beyond it
    return F.least(F.lit(len(falling)), whole * width + F.when(whole < len(groups), inside).otherwise(0))


def with_next(docs: DataFrame, *, range_bytes: int = 16 << 20, most_ranges: int = 16_384) -> DataFrame:
    """Rows (doc_id, text) with ``next_text``: the text of the next row by descending doc_id, nulls last, ties by the text's hash; after the last row the first.

    Rows are dealt by ranges of doc_id, ``most_ranges`` at most, whose bounds come from approximate quantiles, and sorted in their range; larger ranges spill. The first row of each range is also given, with its
    text, to the range before. The texts are shuffled once.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(most_ranges, max(1, size // range_bytes))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()[0] if n > 1 else None
    place = range_number("doc_id", sorted(set(bounds or [])))
    # null ids come last, spread by their hash
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.lit(n) + 7 - F.shiftright("h", 60)).otherwise(place).cast("long"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    key = F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")
    heads = scratch.write(rows.groupBy("place").agg(F.max_by(F.struct("doc_id", "text", "h"), key).alias("head")))
    by_place = Window.orderBy("place")  # a row a range
    names = heads.select("place").withColumn("to", F.coalesce(F.lag("place").over(by_place), F.max("place").over(Window.partitionBy())))
    ghosts = heads.join(names.hint("shuffle_merge"), "place").select("head.doc_id", "head.text", "head.h", F.col("to").alias("place"), F.lit(1).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    sorted_ = Window.partitionBy("place").orderBy("ghost", *order)
    return both.withColumn("next_text", F.lead("text").over(sorted_)).where("ghost = 0").select("doc_id", "text", "next_text", "h")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of edited versions of them, and how alike the versions and the next documents are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document. Likeness is the
    share of both paragraph sets that agrees: 1 - differing / (size of one + size of the other), 1 for two empty texts. The fingerprints are subtracted and peeled, which tells the
    differing digests if there are few. Where peeling fails, the counts of the subtracted cells estimate their number, and larger tables are built for it, subtracted and peeled, four times as many
    on each failure. Null texts are empty; null ids come last; equal rows follow each other; no rows give no rows. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    half = "CAST(floor(length(text) / 2) AS INT)"
    edited = f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"
    rows = with_next(docs).selectExpr("*", f"{edited} AS edited")
    rows = rows.selectExpr("doc_id", "CAST(length(text) AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", f"{paragraph_digests('text')} AS own", f"{paragraph_digests('edited')} AS edited", f"{paragraph_digests('next_text')} AS next", "xxhash64(doc_id, h, next_text) AS id")
    rows = scratch.write(rows)
    sketched = rows.selectExpr("*", *[f"{first_table(c)} AS {c}_table" for c in ("own", "edited", "next")])
    for kind in ("edited", "next"):
        sketched = sketched.withColumn(f"{kind}_less", F.expr(subtracted("own_table", f"{kind}_table")))
        less = f"{kind}_less"
        empty = f"(NOT exists({less}.key, x -> x <> 0) AND NOT exists({less}.cnt, x -> x <> 0))"
        sketched = sketched.withColumn(f"{kind}_peel", F.expr(f"IF({empty}, named_struct('cnt', {less}.cnt, 'key', {less}.key, 'chk', {less}.chk, 'found', 0), {_peeled(f'{less}.cnt', f'{less}.key', f'{less}.chk')})"))
        clear = f"NOT exists({kind}_peel.key, x -> x <> 0) AND NOT exists({kind}_peel.cnt, x -> x <> 0)"
        sketched = sketched.withColumn(f"{kind}_found", F.expr(f"IF({clear}, {kind}_peel.found, NULL)"))
        # each part of three cells shows the sum of squared counts of a random walk over the differing digests
        sketched = sketched.withColumn(f"{kind}_guess", F.expr(f"CAST(least(size(own) + size({kind}), greatest(4, aggregate({less}.cnt, 0L, (s, n) -> s + n * n) / 2)) AS BIGINT)"))
    kept = ["doc_id", "n_chars", "edited_sha256", "id", "own", "edited", "next", f"{printed_table('own_table')} AS fingerprint", f"{printed_table('edited_table')} AS edited_fingerprint"]
    sketched = scratch.write(sketched.selectExpr(*kept, "edited_found", "next_found", "edited_guess", "next_guess"))
    scratch.drop(rows)
    open_ = sketched.where("edited_found IS NULL OR next_found IS NULL").dropDuplicates(["id"])
    pairs = open_.selectExpr("id", "own AS x", "stack(2, 'edited', edited, edited_found, edited_guess, 'next', next, next_found, next_guess) AS (kind, y, found, guess)").where("found IS NULL")
    found = set_differences(pairs.select("id", "kind", "x", "y", "guess"))
    wide = scratch.write(found.groupBy("id").agg(F.max(F.when(F.col("kind") == "edited", F.col("differing"))).alias("de"), F.max(F.when(F.col("kind") == "next", F.col("differing"))).alias("dn")))
    out = sketched.join(wide.hint("shuffle_merge"), "id", "left")
    scratch.keep_only(sketched, wide)
    like = lambda d, kind: f"IF(size(own) + size({kind}) = 0, 1.0D, 1.0D - coalesce({kind}_found, {d}) / CAST(size(own) + size({kind}) AS DOUBLE)) AS near_{kind}"
    return out.selectExpr("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("de", "edited"), like("dn", "next"))


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
