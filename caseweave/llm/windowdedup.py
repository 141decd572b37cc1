"""Repeated runs of words: Rabin-Karp hashes of fixed-length word windows, counted in Spark; repeated windows merge into maximal intervals.

A text's words are hashed, a polynomial prefix sum gives the hash of any run of them, and equal windows have equal hashes (two of 64 bits) wherever they
stand. Counting every window of a corpus would shuffle some four times its size, so windows that cannot repeat are left at home: each window has one anchor, the run
of ``GRAM`` words in it with the least hash. Equal windows have equal anchors, so only windows whose anchor occurs in two documents are counted.
No repeat is lost by that. Texts that are equal as a whole are counted once, through the copy with the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.suffixdedup import sliding_argmin
from caseweave.llm.textkernels import BASES, SEGMENT, U, Prefix, mix, word_bounds
from caseweave.plans.scratch import Scratch

WINDOW, GRAM = 50, 16
SALTS = 32
#: Documents with one anchor that share a task of the join; the windows of a hotter anchor are dealt over more.
PER_SALT = 1_000
_LAST = (1 << 63) - 1  # an absent id is no smaller than any other
_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = ["t1", "t2", "ord"]
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words between ASCII white space, unchanged; a very long text is hashed in segments cut between words."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    hashes, k = np.zeros(len(starts), U), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        a, b = starts[k], ends[stop - 1]
        hashes[k:stop] = Prefix(data[a:b]).at(starts[k:stop] - a, ends[k:stop] - a)
        k = stop
    return starts, ends, hashes


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of each run of ``width`` word hashes."""
    sums, n = Prefix(words, base), len(words) - width + 1
    at = np.arange(max(n, 0))
    return sums.at(at, at + width)


def window_anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each window's anchor, hash of the run of words that starts at each place); a very long text goes in segments of windows."""
    grams, n, span = rolling(words, gram, BASES[0]), len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    return np.concatenate([at + sliding_argmin(grams[at : min(at + SEGMENT, n) + span - 1], span) for at in range(0, n, SEGMENT)]), grams


def merged(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal intervals [a, b) of the union of the windows that begin at ``starts``."""
    out: list[list[int]] = []
    for a in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + width)
        else:
            out.append([a, a + width])
    return [(a, b) for a, b in out]


def cut_words(raw: bytes, spans) -> tuple[int, bytes]:
    """(number of words, the words outside ``spans`` joined by one space)."""
    words = [w for w in raw.translate(_BLANKS).split(b" ") if w]
    at, left = 0, []
    for a, b in spans:
        left += words[at:a]
        at = b
    return len(words), b" ".join(left + words[at:])


def _key(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _marks(window: int, gram: int):
    fields = [("t1", pa.int64()), ("t2", pa.int64()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("whole_sha", pa.string()), ("grams", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def rows(batches):
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("t1", "t2", "ord", "doc_id")]
            for at in range(0, batch.num_rows, 500):
                out = []
                for i in range(at, min(at + 500, batch.num_rows)):
                    raw = batch.column("text")[i].as_py().encode()
                    n, whole = cut_words(raw, ())
                    found = np.zeros(0, np.int64)
                    if n >= window:
                        places, grams = window_anchors(words_of(raw)[2], window, gram)
                        found = np.unique(grams[np.unique(places)]).view(np.int64)
                    out.append((*(c[i] for c in ids), n, hashlib.sha256(whole).hexdigest(), found))
                yield _arrow(out, schema)

    return rows, "t1 long, t2 long, ord long, doc_id long, n_words long, whole_sha string, grams array<long>"


def _windows(window: int, gram: int):
    names = ["h1", "h2", "t1", "t2", "ord", "pos", "salts"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def rows(batches):
        for batch in batches:
            held, size = [], 0
            keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
            for i, key in enumerate(keys):
                if i and key == keys[i - 1]:  # repeated rows come side by side; what is left of them changes no result
                    continue
                wanted = batch.column("wanted")[i].as_py()
                words = words_of(batch.column("text")[i].as_py().encode())[2]
                places, grams = window_anchors(words, window, gram)
                shared = np.array([w["gram"] for w in wanted], np.int64)
                salts = np.array([w["salts"] for w in wanted], np.int64)
                order = np.argsort(shared)
                shared, salts = shared[order], salts[order]
                mine = grams[places].view(np.int64)
                slot = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
                starts = np.flatnonzero(shared[slot] == mine)
                if len(starts):
                    h = [rolling(words, window, b)[starts].view(np.int64) for b in BASES]
                    held.append((*h, *(np.full(len(starts), k) for k in key), starts, salts[slot[starts]]))
                    size += len(starts)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    return rows, ", ".join(f"{n} long" for n in names)


def _cuts(window: int):
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("ord", pa.int64()), ("n_cut", pa.int64()), ("cut_sha", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def rows(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
            for at in range(0, batch.num_rows, 500):
                out = []
                for i in range(at, min(at + 500, batch.num_rows)):
                    if i and keys[i] == keys[i - 1]:
                        continue
                    spans = merged(batch.column("starts")[i].as_py(), window)
                    _, left = cut_words(batch.column("text")[i].as_py().encode(), spans)
                    out.append((*keys[i], sum(b - a for a, b in spans), hashlib.sha256(left).hexdigest(), [{"a": a, "b": b} for a, b in spans]))
                yield _arrow(out, schema)

    return rows, "t1 long, t2 long, ord long, n_cut long, cut_sha string, spans array<struct<a:long,b:long>>"


def _salted(table: DataFrame, salts: Column) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Which words lie in a ``window``-word run that also starts in a document of a smaller id, as maximal intervals.

    Words are what stands between ASCII white space, unchanged; windows are judged on the input. Returns a row per row of ``docs``: doc_id, n_words, n_removed,
    spans array<struct<a, b>> (word places [a, b)), kept_sha256 (the other words joined by one space, UTF-8), and t1, t2, ord, which tell the text and id.

    Null and empty texts have no words and keep the hash of nothing; texts below ``window`` words are kept whole; very long texts are hashed in segments and never cut.
    A null id is no smaller than any other, so such a row loses what a row with an id has and takes nothing from others; equal ids don't take from each other, so rows
    repeated as a whole all keep what the first keeps. Other columns are not read. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = _keyed(docs, id_col, text_col)
    rows, schema = _marks(window, gram)
    marks = scratch.write(base.mapInArrow(rows, schema))

    # Equal texts: the rows of the least id take part; the others are wholly covered by them.
    salt = F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int").alias("salt")
    long_enough = marks.where(F.col("n_words") >= window)
    firsts = long_enough.groupBy("t1", "t2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    slim = marks.withColumn("salt", salt).join(_salted(firsts, F.lit(SALTS)).hint("shuffle_merge"), ["t1", "t2", "salt"], "left").drop("salt")
    slim = slim.withColumn("copy", F.coalesce(F.col("first") < F.col("ord"), F.lit(False))).withColumn("n", F.coalesce("n", F.lit(1)))
    slim = scratch.write(slim.drop("first"))
    scratch.drop(marks)

    # Anchors in two documents: counted by salt first, so that a common one meets no single task.
    heads = slim.where(~F.col("copy") & (F.size("grams") > 0)).select(*_KEY, "grams", "n")
    heads = heads.where("n = 1").drop("n").unionByName(heads.where("n > 1").groupBy(*_KEY).agg(F.first("grams").alias("grams")))
    heads = heads.select(*_KEY, F.explode("grams").alias("gram"), salt)
    parts = scratch.write(heads.groupBy("gram", "salt").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n")))
    shared = parts.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    shared = shared.select("gram", F.ceil(F.col("n") / PER_SALT).cast("long").alias("salts"))
    shared = scratch.write(parts.select("gram", "salt").join(shared.hint("shuffle_merge"), "gram"))
    wanted = heads.join(shared.hint("shuffle_merge"), ["gram", "salt"]).groupBy(*_KEY).agg(F.collect_set(F.struct("gram", "salts")).alias("wanted"))
    wanted = scratch.write(wanted)
    scratch.drop(parts, shared)
    texts = scratch.write(base.drop("doc_id").join(wanted.hint("shuffle_merge"), _KEY))
    scratch.drop(wanted)

    # Equal windows have one anchor and so one number of salts: the join back is dealt by the heat of each window.
    rows, schema = _windows(window, gram)
    windows = scratch.write(texts.mapInArrow(rows, schema))
    counted = windows.groupBy("h1", "h2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.max("salts").alias("salts")).where("lo < hi")
    counted = _salted(counted.select("h1", "h2", "lo", "salts"), F.col("salts")).drop("salts")
    met = windows.withColumn("salt", F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int")).join(counted.hint("shuffle_merge"), ["h1", "h2", "salt"])
    starts = met.where("lo < ord").groupBy(*_KEY).agg(F.collect_list("pos").alias("starts"))
    rows, schema = _cuts(window)
    cuts = texts.drop("wanted").join(starts.hint("shuffle_merge"), _KEY).mapInArrow(rows, schema)
    cuts = scratch.write(cuts.groupBy(*_KEY).agg(F.first("n_cut").alias("n_cut"), F.first("cut_sha").alias("cut_sha"), F.first("spans").alias("spans")))
    scratch.drop(texts, windows)

    # Rows that repeat both id and text meet the one result of theirs in as many parts as their number needs.
    dealt = F.ceil(F.col("n") / PER_SALT).cast("long")
    often = slim.where(~F.col("copy") & (F.col("n") > PER_SALT)).groupBy(*_KEY).agg(F.max(dealt).alias("salts"))
    cuts = _salted(cuts.join(often.hint("shuffle_merge"), _KEY, "left").withColumn("salts", F.coalesce("salts", F.lit(1))), F.col("salts")).drop("salts")
    slim = slim.withColumn("salt", F.when(F.col("copy"), 0).otherwise(F.pmod(F.monotonically_increasing_id(), dealt)).cast("int"))
    out = slim.drop("grams", "n").join(cuts.hint("shuffle_merge"), [*_KEY, "salt"], "left")
    span = F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b"))
    whole = F.col("copy")
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.array(span)).otherwise(F.coalesce("spans", F.expr("CAST(array() AS array<struct<a:bigint,b:bigint>>)"))).alias("spans"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "whole_sha")).alias("kept_sha256"),
        *_KEY,
    )


def remove_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with all columns, the words of ``repeated_windows`` taken out of the texts and the others joined by one space.

    Texts without such words, null ones included, stay as they are. Rows repeated as a whole are cut alike.
    """
    spans = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window, gram=gram).where("n_removed > 0")
    spans = spans.groupBy(*_KEY).agg(F.first("spans").alias("spans"))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = plain.select("*", *_key(at[id_col], at[text_col]))
    met = keyed.join(spans.hint("shuffle_merge"), _KEY, "left").drop(*_KEY)
    names, text_name = plain.columns, at[text_col]

    def rows(batches):
        for batch in batches:
            cut = []
            for text, found in zip(batch.column(text_name), batch.column("spans").to_pylist(), strict=True):
                cut.append(cut_words(text.as_py().encode(), [(s["a"], s["b"]) for s in found])[1].decode() if found else text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == text_name else batch.column(c) for c in names], names)

    return met.mapInArrow(rows, plain.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op11_window_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document in 50-word runs that a document with a smaller id has too: counts and the hash of what is left."""
    return repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as strings of words; the whole texts of documents.
OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, len(words) AS n_words FROM w),
win AS (SELECT doc_id, i AS pos, array_to_string(words[i:i + 49], ' ') AS s FROM p, unnest(range(1, n_words - 48)) AS t(i) WHERE n_words >= 50),
hit AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY md5(s)) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hit, unnest(range(0, 50)) AS t(k)),
kept AS (SELECT p.doc_id, string_agg(words[i], ' ' ORDER BY i) AS left_over, count(*) AS n
  FROM p, unnest(range(1, n_words + 1)) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos = i) GROUP BY p.doc_id)
SELECT p.doc_id, p.n_words, p.n_words - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM p LEFT JOIN kept k ON k.doc_id = p.doc_id"""
