"""Best-fit packing of token sequences in bulk-synchronous rounds: pieces and gaps sorted by ranges of size, successor sweeps, ranks."""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.llm.textkernels import SPACE, Prefix
from caseweave.plans.scratch import Scratch

EOS = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CHUNKS_KEPT = 1_000_000


class _Vocabulary:
    """Ids of chunks of text that were encoded before, by hash; forgotten when there are too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), 0

    def add(self, hashes: list[int], chunks: list[str]) -> None:
        # letters only: such a chunk ends with its only word-final id, so many are encoded as one text
        plain = np.fromiter((x.isalpha() for x in chunks), bool, len(chunks))
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain))).tolist()
        joined = np.array(self.tokenizer.encode_batch_fast([" ".join([chunks[k] for k in order[: plain.sum()]])], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.final[joined]) + 1
        if len(stops) != plain.sum():
            order, joined, stops = list(range(len(chunks))), joined[:0], stops[:0]
        rest = self.tokenizer.encode_batch_fast([chunks[k] for k in order[len(stops) :]], add_special_tokens=False)
        rest = [x.ids for x in rest]
        flat = np.concatenate((joined, np.fromiter(chain.from_iterable(rest), "<u4")))
        hashes = [hashes[k] for k in order]
        n, first = len(self.number), len(self.number)
        while n + len(hashes) + 1 > len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(hashes)] = self.used + np.concatenate((stops, len(joined) + np.cumsum([len(x) for x in rest], dtype=np.int64)))
        self.used += len(flat)
        self.number.update(zip(hashes, range(first, first + len(hashes)), strict=True))


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def _chunk_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends between ASCII white space, and before a comma or full stop that stands between a Latin letter and white space."""
    space = SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    previous = np.concatenate(([0], data[:-1]))
    ahead = np.concatenate(([0], previous[:-1]))
    letter = ((previous >= 97) & (previous <= 122)) | ((ahead == 0xC3) & (previous >= 0x9F) & (previous <= 0xBF) & (previous != 0xB7))
    cut = ((data == 44) | (data == 46)) & after & letter
    starts = np.flatnonzero(~space & before | cut)
    ends = np.flatnonzero(~space & after | np.concatenate((cut[1:], [False]))) + 1
    return starts, ends


def _encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text. A chunk is encoded once and remembered.

    This vocabulary drops white space, lowers case letter by letter and never joins over white space or from letters to punctuation, so
    texts can be lowered first and cut there. The two letters whose lower case depends on more than the letter leave their text as it is, and so does the start of a special token, which lowering could complete.
    """
    known = _vocabulary(path)
    raw = [(t if "\u03a3" in t or "\u0130" in t or "<|" in t else t.lower()).encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    if not len(data):
        return [np.zeros(0, "<u4") for _ in texts]
    starts, ends = _chunk_bounds(data)
    which, hashes = pd.factorize(Prefix(data).at(starts, ends))
    if len(known.number) > _CHUNKS_KEPT:
        known.forget()
    listed = hashes.tolist()
    numbers = list(map(known.number.get, listed))
    if new := [k for k, n in enumerate(numbers) if n is None]:
        whole, first = data.tobytes(), np.empty(len(hashes), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        known.add([listed[k] for k in new], [whole[starts[first[k]] : ends[first[k]]].decode() for k in new])
        for k in new:
            numbers[k] = known.number[listed[k]]
    number = np.array(numbers, np.int64)[which]
    lengths = known.ends[number + 1] - known.ends[number]
    out_ends = np.cumsum(lengths)
    source = np.repeat(known.ends[number] - (out_ends - lengths), lengths) + np.arange(out_ends[-1] if len(out_ends) else 0)
    ids = known.ids[source]
    # texts end where their chunks do
    text_ends = np.cumsum([len(x) + 1 for x in raw])
    chunks_until = np.searchsorted(starts, text_ends)
    until = np.concatenate(([0], out_ends))[chunks_until]
    return np.split(ids, until[:-1])


def token_pieces(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``max_tokens`` tokens of each text and its closing id: (doc_id, piece, start, length, ids_crc32).

    Null and empty texts are the closing id alone. Each row gives its pieces, repeated rows each. No rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), _encode(texts, tokenizer_path), strict=True):
                    ids = np.append(ids, np.uint32(EOS)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), max_tokens)):
                        cut = ids[start : start + max_tokens]
                        out.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, PIECES)


RUNS = "kind string, size long, first long, n long, copies long, sequence long, offset long"


def sweep(runs: list[tuple], capacity: int) -> list[tuple]:
    """Successor sweep over runs, by size from large to small: rows of ``RUNS``.

    A run of kind ``piece`` stands for the ranks first..first+n-1 of the pieces of that length, one of kind ``gap`` for the sequences
    first..first+n-1 with that much room. Each length meets its successor, the smallest gap passed that no longer piece has claimed; conflicts go
    by rank: lower ranks get the gap, the others the next larger one. A gap takes as many pieces of that one length as it holds. Out come the
    matches (kind ``placed``: rank first+k goes to sequence sequence+k%n, at offset+k//n*size, for k below n*copies), the gaps that
    matches left, gaps nobody claimed, and pieces without a gap among these runs.
    """
    out, open_gaps = [], []
    for kind, size, first, n in sorted(runs, key=lambda r: (-r[1], r[0], r[2])):
        if kind == "gap":
            open_gaps.append((size, first, n))
            continue
        while n and open_gaps:
            room, sequence, m = open_gaps.pop()
            copies = min(room // size, n)
            used = min(m, n // copies)
            out.append(("placed", size, first, used, copies, sequence, capacity - room))
            if rest := room - copies * size:
                out.append(("gap", rest, sequence, used, None, None, None))
            if m > used:
                open_gaps.append((room, sequence + used, m - used))
            first, n = first + used * copies, n - used * copies
        if n:
            out.append(("piece", size, first, n, None, None, None))
    return out + [("gap", *gap, None, None, None) for gap in open_gaps]


def _swept(runs: DataFrame, capacity: int) -> DataFrame:
    """``sweep`` in each partition of ``runs``; matches made before pass through."""

    def rows(batches):
        held, names = [], None
        for batch in batches:
            names = list(batch.columns)
            done = batch["kind"] == "placed"
            if done.any():
                yield batch[done]
            held += batch.loc[~done, ["kind", "size", "first", "n"]].itertuples(index=False, name=None)
        if held:
            yield pd.DataFrame(sweep(held, capacity), columns=names).astype({"copies": "Int64", "sequence": "Int64", "offset": "Int64"})

    return runs.mapInPandas(rows, RUNS)


def _least_sequences(runs: DataFrame, capacity: int) -> tuple[int, int]:
    """(pieces left, sequences that those longer than every gap need at least): by their tokens, and as at most k pieces over capacity/(k+1) share a sequence."""
    room = runs.agg(F.coalesce(F.max(F.when(F.col("kind") == "gap", F.col("size"))), F.lit(0)).alias("room"))
    pieces = runs.where("kind = 'piece'").crossJoin(F.broadcast(room))  # one row
    long = F.when(F.col("size") > F.col("room"), F.col("n"))
    shares = [F.ceil(F.sum(F.when(F.col("size") * (k + 1) > capacity, long)) / k) for k in range(1, 17)]
    found = pieces.agg(F.sum("n").alias("left"), F.greatest(F.ceil(F.sum(long * F.col("size")) / capacity), *shares).alias("need")).first()
    return found["left"] or 0, found["need"] or 0


def placements(counts: DataFrame, capacity: int) -> DataFrame:
    """Best fit in bulk-synchronous rounds over ``counts`` (length, n): a written table of ``RUNS`` of kind ``placed``.

    A round opens what sequences the pieces longer than every gap need at least, sorts runs of pieces and gaps by ranges of size, sweeps each range in its own
    task and then what the ranges left, writes matches and new gaps, and repeats until no piece is left. A gap that takes pieces keeps less than
    half its room, so the rounds are few: they grow with the logarithm of ``capacity``. The driver sees two counts a round.
    The runs are bounded by ``capacity`` and the rounds, not by the number of pieces. No rows give no rows.
    """
    spark, scratch = counts.sparkSession, Scratch(counts.sparkSession)
    empty = {c: F.lit(None).cast("long") for c in ("copies", "sequence", "offset")}
    state = scratch.write(counts.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n").withColumns(empty))
    opened, placed, states = 0, [], [state]
    while True:
        left, need = _least_sequences(state, capacity)
        if not left:
            break
        if need:
            state = state.unionByName(spark.range(1).select(F.lit("gap").alias("kind"), F.lit(capacity).cast("long").alias("size"), F.lit(opened).cast("long").alias("first"), F.lit(need).cast("long").alias("n")).withColumns(empty))
            opened += need
        ranged = state.repartitionByRange(F.desc("size"), "kind", "first")
        states.append(scratch.write(_swept(_swept(ranged, capacity).repartition(1), capacity)))
        state = states[-1].where("kind <> 'placed'")
        placed.append(states[-1].where("kind = 'placed'"))
    out = scratch.write(reduce(DataFrame.unionByName, placed, states[0].where("false")))
    scratch.keep_only(out)
    return out


def pack(pieces: DataFrame, *, max_tokens: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``max_tokens``: best fit from long to short, without gaps.

    ``placements`` works on counts by length. Ranks inside a length are counted per (length, salt), full pieces, of which a large corpus has most, with more
    salts, so no length is a single group; a piece finds its run by a join on (length, block of ranks). ``pieces`` must be stable to read, as a written table is.
    No rows give no rows; rows with null lengths may not occur; repeated rows are placed each, and which of them goes where makes no difference.
    """
    scratch = Scratch(pieces.sparkSession)
    order = ["doc_id", "start", "ids_crc32"]
    salts = F.when(F.col("length") == max_tokens, 16_384).otherwise(256)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    cells = scratch.write(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    runs = placements(cells.groupBy("length").agg(F.sum("n").alias("n")), max_tokens)
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("i", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before.hint("shuffle_hash"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("i"))
    # a run covers a range of ranks; both sides meet in blocks of 4,096 ranks
    ends = runs.withColumn("end", F.col("first") + F.col("n") * F.col("copies") - 1)
    run = F.struct("first", "end", "n", "sequence", "offset").alias("run")
    blocks = scratch.write(ends.select(F.col("size").alias("length"), run, F.explode(F.sequence(F.shiftright("first", 12), F.shiftright("end", 12))).alias("block")))
    grouped = blocks.groupBy("length", "block").agg(F.collect_list("run").alias("runs"))
    met = ranked.withColumn("block", F.shiftright("rank", 12)).join(grouped.hint("shuffle_hash"), ["length", "block"])
    met = met.withColumn("run", F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (r["end"] >= F.col("rank")))[0])
    k = F.col("rank") - F.col("run.first")
    offset = F.col("run.offset") + F.floor(k / F.col("run.n")).cast("long") * F.col("length")
    return met.select(*pieces.columns, (F.col("run.sequence") + k % F.col("run.n")).alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 4096) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text) with their places: see ``token_pieces`` and ``pack``."""
    pieces = Scratch(docs.sparkSession).write(token_pieces(docs, tokenizer_path, max_tokens=max_tokens))
    return pack(pieces, max_tokens=max_tokens)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
