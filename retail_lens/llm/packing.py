"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Permitted sequence lengths in tokens.
LENGTHS = (2048, 4096, 8192, 16384)
#: Tokens' worth of cost that each sequence has besides its length.
OVERHEAD = 64
#: Pieces that one task packs together; more pieces make more packs, not larger ones.
PACK_PIECES = 5_000
#: The byte that ends a document and fills a sequence up; no UTF-8 text has it.
END = b"\xff"
SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, bin_length long, at long"


def default_cost(length: int) -> float:
    return length + OVERHEAD


def pack(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each piece, its place in the bin, length of each bin). ``lengths`` are sorted downwards, each at most the longest permitted.

    Each piece goes to the open bin that it leaves least room in. If it fits none, a bin opens with the permitted length whose
    cost is least for the tokens that it may come to hold: the piece, and what it has room for of the pieces that are still to
    come and small enough for that room. At the end each bin shrinks to the least permitted length that holds its contents.
    """
    permitted = tuple(sorted(permitted))
    after = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0]))  # tokens of piece i and all later ones
    down = -lengths
    room: list[tuple[int, int]] = []
    used: list[int] = []
    free = 0
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            best = None
            for c in permitted:
                if c >= size:
                    small = max(i + 1, int(np.searchsorted(down, -(c - size))))
                    held = size + min(c - size, max(0, int(after[small]) - free))
                    if best is None or cost(c) / held < best[0]:
                        best = (cost(c) / held, c)
            left, b = best[1], len(used)
            used.append(0)
            free += left
        bins[i], places[i] = b, used[b]
        used[b] += size
        free -= size
        if left > size:
            insort(room, (left - size, b))
    return bins, places, [next(c for c in permitted if c >= u) for u in used]


def best_fit(docs: DataFrame, length: str, key: str = "doc_id", permitted: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost, pack_pieces: int = PACK_PIECES) -> DataFrame:
    """Where each document's tokens go: doc_id, piece, start and length in the document; bin_id, bin_length and place in the bin.

    A document longer than the longest permitted length is cut into pieces of that length and a rest; nothing is dropped.
    Pieces are numbered as they are written down and dealt evenly, by a hash of all that they are, into packs of about ``pack_pieces`` pieces, however many rows are
    equal; each pack is packed by itself. Only lengths and ids are shuffled. Documents of null, zero or negative length have no piece. Rows that repeat
    one key are documents of their own, packed with each other; a null key stays null. bin_id names a bin among all packs.
    """
    longest = max(permitted)
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(length).cast("long").alias("n")).where("n > 0")
    cut = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(longest))).alias("piece", "start"))
    pieces = common.materialize(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("piece").cast("long").alias("piece"), F.col("start").cast("long").alias("start"), F.least(F.col("n") - F.col("start"), F.lit(longest)).cast("long").alias("length")), "pieces")
    packs = max(1, -(-pieces.count() // pack_pieces))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])  # null ids come last
        bins, places, sizes = pack(t.column("length").to_numpy(), permitted, cost)
        made = {"bin_id": bins * packs + t.column("pack")[0].as_py(), "bin_length": np.array(sizes, np.int64)[bins], "at": places}
        return t.drop_columns("pack").append_column("bin_id", [made["bin_id"]]).append_column("bin_length", [made["bin_length"]]).append_column("at", [made["at"]])

    dealt = pieces.select("doc_id", "piece", "start", "length", F.pmod(F.xxhash64("doc_id", "piece", "length", "row"), F.lit(packs)).alias("pack"))
    return dealt.groupBy("pack").applyInArrow(one, SCHEMA)


def byte_tokens(text: str):
    """Tokens of a text for a model that reads UTF-8 bytes, with one that ends the document; null texts have none."""
    return F.octet_length(text) + 1


def sequences(docs: DataFrame, placed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a bin: bin_id, bin_length, tokens (binary; the pieces of UTF-8 texts, each document ended by END and the bin filled up with it).

    ``placed`` comes from ``best_fit`` over ``byte_tokens`` of ``docs``, whose keys must be unique and not null: a token is one byte.
    Texts move once, to their pieces; a bin is one group, of at most the longest permitted length.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.concat(F.col(text).cast("binary"), F.lit(END)).alias("_b"))
    parts = placed.join(texts, "doc_id").select("bin_id", "bin_length", F.struct("at", F.substring("_b", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("b")).alias("p"))
    whole = parts.groupBy("bin_id", "bin_length").agg(F.sort_array(F.collect_list("p")).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["b"]))
    return whole.select("bin_id", "bin_length", F.rpad(joined, F.col("bin_length").cast("int"), F.lit(END)).alias("tokens"))


def fill(placed: DataFrame) -> DataFrame:
    """One row a bin length: bins, tokens in them, and the share of the bins' room that they fill."""
    bins = placed.groupBy("bin_id", "bin_length").agg(F.sum("length").alias("tokens"))
    return bins.groupBy("bin_length").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("bin_length")).alias("filled"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents as UTF-8 byte tokens."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", byte_tokens("text").alias("n"))
    return best_fit(docs, "n")
