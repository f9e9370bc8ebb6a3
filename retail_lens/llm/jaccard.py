"""N-gram Jaccard join: documents meet in size-banded tiles, bit counts of hashed bitmaps bound their overlap from above, and
what is left is verified by intersecting sorted arrays.

Two sets whose similarity is t or more share at least l of their first n - ceil(t n) + l shingles, in any one order of all
shingles. So only these prefixes are shuffled, and only documents meet that share a prefix shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components
from .words import SPACED, Words, chunks, grams

#: Bits of a signature at least; a set of more shingles has the next power of two.
BITS = 1024
#: Rows of a tile's side; a band with more rows makes more tiles.
TILE = 2048
#: Pairs that are compared at a time.
STEP = 1 << 17
#: Documents whose frequent shingles go last in the order, and the most such shingles. They decide the work, never the result.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 100_000
#: A shingle is frequent if so many documents of the sample have it.
FREQUENT = 8
#: Shingles of an ordered prefix that two similar sets share: 1 for each so many of the smaller set, and 1.
SHARE = 20
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for _, part in chunks(texts):
        w = Words(part, SPACED, lower=True)
        h = w.hashes()
        g = grams(h, width)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j - i >= width:
                yield np.unique(g[i : j - width + 1])
            else:
                yield grams(h[i:j], j - i) if j > i else np.empty(0, np.uint64)


def needed(n: int, per_cent: int) -> int:
    """The least overlap with any set of the similarity that a set of n has to have."""
    return -(-per_cent * n // 100)


def shared(n: int) -> int:
    return 1 + n // SHARE


def parity_bits(values: np.ndarray) -> bytes:
    """Bit b is the parity of the number of hashes that fall on b: two sets differ in at least as many elements as in bits."""
    width = max(BITS, 1 << (len(values) - 1).bit_length()) if len(values) else BITS
    return np.packbits((np.bincount((values >> np.uint64(20)).astype(np.int64) % width, minlength=width) & 1).astype(np.uint8)).tobytes()


def differing(bits: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows x and y differ. A wider signature is folded to the narrower one's width: the halves' parities add up."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    pop = np.zeros(len(x), np.int64)
    pair = np.minimum(size[x], size[y])
    for width in np.unique(pair).tolist():
        at = np.flatnonzero(pair == width)
        rows, place = np.unique(np.concatenate((x[at], y[at])), return_inverse=True)
        folded = np.empty((len(rows), width // 8), np.uint64)
        for k, r in enumerate(rows.tolist()):
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, width // 8), axis=0)
        for begin in range(0, len(at), max(1, STEP * 128 // width)):
            part = slice(begin, begin + max(1, STEP * 128 // width))
            pop[at[part]] = np.bitwise_count(folded[place[: len(at)][part]] ^ folded[place[len(at) :][part]]).sum(axis=1)
    return pop


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """The shingles that at least FREQUENT documents of a bounded sample have, the most frequent ORDER_SHINGLES of them."""
    def count(batch: pa.RecordBatch) -> pa.Table:
        sets = [s for s in shingle_sets(batch.column(0), width) if len(s)]
        values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pa.table({"s": values[counts > 1].view(np.int64), "n": counts[counts > 1]})

    sample = common.hash_sample(docs, "doc_id", ORDER_DOCS, "order").select("text")
    counted = common.map_batches(sample, count, T.StructType([T.StructField("s", T.LongType()), T.StructField("n", T.LongType())]))
    top = counted.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES)
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def _sets(docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """One row a document: size, signature of the whole set, bitmap, and the prefix in the order (frequent last, then by hash)."""
    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(batch: pa.RecordBatch) -> pa.Table:
        frequent, seen = last.value, np.zeros(1 << 20, bool)
        seen[(frequent >> np.uint64(44)).astype(np.int64)] = True
        out: list[list] = [[], [], [], []]
        for s in shingle_sets(batch.column(1), width):
            n = len(s)
            late = seen[(s >> np.uint64(44)).astype(np.int64)]
            if late.any():
                at = np.flatnonzero(late)
                place = np.minimum(np.searchsorted(frequent, s[at]), len(frequent) - 1)
                late[at] = frequent[place] == s[at]
            order = np.concatenate((s[~late], s[late])) if late.any() else s
            out[0].append(n)
            out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out[2].append(parity_bits(s))
            out[3].append(order[: n - needed(n, per_cent) + shared(n)].view(np.int64))
        return pa.table({"doc_id": batch.column(0), "n": pa.array(out[0], pa.int64()), "signature": pa.array(out[1], pa.binary()), "bits": pa.array(out[2], pa.binary()), "prefix": pa.array(out[3], pa.list_(pa.int64()))})

    return common.materialize(common.map_batches(docs.select("doc_id", "text"), run, SETS), "sets")


def _meetings(sets: DataFrame, gone: DataFrame, per_cent: int) -> DataFrame:
    """(token, doc_id, n): prefix shingles that several documents have, of documents that share enough of them to be similar to any.

    The documents ``gone`` are left out where a document is one row of two numbers: before, their prefixes would be shuffled.
    """
    rows = sets.select("doc_id", "n", F.explode("prefix").alias("token"))
    again = common.materialize(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "tokens")
    met = common.materialize(rows.join(again, "token"), "met")
    common.drop(again)
    common.release(sets.sparkSession)
    smallest = F.ceil(F.col("n") * per_cent / 100)
    enough = met.groupBy("doc_id").agg(F.count("*").alias("met"), F.min("n").alias("n")).where(F.col("met") >= 1 + F.floor(smallest / SHARE))
    kept = common.materialize(enough.select("doc_id").join(gone, "doc_id", "left_anti"), "enough")
    few = common.materialize(met.join(kept, "doc_id", "left_semi"), "met")
    common.drop(met)
    return few


def _bound(pop, a, b):
    """The overlap of sets of a and b elements whose bitmaps differ in pop bits is at most this."""
    return (a + b - pop) // 2


def _may(over, a, b, per_cent: int):
    """Whether that overlap makes the similarity."""
    return 100 * over >= per_cent * (a + b - over)


def _pairs_bounded(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of ``pairs`` that sizes and bit counts leave possible."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        a, b, n_a, n_b = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("a", "b", "n_a", "n_b"))
        bits = [v for x in ("bits_a", "bits_b") for v in batch.column(batch.schema.get_field_index(x)).to_pylist()]
        pop = differing(bits, np.arange(len(a)), np.arange(len(a), 2 * len(a)))
        keep = _may(np.minimum(_bound(pop, n_a, n_b), np.minimum(n_a, n_b)), n_a, n_b, per_cent)
        return pa.table({"a": a[keep], "b": b[keep]})

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * per_cent)
    return common.map_batches(joined, run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, per_cent: int, hint: str | None = None) -> DataFrame:
    """(a, b) of ``pairs`` whose sorted shingle arrays intersect enough. Arrays are made again, for the documents in pairs alone."""
    wanted = common.materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    wanted_ids = wanted.hint(hint) if hint else wanted
    make = lambda batch: pa.table({"doc_id": batch.column(0), "set": pa.array([s.tobytes() for s in shingle_sets(batch.column(1), width)], pa.binary())})
    arrays = common.materialize(common.map_batches(docs.join(wanted_ids, "doc_id", "left_semi").select("doc_id", "text"), make, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("set", T.BinaryType())])), "arrays")
    common.release(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.Table:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            over = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * over >= per_cent * (len(x) + len(y) - over))
        return pa.table({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(arrays.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a").join(arrays.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    out = common.materialize(common.map_batches(both.select("a", "b", "set_a", "set_b"), run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), "links")
    common.drop(arrays)
    common.drop(wanted)
    return out


def _tiled(met: DataFrame, sets: DataFrame, component: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of different components that share a prefix shingle and that sizes and bit counts leave possible.

    A tile holds rows of one shingle and of one size band or the one below it, so all its sizes are near; a side of over TILE
    rows is cut into blocks, and each two blocks are a tile.
    """
    rows = met.join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = common.materialize(rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token"), "split")
    open_ = common.materialize(rows.join(split, "token"), "open")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(per_cent / 100))).cast("int")
    placed = open_.select("token", "doc_id", "n", "component", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("p")).select("token", "doc_id", "n", "component", "p.band", "p.home")
    sizes = common.materialize(placed.groupBy("token", "band").agg(F.count("*").alias("m"), F.sum(F.col("home").cast("int")).alias("homes")).where("m > 1 and homes > 0").select("token", "band", F.ceil(F.col("m") / TILE).cast("int").alias("blocks")), "bands")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    dealt = placed.join(sizes, ["token", "band"]).withColumn("mine", mine).withColumn("tile", F.explode(tiles)).join(sets.select("doc_id", "bits"), "doc_id")

    keys = ["token", "band", "i", "j"]
    rows = dealt.select("token", "band", "tile.i", "tile.j", "n", "doc_id", "component", "home", "mine", "bits").repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.column_stack([batch.column(k).to_numpy() for k in keys])
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            if not last:  # one tile goes on through the whole batch, or starts with it
                left.append(batch)
                continue
            yield from _compare(pa.Table.from_batches([*left, batch.slice(0, last)]), keys, per_cent)
            left = [batch.slice(last)]
        if left:
            yield from _compare(pa.Table.from_batches(left), keys, per_cent)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _compare(t: pa.Table, keys: list[str], per_cent: int) -> Iterator[pa.RecordBatch]:
    """The possible pairs of whole tiles, whose rows are sorted by tile and size: all at once, STEP pairs at a time."""
    col = {c: t.column(c).to_numpy() for c in (*keys, "n", "doc_id", "component", "home", "mine")}
    bits = t.column("bits").to_pylist()
    tile = np.cumsum(np.concatenate(([0], np.any([col[k][1:] != col[k][:-1] for k in keys], axis=0)))) << 40
    n = col["n"]
    stop = np.searchsorted(tile + n, tile + n * 100 // per_cent, "right")  # up to the largest set that each can be similar to
    counts = stop - np.arange(len(n)) - 1
    sums = np.cumsum(counts)
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + STEP, "right")))
        c = counts[begin:end]
        x = np.repeat(np.arange(begin, end), c)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        keep = (col["component"][x] != col["component"][y]) & (col["home"][x] | col["home"][y]) & ((col["i"][x] == col["j"][x]) | (col["mine"][x] != col["mine"][y]))
        x, y = x[keep], y[keep]
        keep = _may(np.minimum(_bound(differing(bits, x, y), n[x], n[y]), n[x]), n[x], n[y], per_cent)
        a, b = col["doc_id"][x[keep]], col["doc_id"][y[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        begin = end


def jaccard_classes(docs: DataFrame, width: int = 5, per_cent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links lead to).

    Documents link when the Jaccard similarity of their sets of ``width``-word shingles is at least ``per_cent`` in 100. Words
    are runs without ASCII white space, lower-cased in A-Z; with fewer words than ``width`` all of them are one shingle.
    Documents without words link with nothing. No link is lost, but links between documents that others connect are not listed.

    Rows that repeat a doc_id each have a row, with the size of their own set, and are one node of the links: what links with one
    of them is in the component of all. A row without a doc_id has its size, links with nothing and has no component.

    Documents of equal sets count as one. First each prefix shingle's documents are compared with its least and its greatest
    document, which joins groups of copies in as many comparisons as rows; then tiles compare what is still apart.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = _sets(docs, width, per_cent)
    wordy = sets.where("n > 0 and doc_id is not null")
    classes = wordy.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("signature", "first")
    copies = common.materialize(wordy.select("doc_id", "signature").join(common.materialize(classes, "classes"), "signature").where("doc_id <> first").select("doc_id", "signature", "first"), "copies")
    copies = copies.select("doc_id", "first").distinct()
    several = common.materialize(wordy.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "several")
    gone = copies.select("doc_id").distinct().join(several, "doc_id", "left_anti")
    met = _meetings(wordy, gone, per_cent)
    ends = common.materialize(met.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "ends")
    star = met.join(ends, "token").select("doc_id", F.explode(F.array("low", "high")).alias("end")).where("doc_id <> end")
    near = _pairs_bounded(star.select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct(), sets, per_cent)
    # near copies are a share of the corpus, so finding their texts is a shuffle at every size
    links = _verified(common.materialize(near.distinct(), "near"), docs, width, per_cent, hint="merge")
    # a doc_id with several texts joins the groups of copies that they are in
    if not several.isEmpty():
        ties = copies.join(several, "doc_id", "left_semi").union(copies.join(several.withColumnRenamed("doc_id", "first"), "first", "left_semi").select("doc_id", "first"))
        links = links.union(ties.select("doc_id", "first"))
    component = common.materialize(connected_components(links), "components").select(F.col("node").alias("doc_id"), "component")
    rest = common.materialize(_tiled(met, sets, component, per_cent), "apart")
    if not rest.isEmpty():
        links = links.union(_verified(rest, docs, width, per_cent))
        component = common.materialize(connected_components(links), "components").select(F.col("node").alias("doc_id"), "component")
    common.release(spark)
    of_copies = copies.join(component.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("component"))
    named = common.materialize(of_copies.union(component).distinct(), "named")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by four-word shingles at 0.85."""
    return jaccard_classes(common.table(spark, sf_dir, "documents"), width=4, per_cent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + least(4, len(a)) - 1], ' ') AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 0) + 2)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
