"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import ALNUM, Words, chunks, grams, within

#: Test words in one broadcast set; a larger benchmark is scanned in several sets, one after another.
BLOCK_WORDS = 500_000
#: Sets that one task scans with before what was found is written down.
SETS_AT_ONCE = 2
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _windows(items: list[tuple[str, str]], n: int) -> dict[int, dict[int, dict[bytes, list[str]]]]:
    """length -> hash -> words joined by a space -> items, each once."""
    found: dict[int, dict[int, dict[bytes, dict[str, None]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(dict)))
    for begin in range(0, len(items), 1000):
        part = items[begin : begin + 1000]
        for at, texts in chunks(pa.array([t for _, t in part], pa.large_string())):
            w = Words(texts, ALNUM, lower=True)
            h = w.hashes()
            for r, size in enumerate(w.counts):
                if size:
                    k = min(n, int(size))
                    i = int(w.first[r])
                    words = w.words(i, i + int(size))
                    for j, x in enumerate(grams(h[i : i + size], k).tolist()):
                        found[k][x][b" ".join(words[j : j + k])][part[at + r][0]] = None
    return {k: {x: {t: list(i) for t, i in texts.items()} for x, texts in v.items()} for k, v in found.items()}


def _scan(w: Words, sets: dict[int, tuple[np.ndarray, np.ndarray, dict]]) -> tuple[np.ndarray, list[set[str]]]:
    """Which words lie in a window of an item, and each row's items. A hash that fits counts once its words are equal; a window's items are listed once a row."""
    hit, items, met = np.zeros(len(w), bool), [set() for _ in range(len(w.counts))], set()
    h = w.hashes()
    for k, (keys, seen, entries) in sets.items():
        g = grams(h, k)
        maybe = np.flatnonzero(seen[(g >> np.uint64(44)).astype(np.int64)] & within(w.row, k)) if len(g) else np.empty(0, np.int64)
        place = np.searchsorted(keys, g[maybe])
        for i in maybe[keys[np.minimum(place, len(keys) - 1)] == g[maybe]].tolist():
            words = b" ".join(w.words(i, i + k))
            of = entries[int(g[i])].get(words)
            if of is not None:
                hit[i : i + k] = True
                if (w.row[i], words) not in met:
                    met.add((w.row[i], words))
                    items[w.row[i]].update(of)
    return hit, items


def _pieces(test: DataFrame, n: int, block_words: int) -> DataFrame:
    """(i, t) of items, those of over ``block_words`` words in overlapping pieces that have all their windows."""
    words = F.filter(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")
    long = F.length("t") > 2 * block_words  # a word and what parts it from the next have two characters at least
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)), F.lit(block_words)), lambda i: F.array_join(F.slice("w", i, block_words + n - 1), " "))
    return test.where(~long).union(test.where(long).select("i", words.alias("w")).select("i", F.explode(cut).alias("t")))


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, cleaned: str | None = None) -> DataFrame:
    """``docs`` with n_words, hit (one byte a word: 1 if inside a test window) and items (ids of the items that occur).

    Texts are lower-cased in A-Z and cut into runs of ASCII letters, digits and non-ASCII characters. A test window is n
    consecutive words of an item; an item with fewer words is one window. The test set is broadcast in sets of about
    ``block_words`` words, longer items in overlapping pieces, and each set is a pass over the documents, of which SETS_AT_ONCE follow each other in a task before
    hits are written down: so its size never meets a limit, and neither a set nor a task grows with it. Rows that repeat a key are scanned each, and so are rows without one.
    Null or wordless texts have no words, no hits and no items; a null item text has no window, a null item id reads as ''.
    Columns of ``docs`` called n_words, hit or items are replaced; all others and all rows stay.

    ``cleaned`` names one more column: the text without each run of hit words and what lies between them, made in the pass
    that finds the hits. Null texts, and texts without hits, are there as they are.
    """
    spark: SparkSession = docs.sparkSession
    test = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    test = _pieces(test, n, block_words)
    total = test.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(total // (2 * block_words)) + 1  # a word and what parts it from the next have two characters at least
    out = common.append_columns(docs, lambda b: _start(b.column(b.schema.get_field_index(text))), ADDED) if total == 0 else docs
    if total == 0 and cleaned:
        out = out.withColumn(cleaned, F.col(text))
    sent, written = [], None
    for block in range(blocks if total else 0):
        if block and block % SETS_AT_ONCE == 0:
            out = common.materialize(out, "hits")
            for x in sent:
                x.destroy()
            if written is not None:
                common.drop(written)
            sent, written = [], out
        rows = test.where(common.hash_buckets(test, "i", "t", n=blocks) == block) if blocks > 1 else test
        found = _windows([tuple(r) for r in rows.toLocalIterator()], n)
        sets = {}
        for k, entries in found.items():
            keys = np.array(sorted(entries), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            sets[k] = (keys, seen, entries)
        shared = spark.sparkContext.broadcast(sets)
        sent.append(shared)
        clean = cleaned if block == blocks - 1 else None
        out = common.append_columns(out, _scanner(shared, text, block > 0, clean), T.StructType([*ADDED.fields, T.StructField(clean, T.StringType())]) if clean else ADDED)
    return out


def _start(texts: pa.Array) -> dict[str, pa.Array]:
    counts = np.concatenate([Words(t, ALNUM).counts for _, t in chunks(texts)]) if len(texts) else np.empty(0, np.int64)
    return {"n_words": pa.array(counts, pa.int64()), "hit": pa.array([bytes(int(c)) for c in counts], pa.binary()), "items": pa.array([[] for _ in counts], pa.list_(pa.string()))}


def _scanner(shared, text: str, again: bool, cleaned: str | None):
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, hits, items = [], [], []
        for _, texts in chunks(batch.column(batch.schema.get_field_index(text))):
            w = Words(texts, ALNUM, lower=True)
            hit, found = _scan(w, shared.value)
            flat = hit.view(np.uint8).tobytes()
            counts += w.counts.tolist()
            hits += [flat[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            items += [sorted(x) for x in found]
        if again:
            old = batch.column(batch.schema.get_field_index("hit")).to_pylist()
            hits = [(np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(hits, old, strict=True)]
            items = [sorted({*a, *b}) for a, b in zip(items, batch.column(batch.schema.get_field_index("items")).to_pylist(), strict=True)]
        out = {"n_words": pa.array(counts, pa.int64()), "hit": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
        if cleaned:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            out[cleaned] = pa.array([_cut(t, m) for t, m in zip(texts, hits, strict=True)], pa.string())
        return out

    return run


def _cut(text: str | None, mask: bytes | None) -> str | None:
    """A text without each run of its hit words and what lies between them."""
    if text is None or mask is None or 1 not in mask:
        return text
    w = Words(pa.array([text], pa.large_string()), ALNUM)
    edge = np.diff(np.concatenate(([0], np.frombuffer(mask, np.uint8), [0])).astype(np.int8))
    raw, at, kept = text.encode(), 0, []
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        kept.append(raw[at : w.starts[i]])
        at = w.ends[j - 1]
    return b"".join([*kept, raw[at:]]).decode()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of whole ``benchmark`` items, by windows of 10 words, in every whole document."""
    found = scan_benchmark(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    hits = F.length(F.translate(F.hex("hit"), "0", ""))
    return found.select("doc_id", "n_words", hits.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(a)) AS k, array_to_string(a[i : i + least(10, len(a)) - 1], ' ') AS g
  FROM (SELECT item_id, a, unnest(range(1, greatest(len(a) - 10, 0) + 2)) AS i FROM b WHERE len(a) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(a[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM w, ks WHERE len(a) >= k)),
m AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(len(w.a) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""
