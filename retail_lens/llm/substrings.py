"""Substring deduplication: of passages of at least 20 words that recur in a corpus, only the first occurrence stays.

Passages are matched by suffix automata. Equal windows have equal anchors, so the anchors that two documents share cut the corpus
into shards: a shard holds the passages around one anchor. In the order of their documents these are streamed through the shard's
automaton, whose matching statistics tell which windows have come before, and what is new is added to it. Hashes tell where words
are compared, never what is equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import Words, chunks, grams, within

#: Words of a window, and of the n-grams whose least hash in a window is its anchor.
WINDOW, ANCHOR = 20, 8
#: Windows of a passage at most, longer ones are cut (a multiple of short periods, so the pieces of what repeats itself are equal); documents that share one automaton of an anchor, about.
PIECE, STREAM = 1_680, 4_000
#: Groups that the new windows of an anchor with several automata are dealt to, for each of these.
SPREAD = 8
_LONGS = ("anchor", "salts", "salt", "doc_id", "copy", "start", "stop")
PASSAGE = T.StructType([*(T.StructField(n, T.LongType()) for n in _LONGS), T.StructField("words", T.BinaryType())])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _keys(h: np.ndarray, anchor: int, bits: int) -> np.ndarray:
    return grams(h, anchor) >> np.uint64(64 - bits) if bits else np.zeros(max(0, len(h) - anchor + 1), np.uint64)


def anchors(h: np.ndarray, window: int, anchor: int, bits: int = 64) -> np.ndarray:
    """For each window of word hashes the least hash, of so many bits, of its n-grams. Equal windows have equal anchors; neighbours mostly share one."""
    g = _keys(h, anchor, bits)
    size = len(h) - window + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    least = g[:size].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(least, g[j : j + size], out=least)
    return least


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with copy, which tells texts under one doc_id apart: 0 if the doc_id comes once, else the text's hash. Equal rows are one to each other."""
    again = common.materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    return docs.join(again, "doc_id", "left").select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("copy"), "text")


def _recurring(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(doc_id, copy, anchors): of each document the anchors that another document has too, each with its number of automata."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        lists = []
        for _, part in chunks(batch.column(2)):
            w = Words(part)
            a = anchors(w.hashes(), window, anchor, bits)
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                lists.append(np.unique(a[i : max(i, j - window + 1)]).view(np.int64))
        return pa.table({"doc_id": batch.column(0), "copy": batch.column(1), "anchors": pa.array(lists, pa.list_(pa.int64()))})

    made = common.materialize(common.map_batches(docs, run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("anchors", T.ArrayType(T.LongType()))])), "anchors")
    rows = made.select("doc_id", "copy", F.explode("anchors").alias("anchor"))
    again = common.materialize(rows.groupBy("anchor").agg(F.count("*").alias("df")).where("df > 1").select("anchor", (1 + F.floor(F.col("df") / STREAM)).cast("long").alias("salts")), "recurring")
    out = common.materialize(rows.join(again, "anchor").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "salts")).alias("anchors")), "recurring-anchors")
    common.drop(made)
    common.drop(again)
    common.release(docs.sparkSession)
    return out


def _stretches(a: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the runs of windows of one row and one anchor, at most PIECE windows each."""
    whole = within(row, window)
    head = whole.copy()
    head[1:] &= (a[1:] != a[:-1]) | ~whole[:-1]
    start = np.flatnonzero(head)
    tail = whole.copy()
    tail[:-1] &= (a[1:] != a[:-1]) | ~whole[1:]
    stop = np.flatnonzero(tail) + 1
    pieces = -(-(stop - start) // PIECE)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, stop = np.repeat(start, pieces) + PIECE * nth, np.repeat(stop, pieces)
    return start, np.minimum(stop, start + PIECE)


class Automaton:
    """The suffix automaton of passages of word codes. A state stands for words that end at the same places; it knows the first document that they stand in, or where they end first."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]

    def _state(self, following: dict[int, int], link: int, length: int, doc: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.link) - 1

    def _split(self, p: int, q: int, code: int) -> int:
        """The state of q's words that are at most one longer than p's: q itself, or a copy that the links and transitions now go to."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.doc[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = copy
            p = self.link[p]
        return copy

    def add(self, codes: list[int], doc: int, step: int = 0) -> None:
        """Adds a passage. Passages come in the order of their documents. With a step of 1, ``doc`` is the place of the first word, and places are told in place of documents."""
        nexts, link, last = self.next, self.link, 0
        for doc, code in enumerate(codes, doc) if step else ((doc, code) for code in codes):
            known = nexts[last].get(code)
            if known is not None:
                last = self._split(last, known, code)
                continue
            p, new = last, self._state({}, 0, self.length[last] + 1, doc)
            while p >= 0 and code not in nexts[p]:
                nexts[p][code] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, nexts[p][code], code)
            last = new

    def first_docs(self, codes: list[int], window: int) -> list[tuple[int, int]]:
        """(start of a window, first document with it) of all windows of a passage that the automaton has, by its matching statistics."""
        nexts, link, length, doc = self.next, self.link, self.length, self.doc
        state = matched = 0
        out = []
        for i, code in enumerate(codes):
            while code not in nexts[state]:
                if not state:
                    break
                state = link[state]
                matched = length[state]
            else:
                state = nexts[state][code]
                matched += 1
                if matched >= window:
                    while length[link[state]] >= window:  # shorter words of these end in the same places, and more
                        state = link[state]
                    matched = min(matched, length[state])
                    out.append((i - window + 1, doc[state]))
        return out


def _passages(batch: pa.RecordBatch, window: int, anchor: int, bits: int) -> pa.Table:
    """The passages around recurring anchors, with their words. Of passages of equal bytes in a part of the batch only the first has them:
    all windows of the others start earlier, which no other document can change."""
    ids, copies, texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "copy", "text", "anchors"))
    ids, copies = ids.to_numpy(), copies.to_numpy()
    out: list[list] = [[] for _ in PASSAGE.names]
    for at, part in chunks(texts):
        w = Words(part)
        a = anchors(w.hashes(), window, anchor, bits)
        start, stop = _stretches(a, w.row, window)
        row = w.row[start]
        salts = np.zeros(len(start), np.int64)
        begin = np.searchsorted(row, np.arange(len(part) + 1))
        for r in range(len(part)):
            x = lists[at + r].values
            known, numbers = x.field("anchor").to_numpy().view(np.uint64), x.field("salts").to_numpy()
            order = np.argsort(known)
            own = a[start[begin[r] : begin[r + 1]]]
            place = order[np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)]
            salts[begin[r] : begin[r + 1]] = np.where(known[place] == own, numbers[place], 0)
        take = np.flatnonzero(salts)
        take = take[np.lexsort((start[take], copies[at + row[take]], ids[at + row[take]]))]
        start, stop, row, salts = start[take], stop[take], row[take], salts[take]
        doc, copy, local = ids[at + row], copies[at + row], w.first[row]
        salt = (grams(doc.astype(np.uint64), 1) % salts.astype(np.uint64)).astype(np.int64)
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        words = []
        for key, d, k, i, j in zip(a[start].tolist(), doc.tolist(), row.tolist(), w.starts[start].tolist(), w.ends[stop + window - 2].tolist(), strict=True):
            said = w.data[i:j].tobytes()
            had = first.get((key, said))
            if had is None:
                first[key, said] = (d, k)
            words.append(None if had and (had[0] < d or had == (d, k)) else said)
        for column, v in zip(out, (a[start].view(np.int64), salts, salt, doc, copy, start - local, stop - local), strict=False):
            column.append(v)
        out[-1].extend(words)
    return pa.table([pa.array(out[-1], pa.binary()) if n == "words" else pa.array(np.concatenate(v) if v else [], pa.int64()) for n, v in zip(PASSAGE.names, out, strict=True)], names=PASSAGE.names)


class _Shard:
    """What has come before around one anchor: its automaton, and the first documents of the windows of passages seen."""

    def __init__(self, window: int):
        self.window, self.automaton, self.codes, self.seen = window, Automaton(), {}, {}

    def firsts(self, words: bytes, doc: int) -> list[int]:
        """The first document of each window of a passage. Passages come in the order of their documents."""
        known = self.seen.get(words)
        if known is None:
            codes = [self.codes.setdefault(x, len(self.codes)) for x in words.split()]
            known = [doc] * (len(codes) - self.window + 1)
            had = self.automaton.first_docs(codes, self.window)
            for i, first in had:
                known[i] = first
            if len(had) < len(known):
                self.automaton.add(codes, doc)
            self.seen[words] = known
        return known


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of PASSAGE: without words, runs of windows that stand in a smaller doc_id; with words, the new windows of an anchor that has
    several automata, for which the others are to be asked. A shard's passages come together, in the order of their documents."""
    at, shard = None, _Shard(window)
    for batch in batches:
        out: list[list] = [[] for _ in PASSAGE.names]

        def put(*values: object, out: list[list] = out) -> None:
            for column, v in zip(out, values, strict=True):
                column.append(v)

        for anchor, salts, salt, doc, copy, start, stop, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (anchor, salt) != at:
                at, shard = (anchor, salt), _Shard(window)
            if words is None:
                put(anchor, salts, salt, doc, copy, start, stop, None)
                continue
            known = shard.firsts(words, doc)
            single = words.split() if salts > 1 and max(known) == doc else ()
            run = None
            for i, first in enumerate(known):
                if first < doc:
                    if run is not None and out[6][run] == start + i:
                        out[6][run] += 1
                    else:
                        run = len(out[6])
                        put(anchor, salts, salt, doc, copy, start + i, start + i + 1, None)
                elif single:
                    said = b" ".join(single[i : i + window])
                    put(anchor, 1, zlib.crc32(said) % (SPREAD * salts), doc, copy, start + i, start + i + 1, said)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n == "words" else pa.int64()) for n, v in zip(PASSAGE.names, out, strict=True)], names=PASSAGE.names)


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """(doc_id, copy, runs): runs (start, stop) of starts of windows whose words also start in a smaller doc_id. ``docs`` are ``_numbered``.

    An anchor of more than STREAM documents has several automata, to which documents are dealt by their ids. What is new to each of
    them is then dealt by windows to groups, in which automata tell what is new to all: so neither a passage that very many documents
    share nor an anchor between very many different words is one task's. Repeats inside one document are not looked for;
    ``remove_repeats`` finds those by itself.
    """
    def match(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "copy", "start")
        return dealt.mapInArrow(lambda batches: _matched(batches, window), PASSAGE)

    seen = _recurring(docs, window, anchor, bits)
    passages = common.map_batches(docs.join(seen, ["doc_id", "copy"]), lambda b: _passages(b, window, anchor, bits), PASSAGE)
    matched = common.materialize(match(passages), "matched")
    runs = matched.where("words is null").union(match(matched.where("words is not null")))
    out = common.materialize(runs.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "stop")).alias("runs")), "repeats")
    common.drop(seen)
    common.drop(matched)
    common.release(docs.sparkSession)
    return out


def _within_rows(w: Words, window: int, anchor: int, bits: int) -> list[int]:
    """The windows that start earlier in their own row. Anchors that a row has at several places have an automaton, which knows where words end first."""
    h = w.hashes()
    a, g = anchors(h, window, anchor, bits), _keys(h, anchor, bits)
    start, stop = _stretches(a, w.row, window)
    if not len(start):
        return []
    place = lambda at: at + g[at[:, None] + np.arange(window - anchor + 1)].argmin(axis=1)  # noqa: E731 where a window has its anchor first
    row, key = w.row[start], a[start]
    order = np.lexsort((start, key, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    edges = np.append(np.flatnonzero(new), len(order))
    many = (np.diff(edges) > 1) | np.logical_or.reduceat((place(start) != place(stop - 1))[order], edges[:-1])
    out = []
    for i, j in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
        automaton, codes, had, parts = Automaton(), {}, set(), []
        for k in order[i:j].tolist():
            s, e = int(start[k]), int(stop[k])
            said = w.data[w.starts[s] : w.ends[e + window - 2]].tobytes()
            if said in had:
                out.extend(range(s, e))
                continue
            had.add(said)
            parts.append((s, [codes.setdefault(x, len(codes)) for x in said.split()]))
            automaton.add(parts[-1][1], s, 1)
        for s, part in parts:
            out.extend(s + n for n, first in automaton.first_docs(part, window) if first < s + n + window - 1)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept (the words that stay, joined by one space).

    Words are runs without ASCII white space. Each word in a window of ``window`` words goes if the window's words also start
    earlier: in a smaller doc_id, or before in the same document. Windows are judged on the input, so what is removed does not
    depend on what else is. Null, empty and shorter texts lose nothing. Rows that repeat a doc_id take
    nothing from each other, equal or not: of a window in both, one stays in each. A row without a doc_id loses its own repeats alone.

    Equal windows share an anchor, the least hash of their n-grams of ``anchor`` words, which sends their passages to the same suffix
    automaton; there words are compared. ``bits`` are those of an anchor: with fewer of them, or none, more is compared, and the same comes out.
    No passage is dropped for being frequent.
    """
    docs = _numbered(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    runs = repeated_windows(docs, window, anchor, bits)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lists, total, gone, kept = batch.column(batch.schema.get_field_index("runs")), [], [], []
        for at, part in chunks(batch.column(batch.schema.get_field_index("text"))):
            w = Words(part)
            change = np.zeros(len(w) + 1, np.int64)
            s = np.array(_within_rows(w, window, anchor, bits), np.int64)
            np.add.at(change, s, 1)
            np.add.at(change, s + window, -1)
            for r, x in enumerate(lists.slice(at, len(part))):
                if x.is_valid and len(x.values):
                    base = w.first[r]
                    np.add.at(change, base + x.values.field("start").to_numpy(), 1)
                    np.add.at(change, base + x.values.field("stop").to_numpy() + window - 1, -1)
            stays = np.cumsum(change[:-1]) == 0
            sums = np.concatenate(([0], np.cumsum(stays)))
            total += w.counts.tolist()
            gone += (w.counts - (sums[w.first[1:]] - sums[w.first[:-1]])).tolist()
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                words = w.words(i, j) if stays[i:j].all() else [w.data[s:e].tobytes() for s, e, k in zip(w.starts[i:j], w.ends[i:j], stays[i:j], strict=True) if k]
                kept.append(b" ".join(words))
        return {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return common.append_columns(docs.join(runs, ["doc_id", "copy"], "left"), run, RESULT).select("doc_id", "n_words", "n_removed", "kept")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes the repeated windows of 20 words of all documents."""
    return remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, i, array_to_string(a[i : i + 19], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS i FROM w WHERE len(a) >= 20)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l),
p AS (SELECT w.doc_id AS doc_id, k.p AS p, w.a[k.p] AS word, x.p IS NULL AS stays
      FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p FROM w) k JOIN w ON w.doc_id = k.doc_id LEFT JOIN x ON x.doc_id = k.doc_id AND x.p = k.p)
SELECT w.doc_id AS doc_id, CAST(len(w.a) AS BIGINT) AS n_words, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (WHERE stays) AS kept FROM p GROUP BY doc_id) s ON s.doc_id = w.doc_id
"""
