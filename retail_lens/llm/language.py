"""Language identification, word first: known words score by their log frequency in each language, unseen words back off to
progressively shorter character n-grams."""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A model is fitted on about so many labelled documents of each language, chosen by their hashes.
FIT_DOCS = 2000
#: Languages that are learned at most, those with most labelled rows; and words, and n-grams of each length, that a model keeps. Each language
#: has an equal share of these for its own most frequent ones, so a broadcast model has a bounded size and no language crowds out another.
MAX_LANGS, MAX_WORDS, MAX_GRAMS = 200, 60_000, 30_000
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a task remembers at a time.
CACHE = 50_000
#: What an n-gram's score counts against a known word's.
BACKOFF = 0.4
_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that the pattern takes though they are neither letters nor digits: other numbers.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letters(text: str) -> list[str]:
    """Lower-case runs of letters of any script. Numbers that are no digits (as ½ and ②) are no letters, and part words."""
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _LETTERS.findall(text.lower())


class Model:
    """Log frequencies of words and of character n-grams, one value a language; ``langs`` are sorted."""

    def __init__(self, langs: list[str], words: dict[str, int], scores: np.ndarray, grams: dict[int, tuple[dict[str, int], np.ndarray]], unseen: np.ndarray):
        self.langs, self.words, self.scores, self.grams, self.unseen = langs, words, scores, grams, unseen

    def back_off(self, word: str) -> np.ndarray:
        """The mean score of the longest n-grams of ``<word>`` that the model knows."""
        marked = f"<{word}>"
        for n in ORDERS:
            known, values = self.grams[n]
            got = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in known]
            if got:
                return values[got].mean(axis=0) * BACKOFF
        return self.unseen

    def _rows(self, words: list[str]) -> list[int]:
        """Where ``table`` has the words' scores. Unseen words get places behind the known ones, and lose them when all CACHE places are taken."""
        if not hasattr(self, "table"):
            self.index, self.table = dict(self.words), np.vstack([self.scores, np.empty((CACHE, len(self.langs)))])
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > len(self.table):
            self.index = dict(self.words)
            new = [w for w in words if w not in self.index]
            if len(self.index) + len(new) > len(self.table):  # one text with more unseen words than there are places
                self.table = np.vstack([self.scores, np.empty((len(new), len(self.langs)))])
        for w in new:
            self.table[len(self.index)] = self.back_off(w)
            self.index[w] = len(self.index)
        return [self.index[w] for w in words]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            counts = Counter(letters(text or ""))
            if not counts or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            times = np.fromiter(counts.values(), float, len(counts))
            rows = self._rows(list(counts))
            total, n = times @ self.table[rows], times.sum()
            # the posterior of the evidence, which counts as that of 20 words at most: neighbouring words are not independent
            p = np.exp((total - total.max()) / n * min(n, 20))
            best = int(np.argmax(p))
            names.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def _log_scores(counts: DataFrame, key: str, langs: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """``most`` keys, taken in turn from the most frequent ones of each language, and their log frequency by language with add-half smoothing."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(key).agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
    kept = ranked.orderBy("rank", F.desc("n"), key).limit(most).select(key)
    rows = counts.join(F.broadcast(kept), key, "left_semi").groupBy(key).pivot("lang", langs).agg(F.sum("n")).fillna(0, langs).orderBy(key).collect()
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    distinct = counts.select(F.approx_count_distinct(key, 0.01)).first()[0]
    values = np.array([r[1:] for r in rows], float).reshape(len(rows), len(langs))
    return [r[0] for r in rows], np.log((values + 0.5) / (np.array([sizes.get(x, 0) for x in langs], float) + 0.5 * max(1, distinct)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_docs: int = FIT_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_langs: int = MAX_LANGS) -> Model:
    """A model of labelled documents: about ``fit_docs`` rows of each of the ``max_langs`` most frequent languages, chosen by the hash of ``key``, whole texts.

    Null texts, null and empty languages are left out. Of no labelled rows comes a model without languages, which calls all texts ``und``.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text")).where("lang is not null and lang <> '' and text is not null")
    of_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    langs = sorted(of_lang)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros(0))
    chosen = common.hash_sample(rows, "key", fit_docs, "lang", by="lang", counts=of_lang).select("lang", "text")
    counted = common.map_batches(chosen, _count_words, T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    counts = common.materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    words, scores = _log_scores(counts, "word", langs, max_words)
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = {}
    for n in ORDERS:
        g = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substring(marked, i, F.lit(n)))  # noqa: B023
        split = counts.where(F.length(marked) >= n).select("lang", F.explode(g).alias("g"), "n").groupBy("lang", "g").agg(F.sum("n").alias("n"))
        names, values = _log_scores(common.materialize(split, "lang-grams"), "g", langs, max_grams)
        grams[n] = ({g: i for i, g in enumerate(names)}, values - values.mean(axis=1, keepdims=True))
    # only what tells languages apart counts, so that word and n-gram scores have one scale
    scores = scores - scores.mean(axis=1, keepdims=True) if len(words) else np.zeros((0, len(langs)))
    return Model(langs, {w: i for i, w in enumerate(words)}, scores, grams, np.zeros(len(langs)))


def _count_words(batch: pa.RecordBatch) -> pa.Table:
    by: dict[str, Counter] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by.setdefault(lang, Counter()).update(letters(text))
    rows = [(x, w, n) for x, c in by.items() for w, n in c.items()]
    return pa.table({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1): whole texts, no other column read.

    lang_pred is ``und``, with score 0, for null texts and texts without a letter. Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return common.append_columns(docs, run, RESULT)


def held_out(key: Column) -> Column:
    """The fifth of all documents that no model learns from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole documents, by a model of those that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
