"""Filter interaction audit: what each filter removes under every order of the filters, from counts on the edges of the lattice of filter subsets."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD_GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def measures(text: Column) -> dict[str, Column]:
    """What filters A to D need of a text: its words (n and distinct), capitals, chars and signs. Null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]  # words are parted once
    return {"words": sizes, "capitals": F.regexp_count(text, F.lit("[A-Z]")), "chars": F.char_length(text), "signs": text.rlike(r"[#$%&*|]")}


def lattice_edges(counted: DataFrame, filters: str, part: str = "part") -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost): counts on each edge (subset already applied, next filter).

    ``counted`` has one row for each kind of document: part, fails (bits of ``filters``), good, toxic and n, the number of such documents. A filter's
    bit is 1 << its place. n filters have n * 2^(n - 1) edges, and every kind stands on every edge.
    """
    n = len(filters)
    edges = [(s, 1 << f) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    bits = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for s, b in edges)))
    each = counted.withColumn("e", bits).select(part, "fails", "good", "toxic", "n", "e.applied", "e.next")
    hit, before = F.col("fails").bitwiseAND(F.col("next")) != 0, F.col("fails").bitwiseAND(F.col("applied")) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy(part, "applied", "next").agg(
        total(~hit & ~before).alias("kept"), total(hit & ~before).alias("removed"), total(hit & before).alias("redundant"), total(F.col("fails") == F.col("next")).alias("unique_fails"),
        total(hit & ~before & F.col("good")).alias("good_lost"), total(hit & ~before & F.col("toxic")).alias("toxic_lost"))


def paths(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, step, applied, next): every step of every order, as an edge. n! * n rows: a fixed number, 600 for five filters."""
    rows = [(order, k + 1, sum(1 << filters.index(x) for x in order[:k]), 1 << filters.index(order[k])) for order in map("".join, permutations(filters)) for k in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def interactions(counted: DataFrame, filters: str, part: str = "part") -> DataFrame:
    """One row for each part, order of ``filters`` and step, with COUNTS; a part's rows are all there if any kind of document has that part."""
    n, edges = len(filters), lattice_edges(counted, filters, part)
    size = F.bit_count("applied")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)  # orders whose path takes this edge
    values = edges.groupBy(part, "next").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = F.broadcast(paths(edges.sparkSession, filters))
    return edges.join(values, [part, "next"]).join(steps, ["applied", "next"]).select(part, "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in COUNTS))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Kinds of documents: part, fails (bits of A to E), good, toxic, n. E is a text that a smaller doc_id has too, anywhere in the table.

    Every text is read once, where it lies; from then on a row is its SHA-256 and flags. Copies are counted by doc_id and digest before they meet,
    and a digest's kinds before they are compared, so a text that a third of all rows have is no one task's. Texts are equal if their digests are.
    A doc_id of many labels is good or toxic if one of them says so. Rows without a doc_id have no label, and are no copies.
    """
    flags = measures(F.col("text"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), *(c.alias(k) for k, c in flags.items()))
    short, repeats = F.col("words.n") < 200, 100 * F.col("words.distinct") < 50 * F.col("words.n")
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((short, repeats, 100 * F.col("capitals") > 2 * F.col("chars"), F.col("signs")))), F.lit(0))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = read.select("doc_id", "part", F.unhex("digest").alias("digest"), fails.alias("fails")).join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    once = rows.groupBy("doc_id", "digest", "part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    kinds = once.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    first = kinds.groupBy("digest").agg(F.min("least").alias("first"))
    own = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)  # those that are the text's first, or nobody's copy
    split = kinds.join(first, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails"), own.alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(16)).alias("fails"), (F.col("n") - own).alias("n")))).alias("k"))
    return split.select("part", "good", "toxic", "k.fails", "k.n").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What filters A to E do to all documents in each of their 120 orders, by source.

    Documents are counted by what they fail (at most 32 kinds a source and label) before they go to the 80 edges of the lattice, so what is shuffled there
    follows the number of sources and not of documents; edges joined to the 600 steps give the rows. A null source is the part of the empty one, a null text
    an empty text, and of an empty table there are no rows. Other cases are those of ``judged``.
    """
    documents, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    return interactions(judged(documents.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic")), "ABCDE")


#: Order by order, from the documents' flags, without a lattice.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT part, filter_order, step, filter_order[step] AS next, n, good, toxic, fails, contains(fails, filter_order[step]) AS hit, step > 1 AND len(list_intersect(string_split(fails, ''), string_split(filter_order[1 : step - 1], ''))) > 0 AS before
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
c AS (SELECT part, filter_order, step, next, CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT before), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE hit AND before), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE fails = next), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT before AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT before AND toxic), 0) AS BIGINT) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, next) AS BIGINT) AS shapley FROM c
"""
