"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range, by built-in functions alone."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 5
FRACTION = 1 / 8
LEAST = -(1 << 63)
#: Bytes of text that one range of neighbouring documents holds, about: a task's share at every size of the corpus.
RANGE_BYTES = 64 << 20
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda's variable, unlike an alias, is never put in by copy."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words; with fewer words, of all of them as one; none without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    return let(words, lambda w: F.when(F.size(w) >= width, runs(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """The sorted distinct shingle hashes in the lowest ``fraction`` of the hash range; if none is, the least one.

    Sketches of one fraction merge by union, and the share of one sketch found in another estimates containment, however
    unequal the documents are. Null and wordless texts have an empty sketch. Equal texts have equal sketches.
    """
    top = int(LEAST + fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1
    low = lambda h: let(F.filter(h, lambda x: x <= F.lit(top)), lambda k: F.when((F.size(k) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(k))
    return F.sort_array(F.array_distinct(let(shingle_hashes(text, width), low)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 if both sketches are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all documents of a group together. Collects distinct hashes, so it is for groups whose union is small."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketches))))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.hex(h))), ",")


def ranges_of(docs: DataFrame, text: str = "text") -> int:
    """The number of ranges that hold about RANGE_BYTES of text each."""
    return 1 + (docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0) // RANGE_BYTES


def with_next(docs: DataFrame, key: str, columns: list[str], ranges: int) -> DataFrame:
    """Adds next_<column> of the row that follows in descending order of ``key`` (after the last: of the first).

    Rows are dealt out by about ``ranges`` ranges of the key, and each range's first row also goes to the range before it, so no
    task sees more than one range. Rows of equal keys follow each other by their texts' order; null keys come last. A single
    row follows itself, and an empty table stays empty. Columns of ``docs`` named next_<column> are replaced; all others stay.
    """
    made = {f"next_{c}" for c in columns}
    rows = docs.select(F.struct(*(c for c in docs.columns if c not in made)).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("key"))
    rows = rows.withColumn("near", F.col("key").cast("double"))
    cuts = sorted(set(rows.stat.approxQuantile("near", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="near", outputCol="range").transform(rows) if cuts else rows.withColumn("range", F.lit(0.0))
    order = Window.orderBy("range")  # one row a range
    heads = ranged.groupBy("range").agg(F.max("key").alias("head"))
    heads = heads.withColumn("up", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())))
    heads = common.materialize(heads, "ranges")
    own, ghost = F.struct(F.col("range").alias("at"), F.lit(0).alias("ghost")), F.struct(F.col("up").alias("at"), F.lit(1).alias("ghost"))
    dealt = ranged.drop("near").join(F.broadcast(heads), "range").withColumn("to", F.explode(F.when(F.col("key") == F.col("head"), F.array(own, ghost)).otherwise(F.array(own))))
    follow = Window.partitionBy("to.at").orderBy(F.col("to.ghost"), F.col("key").desc(), *(f"row.{c}" for c in columns[:1]))
    out = dealt.withColumns({f"next_{c}": F.lead(f"row.{c}").over(follow) for c in columns})
    return out.where("to.ghost = 0").select("row.*", *(f"next_{c}" for c in columns))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every whole document, of its edited text, and their likeness to each other and to the next document's."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges_of(docs)
    docs = docs.withColumn("print", sketch(F.col("text")))
    rows = with_next(docs, "doc_id", ["text", "print"], ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", edited.alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_print": sketch(F.col("edited"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
