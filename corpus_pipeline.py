"""A corpus pipeline of the training-data operators: raw documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
``documents``; null texts pass the stages that follow the first as empty ones do, though the first one rejects both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lens.llm import common, decontamination, jaccard, language, packing, pii

#: A language below this probability is no decision, and the document goes.
LEAST_SCORE = 0.5
#: A document with a larger share of its words in benchmark passages goes as a whole; of others, the passages go.
MOST_HIT = 0.5


def _recounted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that can be told; those without a letter, and those of no clear language, go."""
    return language.identify(docs, language.fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more, through any number of links."""
    classes = jaccard.jaccard_classes(docs, width=5, per_cent=80)
    gone = common.materialize(classes.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items out of the texts; a document that is mostly such passages goes."""
    scanned = decontamination.scan_benchmark(docs, common.table(spark, sf_dir, "benchmark"), cleaned="cleaned")
    hits = F.length(F.translate(F.hex("hit"), "0", ""))
    return _recounted(scanned.where((hits == 0) | (hits <= MOST_HIT * F.col("n_words"))).withColumn("text", F.col("cleaned"))).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a kind in brackets in the place of personal data."""
    return _recounted(pii.redact(docs, pii.fit(docs))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents, as UTF-8 byte tokens, in sequences of the permitted lengths."""
    return packing.best_fit(docs.select("doc_id", packing.byte_tokens("text").alias("n")), "n")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models decide in two stages, which SQL cannot express; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
