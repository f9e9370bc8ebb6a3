"""Text similarity: sublinear TF-IDF over word n-grams, and cosine to a reference row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..registry import query


#: Rows' keys of one span are neighbours that a task sorts together.
SPAN = 100_000
#: Claims of one or two words that are searched for at a time.
SHORT_CLAIMS = 1000


def _terms(docs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, term): words of two letters or more, and pairs of neighbouring ones, also where a pair goes on from one row of a key to the next.

    The next row's first word comes from a window over a span of ``order``, or from the first row of the key's next span: no task
    sees more of a key than a span, and of the spans one row each.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), 0)
    rows = docs.select(key, F.col(order).cast("long").alias("o"), words.alias("w")).where(F.size("w") > 0).withColumn("span", F.floor(F.col("o") / SPAN))
    head = F.get("w", F.lit(0))
    spans = rows.groupBy(key, "span").agg(F.min_by(head, "o").alias("head"))
    spans = spans.select(key, "span", F.lead("head").over(Window.partitionBy(key).orderBy("span")).alias("later"))
    rows = rows.withColumn("next", F.lead(head).over(Window.partitionBy(key, "span").orderBy("o"))).join(spans, [key, "span"])
    run = F.concat("w", F.array_compact(F.array(F.coalesce("next", "later"))))
    pairs = F.when(F.size("run") > 1, F.zip_with(F.slice("run", 1, F.size("run") - 1), F.slice("run", 2, F.size("run") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, "w", run.alias("run")).select(key, F.explode(F.concat("w", pairs)).alias("term"))


def tfidf(docs: DataFrame, key: str, order: str, text: str, min_df: int = 2) -> DataFrame:
    """(key, term, weight) of the documents that the rows of a key make in ``order``: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), each document's weights of length 1.

    Terms in under ``min_df`` documents go. All of it is aggregates; no text is put together.
    """
    tf = _terms(docs, key, order, text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n = docs.agg(F.countDistinct(key).alias("docs"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))  # one row
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


@query(r"""
WITH d AS (SELECT p_brand, string_agg(p_name || ' ' || lower(p_type), ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand),
w AS (SELECT p_brand, regexp_extract_all(lower(text), '\b\w\w+\b') AS w FROM d),
t AS (SELECT p_brand, unnest(w) AS term FROM w UNION ALL SELECT p_brand, w[i] || ' ' || w[i + 1] FROM (SELECT p_brand, w, unnest(range(1, len(w))) AS i FROM w)),
tf AS (SELECT p_brand, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT p_brand, tf.term AS term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term),
n AS (SELECT p_brand, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), v AS (SELECT x.p_brand AS p_brand, term, w / norm AS w FROM x JOIN n ON n.p_brand = x.p_brand)
SELECT a.p_brand AS brand, round(sum(a.w * b.w), 5) AS cosine FROM v a JOIN v b ON b.term = a.term AND b.p_brand = 'Brand#7' WHERE a.p_brand <> 'Brand#7' GROUP BY a.p_brand""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each brand's product texts are to the home brand's."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    v = tfidf(part, "p_brand", "p_partkey", "text")
    home = v.where("p_brand = 'Brand#7'").select("term", F.col("weight").alias("home"))
    return v.where("p_brand <> 'Brand#7'").join(home, "term").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.sum(F.col("weight") * F.col("home")), 5).alias("cosine"))


@query("WITH b AS (SELECT CAST(item_id AS BIGINT) AS item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t) WHERE b.t <> ''")
def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole claim of any length, spaces and case aside."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return contained(table(spark, sf_dir, "documents").select("doc_id", "text"), claims)


def contained(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document's text contains a claim's, in lower case and with single spaces. Empty claims are nowhere.

    A claim's first and last words may be parts of a document's words, so candidates meet on a hash of the up to six whole words
    between them, and then the text is searched. Claims of one or two words have none between: they are searched for in blocks of
    SHORT_CLAIMS, each a pass over the documents.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " ")
    b = claims.select("item_id", words(F.col("text")).alias("w")).withColumn("claim", F.array_join("w", " ")).where("claim <> ''")
    keyed = b.where(F.size("w") > 2).withColumn("n", F.least(F.size("w") - 2, F.lit(6)))
    keyed = keyed.select("item_id", "claim", "n", F.xxhash64(F.slice("w", F.lit(2), F.col("n"))).alias("key"))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # at most six
    d = docs.where("text is not null").select("doc_id", words(F.col("text")).alias("w"))
    keys = lambda n: F.when(F.size("w") >= n, F.transform(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))), lambda h: F.struct(F.lit(n).alias("n"), h.alias("key"))))
    none = F.array().cast("array<struct<n:int,key:bigint>>")
    met = d.select("doc_id", F.explode(F.concat(none, *(F.coalesce(keys(n), none) for n in sizes))).alias("k")).select("doc_id", "k.n", "k.key")
    near = met.join(keyed, ["n", "key"]).select("doc_id", "item_id", "claim").distinct()
    texts = d.select("doc_id", F.array_join("w", " ").alias("t"))
    out = near.join(texts, "doc_id").where(F.col("t").contains(F.col("claim"))).select("doc_id", "item_id")
    short, block = b.where(F.size("w") <= 2).select("item_id", "claim"), []
    for r in [*short.toLocalIterator(), None]:
        if r is not None:
            block.append(r)
        if block and (r is None or len(block) == SHORT_CLAIMS):
            known = F.array(*(F.struct(F.lit(x["item_id"]).alias("item_id"), F.lit(x["claim"]).alias("claim")) for x in block))
            out = out.union(texts.select("doc_id", F.explode(F.filter(known, lambda k: F.contains(F.col("t"), k["claim"]))).alias("k")).select("doc_id", "k.item_id"))
            block = []
    return out.distinct()


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id, e FROM v WHERE vec_id = 0) SELECT v.vec_id AS vec_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 4) AS cosine FROM v CROSS JOIN q")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the reference row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = e.where("vec_id = 0").select(F.col("e").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q"))), 4).alias("cosine"))  # one row
