"""Fill-in-the-middle: texts are cut in three at two tokens and put together again, with the middle last. DuckDB works on whole Arrow batches."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A token is a run of ASCII letters or any other code point.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: The marks of prefix, suffix and middle. None may be part of another.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, how many are rearranged, and how many of those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters of text that one DuckDB statement takes: a token takes it about forty bytes, so memory follows this or one longer text.
STATEMENT = 1 << 20
#: DuckDB's own memory in a task; it has no folder to spill to, so what does not fit fails aloud.
MEMORY = "1500MB"
MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

#: The batch has the columns i (row number), key (string) and text. Four draws come from a hash of the key; two of them are cuts.
CUT = """
WITH drawn AS (SELECT i, text, regexp_extract_all(text, $token) AS t, sha256('1:' || key) AS h FROM batch),
cut AS (SELECT i, text, t, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(t) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(t) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT AS c, ('0x' || substr(h, 25, 8))::BIGINT AS d FROM drawn),
formed AS (SELECT *, CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR c % 100 >= $rate THEN 'plain' WHEN d % 100 < $suffix_first THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT i, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(t, 1, least(a, b)), '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(t, least(a, b) + 1, greatest(a, b)), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(t, greatest(a, b) + 1, n), '') END AS suffix FROM formed)
SELECT n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM parts ORDER BY i
"""


def _pieces(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """(first row, rows) of consecutive pieces of about ``limit`` bytes; a longer text is a piece of its own."""
    at, out, size = 0, [], 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > at and size + n > limit:
            out.append((at, i - at))
            at, size = i, 0
        size += n
    return [*out, (at, len(texts) - at)] if len(texts) else out


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output, the text for training.

    The cuts lie before tokens that a SHA-256 of the key chooses, so a document is cut alike whenever and wherever it is read. In psm, output
    is prefix, suffix, middle, each behind its mark; in spm the suffix comes first. An empty text, one that has a mark in it, and
    those that the draw leaves out stay plain: output is the text, and prefix_chars and middle_chars are null.

    A null text is an empty one; a null key counts as an empty one. Rows that repeat a key are cut at tokens of the same draw. Each row is by itself, so order,
    repeats and skew change nothing, and an empty table stays empty. Columns of ``docs`` with the names of new ones are replaced.
    A text is never split: a task needs memory for its longest text, about a hundred times its bytes.
    """
    given = {"token": TOKEN, "p": marks[0], "s": marks[1], "m": marks[2], "rate": rate, "suffix_first": suffix_first}

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        keys = batch.column(batch.schema.get_field_index(key)).cast(pa.string()).fill_null("")
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        made = []
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for at, rows in _pieces(texts, STATEMENT):
                con.register("batch", pa.table({"i": pa.array(range(rows), pa.int64()), "key": keys.slice(at, rows), "text": texts.slice(at, rows)}))
                made.append(con.sql(CUT, params=given).to_arrow_table())
                con.unregister("batch")
        return {f.name: pa.concat_tables(made).column(f.name).combine_chunks() for f in MADE.fields} if made else {f.name: pa.array([]) for f in MADE.fields}

    return common.append_columns(docs, cut, MADE)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of, told from its form alone. A rearranged text has no mark of its own, so each mark is where it was put."""
    p, s, m = (F.lit(x) for x in marks)
    behind = lambda c, mark: F.substr(c, F.instr(c, mark) + F.char_length(mark))
    psm = F.concat(F.substring_index(behind(output, p), marks[1], 1), behind(output, m), F.substring_index(behind(output, s), marks[2], 1))
    spm = F.concat(F.substring_index(behind(output, p), marks[2], 1), behind(output, m), F.substring_index(behind(output, s), marks[0], 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document rearranged for filling in the middle, and digests of the result and of the text that it gives back. Cases are those of ``rearrange``."""
    made = rearrange(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: By positions of characters: each token's end is a running sum of lengths, and the parts are substrings of the text.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS w FROM d),
n AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM e),
k AS (SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form, CAST(coalesce(list_sum(w[1 : least(a, b)]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(w[least(a, b) + 1 : greatest(a, b)]), 0) AS BIGINT) AS m FROM n),
o AS (SELECT *, left(text, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
