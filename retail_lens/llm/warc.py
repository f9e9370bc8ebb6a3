"""WARC archives written and read with Spark's text source; a chain of record lengths tells records from look-alikes.

Reading cuts files at every ``WARC/1.`` in parallel splits. Such a magic may also stand inside a payload, so each candidate
names its successor (its own offset plus header and Content-Length), and pointer jumping from each file's first byte keeps
the candidates that the chain reaches. Magic inside a payload or a header is never reached; its pieces go back where they stood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1."
CRLF = "\r\n"
#: Smaller payloads are never deduplicated.
MIN_REVISIT_BYTES = 100
#: Offsets are joined to record intervals by blocks of so many bytes.
BLOCK = 1 << 20
FIELDS = ("path", "piece", "head", "length")


def payload_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row a record: key, uri, payload (binary), digest, size, refers_to (the response's key for revisits, else null).

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest key is the response. Null payloads are empty;
    null uris are empty; a null key gives a response without a record id; rows repeated with one key are records of one key, and refer to it if another row is the response.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    keyed = rows.where(F.col("size") >= min_bytes).select("key", "digest")
    first = common.materialize(keyed.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-first")
    revisits = common.materialize(keyed.join(first, "digest").where("key <> first").select("key", "digest", F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    common.drop(first)
    return rows.join(revisits, ["key", "digest"], "left")


def record_text(r: DataFrame) -> Column:
    """A record's bytes, up to but without its closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    header = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("key").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *header), F.lit(CRLF + CRLF), body.cast("string"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes one archive a partition. The text source copies bytes, so payloads need not be UTF-8."""
    records.select(record_text(records).alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at each magic, in scan order: path, file (its hash, a short key), block (where the split starts), seq, piece (bytes after the magic), bytes,
    starts (it goes on as a record does), head (bytes before its first blank line, null if it has none) and length (a Content-Length before that line)."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value"))
    first = F.substring_index("value", CRLF + CRLF, 1)
    said = _field(F.concat(F.lit(MAGIC), first), "Content-Length").try_cast("long")
    return lines.select("path", "file", "block", "seq", F.col("value").cast("binary").alias("piece"), F.octet_length("value").cast("long").alias("bytes"), (F.substring("value", 2, 2) == CRLF).alias("starts"),
                        F.when(F.col("value").contains(CRLF + CRLF), F.octet_length(first).cast("long")).alias("head"), said.alias("length"))


def offsets(cut: DataFrame) -> DataFrame:
    """(file, block, seq, bytes, starts, whole, offset, head, length) of each piece, from what ``candidates`` says of it.

    The offset is the bytes of earlier splits, then of earlier pieces of its split. A header ends at the first blank line from
    its start on, in whatever piece that is, because a field may hold the magic too; head and length tell the bytes up to there
    and the first Content-Length in them, and whole that all of the header is in the piece itself. A split's pieces are one
    window, so a window holds at most what one split holds; the splits of a file are a few rows.
    """
    split = Window.partitionBy("file", "block")
    before = split.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    onward = split.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("inside", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(before), F.lit(0)))
    cut = cut.withColumns({"end": F.when(F.col("head").isNotNull(), F.struct("inside", (F.col("inside") + F.col("head")).alias("n"))), "said": F.when(F.col("length").isNotNull(), F.struct("inside", F.col("length").alias("n")))})
    sums = cut.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("of_block"), F.min("end").alias("end"), F.min("said").alias("said"))
    file = Window.partitionBy("file")
    sums = sums.withColumn("base", F.coalesce(F.sum("of_block").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = file.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c, base, n: F.when(c.isNotNull(), F.struct((base + c["inside"]).alias("inside"), n.alias("n")))
    base = F.col("base")
    sums = sums.select("file", "block", "base", F.last(at(F.col("end"), base, base + F.col("end.n")), True).over(later).alias("next_end"), F.last(at(F.col("said"), base, F.col("said.n")), True).over(later).alias("next_said"))
    cut = cut.withColumns({"end": F.last("end", True).over(onward), "said": F.last("said", True).over(onward)}).join(sums, ["file", "block"])
    end = F.coalesce(at(F.col("end"), base, base + F.col("end.n")), F.col("next_end"))
    said = F.coalesce(at(F.col("said"), base, F.col("said.n")), F.col("next_said"))
    start = base + F.col("inside")
    return cut.select("file", "block", "seq", "bytes", "starts", F.col("head").isNotNull().alias("whole"), (start - len(MAGIC)).alias("offset"), (end["n"] - start).alias("head"), F.when(said["inside"] <= end["inside"], said["n"]).alias("length"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) that the chain of (file, offset, successor) reaches from offset 0, by pointer jumping.

    Each round doubles the jump: what is reached takes in what one jump from it reaches, and jumps are joined with themselves.
    So a file with n records takes log2(n) rounds; a file that does not start with a record has none.
    """
    jump = links.select("file", "offset", F.col("successor").alias("to"))
    reached = links.where("offset = 0").select("file", "offset").distinct()
    earlier: list[DataFrame] = []
    while True:
        hop = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        nxt = jump.join(hop, ["file", "to"]).select("file", "offset", F.col("next").alias("to"))
        more = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        new_reached = common.materialize(reached.union(more).distinct(), "warc-reached")
        new_jump = common.materialize(nxt, "warc-jump")
        for x in earlier:
            common.drop(x)
        reached, jump, earlier = new_reached, new_jump, [new_reached, new_jump]
        if jump.isEmpty():
            return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, header (text), payload (binary), type, record_id, refers_to, digest, size.

    digest and size are of the payload as archived; for a revisit, which has none, of its response by the header. Look-alike
    magic in a payload or in a header field stays there. An archive cut short loses its last record; archives without a record, and
    files that don't start with one, give no rows.

    The archives are scanned once and their pieces written down: how Spark cuts files follows the live cores, so only what is
    written down has one (file, block, seq). Payloads are shuffled only where look-alike magic broke a record up.
    """
    pieces = common.materialize(candidates(spark, path), "warc-pieces", "zstd")
    cut = common.materialize(offsets(pieces.drop("path", "piece")), "warc-cut")
    end = F.col("offset") + len(MAGIC) + F.col("head") + 2 * len(CRLF) + F.col("length") + 2 * len(CRLF)
    # a chain's last link leads to the end of its file, where no candidate starts
    real = reachable(cut.where("starts and offset >= 0 and length >= 0").select("file", "offset", end.alias("successor")))
    known = cut.join(real.withColumn("real", F.lit(True)), ["file", "offset"], "left")
    one = F.col("real") & F.col("whole") & (F.col("head") + 2 * len(CRLF) + F.col("length") <= F.col("bytes"))
    odd = common.materialize(known.where(~F.coalesce(one, F.lit(False))), "warc-odd")
    records = pieces.join(odd.select("file", "block", "seq"), ["file", "block", "seq"], "left_anti").select(*FIELDS).union(_rejoined(pieces, odd))
    h = F.col("header")
    payload = F.col("piece").substr(F.col("head").cast("int") + F.lit(2 * len(CRLF) + 1), F.col("length").cast("int"))
    records = records.withColumn("header", F.col("piece").substr(F.lit(1), F.col("head").cast("int")).cast("string"))
    out = records.select(F.col("path").alias("file"), h, payload.alias("payload"), _field(h, "WARC-Type").alias("type"), _urn(h, "WARC-Record-ID").alias("record_id"), _urn(h, "WARC-Refers-To").alias("refers_to"), _field(h, "WARC-Payload-Digest").alias("noted"), _field(h, "WARC-Payload-Length").try_cast("long").alias("noted_size"))
    revisit = F.col("type") == "revisit"
    digest = F.when(revisit, F.substring_index("noted", ":", -1)).otherwise(F.sha2("payload", 256))
    size = F.when(revisit, F.col("noted_size")).otherwise(F.octet_length("payload").cast("long"))
    return out.select("file", "header", "payload", "type", "record_id", "refers_to", digest.alias("digest"), size.alias("size"))


def _urn(header: Column, name: str) -> Column:
    return F.regexp_extract(_field(header, name), r"^<urn:page:(.*)>$", 1)


def _rejoined(pieces: DataFrame, odd: DataFrame) -> DataFrame:
    """Records that hold look-alike magic in header or payload: their pieces in order of offset, with the magic put back between them.

    ``odd`` has these records' first pieces (real) and the look-alikes. A record takes the look-alikes between its ends;
    both are dealt out by blocks of the file, and at most one record holds a look-alike.
    """
    broken = odd.where("real").withColumn("last", F.col("offset") + F.col("head") + F.col("length") + 2 * len(CRLF))
    spans = broken.select("file", F.col("offset").alias("record"), "last", "head", "length", F.explode(F.sequence(F.expr(f"offset div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("slot"))
    parts = odd.select("file", "block", "seq", "offset", F.expr(f"offset div {BLOCK}").alias("slot"))
    held = common.materialize(parts.join(spans, ["file", "slot"]).where("offset >= record and offset <= last").select("file", "block", "seq", "offset", "record", "head", "length"), "warc-held")
    texts = pieces.drop("head", "length").join(held, ["file", "block", "seq"])
    joined = texts.groupBy("file", "record").agg(F.max("path").alias("path"), F.max("head").alias("head"), F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    return joined.withColumn("piece", F.array_join(F.transform("parts", lambda p: p["piece"].cast("string")), MAGIC).cast("binary")).select(*FIELDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all of ``pages`` to WARC archives in the shared folder and reads them back."""
    path = common.scratch_dir(spark, "warc")
    write_warc(payload_records(common.table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path)
    return back.select(F.col("record_id").try_cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").try_cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
