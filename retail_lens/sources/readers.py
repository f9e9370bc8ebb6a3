"""Readers of link lists, dimension files and canonical tables."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import place, text, url
from ..scratch import saved

# Names of the column that holds the links, the most specific first.
URL_COLUMNS = ("url", "website", "website_url", "site", "homepage", "link", "store_url", "domain", "web")
LINK = r"(?:https?://|www\.)[^\s<>\"]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[^\s<>\"]*)?"
TRAILING = ".,;:!?)]}'\""


def links_in_text(text: Column) -> Column:
    """Links of a prose text, without the punctuation that follows them."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + LINK), 0), lambda u: F.rtrim(u, F.lit(TRAILING)))


def link_in_cell(cell: Column) -> Column:
    """The link of a cell: a sentence yields the first link in it, and stays as it is if it has none."""
    t = F.trim(cell)
    return F.when(t.rlike(r"\s"), F.coalesce(F.get(links_in_text(t), F.lit(0)), t)).otherwise(t)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(input_id, url) of all links in text files, one row a link; ids count from 0 in the order of files, lines and links in them, without gaps.

    Links are written down with the split that they were read in, splits are counted, and a link's id is its place in the split behind all splits before: no task orders more than one.
    """
    lines = spark.read.text(path)
    at = lines.metadataColumn("_metadata")
    found = lines.select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), links_in_text(F.col("value")).alias("links"))
    rows = saved(found.select("file", "block", "line", F.posexplode("links").alias("pos", "url")), "links")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("line", "pos")) - 1
    return rows.withColumn("place", place).join(splits, ["file", "block"]).select((F.col("before") + F.col("place")).alias("input_id"), "url")


def _sheet(data: bytes) -> tuple[list[str], list[dict[str, str]]]:
    """Header and rows of a workbook's first sheet; its first non-empty row is the header, and a column without a name is called by its number."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        sheet = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        header: dict[int, str] | None = None
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{ns}row"):
            cells: dict[int, str] = {}
            for k, cell in enumerate(row.iter(f"{ns}c")):
                letters = re.match("[A-Z]+", cell.get("r", ""))
                at = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters[0], 0) - 1 if letters else k
                value = cell.find(f"{ns}v")
                text = "".join(t.text or "" for t in cell.iter(f"{ns}t")) if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                if text is not None:
                    cells[at] = text
            if cells and header is None:
                header = {i: (cells.get(i) or "").strip() or f"column_{i + 1}" for i in range(max(cells) + 1)}
            elif cells:
                rows.append({n: cells[i] for i, n in header.items() if i in cells})
    return list((header or {}).values()), rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of workbooks, every value as text: each file is read by one task, a row becomes a map, and the maps' keys the columns."""
    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                head, rows = _sheet(data)
                yield pd.DataFrame({"n": range(len(rows)), "head": [head] * len(rows), "cells": rows})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "n long, head array<string>, cells map<string,string>")
    names = [r[0] for r in cells.select(F.posexplode("head").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").select("name").collect()]  # columns of sheets
    return cells.orderBy("n").select(*(F.try_element_at("cells", F.lit(n)).alias(n) for n in names))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A table file by its suffix, every value as text; an unknown suffix is an error. A JSON document may be a list, or an object with one list of records."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", inferSchema=False, multiLine=True, escape='"')
        return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    if suffix in ("json", "jsonl", "ndjson"):
        df = spark.read.json(path, multiLine=suffix == "json")
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        return df.select(F.inline(F.col(f"`{lists[0]}`"))) if suffix == "json" and len(lists) == 1 else df
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "xlsx":
        return read_xlsx(spark, path)
    if suffix in ("txt", "text", "md"):
        return read_text(spark, path)
    raise ValueError(f"cannot read .{suffix} files")


def url_column(df: DataFrame, named: str | None = None) -> str:
    """The column with links: the named one, else the first with a usual name, else the one most of whose values look like links (half at least). One pass."""
    if named:
        if named not in df.columns:
            raise ValueError(f"no column {named}")
        return named
    by_name = {c.lower().strip(): c for c in reversed(df.columns)}
    for c in URL_COLUMNS:
        if c in by_name:
            return by_name[c]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shares = df.agg(*(F.avg(F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`").rlike(rf"(?i)^\s*(?:{LINK})\s*$").cast("int"))).alias(c) for c in texts)).first() if texts else {}
    best = max(texts, key=lambda c: shares[c] or 0, default=None)
    if best is None or (shares[best] or 0) < 0.5:
        raise ValueError("no column holds links")
    return best


def clean_values(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, dates as ISO text, decimals as doubles, bytes as UTF-8 text; nested values stay."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(f.dataType, T.BinaryType):
            return F.decode(c, "UTF-8")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c

    return df.select(*(one(f).alias(f.name) for f in df.schema.fields))


def aliased(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by any of their aliases, compared without case and punctuation; the first non-blank value counts, ``""`` if there is none."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    found = {plain(c): c for c in reversed(df.columns)}
    pick = lambda options: [F.nullif(F.trim(F.col(f"`{found[plain(o)]}`").cast("string")), F.lit("")) for o in options if plain(o) in found]
    return df.select(*(F.coalesce(*pick((name, *options)), F.lit("")).alias(name) for name, options in names.items()))


ACCOUNT_FIELDS = {"name": ("Account Name", "company"), "website": ("Web site", "url"), "phone": ("Telephone",), "city": ("Billing City",), "state": ("Billing State", "prov_state", "province"), "postal": ("Billing Zip", "postal_zip", "zip"), "country": ("Billing Country",)}


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return aliased(read_file(spark, path), ACCOUNT_FIELDS)


def read_brand_relations(spark: SparkSession, path: str) -> DataFrame:
    """(brand, relation): a relation that starts with ``comp`` is a competitor, any other a peer."""
    rows = aliased(read_file(spark, path), {"brand": ("name", "vendor"), "relation": ("type",)})
    return rows.where("brand <> ''").select("brand", F.when(F.lower("relation").startswith("comp"), "competitor").otherwise("peer").alias("relation"))


STOCKIST_FIELDS = {
    "name": ("store_name", "location_name"), "website": ("url", "web"), "phone": ("telephone",), "city": (), "state": ("prov_state", "province"), "postal": ("postal_zip", "zip", "postal_code"), "country": (), "lat": ("latitude",), "lng": ("lon", "longitude"),
}


def read_stockists(spark: SparkSession, path: str) -> DataFrame:
    """Stockists of a JSON list, a ``{"stores": [...]}`` document or a CSV: loosely named columns, blank cells skipped; domain, phone digits, state code, postal code and coordinates as they compare."""
    r = aliased(read_file(spark, path), STOCKIST_FIELDS)
    return r.select(
        "name", url.site_domain(F.col("website")).alias("domain"), text.digits(F.col("phone")).alias("phone"), "city", place.state_code(F.col("state")).alias("state"), place.normalize_postal(F.col("postal")).alias("postal"), "country",
        text.loose_number(F.col("lat")).alias("lat"), text.loose_number(F.col("lng")).alias("lng"))


def read_price_points(spark: SparkSession, path: str) -> DataFrame:
    """(category, wholesale, retail) in US dollars; unknown prices are null."""
    r = aliased(read_file(spark, path), {"category": ("type", "product_type"), "wholesale": ("wholesale_usd", "wholesale_price"), "retail": ("retail_usd", "retail_price", "msrp")})
    return r.where("category <> ''").select(F.lower("category").alias("category"), text.loose_number(F.col("wholesale")).alias("wholesale"), text.loose_number(F.col("retail")).alias("retail"))


def read_locators(spark: SparkSession, folder: str) -> DataFrame:
    """All published locators of a folder, each a JSON list named after its brand."""
    schema = "name string, city string, state string, latitude double, longitude double"
    return spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True).select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("brand"))


def optional(spark: SparkSession, read, schema: str, *paths: str) -> tuple[DataFrame, str]:
    """What ``read`` makes of the first of ``paths`` that is there, and that path; else an empty table of ``schema``, so that joins go on, and ""."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return read(spark, path), path
    return spark.createDataFrame([], schema), ""


def largest_run(spark: SparkSession, runs: str, table: str = "products", named: str | None = None) -> str:
    """The run that is named, else the one whose ``table`` has the most bytes, else the newest; run folders are named by their time."""
    if named:
        return named
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{table}.*").option("recursiveFileLookup", "true").load(runs).select("path", "length")
    run = F.regexp_extract("path", rf"{re.escape(runs.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/", 1)
    best = files.groupBy(run.alias("run")).agg(F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), F.desc("run")).first()
    return best["run"] if best else ""


def read_table(spark: SparkSession, schema: T.StructType, *paths: str, tolerant: bool = False) -> DataFrame:
    """Canonical JSONL tables with a declared schema; broken lines are an error, or skipped if ``tolerant``."""
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).json(p, mode="DROPMALFORMED" if tolerant else "FAILFAST") for p in paths))


def only_domains(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted domains; Spark broadcasts the wanted ones if they are few."""
    return df.join(wanted.select("domain").distinct(), "domain", "left_semi")
