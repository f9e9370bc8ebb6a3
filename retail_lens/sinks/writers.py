"""Writers: JSON, JSONL, CSV, TSV, Parquet, ORC, and the SQLite and DuckDB files of a finished run."""

from __future__ import annotations

import json
import sqlite3
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a one-file writer holds at a time.
BATCH = 5000
CELL_LIMIT, CELL_MARK = 32_767, " [cut]"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields))


def sheet_text(df: DataFrame) -> DataFrame:
    """Texts as a spreadsheet takes them: no control characters, formulas as text, cells within the limit."""
    def one(name: str):
        t = F.regexp_replace(F.col(f"`{name}`"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        t = F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)
        return F.when(F.char_length(t) > CELL_LIMIT, F.concat(F.left(t, F.lit(CELL_LIMIT - len(CELL_MARK))), F.lit(CELL_MARK))).otherwise(t).alias(name)

    return df.select(*(one(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """One SQLite table, rows streamed from Spark a partition at a time; an index on domain if there is one. A local file of the driver, for results of one run."""
    rows = flat(df)
    kind = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL"}
    columns = ", ".join(f'"{f.name}" {kind.get(type(f.dataType), "TEXT")}' for f in rows.schema.fields)
    with sqlite3.connect(path) as db:
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({columns})')
        insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(rows.columns))})'
        batch: list[tuple] = []
        for r in rows.toLocalIterator():
            batch.append(tuple(r))
            if len(batch) >= BATCH:
                db.executemany(insert, batch)
                batch.clear()
        db.executemany(insert, batch)
        if "domain" in rows.columns:
            db.execute(f'CREATE INDEX "{table}_domain" ON "{table}" (domain)')


def write_duckdb(df: DataFrame, path: str, table: str) -> None:
    """One DuckDB table by way of Parquet beside it."""
    import duckdb

    flat(df).write.mode("overwrite").parquet(f"{path}.{table}.parquet")
    with duckdb.connect(path) as db:
        db.execute(f'CREATE OR REPLACE TABLE "{table}" AS SELECT * FROM read_parquet(\'{path}.{table}.parquet/*.parquet\')')


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array of a table, rows streamed a partition at a time; a file of the driver, for results of one run."""
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for n, r in enumerate(text.toLocalIterator()):
            out.write((",\n" if n else "\n") + r["j"])
        out.write("\n]\n")


#: Rows of a sheet besides its header; a longer table goes on in the next sheet.
SHEET_ROWS = 1_048_575
_ROW = '<row>{}</row>'


def write_xlsx(tables: dict[str, DataFrame], path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """One workbook with a sheet a table: a bold, frozen header, texts as ``sheet_text`` makes them, numbers as numbers. A file of the driver; rows are streamed."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v, style="": "<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for table, df in tables.items():
            rows, part = sheet_text(flat(df)).toLocalIterator(), 0
            head = "".join(cell(n, ' s="1"') for n in df.columns)
            row = next(rows, None)
            while row is not None or part == 0:
                part += 1
                names.append(table if part == 1 else f"{table}_{part}")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    out.write(f'<worksheet xmlns="{ns}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{_ROW.format(head)}'.encode())
                    for _ in range(sheet_rows):
                        if row is None:
                            break
                        out.write(_ROW.format("".join(map(cell, row))).encode())
                        row = next(rows, None)
                    out.write(b"</sheetData></worksheet>")
        ids = range(1, len(names) + 1)
        sheets = "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(ids, names, strict=True))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        pack = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">{links}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="w" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')


#: Segments in the order in which an analysis lists them.
SEGMENTS = ("retail_partner", "existing_customer", "competitor", "check", "not_a_fit", "not_read", "unknown")


def write_summary(inputs: DataFrame, summary: DataFrame, path: str, key: str = "input_id") -> None:
    """One row an input, in the order of ``key``: the input's own columns first, then those of the summary; inputs without one stay."""
    extra = [x for x in summary.columns if x not in inputs.columns]
    both = inputs.join(summary.select(key, *extra), key, "left").select(*inputs.columns, *extra).orderBy(key)
    flat(both).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def write_analysis(stores: DataFrame, path: str) -> None:
    """Stores by segment, then the highest score, then domain."""
    order = F.array_position(F.array(*(F.lit(x) for x in SEGMENTS)), F.col("segment"))
    flat(stores.orderBy(order, F.desc("score"), "domain")).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def write_manifest(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Rows of each table of a run, as JSON beside a Markdown table; returns them. Only counts come to the driver."""
    counts = {name: df.count() for name, df in tables.items()}
    with open(f"{path}.json", "w", encoding="utf-8") as out:
        json.dump(counts, out, indent=1)
    with open(f"{path}.md", "w", encoding="utf-8") as out:
        out.write("| Table | Rows |\n|---|---|\n" + "".join(f"| {n} | {k:,} |\n" for n, k in counts.items()))
    return counts


def map_records(df: DataFrame, by: str) -> DataFrame:
    """One JSON record a value of ``by``, with its rows nested: what a map of stores reads."""
    rest = [x for x in df.columns if x != by]
    return df.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("rows"), F.count("*").alias("n"))


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": write_json,
    "jsonl": lambda df, path: df.write.mode("overwrite").json(path, ignoreNullFields=False),
    "csv": lambda df, path: flat(df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue=""),
    "tsv": lambda df, path: flat(df).write.mode("overwrite").csv(path, header=True, sep="\t", escape='"', emptyValue="", nullValue=""),
    "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    "orc": lambda df, path: df.write.mode("overwrite").orc(path),
}


def export(tables: dict[str, DataFrame], formats: list[str], dest: str) -> dict[str, str]:
    """Writes every table in every format under ``dest``. Returns the message of each writer that failed; the others go on. An unknown format is an error."""
    unknown = set(formats) - WRITERS.keys()
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}")
    failed = {}
    for f in formats:
        for name, df in tables.items():
            try:
                WRITERS[f](df, f"{dest}/{name}.{f}")
            except Exception as e:  # noqa: BLE001  one format's failure must not stop the others
                failed[f"{name}.{f}"] = str(e)
    return failed


def append_rows(df: DataFrame, path: str) -> None:
    """Canonical rows appended; a job that fails leaves none of its rows."""
    df.write.mode("append").json(path, ignoreNullFields=False)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
