"""Input tables: delimited, JSON, Parquet, workbooks, SQLite, tagged citation exports."""

from __future__ import annotations

import os
import re
import sqlite3
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("EN", "TR")
METHODS = ("nmf", "pnmf", "opnmf", "nmtf")
#: Rows that are taken from a local database at a time.
FETCH_ROWS = 10_000


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """UTF-8 text with a header; quoted fields may hold line breaks, malformed lines are left out, all columns are STRING."""
    return spark.read.csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED", encoding="UTF-8")


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table by its suffix: csv, tsv, json, parquet, xlsx, db or sqlite (its only table)."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt"):
        return read_delimited(spark, path, separator)
    if kind == "tsv":
        return read_delimited(spark, path, "\t")
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        return read_workbook(spark, path)
    if kind in ("db", "sqlite"):
        with sqlite3.connect(path) as con:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        if len(names) != 1:
            raise ValueError(f"{path} has the tables {names}; use read_sqlite with a query")
        return read_sqlite(spark, path, f'SELECT * FROM "{names[0]}"')
    raise ValueError(f"unknown kind of table: {path}")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(path: str) -> list[list[str | None]]:
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            line: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                col = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    col = col * 26 + ord(ch) - 64
                v = c.find("m:v", _NS)
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) or None
                line[col - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([line.get(i) for i in range(max(line, default=-1) + 1)])
        return out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an xlsx workbook, its first row as the header; all columns are STRING. A workbook fits on the driver."""
    rows = _cells(path)
    if not rows:
        raise ValueError(f"{path} has no rows")
    names = [n or f"_c{i}" for i, n in enumerate(rows[0])]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([(r + [None] * len(names))[: len(names)] for r in rows[1:]], schema)


def read_sqlite(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """The rows of a query on a SQLite file; types are those of the first value of each column that isn't NULL."""
    kinds = {int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType()}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        rows = cur.fetchall()
    fields = []
    for i, n in enumerate(names):
        found = {type(r[i]) for r in rows if r[i] is not None}
        kind = kinds.get(found.pop(), T.StringType()) if len(found) == 1 else T.DoubleType() if found == {int, float} else T.StringType()
        fields.append(T.StructField(n, kind))
    fix = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else (lambda x: x) for f in fields]
    return spark.createDataFrame([tuple(None if v is None else fix[i](v) for i, v in enumerate(r)) for r in rows], T.StructType(fields))


def write_sqlite(df: DataFrame, path: str, table: str, append: bool = False) -> int:
    """Rows of df into a table of a SQLite file, in one transaction, one partition at a time on the driver; the number of rows."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB", "boolean": "INTEGER"}
    name = '"' + table.replace('"', '""') + '"'
    columns = ", ".join('"' + c.replace('"', '""') + '" ' + kinds.get(t, "TEXT") for c, t in df.dtypes)
    plain = df.select(*[F.col(f"`{c}`") if t in kinds else F.col(f"`{c}`").cast("string") for c, t in df.dtypes])
    con = sqlite3.connect(path)
    n = 0
    try:
        with con:
            if not append:
                con.execute(f"DROP TABLE IF EXISTS {name}")
            con.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
            part: list[tuple] = []
            for r in plain.toLocalIterator():
                part.append(tuple(r))
                if len(part) >= FETCH_ROWS:
                    con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", part)
                    n, part = n + len(part), []
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", part)
            n += len(part)
    finally:
        con.close()
    return n


def persisted(df: DataFrame, path: str, table: str, save: bool = True) -> DataFrame:
    """df written to a SQLite table and read back, or df itself if it isn't to be saved."""
    if not save:
        return df
    write_sqlite(df, path, table)
    return read_sqlite(df.sparkSession, path, 'SELECT * FROM "' + table.replace('"', '""') + '"')


def check_inputs(path: str | None, frame: DataFrame | None, column: str | None, language: str = "EN", topics: int = 5, method: str = "nmf") -> None:
    """ValueError unless exactly one input is given, it exists and isn't empty, and the options are known."""
    if (path is None) == (frame is None):
        raise ValueError("give a path or a DataFrame, and only one of them")
    if path is not None and "://" not in path and not os.path.exists(path):
        raise ValueError(f"{path} doesn't exist")
    if frame is not None and frame.isEmpty():
        raise ValueError("the DataFrame is empty")
    if not column:
        raise ValueError("the text column must be named")
    if frame is not None and column not in frame.columns:
        raise ValueError(f"column {column!r} is missing; there are {frame.columns}")
    if language.upper() not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}")
    if topics != -1 and topics < 1:
        raise ValueError("topics must be at least 1, or -1 to choose them by size")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """Records of a tagged citation export: pmid, title, abstract, authors, journal, year, month, doi.

    A record begins with a line "PMID- "; tags are 4 characters and "- ", lines that begin with 6
    spaces go on. Records are split by the reader, so a large export is read in parallel.
    """
    raw = spark.read.option("lineSep", "\nPMID-").text(path).where(F.trim("value") != "")
    body = F.concat(F.lit("PMID-"), F.regexp_replace("value", "^\\s*PMID-", ""))
    flat = F.regexp_replace(F.regexp_replace(body, "\r", ""), "\n {6}", " ")

    def tag(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(flat, f"(?m)^{name.ljust(4)}- ?(.*)$", 1)), F.lit(""))

    authors = F.array_join(F.regexp_extract_all(flat, F.lit("(?m)^FAU - ?(.*)$"), 1), "; ")
    doi = F.nullif(F.regexp_extract(flat, "(?m)^(?:LID|AID) - ?(\\S+) \\[doi\\]", 1), F.lit(""))
    year = F.nullif(F.regexp_extract(tag("DP"), "^(\\d{4})", 1), F.lit("")).cast("int")
    month = F.nullif(F.regexp_extract(tag("DP"), "^\\d{4}\\s+(\\S+)", 1), F.lit(""))
    return raw.select(tag("PMID").alias("pmid"), tag("TI").alias("title"), tag("AB").alias("abstract"), F.nullif(authors, F.lit("")).alias("authors"), tag("JT").alias("journal"), year.alias("year"), month.alias("month"), doi.alias("doi")).where("pmid IS NOT NULL")
