"""Spreadsheets: CSV, TSV and XLSX as typed tables."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

from marginalia.sources.office import ods_sheets
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.columns import blank_to_null, fold_text


def sql_name(header: str) -> str:
    """A header as a column name: folded, snake case, ASCII; col if nothing is left."""
    s = re.sub(r"[^a-z0-9]+", "_", fold_text(header or "")).strip("_") or "col"
    return f"c_{s}" if s[0].isdigit() else s


def unique(names: list[str]) -> list[str]:
    """Names made different by _2, _3 and so on."""
    out: list[str] = []
    for n in names:
        k, name = 1, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def table_name(path: str, sheet: str | None = None, sheets: int = 1) -> str:
    stem = sql_name(PurePosixPath(path).stem)
    return f"{stem}__{sql_name(sheet)}" if sheet and sheets > 1 else stem


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """A text table and its headers.  All columns are texts; short rows end in nulls, and cells beyond the
    headers are dropped."""
    raw = spark.read.option("lineSep", "\n").text(path).filter("value <> ''")
    first = raw.first()
    if first is None:
        return spark.createDataFrame([], "col string"), ["col"]
    import csv

    head = next(csv.reader([first["value"].lstrip("﻿").rstrip("\r")], delimiter=sep))
    names = unique([sql_name(h) for h in head])
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, mode="PERMISSIVE", multiLine=True, escape='"', enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df, head


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def read_xlsx(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet, rows of texts) of every sheet with content, by the file format alone."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    dates = _date_styles(z)
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows: list[list[str | None]] = []
        for row in root.iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                k = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (k - len(cells))
                cells.append(_cell(c, shared, dates))
            rows.append(cells)
        if any(x for r in rows for x in r):
            out.append((s.get("name"), rows))
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{{{_NS['m']}}}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    xfs = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(xfs if xfs is not None else []) if (k := int(x.get("numFmtId", 0))) in own or 14 <= k <= 22 or 45 <= k <= 47}


def _cell(c, shared: list[str], dates: set[int]) -> str | None:
    v = c.find("m:v", _NS)
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind in ("str", "e"):
        return v.text
    x = float(v.text)
    if int(c.get("s", 0)) in dates:
        return serial_date(x)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def serial_date(x: float) -> str:
    import datetime

    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(x * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def read_workbook(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """Tables of a workbook by name.  A workbook is one file of bounded size, read by one task."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    sheets = ods_sheets(data) if path.lower().endswith(".ods") else read_xlsx(data)
    out = {}
    for name, rows in sheets:
        head = [str(x or "") for x in rows[0]]
        width = max(map(len, rows))
        head += [""] * (width - len(head))
        cols = unique([sql_name(h) for h in head])
        body = [tuple(r + [None] * (width - len(r))) for r in rows[1:]]
        out[table_name(path, name, len(sheets))] = (spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in cols)), head)
    return out


INTEGER, REAL, TEXT = "bigint", "double", "string"


def _kind(c: Column) -> Column:
    """Whether all filled values are whole numbers, numbers, or neither.  Leading zeros (but 0 and 0.x) and
    values that aren't finite make texts."""
    v = blank_to_null(c)
    n = F.count(v)
    zeros = F.count_if(v.rlike(r"^[+-]?0[0-9]"))
    whole = F.count_if(v.rlike(r"^[+-]?[0-9]{1,19}$") & v.try_cast("bigint").isNotNull())
    real = F.count_if(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(v.try_cast("double")) < float("inf")))
    return F.when((n == 0) | (zeros > 0), TEXT).when(whole == n, INTEGER).when(real == n, REAL).otherwise(TEXT)


def infer(df: DataFrame) -> dict[str, str]:
    """The type of every column over all rows, in one pass."""
    row = df.agg(*[_kind(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return {c: row[c] for c in df.columns}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Trimmed and cast columns; blanks and failed casts are null, and blank rows are dropped."""
    kinds = types or infer(df)
    cells = {c: blank_to_null(F.col(f"`{c}`")) for c in df.columns}
    some = F.coalesce(*cells.values()).isNotNull()
    return df.filter(some).select(*[(v if kinds[c] == TEXT else v.try_cast(kinds[c])).alias(c) for c, v in cells.items()])
