"""The first sheet of .xlsx and .ods spreadsheets as text rows."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from tabmend.operators.names import positional_names
from tabmend.options import ConversionError

#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def number_text(value: float) -> str:
    """Whole numbers below 10^15 as integers."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def date_text(serial: float, from_1904: bool = False) -> str:
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_parts(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The first sheet's part, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    first = next(e for e in root.iter() if _local(e.tag) == "sheet")
    key = next(v for k, v in first.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.attrib["Target"] for e in links if e.attrib["Id"] == key)
    pr = next((e for e in root.iter() if _local(e.tag) == "workbookPr"), None)
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return path, pr is not None and pr.attrib.get("date1904") in ("1", "true")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.attrib["numFmtId"]): e.attrib["formatCode"] for e in root.iter() if _local(e.tag) == "numFmt"}
    cells = next((e for e in root if _local(e.tag) == "cellXfs"), [])

    def dated(code: int) -> bool:
        plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(code, "")).lower()
        return code in DATE_FORMATS or bool(re.search(r"[ymdhs]", plain)) and "general" not in plain

    return {i for i, x in enumerate(cells) if dated(int(x.attrib.get("numFmtId", 0)))}


def _xlsx_rows(book: zipfile.ZipFile) -> Iterator[list[str]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if _local(e.tag) == "si":
                shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t" and not _phonetic(e, t)))
                e.clear()
    path, from_1904 = _xlsx_parts(book)
    dates = _date_styles(book)
    for _, e in ElementTree.iterparse(book.open(path)):
        if _local(e.tag) != "row":
            continue
        row: dict[int, str] = {}
        for at, c in enumerate(x for x in e if _local(x.tag) == "c"):
            kind = c.attrib.get("t", "n")
            value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
            if kind == "s":
                value = shared[int(value)] if value else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
            elif kind == "b":
                value = "true" if value == "1" else "false"
            elif kind == "e":
                value = f"#ERROR:{value}"
            elif kind == "n" and value:
                number = float(value)
                value = date_text(number, from_1904) if int(c.attrib.get("s", 0)) in dates else number_text(number)
            row[_column(c.attrib["r"]) if "r" in c.attrib else at] = value
        e.clear()
        yield [row.get(i, "") for i in range(max(row, default=-1) + 1)]


def _phonetic(item, text) -> bool:
    return any(_local(x.tag) == "rPh" and text in list(x) for x in item)


def _ods_rows(book: zipfile.ZipFile) -> Iterator[list[str]]:
    get = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    root = ElementTree.fromstring(book.read("content.xml"))
    table = next((e for e in root.iter() if _local(e.tag) == "table"), [])
    for r in (e for e in table.iter() if _local(e.tag) == "table-row") if len(table) else []:
        row: list[str] = []
        for c in (x for x in r if _local(x.tag) in ("table-cell", "covered-table-cell")):
            kind, value = get(c, "value-type"), get(c, "value")
            text = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
            if kind in ("float", "currency", "percentage") and value:
                text = number_text(float(value))
            elif kind == "boolean":
                text = get(c, "boolean-value") or ""
            elif kind == "date":
                text = (get(c, "date-value") or "").replace("T", " ")
                text += " 00:00:00" if len(text) == 10 else ""
            elif kind == "time":
                text = get(c, "time-value") or ""
            times = int(get(c, "number-columns-repeated") or 1)
            if text or times < 1024:  # the last empty cell repeats to the sheet's edge
                row += [text] * times
        while row and row[-1] == "":
            row.pop()
        times = int(get(r, "number-rows-repeated") or 1)
        for _ in range(times if row else 1):
            yield row


def _all_rows(path: str) -> Iterator[list[str]]:
    try:
        book = zipfile.ZipFile(path)
    except (zipfile.BadZipFile, FileNotFoundError) as error:
        raise ConversionError(f"{path} is no .xlsx or .ods file (the older binary .xls has to be saved as one of them): {error}") from None
    with book:
        yield from _ods_rows(book) if "content.xml" in book.namelist() else _xlsx_rows(book)


def width(path: str) -> int:
    return max((len(r) for r in _all_rows(path)), default=0)


def rows(path: str) -> Iterator[list[str]]:
    """Rows that are not empty throughout, as wide as the widest, the header among them."""
    n = width(path)
    for row in _all_rows(path):
        if any(row):
            yield [*row, *[""] * (n - len(row))]


def header(path: str, no_headers: bool) -> list[str]:
    first = next(rows(path), None)
    if first is None:
        raise ConversionError("the sheet has no rows")
    return positional_names(len(first)) if no_headers else [c.strip() or f"c{i}" for i, c in enumerate(first)]
