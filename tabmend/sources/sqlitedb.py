"""SQLite tables and views as text rows."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from tabmend.operators.names import quoted
from tabmend.options import ConversionError


def database(path: str) -> str:
    """The path, or the path with .db where only that exists."""
    if not Path(path).is_file() and Path(f"{path}.db").is_file():
        return f"{path}.db"
    return path


def connect(path: str) -> sqlite3.Connection:
    path = database(path)
    if not Path(path).is_file():
        raise ConversionError(f"no database at {path}")
    db = sqlite3.connect(f"file:{Path(path).resolve().as_posix()}?mode=ro", uri=True)
    db.text_factory = lambda data: data.decode("utf-8", "replace")
    return db


def tables(db: sqlite3.Connection) -> list[tuple[str, str]]:
    """(name, kind) of tables and views, in the order of creation."""
    sql = "SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid"
    return list(db.execute(sql))


def resolve(path: str, wanted: str | None) -> str:
    """The table of this name; without a name `main`, or else the first table."""
    db = connect(path)
    try:
        names = [n for n, _ in tables(db)]
    finally:
        db.close()
    if (wanted or "main") in names:
        return wanted or "main"
    if wanted and wanted != "main":
        raise ConversionError(f"table {wanted!r} is not in the database; it has: {', '.join(names)}")
    if not names:
        raise ConversionError("the database has no table")
    return names[0]


def columns(path: str, table: str) -> list[str]:
    db = connect(path)
    try:
        found = [r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
    finally:
        db.close()
    if not found:
        raise ConversionError(f"table {table!r} has no columns")
    return found


def row_count(path: str, table: str) -> int:
    db = connect(path)
    try:
        return db.execute(f"SELECT count(*) FROM {quoted(table)}").fetchone()[0]
    finally:
        db.close()


def row_ranges(path: str, table: str, pieces: int) -> list[tuple[int | None, int | None]]:
    """Row id ranges [low, high) of about equal width; one open range for views and tables without row ids."""
    db = connect(path)
    try:
        kind = dict(tables(db)).get(table)
        if kind != "table":
            return [(None, None)]
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            return [(None, None)]
    finally:
        db.close()
    if low is None or not isinstance(low, int) or not isinstance(high, int):
        return [(None, None)]
    pieces = max(1, min(pieces, high - low + 1))
    cuts = [low + (high - low + 1) * i // pieces for i in range(pieces + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def rows(path: str, table: str, low: int | None, high: int | None) -> Iterator[list[str]]:
    db = connect(path)
    try:
        names = [r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
        cells = ", ".join(f"CAST({quoted(n)} AS TEXT)" for n in names)
        where = "" if low is None else f" WHERE rowid >= {low} AND rowid < {high} ORDER BY rowid"
        for row in db.execute(f"SELECT {cells} FROM {quoted(table)}{where}"):
            yield ["" if c is None else c for c in row]
    finally:
        db.close()
