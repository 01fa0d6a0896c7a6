"""Column types from a sample, typed columns and the report of misfits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.config import INFER_ROWS, MISMATCH_COLUMNS_SHOWN
from tabmend.functions.typed import INT, FLOAT, BOOL, PRIORITY, TEXT, coerce, fits, misfit
from tabmend.operators.carrier import first_rows, rank_of
from tabmend.options import ConversionError


def _each(df: DataFrame, cells: list[Column]) -> DataFrame:
    """(i, c): every cell with its column's number, so that plans don't grow with the width."""
    return df.select(F.posexplode(F.array(*(F.coalesce(c, F.lit("")) for c in cells))).alias("i", "c"))


def infer_types(df: DataFrame, cells: list[Column]) -> list[str]:
    """The first type of PRIORITY that every non-empty cell of a column fits; text where there is none.

    One aggregation over the whole of df, with partial aggregates; a sample is the caller's choice.
    """
    return _inferred(_each(df, cells), len(cells)) if cells else []


def _inferred(each: DataFrame, width: int) -> list[str]:
    tests = [F.min(fits(F.col("c"), kind)).alias(kind) for kind in PRIORITY]
    rows = {r["i"]: r for r in each.filter("c <> ''").groupBy("i").agg(*tests).collect()}  # a row for each column
    return [next((k for k in PRIORITY if i in rows and rows[i][k]), TEXT) for i in range(width)]


def infer_carrier_types(carrier: DataFrame, width: int, rows: int = INFER_ROWS) -> list[str]:
    """Types of a carrier's columns from its first rows."""
    sample = first_rows(carrier, rows)
    return _inferred(sample.select(F.posexplode(F.slice("cells", 1, width)).alias("i", "c")), width) if width else []


def describe_types(kinds: list[str]) -> str:
    return ", ".join(f"{kinds.count(k)} {k}" for k in (INT, FLOAT, BOOL, TEXT))


def typed_columns(cells: list[Column], names: list[str], kinds: list[str]) -> list[Column]:
    return [coerce(c, k).alias(n) for c, n, k in zip(cells, names, kinds, strict=True)]


def mismatch_counts(df: DataFrame, cells: list[Column], kinds: list[str]) -> list[int]:
    """Misfits of each column, in one aggregation."""
    if not cells:
        return []
    each = _each(df, cells)
    bad = F.lit(False)
    for kind in set(kinds) - {TEXT}:
        bad = F.when(F.col("i").isin([i for i, k in enumerate(kinds) if k == kind]), misfit(F.col("c"), kind)).otherwise(bad)
    found = {r["i"]: r["n"] for r in each.filter(bad).groupBy("i").agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(len(cells))]


@dataclass
class MismatchReport:
    """Misfits by column; cell values are never part of a message."""

    names: list[str]
    kinds: list[str]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def warnings(self) -> list[str]:
        bad = [(n, k, c) for n, k, c in zip(self.names, self.kinds, self.counts, strict=True) if c]
        out = [f"column {n}: {c} values are not {k} and became NULL" for n, k, c in bad[:MISMATCH_COLUMNS_SHOWN]]
        if len(bad) > MISMATCH_COLUMNS_SHOWN:
            out.append(f"{len(bad) - MISMATCH_COLUMNS_SHOWN} more columns have misfits")
        if bad:
            out.append("a larger infer_rows, or no inference, keeps those values")
        return out


def require_fit(carrier: DataFrame, names: list[str], kinds: list[str]) -> None:
    """Fail with row, column and type of the first misfit, never its value."""
    tests = [F.when(misfit(F.get("cells", F.lit(i)), k), F.lit(i)) for i, k in enumerate(kinds) if k != TEXT]
    if not tests:
        return
    first = carrier.select("pos", F.coalesce(*tests).alias("column")).filter("column is not null").orderBy("pos").first()
    if first is not None:
        row = rank_of(carrier, first["pos"])
        raise ConversionError(f"row {row}: column {names[first['column']]!r} is not {kinds[first['column']]}")
