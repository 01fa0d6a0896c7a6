"""Lossless coercion of text cells: an integer, float or boolean only where text and value say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType

INT, FLOAT, BOOL, TEXT = "int", "float", "bool", "text"
#: In the order in which a column's type is chosen.
PRIORITY = (BOOL, INT, FLOAT)
SPARK_TYPES: dict[str, DataType] = {INT: LongType(), FLOAT: DoubleType(), BOOL: BooleanType(), TEXT: StringType()}
SQLITE_TYPES = {INT: "INTEGER", BOOL: "INTEGER", FLOAT: "REAL", TEXT: "TEXT"}

_INT = r"\A(0|-?[1-9][0-9]*)\z"
_FLOAT = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
#: Of at most _MOST_DIGITS characters, these are exact without a look at their digits.
_PLAIN = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?\z"
_LEAST_NORMAL = 2.2250738585072014e-308
_MOST_DIGITS, _EXACT_INT = 15, 2**53


def parse_int(cell: Column) -> Column:
    """A canonical decimal 64-bit integer, or NULL."""
    return F.when(cell.rlike(_INT), cell.try_cast("bigint"))


def parse_float(cell: Column) -> Column:
    """A decimal number of at most 15 significant digits, zero or of normal size, or NULL; whole numbers up to 2^53."""
    digits = F.regexp_replace(F.regexp_replace(cell, r"[eE].*\z", ""), r"[-.]", "")
    significant = F.regexp_replace(digits, r"\A0+|0+\z", "")
    value = cell.try_cast("double")
    size = F.abs(value)
    fits = (F.length(significant) <= _MOST_DIGITS) & ((significant == "") | (size >= _LEAST_NORMAL)) & (size < float("inf"))
    whole = cell.rlike(r"\A-?[0-9]+\z")
    exact = cell.try_cast("bigint").between(-_EXACT_INT, _EXACT_INT)
    plain = (F.length(cell) <= _MOST_DIGITS) & (cell != "-0") & cell.rlike(_PLAIN)
    return F.when(plain, value).when(cell.rlike(_FLOAT) & F.when(whole, exact & (cell != "-0")).otherwise(fits), value)


def parse_bool(cell: Column) -> Column:
    """TRUE or FALSE in any case, or NULL."""
    return F.when(cell.rlike(r"\A[tT][rR][uU][eE]\z"), True).when(cell.rlike(r"\A[fF][aA][lL][sS][eE]\z"), False)


PARSERS = {INT: parse_int, FLOAT: parse_float, BOOL: parse_bool}


def fits(cell: Column, kind: str) -> Column:
    """Whether a cell can be of this type; empty and missing cells fit all."""
    if kind == TEXT:
        return F.lit(True)
    return cell.isNull() | (cell == "") | PARSERS[kind](cell).isNotNull()


def coerce(cell: Column, kind: str) -> Column:
    """The typed value; NULL for empty cells of typed columns and for misfits."""
    return F.coalesce(cell, F.lit("")) if kind == TEXT else PARSERS[kind](cell)


def misfit(cell: Column, kind: str) -> Column:
    return ~fits(cell, kind)
