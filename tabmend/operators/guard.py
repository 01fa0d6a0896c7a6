"""The row guard: every row leaves with the expected width, and cells cleaned in a fixed order.

Width (pad, truncate, drop runaway rows), then mojibake, edge trim and maximum
length. Counters are columns of the row, summed once by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.config import RUNAWAY_FACTOR, RUNAWAY_FIELDS, WARNINGS_SHOWN
from tabmend.functions.charset import unmojibake
from tabmend.operators.carrier import rank_of
from tabmend.options import ConversionError, Options


def runaway(width: int) -> Column:
    return F.size("cells") > max(RUNAWAY_FACTOR * width, RUNAWAY_FIELDS)


def fitted(cells: Column, width: int) -> Column:
    """Padded with empty cells, or cut."""
    n = F.size(cells)
    return F.when(n < width, F.concat(cells, F.array_repeat(F.lit(""), F.lit(width) - n))).when(n > width, F.slice(cells, 1, width)).otherwise(cells)


def guard(carrier: DataFrame, width: int, options: Options) -> DataFrame:
    """The carrier with rows of `width` cells and the counters n_bad and n_moji."""
    if options.strict:
        check_width(carrier, width)
    out = carrier.withColumn("n_bad", (F.size("cells") != width).cast("int"))
    dropped = runaway(width)
    out = out.withColumn("dropped", dropped).withColumn("cells", F.when(dropped, F.array().cast("array<string>")).otherwise(fitted(F.col("cells"), width)))
    out = out.withColumn("n_moji", F.lit(0))
    if options.fix_mojibake:
        fixed = F.transform("cells", lambda c: unmojibake(c, options.fix_mojibake))
        out = out.withColumn("fixed", fixed)
        changed = F.size(F.filter(F.zip_with("cells", "fixed", lambda a, b: a != b), lambda x: x))
        out = out.withColumn("n_moji", changed).withColumn("cells", F.col("fixed")).drop("fixed")
    if options.trim:
        out = out.withColumn("cells", F.transform("cells", lambda c: trimmed(c, options.trim)))
    if options.max_field > 0:
        out = out.withColumn("cells", F.transform("cells", lambda c: F.left(c, F.lit(options.max_field))))
    return out


def kept(guarded: DataFrame) -> DataFrame:
    return guarded.filter(~F.col("dropped")).drop("dropped")


def trimmed(cell: Column, characters: str) -> Column:
    """Any of the characters stripped from both ends."""
    return F.btrim(cell, F.lit(characters))


def check_width(carrier: DataFrame, width: int) -> None:
    """Fail at the first row of another width."""
    first = carrier.filter(F.size("cells") != width).select("pos", F.size("cells").alias("n")).orderBy("pos").first()
    if first is not None:
        row = rank_of(carrier, first["pos"])
        raise ConversionError(f"row {row}: got {first['n']} fields, expected {width}")


def warnings(guarded: DataFrame, width: int) -> list[str]:
    """The first bad rows, and how many more there are."""
    bad = guarded.filter("n_bad > 0")
    shown = bad.select("pos", "dropped").orderBy("pos").limit(WARNINGS_SHOWN).collect()
    out = [f"row at {r['pos']}: {'dropped' if r['dropped'] else f'made {width} fields wide'}" for r in shown]
    if len(shown) == WARNINGS_SHOWN and (more := bad.count() - WARNINGS_SHOWN):
        out.append(f"{more} more rows")
    return out
