"""Parquet and other typed DataFrames: schema, text rows, rows by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.operators.carrier import with_order


def parquet_schema(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Column names and the number of rows; the count comes from footers."""
    df = spark.read.parquet(path)
    return df.columns, df.count()


def to_text(cell: Column, kind: T.DataType) -> Column:
    """A value's text: ISO timestamps, plain decimals, JSON for nested values, nothing for NULL."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.regexp_replace(F.date_format(cell, "SSSSSS"), "0+$", "")
        text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        short = cell.cast("string")
        plain = F.when(F.abs(cell) < 1e15, cell.cast("decimal(38,18)").cast("string")).otherwise(F.format_string("%.1f", cell.cast("double")))
        trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
        text = F.when(short.contains("E") & (F.abs(cell) >= 1e-6), trimmed).otherwise(short)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(cell)
    elif isinstance(kind, T.BinaryType):
        text = F.make_valid_utf8(cell.cast("string"))
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(""))


def text_cells(df: DataFrame) -> Column:
    return F.array(*(to_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields))


def parquet_text(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Names and the carrier (part, pos, cells) of a Parquet table."""
    df = spark.read.parquet(path)
    ordered = with_order(df)
    return df.columns, ordered.select("part", "pos", text_cells(df).alias("cells"))


def rows_at(spark: SparkSession, path: str, indices: list[int]) -> DataFrame:
    """The rows of these places in the table, whose files follow each other by name; places past the end are ignored."""
    df = spark.read.parquet(path)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    wanted, before, picked, index = sorted(set(indices)), 0, F.lit(False), F.lit(None).cast("long")
    for r in sorted(df.groupBy(file.alias("file")).count().collect()):  # a row for each file, from footers
        own = [i - before for i in wanted if before <= i < before + r["count"]]
        if own:  # a condition on the path spares the other files
            picked = picked | ((file == r["file"]) & at.isin(own))
            index = F.when(file == r["file"], at + before).otherwise(index)
        before += r["count"]
    return df.select("*", index.alias("row_index")).filter(picked)
