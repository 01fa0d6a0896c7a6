"""JSON arrays and streams as rows: the union of keys in order of appearance, values as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.operators.carrier import with_order
from tabmend.options import ConversionError
from tabmend.sources import jsonsplit
from tabmend.sources.files import first_file, read_cells
from tabmend.sources.lines import Delimited


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, value): one JSON text for each row.

    Files with one value on each line are split by Spark; arrays and values that
    share or span lines go through the splitter, in parts of files.
    """
    if jsonsplit.shape(first_file(spark, path)) == "stream":
        lines = with_order(spark.read.option("lineSep", "\n").text(path)).filter(F.trim(F.translate("value", "\r\t", "  ")) != "")
        if lines.filter(F.try_parse_json("value").isNull()).isEmpty():
            return lines
    cells = read_cells(spark, "json", path)
    return cells.select("part", "pos", F.get("cells", F.lit(0)).alias("value"))


def json_columns(values: DataFrame) -> list[str]:
    """Top-level keys of all objects, by first appearance: one aggregation with a row for each list of keys, and one with a row for each key."""
    lists = values.groupBy(F.json_object_keys("value").alias("keys")).agg(F.min("pos").alias("pos"))
    keys = lists.select("pos", F.posexplode("keys").alias("i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("pos", "i")).alias("first"))
    return [r["key"] for r in first.orderBy("first").collect()]


def json_rows(values: DataFrame, columns: list[str]) -> DataFrame:
    """(part, pos, cells): missing and null values empty, strings as they are, nested values as compact JSON; other rows are errors."""
    parsed = F.from_json("value", "map<string,string>")
    is_object = F.startswith(F.ltrim(F.translate("value", "\r\n\t", "   ")), F.lit("{"))
    checked = F.when(is_object & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("a JSON row is not an object")))
    rows = values.withColumn("m", checked)
    cells = F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit("")) for c in columns))
    return rows.select("part", "pos", cells.alias("cells"))


def open_json(spark: SparkSession, path: str) -> Delimited:
    values = json_values(spark, path)
    columns = json_columns(values)
    if not columns:
        raise ConversionError("no JSON object was found")
    return Delimited(columns, json_rows(values, columns))
