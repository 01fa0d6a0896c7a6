"""The carrier: rows of text cells with an explicit order.

Columns `part` (the ordered piece of input that a row came from), `pos` (its place
in the whole) and the payload. Rows of one part lie together, in order, in one
task. A pass over the order is done in two steps: each task runs through its parts
for itself, and one small row for each part is combined before the parts' true
starting states are known. Nothing is sorted globally, and no window spans parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above so many parts the table of parts is joined by shuffle instead of broadcast.
BROADCAST_PARTS = 200_000
#: First rows that may be held in memory; lines beyond twice a sample's rows in which it is looked for.
TOP_ROWS, SPARE = 100_000, 1000
#: Rows for which there is a part, parts at most, and rows drawn for each part's boundary.
PART_ROWS, MOST_PARTS, SAMPLED = 500_000, 4096, 64
#: Rows below which a part isn't split for the sake of more tasks: each costs the start of its Python workers.
LEAST_ROWS = 25_000


def with_order(df: DataFrame) -> DataFrame:
    """A file scan with `part` and a dense `pos`, by the files' paths and offsets.

    A task reads each split from start to end, so ids that grow within a task,
    less the split's least, number its rows; sums of the splits' counts do the rest.
    """
    keyed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    splits = keyed.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_id").alias("_least"))
    order = Window.orderBy("_file", "_block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = splits.select("_file", "_block", "_least", before.alias("_before"), (F.row_number().over(order) - 1).cast("long").alias("part"))
    joined = keyed.join(counted_once(table), ["_file", "_block"])
    return joined.withColumn("pos", F.col("_before") + F.col("_id") - F.col("_least")).drop("_file", "_block", "_id", "_least", "_before")


def counted_once(table: DataFrame) -> DataFrame:
    """A table of parts as rows that the plans of all later passes hold, so that none of them counts again; only where they are few."""
    got = table.limit(BROADCAST_PARTS + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(got, table.schema)) if len(got) <= BROADCAST_PARTS else table


def by_part_size(table: DataFrame) -> DataFrame:
    """A table of parts, broadcast only where they are few."""
    return F.broadcast(table) if table.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS else table


def place(pos) -> Column:
    """A place that was collected, which may be a struct of structs, as a literal."""
    return F.struct(*(place(v).alias(k) for k, v in zip(pos.__fields__, pos, strict=True))) if isinstance(pos, Row) else F.lit(pos)


def rank_of(carrier: DataFrame, pos) -> int:
    """How many rows stand at or before a place."""
    return carrier.filter(F.col("pos") <= place(pos)).count()


def first_rows(carrier: DataFrame, n: int) -> DataFrame:
    """The first n rows, in any order. Where places are numbers, a bounded prefix is tried first, so that what follows it is not parsed."""
    if n > TOP_ROWS:
        # whole parts and the start of one, which a sort that can spill finds; a top-n would make room for n rows
        parts = carrier if "part" in carrier.columns else carrier.withColumn("part", F.lit(0).cast("long"))
        left = n
        for r in parts.groupBy("part").count().orderBy("part").collect():
            if r["count"] > left:
                edge = parts.filter(F.col("part") == r["part"]).withColumn("_rank", F.row_number().over(Window.partitionBy("part").orderBy("pos")))
                edge = edge.filter(F.col("_rank") <= left).drop("_rank")
                return parts.filter(F.col("part") < r["part"]).unionByName(edge).select(carrier.columns)
            left -= r["count"]
        return carrier
    line = F.col("pos")
    kind = carrier.schema["pos"].dataType
    while isinstance(kind, T.StructType) and kind.names:
        line, kind = line.getField(kind.names[0]), kind.fields[0].dataType
    if isinstance(kind, T.LongType):
        prefix = carrier.filter((line < 2 * n + SPARE) | line.isNull())
        if n == 1:
            if got := prefix.orderBy("pos").limit(1).collect():
                return carrier.sparkSession.createDataFrame(got, carrier.schema)
        elif prefix.limit(n).count() >= n:
            carrier = prefix
    return carrier.orderBy("pos").limit(n)


def boundaries(df: DataFrame, order: list[str]) -> list[Row]:
    """Quantiles of the order's columns, from about SAMPLED rows for each part. A hash picks them, so that they are the same whenever they are asked for."""
    keys = df.select(*order)
    n = keys.count()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_PARTS, max(-(-n // PART_ROWS), min(tasks, -(-n // LEAST_ROWS)), 1))
    each = max(1, n // (SAMPLED * parts))
    drawn = keys.filter(F.pmod(F.xxhash64(*order), F.lit(each)) == 0).distinct().orderBy(*order).collect()  # some SAMPLED * MOST_PARTS at most
    return [drawn[i * len(drawn) // parts] for i in range(1, parts)] if len(drawn) >= parts else drawn


def rank_among(value: Column, ends: list[Column]) -> Column:
    """The number of sorted boundaries at or below a value, by halving steps over one literal that holds them all."""
    if not ends:
        return F.lit(0).cast("long")
    known = F.array(*ends)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(ends).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(known, n + step - 1) <= value, step).otherwise(0)).cast("long")


def by_ranges(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """`part` and `pos` by ranges of the order's columns for rows that stay where they are, and the number of parts.

    Ranges and places depend on the rows alone, so every pass sees the same parts;
    Spark's own range partitioning draws its boundaries anew each time.
    """
    ends = boundaries(df, order)
    at = F.struct(*order)
    return df.withColumn("part", range_of(order, ends, df.select(at.alias("pos")).schema["pos"].dataType)).withColumn("pos", at), len(ends) + 1


def range_of(order: list[str], ends: list[Row], kind: T.StructType) -> Column:
    """The number of boundaries at or below a row. Its first column tells, which is compared faster, except where it equals a boundary's."""
    whole = rank_among(F.struct(*order), [place(e).cast(kind) for e in ends])
    if not ends or any(e[0] is None for e in ends):
        return whole
    firsts = [place(e[0]).cast(kind[0].dataType) for e in ends]
    value = F.col(order[0])
    if len(order) == 1:
        return rank_among(value, firsts)
    same = lambda n: F.get(F.array(*firsts), n.cast("int") - 1) == value
    return F.get(F.transform(F.array(rank_among(value, firsts)), lambda n: F.when(same(n), whole).otherwise(n)), F.lit(0))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with `part` and `pos` as a carrier: a task for each part, sorted."""
    return rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "pos")


def from_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Any DataFrame as a carrier, ordered by columns: a task for each range of them, sorted."""
    return dealt(*by_ranges(df, order))
