"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie side by
side and a text that fills more than one range is divided by its ids. A
size-weighted sample of those keys gives the quantile boundaries of PIECES ranges
for each shard, none of which divides a text at first; exact sums of size then show
overfull ranges, which are sampled again by themselves and subdivided. So equal
texts share a shard unless they would fill a sixteenth of one. The
ranges are dealt to the shards from the largest down, each to the least filled, so
shard sizes differ by about the smallest range. A row's slot is its range's first
slot plus its rank there. Only samples and one row for each range reach the
driver, and both have fixed bounds.

Results in odd cases: a null text has size EXTRA and the checksum of an empty
text; null ids come first in their text's range; repeated rows take separate
slots, and rows equal in id and text are told apart by number where they would
overfill a range; shards may stay empty where rows are fewer; an empty table gives an empty table. Columns named like the
added ones are replaced; others are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmend.llm.common import materialize, unused

#: Ranges for each shard, sampled keys for each range, bytes a row counts besides its text.
PIECES, SAMPLED, EXTRA = 128, 6, 16
#: A range above this part of a shard is subdivided until none of several keys is left.
OVERFULL = 1 / 16


def piece_of(splitters: list[tuple[int, int]]):
    """The number of the range of each key (a, b); a boundary belongs to the range above it."""
    first = np.array([s[0] for s in splitters], np.int64)
    second = np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def locate(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        low, high = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        for at in np.unique(low[low < high]):  # boundaries within one text
            rows = (low == at) & (high > at)
            stop = int(high[rows][0])
            high[rows] = at + np.searchsorted(second[at:stop], y[rows], "right")
        return pd.Series(high.astype(np.int32))

    return locate


def _sampled(rows: DataFrame, n: int, total: int, seed: int) -> list[tuple[int, int]]:
    """About n keys, each drawn with a chance in proportion to its size of `total`."""
    u = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(2**52)) / float(2**52)
    drawn = rows.filter(u * total < F.col("size") * n).select("a", "b").distinct()
    return sorted((r["a"], r["b"]) for r in drawn.collect())


def shard_by_sampled_splitters(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with size, text_crc32, shard and slot; sizes of shards are nearly equal."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a, b, copy, piece, first, rank = (unused(df, f"{x}_of_shard") for x in ("a", "b", "copy", "piece", "first", "rank"))
    rows = df.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.col(id_col)), "size": (F.octet_length(text) + EXTRA).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    keys = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "size")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = OVERFULL * total / shards
    # rows equal in id and text that would overfill a range by themselves; there can be no more keys of them than ranges of that size
    hot = keys.groupBy("a", "b").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter((F.col("size") > most) & (F.col("n") > 1)).select("a", "b").collect()
    if hot:
        # such rows get keys of their own, written once so that every later pass sees the same
        table = spark.createDataFrame([(r["a"], r["b"], True) for r in hot], f"{a} long, {b} long, {copy} boolean")
        rows = rows.join(F.broadcast(table), [a, b], "left")
        rows = materialize(rows.withColumn(b, F.when(F.col(copy), F.xxhash64(F.col(b), F.monotonically_increasing_id())).otherwise(F.col(b))).drop(copy))
        keys = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "size")
    drawn = _sampled(keys, shards * PIECES * SAMPLED, total, 0)
    step = max(1.0, len(drawn) / (shards * PIECES))
    splitters = sorted({(drawn[int(i * step)][0], -(2**63)) for i in range(min(len(drawn), shards * PIECES))})
    seed = 0
    while True:
        sums = _sums(keys, splitters)
        full = sums[(sums["size"] > most) & (sums["keys"] > 1)]
        if full.empty:
            break
        seed += 1
        inside = keys.filter(piece_of(splitters)("a", "b").isin(full.index.tolist()))
        wanted = int(np.ceil(4 * full["size"].sum() / most))  # quarters of what a range may hold
        more = _sampled(inside, wanted * SAMPLED, int(full["size"].sum()), seed)
        splitters = sorted({*splitters, *more[:: SAMPLED if len(more) > wanted else 1]})
    shard, slot = _dealt(sums, shards)
    table = pd.DataFrame({piece: sums.index.astype("int32"), "shard": shard, first: slot})
    places = F.broadcast(spark.createDataFrame(table, f"{piece} int, shard int, {first} long"))
    within = F.row_number().over(Window.partitionBy(piece).orderBy(a, b))
    out = rows.drop("shard", "slot").withColumn(piece, piece_of(splitters)(a, b)).withColumn(rank, within).join(places, piece)
    return out.withColumn("slot", (F.col(first) + F.col(rank) - 1).cast("long")).drop(a, b, piece, rank, first)


def _sums(keys: DataFrame, splitters: list[tuple[int, int]]) -> pd.DataFrame:
    """Size, rows and (two for many) distinct keys of each range; one row for each splitter at most."""
    key: Column = F.struct("a", "b")
    by = keys.groupBy(piece_of(splitters)("a", "b").alias("piece"))
    got = by.agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min(key) != F.max(key)).cast("int").alias("keys"))
    rows = [(r["piece"], r["size"], r["n"], 1 + r["keys"]) for r in got.collect()]
    return pd.DataFrame(rows, columns=["piece", "size", "n", "keys"]).set_index("piece").sort_index()


def _dealt(sums: pd.DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and first slot of each range."""
    import heapq

    heap = [(0, s) for s in range(shards)]
    shard = np.zeros(len(sums), np.int32)
    size = sums["size"].to_numpy()
    for i in np.argsort(-size, kind="stable"):
        filled, s = heapq.heappop(heap)
        shard[i] = s
        heapq.heappush(heap, (filled + int(size[i]), s))
    slot, next_slot = np.zeros(len(sums), np.int64), np.zeros(shards, np.int64)
    for i, n in enumerate(sums["n"]):
        slot[i] = next_slot[shard[i]]
        next_slot[shard[i]] += n
    return shard, slot
