"""Packing into sequences of a fixed length by cutting-stock column generation.

Every document becomes token ids and a closing id, cut into full sequences and
one shorter tail. The tails' histogram, in classes of WIDTH ids, is a
cutting-stock problem: a linear program over patterns of tails that fit one
sequence, whose new patterns a knapsack dynamic program finds at the program's
dual prices. The rounded solution is a list of patterns with copies; the
remainder is packed best-fit on the histogram. The tails of each class, ranked,
take the slots of its patterns. Only the histogram, its patterns and the counts
of (class, part) reach the driver, whose size the sequence length bounds.

Results in odd cases: null and empty texts are one piece of the closing id; equal
texts are packed apart, as rows; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.llm.common import materialize, small_batches

#: Tail lengths that share a row of the linear program.
WIDTH = 8
#: Parts in which the pieces of a class are ranked, at least, and rows for which there is a part.
PARTS, PART_ROWS = 32, 500_000


def byte_pair_encoder(path: str):
    """Token ids of a text by the byte-level BPE in `path`, equal to those of the tokenizers library.

    tiktoken does the merges, four times faster on the same vocabulary; a text that
    holds the string of a special token goes to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {x["content"] for x in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tokenizers.Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(x in text for x in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _pieces(make, length: int, close: int):
    def run(batches):
        encode = make()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), close], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for column, value in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            rows = [pa.array(x, pa.int64()) for x in out]
            yield pa.record_batch([batch.column("id").take(rows[0]), *rows[1:]], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def best_pattern(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the dearest pattern of sizes within room, as copies of each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = int(np.searchsorted(size, c, side="right"))
        if n:
            value = best[c - size[:n]] + price[:n]
            i = int(value.argmax())
            if value[i] > best[c - 1]:
                best[c], took[c] = value[i], i
                continue
        best[c] = best[c - 1]
    pattern, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        pattern[took[c]] += 1
        c -= size[took[c]]
    return float(best[room]), pattern


def cutting_stock(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 6000) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern) that hold each size as often as demanded, close to the fewest bins.

    The revised simplex method keeps the inverse of the basis, which starts as one
    pattern of copies of each size; it ends when the dual bound shows the
    solution within `gap` of the optimum.
    """
    n = len(size)
    if not n:
        return []
    basis = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / (room // size))
    level = inverse @ demand
    for _ in range(rounds):
        price = np.maximum(inverse.sum(0), 0)
        value, pattern = best_pattern(price, size, room)
        if value <= 1 + 1e-9 or value <= 1 + gap:  # Farley's bound: optimum >= level.sum() / value
            break
        move = inverse @ pattern
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, level / np.where(up, move, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = pattern
        level = level - ratio[leave] * move
        level[leave] = ratio[leave]
        row = inverse[leave] / move[leave]
        inverse -= np.outer(move, row)
        inverse[leave] = row
        level = np.maximum(level, 0)
    used, left = [], demand.astype(np.int64).copy()
    for copies, pattern in sorted(((int(x + 1e-6), basis[:, j].astype(np.int64)) for j, x in enumerate(level)), key=lambda p: (-p[0], p[1].tolist())):
        fits = [int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)]
        copies = min([copies, *fits])
        if copies > 0:
            used.append((copies, pattern))
            left -= copies * pattern
    return used + _best_fit(size, left, room)


def _best_fit(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    spaces: list[tuple[int, int]] = []
    bins: list[np.ndarray] = []
    for i in np.argsort(-size):
        for _ in range(int(left[i])):
            at = bisect_left(spaces, (int(size[i]), -1))
            if at < len(spaces):
                space, b = spaces.pop(at)
            else:
                space, b = room, len(bins)
                bins.append(np.zeros(len(size), np.int64))
            bins[b][i] += 1
            insort(spaces, (space - int(size[i]), b))
    return [(1, b) for b in bins]


def _place(class_slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], top: int):
    """From (class, rank) to the sequence that holds this slot and the class's place in it."""

    def run(batches):
        for batch in batches:
            kind, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            out = np.empty(len(kind), np.int64)
            for k in np.unique(kind):
                at = kind == k
                if k == top:
                    out[at] = -1 - rank[at]
                else:
                    first, per, sequence = class_slots[int(k)]
                    j = np.searchsorted(first, rank[at], side="right") - 1
                    out[at] = sequence[j] + (rank[at] - first[j]) // per[j]
            names = [*batch.schema.names, "sequence"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=names)

    return run


def pack(df: DataFrame, make, length: int = 2048, close: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of df's documents. make: gives an encoder of texts; length: a multiple of WIDTH; close: the id that ends a document."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = T.StructType().add("id", df.schema[id_col].dataType)
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        shape = shape.add(name, T.LongType())
    pieces = rows.mapInArrow(_pieces(make, length, close), shape)
    top = length // WIDTH + 1
    kind = F.when(F.col("length") == length, F.lit(top)).otherwise(F.floor((F.col("length") + WIDTH - 1) / WIDTH))
    pieces = materialize(pieces.withColumn("kind", kind.cast("long")))
    sizes = {r["kind"]: r["count"] for r in pieces.groupBy("kind").count().collect()}  # at most top rows
    # full sequences are most of a large corpus and get parts of their own number
    full, tails = (max(PARTS, -(-max(n, default=0) // PART_ROWS)) for n in ([v for k, v in sizes.items() if k == top], [v for k, v in sizes.items() if k != top]))
    part: Column = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.when(F.col("kind") == top, full).otherwise(tails)).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = pieces.groupBy("kind", "part").count().toArrow().to_pylist()  # at most full + top * tails rows
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for x in sorted(counts, key=lambda x: (x["kind"], x["part"])):
        before[x["kind"], x["part"]] = total.get(x["kind"], 0)
        total[x["kind"]] = total.get(x["kind"], 0) + x["count"]
    slots, sequences = _slots({k: n for k, n in total.items() if k != top}, length)
    starts = spark.createDataFrame([(k, p, n) for (k, p), n in before.items()], "kind long, part int, before long")
    within = F.row_number().over(Window.partitionBy("kind", "part").orderBy("id", "start", "ids_crc32")) - 1
    ranked = pieces.join(F.broadcast(starts), ["kind", "part"]).withColumn("rank", F.col("before") + within).drop("before")
    model = spark.sparkContext.broadcast(slots)
    placed = ranked.mapInArrow(lambda batches: _place(model.value, top)(batches), T.StructType([*ranked.schema.fields]).add("sequence", T.LongType()))
    sequence = F.when(F.col("sequence") < 0, sequences - 1 - F.col("sequence")).otherwise(F.col("sequence"))
    placed = placed.withColumn("sequence_id", sequence)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def _slots(total: dict[int, int], length: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Of each class: the first rank, slots per sequence and first sequence of each of its patterns; and the number of sequences."""
    kinds = np.array(sorted(total), np.int64)
    patterns = cutting_stock(kinds, np.array([total[int(k)] for k in kinds], np.int64), length // WIDTH)
    slots: dict[int, tuple[list, list, list]] = {int(k): ([], [], []) for k in kinds}
    at = {int(k): 0 for k in kinds}
    sequences = 0
    for copies, pattern in patterns:
        for i in np.flatnonzero(pattern):
            k, each = int(kinds[i]), int(pattern[i])
            for column, value in zip(slots[k], (at[k], each, sequences), strict=True):
                column.append(value)
            at[k] += copies * each
        sequences += copies
    return {k: tuple(np.array(x, np.int64) for x in v) for k, v in slots.items()}, sequences
