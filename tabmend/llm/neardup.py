"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

Every distinct word sequence is one node. A node's shingle hashes fall into BINS
by their leading bits and the least hash of a bin is its minimum; an empty bin
borrows from the bin that a fixed hash of (bin, attempt) names, as optimal
densification does. ROWS bins make a band, and nodes that agree on a band share
a bucket. A bucket compares its members with one centre, so it holds as many
candidate edges as members. Where members of a bucket that were not yet compared
still lie in different components, further centres, those with most links first,
are compared in rounds of growing number until nothing is left open. Shingles that
only one open node holds bound its similarity to all others from above, and bitmaps
of two nodes' shingles bound theirs, which spares pairs that can't be links. Each
candidate is confirmed on the full sets.

Results in odd cases: a null or blank text has no shingles and no links; rows
with the same words form one group whatever their white space; a null id takes
part and yields null only where its whole group has none; repeated rows get equal
results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.llm.common import TokenHasher, materialize, mix, sequence_keys, shingle_hashes, small_batches

#: The chance that no band agrees is (1 - 0.8^5)^25 at 80 % similarity, 5 in 100,000, and below one in a million at 85 %.
BIN_BITS, BANDS, ROWS = 7, 25, 5
BINS = 1 << BIN_BITS
#: Further centres of an open bucket in the second round; MORE times as many in each later one.
CENTRES, MORE = 16, 16
#: Ranks up to this one Spark keeps ahead of the shuffle by itself; beyond, a bucket is ranked in PARTS parts first.
PUSHED, PARTS = 1000, 64
#: Bits of the filter that spares nodes outside every bucket from having their sets moved.
FILTER_BITS = 1 << 25
#: Words of 64 bits in the bitmap of an open node's shingles.
MAP_WORDS = 16
#: Shingles that a task counts before it passes them on.
HELD = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def donors(attempts: int = 64) -> np.ndarray:
    """For each attempt and bin, the bin that an empty bin looks at."""
    key = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mix(mix(key + np.uint64(1))) % np.uint64(BINS)).astype(np.int64)


def densify(minima: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row of minima; every row has at least one full bin."""
    out, empty = minima.copy(), minima == EMPTY
    open_rows = np.flatnonzero(empty.any(axis=1))
    attempt = 0
    while len(open_rows):
        at = table[attempt % len(table)]
        if attempt >= len(table):  # nearly impossible; any fixed order of bins is right
            at = (np.arange(BINS) + attempt) % BINS
        got = minima[open_rows][:, at]
        rows = out[open_rows]
        use = (rows == EMPTY) & (got != EMPTY)
        rows[use] = mix(got + np.uint64(attempt + 1))[use]
        out[open_rows] = rows
        open_rows = open_rows[(rows == EMPTY).any(axis=1)]
        attempt += 1
    return out


def band_keys(sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Keys of the BANDS buckets of each non-empty set of sorted hashes."""
    minima = np.full((len(sets), BINS), EMPTY, np.uint64)
    for i, s in enumerate(sets):
        bins = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # sorted, so a bin's first is its least
        minima[i, bins[first]] = s[first]
    full = densify(minima, table)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + full[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def _signatures(k: int):
    def run(batches):
        hasher, table = TokenHasher(), donors()
        for batch in batches:
            for first, stop, tokens, rows in hasher.rows(batch.column("text")):
                at = np.searchsorted(rows, np.arange(first, stop + 1))
                nodes, counts, sets, where = [], [], [], []
                for i in range(stop - first):
                    own = tokens[at[i] : at[i + 1]]
                    s = shingle_hashes(own, k)
                    counts.append(len(s))
                    nodes.append(sequence_keys(own) if len(own) else None)
                    if len(s):
                        sets.append(s)
                        where.append(i)
                keys = band_keys(sets, table).view(np.int64) if sets else np.empty((0, BANDS), np.int64)
                per = np.zeros(stop - first, np.int64)
                per[where] = BANDS
                offsets = np.r_[0, np.cumsum(per)].astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, stop - first),
                        batch.column("text_hash").slice(first, stop - first),
                        pa.array(nodes, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    ["id", "text_hash", "node", "n_shingles", "bands"],
                )

    return run


def _node_sets(k: int, wanted):
    def run(batches):
        hasher, seen = TokenHasher(), set()
        bits = wanted.value
        for batch in batches:
            for first, stop, tokens, rows in hasher.rows(batch.column("text")):
                at = np.searchsorted(rows, np.arange(first, stop + 1))
                nodes, sets = [], []
                for i in range(stop - first):
                    own = tokens[at[i] : at[i + 1]]
                    if not len(own):
                        continue
                    node = sequence_keys(own)
                    bit = int.from_bytes(node[4:8], "big") % FILTER_BITS
                    if node in seen or not (int(bits[bit >> 6]) >> (bit & 63)) & 1:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    sets.append(shingle_hashes(own, k).tobytes())
                if nodes:
                    yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _local_counts(batches):
    """(shingle, times, one node that holds it), summed over pieces of a task's sets."""
    held, owners, size = [], [], 0

    def flush():
        owner = np.repeat(np.arange(len(owners)), [len(x) for x in held])
        h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        nodes = pa.array(owners, pa.binary()).take(pa.array(owner[first]))
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), nodes], ["h", "c", "node"])

    for batch in batches:
        for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
            held.append(np.frombuffer(x.as_buffer(), np.uint64))
            owners.append(node)
            size += len(held[-1])
            if size > HELD:
                yield flush()
                held, owners, size = [], [], 0
    if held:
        yield flush()


def _bitmaps(batches):
    """(node, map): a bit is set where a shingle's hash, modulo the number of bits, is its place."""
    for batch in batches:
        maps = []
        for x in batch.column("shingles"):
            bits = np.zeros(64 * MAP_WORDS, np.uint8)
            bits[(np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(64 * MAP_WORDS)).astype(np.int64)] = 1
            maps.append(np.packbits(bits).view(np.int64))
        values = pa.array(np.concatenate(maps) if maps else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * MAP_WORDS), values)
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "map"])


def _apart(x: str, y: str):
    """At least so many shingles of x are not in y: places that only x's bitmap has set."""
    total = F.lit(0)
    for i in range(MAP_WORDS):
        total = total + F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i)))))
    return total


def _confirm(percent: int):
    def run(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True)):
                if a != last:
                    last, left = a, np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                at = np.searchsorted(large, small)
                common = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(_confirm(percent), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is a component's least node.

    Each round hooks a node to its least neighbour, follows that pointer once
    more and contracts the edges, so the rounds grow with the logarithm of a
    component's diameter.
    """
    edges = materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        hook = edges.groupBy("v").agg(F.min("u").alias("p"))
        up = hook.select(F.col("v").alias("w"), F.col("p").alias("q"))
        hook = materialize(hook.join(up, F.col("p") == F.col("w"), "left").select("v", F.coalesce("q", "p").alias("p")))
        roots = materialize(roots.join(hook, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")))
        for end in ("u", "v"):
            other = "v" if end == "u" else "u"
            to = hook.select(F.col("v").alias("w"), F.col("p").alias("q"))
            edges = edges.join(to, F.col(end) == F.col("w"), "left").select(F.coalesce("q", end).alias(end), other)
        edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    return roots


def _near_size(percent: int, x: str, y: str):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept, text_hash, group. percent: the least similarity of a link.

    text_hash is the text's xxhash64; group is equal for the rows of a component, null for those without words.
    """
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    shape = T.StructType().add("id", id_type).add("text_hash", "long").add("node", "binary").add("n_shingles", "long").add("bands", T.ArrayType(T.LongType()))
    signed = materialize(rows.mapInArrow(_signatures(k), shape))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    member = nodes.select("node", "n", F.explode("bands").alias("key"))
    centre = member.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(member.join(centre, "key").select("key", "node", "n", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    return _labelled(signed, _roots(spark, rows, buckets, percent, k), id_col)


def _roots(spark, rows: DataFrame, buckets: DataFrame, percent: int, k: int) -> DataFrame | None:
    """Components of all links between nodes that share a bucket; nothing where no bucket is shared."""
    word = F.expr(f"cast(conv(hex(substring(node, 5, 4)), 16, 10) as bigint) % {FILTER_BITS}")
    used = buckets.select(word.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    if not used:
        return None
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    for at, value in used:  # at most FILTER_BITS / 64 rows, whatever the input
        bits[at] = value & 0xFFFFFFFFFFFFFFFF
    wanted = spark.sparkContext.broadcast(bits)
    sets = materialize(rows.select("text").mapInArrow(_node_sets(k, wanted), "node binary, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles")))
    stars = buckets.filter("node <> centre").filter(_near_size(percent, "n", "centre_n")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(stars, sets, percent))
    open_rows = buckets.filter("node <> centre").select("key", "node", "n")
    bounded, centres = False, CENTRES
    while True:
        roots = materialize(components(links))
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
        state = open_rows.drop("root", "links").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        state = _torn(state.join(degree, "node", "left").withColumn("links", F.coalesce("count", F.lit(0))).drop("count"))
        if not bounded:
            there = materialize(sets.join(state.select("node").distinct(), "node", "left_semi"))
            own = there.mapInArrow(_local_counts, "h long, c long, node binary")
            own = own.groupBy("h").agg(F.sum("c").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("own"))
            state = state.join(own, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
            keys = buckets.join(state.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
            maps = there.mapInArrow(_bitmaps, "node binary, map array<bigint>")
            state = state.filter(F.col("common") * 100 >= F.col("n") * percent).join(keys, "node").join(maps, "node")
            state, bounded = _torn(state), True
        if state.isEmpty():
            return roots
        # members take turns in this order, those with most links first; the window needs only each bucket's first ones
        ordered = state.withColumn("turn", F.struct((-F.col("links")).alias("less"), "node"))
        chosen = least_turns(ordered, centres)
        chosen = materialize(chosen.select("key", *(F.col(c).alias(f"c_{c}") for c in ("node", "n", "root", "turn", "common", "keys", "map"))))
        # 100 common >= percent (n + m - common), for each bound of what is common; the dear ones last
        least = (F.col("n") + F.col("c_n")) * percent
        able = lambda common: common * (100 + percent) >= least
        could = (F.col("c_root") != F.col("root")) & (F.col("turn") > F.col("c_turn")) & able(F.col("common")) & able(F.col("c_common"))
        near = able(F.col("n") - _apart("map", "c_map")) & able(F.col("c_n") - _apart("c_map", "map"))
        # a pair that shares several buckets is left to the one of the least key
        here = F.array_min(F.array_intersect("keys", "c_keys")) == F.col("key")
        more = ordered.join(chosen, "key").filter(could & here & near)
        more = more.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()
        links = materialize(links.unionByName(confirmed(more, sets, percent)))
        last = chosen.groupBy("key").agg(F.max("c_turn").alias("last"))
        open_rows = materialize(ordered.join(last, "key").filter(F.col("turn") > F.col("last")).select("key", "node", "n", "common", "keys", "map"))
        centres *= MORE


def least_turns(members: DataFrame, most: int, pushed: int | None = None) -> DataFrame:
    """The `most` members of least turn of each bucket (key), without a task that sorts a whole bucket."""
    if most > (PUSHED if pushed is None else pushed):
        members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
        part = F.row_number().over(Window.partitionBy("key", "part").orderBy("turn"))
        members = members.withColumn("rank", part).filter(F.col("rank") <= most).drop("part", "rank")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("turn"))
    return members.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _torn(state: DataFrame) -> DataFrame:
    """The rows of buckets whose rows lie in more than one component."""
    torn = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return materialize(state.join(torn, "key"))


def _labelled(signed: DataFrame, roots: DataFrame | None, id_col: str) -> DataFrame:
    own = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    if roots is None:
        label = own.select("node", F.col("node").alias("root"), F.col("least").alias("component"))
    else:
        placed = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("least").alias("component"))
        label = placed.join(least, "root").select("node", "root", "component")
    out = signed.select("id", "node", "n_shingles", "text_hash").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash", F.col("root").alias("group"))
