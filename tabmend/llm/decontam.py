"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased words (runs of letters and digits) and their five-word
shingles, each weighing the letters of its words. A window of a document is as
long as a benchmark item and starts where a shared shingle says that the item
would; starts between two such are windows too. A window's 64-bit SimHash meets its item by multi-index blocks: the fingerprint's BLOCKS bytes are
looked up among all bytes within RADIUS // BLOCKS bits of its item's, which by the
pigeonhole principle finds it within RADIUS bits. Candidates are then
verified exactly: the part of the item's shingle weight that the window holds
must reach the threshold.

A window that reaches it shares a shingle, so looking for shared shingles first
loses none. The items' shingles are broadcast only up to BROADCAST_ROWS of them;
beyond that hashes of shingles are joined by shuffling. Only words of windows leave
the task that reads a text, never the text.

Results in odd cases: null and empty texts and items match nothing; an item of
fewer than five words is one shingle of all its words; items with equal words each
get their rows; repeated rows of documents give one row; null ids stay; empty
tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import materialize, unused

SHINGLE, THRESHOLD = 5, 0.8
#: A window at the threshold is about 13 bits from its item, with a deviation of 3.
BITS, BLOCKS, RADIUS = 64, 8, 23
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(tokens: Column, k: Column) -> Column:
    """Structs (h, w) of the k-word shingles of an array of at least k words, in order."""
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.transform(made, lambda s: F.struct(F.xxhash64(s).alias("h"), (F.length(s) - (k - 1)).cast("double").alias("w")))


def simhash(sh: Column) -> Column:
    """64 signs of the sums of the shingles' bits, as one integer; a bit counts by the logarithm of its shingle's weight, so that no long word outweighs the rest."""
    sh = F.transform(sh, lambda x: F.struct(x["h"].alias("h"), F.log1p(x["w"]).alias("w")))

    def bit(b: Column) -> Column:
        total = F.aggregate(sh, F.lit(0.0), lambda acc, x: acc + x["w"] * (2 * F.getbit(x["h"], b) - 1))
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _block(fingerprint: Column, b: Column) -> Column:
    shift = F.call_function("shiftrightunsigned", fingerprint, (b * (BITS // BLOCKS)).cast("int"))
    return shift.bitwiseAND(F.lit(2 ** (BITS // BLOCKS) - 1).cast("long")).cast("int")


def near_masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each distinct word sequence: its ids, words, shingle size, shingles and fingerprint."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(text).cast("string")).alias("ws")).filter(F.size("ws") > 0)
    items = items.groupBy("ws").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("null_item"))
    items = items.withColumns({"n_words": F.size("ws"), "k": F.least(F.size("ws"), F.lit(SHINGLE)), "key": F.xxhash64("ws")})
    items = items.withColumn("sh", shingles(F.col("ws"), F.col("k")))
    return items.withColumn("fp", simhash(F.col("sh"))).drop("ws")


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, text hash, item, start, n_words, distance, similarity): the best window of each document for each item that it holds."""
    items = materialize(items_of(benchmark, item_id, item_text))
    posting = items.select("key", "n_words", "k", F.posexplode("sh").alias("q", "s")).select("key", "n_words", "k", "q", F.col("s.h").alias("h"))
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE values
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.select("id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("ws"))
    small = posting.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = None
    for k in sizes or [SHINGLE]:
        one = _stretches(rows, posting.filter(F.col("k") == k), k, small)
        found = one if found is None else found.unionByName(one)
    return _verified(_windows(found), items, threshold, id_col)


def _gap(n_words: Column) -> Column:
    """Starts of an item that are no farther apart have the starts between them as windows too."""
    return F.floor(n_words / 5).cast("int")


def _stretches(rows: DataFrame, posting: DataFrame, k: int, small: bool) -> DataFrame:
    """(id, t, key, n_words, k, s, words): each start that a shared shingle gives, with as many words as its windows and those up to the next may hold."""
    n = F.size("ws")
    columns = [F.slice("ws", F.lit(j + 1), F.greatest(n - (k - 1), F.lit(0))) for j in range(k)]
    zipped = F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(columns)))
    each = rows.filter(n >= k).select("id", "t", "ws", F.posexplode(zipped).alias("p", "z"))
    h = F.xxhash64(F.concat_ws(" ", *(F.col("z").getField(f"w{j}") for j in range(k))))
    each = each.select("id", "t", "ws", "p", h.alias("h"))
    start = (F.col("p") - F.col("q")).alias("s")
    if small:
        hits = each.join(F.broadcast(posting), "h").select("id", "t", "ws", "key", "n_words", "k", start)
    else:  # hashes alone are shuffled; words join the starts
        hits = each.drop("ws").join(posting, "h").select(F.col("id").alias("hit_id"), F.col("t").alias("hit_t"), "key", "n_words", "k", start).distinct()
        hits = hits.join(rows, F.col("hit_id").eqNullSafe(F.col("id")) & (F.col("hit_t") == F.col("t"))).drop("hit_id", "hit_t")
    from_start = F.slice("ws", F.greatest(F.col("s"), F.lit(0)) + 1, F.col("n_words") + _gap(F.col("n_words")) + F.least(F.col("s"), F.lit(0)))
    return hits.select("id", "t", "key", "n_words", "k", "s", F.array_join(from_start, " ").alias("words")).distinct()


def _windows(found: DataFrame) -> DataFrame:
    """(id, t, key, n_words, k, s, win): the windows at the starts and between those that are close."""
    per = found.groupBy("id", "t", "key", "n_words", "k").agg(F.sort_array(F.collect_set(F.struct("s", "words"))).alias("all"))
    before = lambda i: F.get("all", i - 1)
    place = lambda s, origin, text: F.struct(s.alias("s"), origin.alias("origin"), text.alias("words"))
    between = lambda x, i: F.transform(F.sequence(before(i)["s"] + 1, x["s"]), lambda y: place(y, before(i)["s"], before(i)["words"]))
    close = lambda x, i: (i > 0) & (x["s"] - before(i)["s"] <= _gap(F.col("n_words")))
    filled = F.flatten(F.transform("all", lambda x, i: F.when(close(x, i), between(x, i)).otherwise(F.array(place(x["s"], x["s"], x["words"])))))
    # few bytes but much work: dealt out by number, which Spark doesn't undo
    per = per.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = per.select("id", "t", "key", "n_words", "k", F.explode(filled).alias("w"))
    zero = F.lit(0)
    win = F.slice(F.split("w.words", " "), F.greatest(F.col("w.s"), zero) - F.greatest(F.col("w.origin"), zero) + 1, F.col("n_words") + F.least(F.col("w.s"), zero))
    return at.select("id", "t", "key", "n_words", "k", F.col("w.s").alias("s"), win.alias("win")).filter("size(win) >= k")


def _verified(windows: DataFrame, items: DataFrame, threshold: float, id_col: str) -> DataFrame:
    at = windows.select("id", "t", "key", "n_words", "s", shingles(F.col("win"), F.col("k")).alias("sh"))
    at = at.select("id", "t", "key", "n_words", "s", F.transform("sh", lambda x: x["h"]).alias("hashes"), simhash(F.col("sh")).alias("fp"))
    at = materialize(at)  # else the optimizer moves the joins' conditions below, and fingerprints are computed for each bit anew
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    probes = at.withColumn("b", F.explode(blocks)).withColumn("v", _block(F.col("fp"), F.col("b")))
    masks = F.array(*(F.lit(m) for m in near_masks(BITS // BLOCKS, RADIUS // BLOCKS)))
    index = items.select("key", F.col("fp").alias("item_fp"), F.explode(blocks).alias("b"))
    index = index.withColumn("v", _block(F.col("item_fp"), F.col("b"))).withColumn("m", F.explode(masks)).withColumn("v", F.col("v").bitwiseXOR(F.col("m"))).drop("m")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair may meet in several blocks, of which the first counts
    first = F.array_min(F.filter(blocks, lambda b: F.bit_count(_block(apart, b)) <= RADIUS // BLOCKS))
    met = probes.join(index, ["key", "b", "v"]).withColumn("distance", F.bit_count(apart)).filter((F.col("distance") <= RADIUS) & (F.col("b") == first))
    met = met.join(items.select("key", "sh", "items", "null_item"), "key")
    item_set = F.array_distinct("sh")
    total = F.aggregate(item_set, F.lit(0.0), lambda acc, x: acc + x["w"])
    held = F.aggregate(F.filter(item_set, lambda x: F.array_contains("hashes", x["h"])), F.lit(0.0), lambda acc, x: acc + x["w"])
    sure = met.withColumn("similarity", F.round(held / total, 6)).filter(F.col("similarity") >= threshold)
    best = sure.groupBy("id", "t", "key").agg(F.max(F.struct("similarity", -F.col("distance"), -F.col("s"))).alias("m"), F.first("n_words").alias("n_words"), F.first("items").alias("items"), F.first("null_item").alias("null_item"))
    item = F.explode(F.when(F.col("null_item"), F.concat("items", F.array(F.lit(None)))).otherwise(F.col("items")))
    return best.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), item.alias("item_id"), (-F.col("m.col3")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), (-F.col("m.col2")).cast("int").alias("distance"), F.col("m.similarity").alias("similarity"))


def decontaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the rows whose text holds a benchmark item."""
    the_id, the_hash = unused(df, "bad_id"), unused(df, "bad_hash")
    bad = contaminated(df, benchmark, id_col, text_col, threshold=threshold).select(F.col(id_col).alias(the_id), F.col("text_hash").alias(the_hash)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(the_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(the_hash))
    return df.join(bad, same, "left_anti")
