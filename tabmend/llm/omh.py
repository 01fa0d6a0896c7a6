"""Order MinHash fingerprints with DataFrame functions only.

A text's words (split at white space, as written) give its pieces of K words, each
numbered by how often it came before. Texts of at most K words, and those whose
words are long on average (scripts without spaces, encoded data), give pieces of
CHARS characters instead. Every numbered piece has a place on a circle of hashes.
From each of BINS even points of the circle the next TAKEN pieces are selected, put
back in the order in which they stand in the text, and hashed as a tuple: an entry
of the fingerprint. Texts agree on an entry where its pieces and their order agree, so the share of
equal entries falls with the edit distance. A text without words has empty entries
(0); entries that are empty in both texts don't count.

Every row also meets the text of the next id: rows are dealt into ranges of ids,
each of which is sorted on its own, and a copy of each range's first row closes
the range before. Boundaries come from a sample of some SAMPLED ids for each
range; there is a range for ROWS rows, PARTS at most.

Results in odd cases: a null text is empty; texts without words equal each other
fully; a text of one piece has it twice in every entry; equal ids are
ordered by text; null ids come first; repeated rows get equal fingerprints; the
only row of a table is its own next; an empty table gives an empty table; other
columns are not read. Ids may have any type that can be ordered. A piece's place in
its text has POSITION bits, which is more than an array in memory can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a piece, characters in a piece, characters for each word from which texts count as unspaced.
K, CHARS, UNSPACED = 3, 5, 32
#: Points of the circle, pieces taken at each, bits that hold a position; a point is given by a hash's leading bits.
BINS, TAKEN, POSITION, SHIFT = 64, 2, 28, 64 - 6
PARTS, ROWS, SAMPLED = 4096, 20_000, 64
SPACE = r"[\x20\x09-\x0D]+"


def _packed(h: Column, at: Column) -> Column:
    """A hash's leading bits above a position."""
    return _hash(h).bitwiseOR(at.cast("long"))


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(-(1 << POSITION)))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POSITION) - 1))


def _numbered(x: Column, times: Column) -> Column:
    """A piece that came before gets a hash of its own; the first keeps its hash."""
    return F.when(times == 0, x).otherwise(_packed(F.xxhash64(_hash(x), times.cast("long")), _place(x)))


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out` of BINS tuple hashes of the column `text`."""
    none = F.array().cast("array<long>")
    df = df.withColumn("_w", F.array_remove(F.split(F.col(text), SPACE), ""))
    n = F.size("_w")
    fine = (n <= K) | (F.length(text) > UNSPACED * n)
    df = df.withColumn("_t", F.when(fine, F.split(F.col(text), "")).otherwise(F.col("_w"))).withColumn("_fine", fine)

    def pieces(width: int) -> Column:
        last = F.greatest(F.size("_t") - (width - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: _packed(F.xxhash64(*(F.get(F.col("_t"), i + (j - 1)) for j in range(width))), i))

    df = df.withColumn("_s", F.when(n == 0, none).when(F.col("_fine"), F.sort_array(pieces(CHARS))).otherwise(F.sort_array(pieces(K))))
    # a run of equal hashes is a repeated piece; its positions are in order, so they number themselves
    new = lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(F.col("_s"), i - 1)))
    df = df.withColumn("_again", F.size(F.filter("_s", new)) < F.size("_s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: new(F.get(F.col("_s"), i), i))
    df = df.withColumn("_r", F.when(F.col("_again"), starts))
    runs = F.flatten(F.transform("_r", lambda start, r: F.transform(F.sequence(start, F.coalesce(F.get(F.col("_r"), r + 1), F.size("_s")) - 1), lambda i: _numbered(F.get(F.col("_s"), i), i - start))))
    df = df.withColumn("_p", F.when(F.col("_again"), F.sort_array(runs)).otherwise(F.col("_s")))
    # between two points only the first TAKEN pieces can be selected
    bin_of = lambda x: F.shiftright(x, SHIFT)
    df = df.withColumn("_l", F.filter("_p", lambda x, i: (i < TAKEN) | (bin_of(x) != bin_of(F.get(F.col("_p"), i - TAKEN)))))
    # from the circle's end to its start: a point, which has position 0, takes the two pieces seen last
    points = F.array(*(F.lit((b - BINS // 2) << SHIFT).cast("long") for b in range(BINS)))
    around = F.reverse(F.sort_array(F.concat("_l", points)))
    start = F.struct(F.get("_l", F.lit(0)).alias("a"), F.coalesce(F.get("_l", F.lit(1)), F.get("_l", F.lit(0))).alias("b"), none.alias("out"))

    def entry(a: Column, b: Column) -> Column:
        first, then = F.when(_place(a) <= _place(b), a).otherwise(b), F.when(_place(a) <= _place(b), b).otherwise(a)
        return F.xxhash64(_hash(first), _hash(then)).bitwiseAND(F.lit(0xFFFFFFFF))

    def step(acc: Column, x: Column) -> Column:
        seen = F.struct(x.alias("a"), acc["a"].alias("b"), acc["out"].alias("out"))
        return F.when(_place(x) > 0, seen).otherwise(F.struct(acc["a"].alias("a"), acc["b"].alias("b"), F.concat(acc["out"], F.array(entry(acc["a"], acc["b"]))).alias("out")))

    bins = F.aggregate(around, start, step, lambda acc: acc["out"])
    df = df.withColumn(out, F.when(F.size("_l") > 0, bins).otherwise(F.array_repeat(F.lit(0).cast("long"), BINS)))
    return df.drop("_w", "_t", "_fine", "_s", "_again", "_r", "_p", "_l")


def fingerprint(bins: Column) -> Column:
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).when(x == y, 1).otherwise(0))
    counted = F.filter(pairs, lambda x: x.isNotNull())
    equal = F.size(F.filter(counted, lambda x: x == 1))
    return F.when(F.size(counted) == 0, F.lit(1.0)).otherwise(equal / F.size(counted))


def _boundaries(ids: DataFrame) -> list:
    """Quantiles of the ids, from about SAMPLED for each range."""
    n = ids.count()
    parts = min(PARTS, max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)))
    each = max(1, n // (SAMPLED * parts))
    drawn = ids.filter("id is not null").filter(F.pmod(F.xxhash64("id"), F.lit(each)) == 0).distinct()
    drawn = sorted(r["id"] for r in drawn.collect())  # some SAMPLED * PARTS at most
    return [drawn[i * len(drawn) // parts] for i in range(1, parts)] if len(drawn) >= parts else drawn


def with_next(df: DataFrame) -> DataFrame:
    """Rows (id, text, bins) with next_text and next_bins of the row that follows by id and text; the first follows the last."""
    ends = sorted(set(_boundaries(df.select("id"))))
    # the range of an id is the number of boundaries at or below it; null ids lie in range 0
    part = _rank(F.col("id"), ends, 0, len(ends))
    dealt = df.withColumn("part", F.coalesce(part, F.lit(0)))
    least = dealt.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("s"), "id")).alias("m"))
    used = sorted(least.select("part", "m.s", "m.id").collect(), key=lambda r: r["part"])  # one row for each range
    dealt = dealt.withColumn("copy", F.lit(False))
    if used:
        before = {r["part"]: used[i - 1]["part"] for i, r in enumerate(used)}
        pick = F.col("id").isin([r["id"] for r in used if r["id"] is not None])
        if any(r["id"] is None for r in used):
            pick = F.col("id").isNull() | F.coalesce(pick, F.lit(False))
        to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
        firsts = dealt.filter(pick).withColumn("part", F.try_element_at(to, F.col("part")))
        dealt = dealt.unionByName(firsts.withColumn("copy", F.lit(True)))
    # a task for each range, not for what ranges hash to
    dealt = dealt.repartitionById(len(ends) + 1, "part")
    order = Window.partitionBy("part").orderBy("copy", F.asc_nulls_first("id"), "text")
    out = dealt.withColumns({"next_text": F.lead("text").over(order), "next_bins": F.lead("bins").over(order)})
    return out.filter(~F.col("copy")).drop("copy", "part")


def _rank(value: Column, ends: list, low: int, high: int) -> Column:
    """The number of sorted boundaries at or below a value, by a tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value >= F.lit(ends[middle]), _rank(value, ends, middle + 1, high)).otherwise(_rank(value, ends, low, middle))


def order_minhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_chars, fingerprint, and those of the text whose last quarter the next text's start replaces."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = with_next(with_bins(rows, "text", "bins"))
    chars = F.length("text")
    quarter = F.floor(chars / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring("next_text", F.lit(1), quarter)))
    both = both.withColumn("n_chars", chars.cast("long")).drop("text", "next_text")
    both = with_bins(both, "edited", "edited_bins")
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("bins")).alias("fingerprint"),
        fingerprint(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
