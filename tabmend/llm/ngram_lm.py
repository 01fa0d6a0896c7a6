"""Language-model scoring: a weighted backoff automaton over words.

States are contexts: nothing, a word, or a pair of words. Every pair and triple of
words that training texts hold at least LEAST times is an arc, whatever the size
of the input. Absolute discounting leaves each state a mass that its failure arc
passes to the next shorter context; the last is the add-half unigram model over
all words. A text is walked from left to right: from the state of its last two
words an arc is taken where there is one, else failure arcs are, and the logs of
what was passed add up.

The automaton grows with the corpus, so no task holds all of it. Texts become
chunks of some CHUNK_TOKENS tokens, coded by the chunk's own vocabulary and written
once. A chunk asks for what its walk needs: it sends its distinct keys, sorted,
cut by ranges of the hash space and packed, and gets one answer for each key in the
same order. There are three questions: counts of its words and pairs; counts of
triples whose pairs were both kept (no other can be an arc); and sums over the arcs
of its states, from which the masses follow, where the chunk that comes first among
a kept n-gram's holders adds that n-gram. A key reaches its range once for each chunk at
most, however often it occurs, so no key is hot.

Keys are 63-bit hashes and a bit that tells words from longer n-grams.

Results in odd cases: null and empty texts are the single end token; without any
training text every count is 0; repeated rows get equal scores, and train as often
as they occur; null ids are scored and train as remainder null does: not at all;
an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.llm.common import LOWER, TokenHasher, materialize, mix, small_batches, tidy

#: Least count of an arc, and what is taken off each count.
LEAST, DISCOUNT = 2, 0.6
#: Tokens from which a chunk is closed, and tokens for each range of keys: they bound a task's memory.
CHUNK_TOKENS, RANGE_TOKENS = 1_500_000, 3_000_000
END = b""
END_KEY = np.uint64(0x5851F42D4C957F2D)
LONGER = np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


# Packing

def packed(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal rank together, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data, dtype) -> np.ndarray:
    data, size = memoryview(data), np.dtype(dtype).itemsize
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, in six bytes each where they fit."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps = int(gaps[0]), np.where(np.arange(len(gaps)) == 0, np.uint64(0), gaps)
    wide = gaps.max() >> np.uint64(48) > 0
    return first.to_bytes(8, "little") + bytes([8 if wide else 6]) + gaps.view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 6].tobytes()


def unpacked_keys(data) -> np.ndarray:
    data = memoryview(data)
    first, width = int.from_bytes(data[:8], "little"), data[8]
    short = np.frombuffer(data[9:], np.uint8).reshape(-1, width)
    gaps = np.zeros((len(short), 8), np.uint8)
    gaps[:, :width] = short
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(first)


def starts_of(ranges: int) -> np.ndarray:
    """The least key of each range."""
    return np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)


# Chunks

def _chunks(id_type: pa.DataType, full: int):
    """(ids, held_out, tokens, body): texts of at least `full` tokens, but for a task's last, as codes of their own vocabulary."""

    def run(batches):
        hasher = TokenHasher()
        ids, held, lens, keys, size = [], [], [], [], 0

        def flush():
            every = np.concatenate(keys)
            words, codes, n = np.unique(every, return_inverse=True, return_counts=True)
            # frequent words get small codes, which pack better
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, codes = words[order], rank[codes]
            body = b"".join(len(x).to_bytes(8, "little") + x for x in (packed(np.concatenate(lens)), packed(words), packed(codes.astype(np.uint32))))
            own = pa.chunked_array(ids, id_type).combine_chunks()
            out = pa.concat_arrays(held)
            ends = pa.array([0, len(own)], pa.int32())
            return pa.record_batch([pa.ListArray.from_arrays(ends, own), pa.ListArray.from_arrays(ends, out), pa.array([len(every)], pa.int64()), pa.array([body], pa.binary())], ["ids", "held", "tokens", "body"])

        for batch in batches:
            for first, stop, tokens, row in hasher.rows(batch.column("text")):
                n = np.bincount(row - first, minlength=stop - first)
                seq = np.full(len(tokens) + 2 * len(n), END_KEY, np.uint64)
                seq[np.arange(len(tokens)) + 2 * (row - first) + 1] = tokens
                ids.append(batch.column("id").slice(first, stop - first))
                held.append(batch.column("held_out").slice(first, stop - first))
                lens.append(n + 2)
                keys.append(seq)
                size += len(seq)
                if size >= full:
                    yield flush()
                    ids, held, lens, keys, size = [], [], [], [], 0
        if lens:
            yield flush()

    return run


class Chunk:
    """A chunk's texts: an end token, the words and an end token each; n-grams are numbered by their codes."""

    def __init__(self, row: dict, answers: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        parts, at, body = [], 0, memoryview(row["body"])
        for dtype in (np.int64, np.uint64, np.uint32):
            n = int.from_bytes(body[at : at + 8], "little")
            parts.append(unpacked(body[at + 8 : at + 8 + n], dtype))
            at += 8 + n
        self.lens, self.words, seq = parts
        self.seq = seq
        self.row = np.repeat(np.arange(len(self.lens), dtype=np.uint32), self.lens)
        #: Positions of all tokens but each text's first, and whether their text trains.
        self.at = np.flatnonzero(np.r_[False, self.row[1:] == self.row[:-1]]).astype(np.uint32)
        trains = np.array([x is False for x in row["held"]], bool)
        self.trains = trains[self.row]
        codes = self.seq[self.at - 1] * np.int64(len(self.words)) + self.seq[self.at]
        self.pairs, of = np.unique(codes, return_inverse=True)
        del codes
        #: The pair that ends at each position; none at a text's first.
        self.pair_at = np.full(len(self.seq), -1, np.int32)
        self.pair_at[self.at] = of
        self.first, self.second = self.pairs // len(self.words), self.pairs % len(self.words)
        self.pair_hash = mix(mix(self.words[self.first]) * np.uint64(0x9FB21C651E98DF25) + self.words[self.second])
        #: Words' and pairs' keys, in the order of the questions about them.
        self.short_keys = np.concatenate([self.words & ~LONGER, self.pair_hash | LONGER])
        if "short" in answers:
            counts, self.short_owned = self._ordered(self.short_keys, answers["short"])
            self.word_n, self.pair_n = counts[: len(self.words)], counts[len(self.words) :]
            self._triples()
        if "triple" in answers:
            self.triple_n, self.triple_owned = self._ordered(self.triple_keys, answers["triple"])
        if "state" in answers:
            self._backs(answers["state"])

    @staticmethod
    def _ordered(keys: np.ndarray, answer: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Answers, which come in the order of sorted keys, in the order of keys."""
        order = np.argsort(keys, kind="stable")
        values, owned = np.zeros(answer[0].shape, answer[0].dtype), np.zeros(len(keys), bool)
        values[order], owned[order] = answer
        return values, owned

    def _triples(self) -> None:
        kept = np.r_[self.pair_n > 0, False]  # the last stands for no pair
        at = self.at[kept[self.pair_at[self.at]] & kept[self.pair_at[self.at - 1]]]
        codes = self.pair_at[at - 1] * np.int64(max(1, len(self.pairs))) + self.pair_at[at]
        self.triples, of = np.unique(codes, return_inverse=True)
        self.triple_at = np.full(len(self.seq), -1, np.int32)
        self.triple_at[at] = of
        self.upper, self.lower = self.triples // max(1, len(self.pairs)), self.triples % max(1, len(self.pairs))
        self.triple_keys = mix(mix(self.pair_hash[self.upper] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + self.words[self.second[self.lower]]) | LONGER

    def _state_keys(self) -> tuple[np.ndarray, np.ndarray]:
        states = np.flatnonzero(np.concatenate([self.word_n, self.pair_n]) > 0)
        return self.short_keys[states], states

    def short_question(self) -> tuple[np.ndarray, np.ndarray]:
        train = self.trains[self.at]
        words = np.bincount(self.seq[self.at][train], minlength=len(self.words))
        pairs = np.bincount(self.pair_at[self.at][train], minlength=len(self.pairs))
        return self.short_keys, np.concatenate([words, pairs])

    def triple_question(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.triple_at[self.trains & (self.triple_at >= 0)]
        return self.triple_keys, np.bincount(at, minlength=len(self.triples))

    def logs(self, norm: float) -> None:
        """Probabilities of words, and of pairs and triples by their arcs."""
        self.one = (self.word_n + 0.5) / norm
        self.two = (self.pair_n - DISCOUNT) / np.maximum(self.word_n[self.first], 1)
        self.three = (self.triple_n - DISCOUNT) / np.maximum(self.pair_n[self.upper], 1)

    def state_question(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each state's owned arcs: how many, their counts' sum, and the sum of the counts that the same words have in the next shorter context."""
        n = len(self.words)
        pairs = np.flatnonzero(self.short_owned[n:] & (self.pair_n > 0))
        triples = np.flatnonzero(self.triple_owned & (self.triple_n > 0))
        sums = np.zeros((len(self.short_keys), 3), np.int64)
        np.add.at(sums, self.first[pairs], np.stack([np.ones_like(pairs), self.pair_n[pairs], self.word_n[self.second[pairs]]], 1))
        np.add.at(sums, n + self.upper[triples], np.stack([np.ones_like(triples), self.triple_n[triples], self.pair_n[self.lower[triples]]], 1))
        keys, states = self._state_keys()
        return keys, sums[states]

    def _backs(self, answer: tuple[np.ndarray, np.ndarray]) -> None:
        keys, states = self._state_keys()
        sums = np.zeros((len(self.short_keys), 3))
        sums[states] = self._ordered(keys, answer)[0]
        self.sums = sums

    def backs(self, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 masses of words' and pairs' failure arcs."""
        n = len(self.words)
        out = []
        own = (np.maximum(self.word_n, 1), np.maximum(self.pair_n, 1))
        for sums, c, (take, each) in zip((self.sums[:n], self.sums[n:]), own, ((-0.5, np.full(n, norm)), (DISCOUNT, np.maximum(self.word_n[self.second], 1))), strict=True):
            arcs, upper, lower = sums.T
            out.append(np.log10(np.maximum(1 - (upper - DISCOUNT * arcs) / c, 1e-12) / np.maximum(1 - (lower - take * arcs) / each, 1e-12)))
        return out[0], out[1]

    def scores(self, norm: float) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        self.logs(norm)
        word_back, pair_back = self.backs(norm)
        n, at = len(self.lens), self.at
        row, word = self.row[at], self.seq[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            arcs = [np.log10(self.one), np.where(self.pair_n > 0, np.log10(self.two), 0), np.where(self.triple_n > 0, np.log10(self.three), 0)]
        base = arcs[0][word]
        pair, before, triple = self.pair_at[at], self.pair_at[at - 1], self.triple_at[at]
        # the walk's value at a state of one word: its arc, or its failure arc and the word itself
        one = np.where(self.pair_n[pair] > 0, arcs[1][pair], word_back[self.seq[at - 1]] + base)
        deep = (before >= 0) & (self.pair_n[before] > 0)
        value = one + np.where(deep, pair_back[before], 0)
        taken = np.flatnonzero(triple >= 0)
        taken = taken[self.triple_n[triple[taken]] > 0]
        value[taken] = arcs[2][triple[taken]]
        return [np.bincount(row, minlength=n), np.bincount(row, self.word_n[word] > 0, n).astype(np.int64), np.bincount(row, base, n), np.bincount(row, value, n)]


# Questions and answers

QUESTION = "range int, chunk long, keys binary, given binary"
ANSWER = "range int, chunk long, body binary, owned binary, tokens long, words long"


def _asked(chunk: int, keys: np.ndarray, given: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of QUESTION: the sorted keys, cut by ranges, with what is given for them."""
    order = np.argsort(keys, kind="stable")
    keys, given = keys[order], given[order]
    cuts = np.r_[np.searchsorted(keys, starts_of(ranges)), len(keys)]
    rows = [(i, packed_keys(keys[a:b]), packed(given[a:b].ravel())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        yield pa.record_batch([pa.array([x[0] for x in part], pa.int32()), pa.array([chunk] * len(part), pa.int64()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], ["range", "chunk", "keys", "given"])


def _runs(batches, key: str) -> Iterator[list[dict]]:
    """Rows that lie together and agree in a column."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(batches):
    """Answers with counts: 0 for n-grams that are not kept. The first chunk that holds a kept one owns it."""
    for rows in _runs(batches, "range"):
        keys = [unpacked_keys(r["keys"]) for r in rows]
        cuts = np.cumsum([0, *map(len, keys)])
        every, given = np.concatenate(keys), np.concatenate([unpacked(r["given"], np.int64) for r in rows])
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        total = np.add.reduceat(given[order], np.flatnonzero(new))
        long = (ranked[new] & LONGER).astype(bool)
        total[long & (total < LEAST)] = 0
        counts, owned = np.empty_like(given), np.zeros(len(given), bool)
        counts[order] = total[np.cumsum(new) - 1]
        owned[order[new]] = total > 0
        sums = int(total[~long].sum()), int((total[~long] > 0).sum())
        for i, (r, a, b) in enumerate(zip(rows, cuts, cuts[1:], strict=False)):
            out = [r["range"], r["chunk"], packed(counts[a:b]), packed(np.packbits(owned[a:b])), *(sums if i == 0 else (0, 0))]
            yield _answer(out)


def _answer(out: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([x], t) for x, t in zip(out, types, strict=True)], ["range", "chunk", "body", "owned", "tokens", "words"])


def _summed(batches):
    """Answers with the sums of what chunks give for each key."""
    for rows in _runs(batches, "range"):
        keys = [unpacked_keys(r["keys"]) for r in rows]
        cuts = np.cumsum([0, *map(len, keys)])
        every, given = np.concatenate(keys), np.concatenate([unpacked(r["given"], np.int64) for r in rows]).reshape(-1, 3)
        order = np.argsort(every, kind="stable")
        new = np.r_[True, every[order][1:] != every[order][:-1]]
        values = np.empty_like(given)
        values[order] = np.add.reduceat(given[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            yield _answer([r["range"], r["chunk"], packed(values[a:b].ravel()), packed(np.zeros(0, np.uint8)), 0, 0])


def _met(rows: list[dict]) -> Chunk:
    """A chunk from its own row and its answers, which come in the order of ranges."""
    answers = {}
    for kind in ("short", "triple", "state"):
        own = [r for r in rows if r["kind"] == kind]
        if own or any(r["kind"] == f"asked {kind}" for r in rows):
            bodies = [unpacked(r["body"], np.int64) for r in own]
            bits = [np.unpackbits(unpacked(r["owned"], np.uint8), count=len(b)).astype(bool) for r, b in zip(own, bodies, strict=True) if kind != "state"]
            values = np.concatenate([np.empty(0, np.int64), *bodies])
            if kind == "state":
                values = values.reshape(-1, 3)
            answers[kind] = (values, np.concatenate(bits) if bits else np.zeros(len(values), bool))
    return Chunk(next(r for r in rows if r["kind"] == "a chunk"), answers)


def _answered(chunks: DataFrame, answers: dict[str, DataFrame], parts: int) -> DataFrame:
    """Chunks and all their answers, those of a chunk together."""
    none = lambda c: F.lit(None).cast(chunks.schema[c].dataType).alias(c)
    every = chunks.select("chunk", F.lit("a chunk").alias("kind"), F.lit(-1).alias("range"), "body", F.lit(None).cast("binary").alias("owned"), "ids", "held")
    for kind, answer in answers.items():
        # that a question was asked is said even where there was no key to ask for
        said = chunks.select("chunk", F.lit(f"asked {kind}").alias("kind"), F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("binary").alias("owned"), none("ids"), none("held"))
        every = every.unionByName(said).unionByName(answer.select("chunk", F.lit(kind).alias("kind"), "range", "body", "owned", none("ids"), none("held")))
    return every.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "range")


def _per_chunk(question, ranges: int):
    def run(batches):
        for rows in _runs(batches, "chunk"):
            yield from _asked(rows[0]["chunk"], *question(_met(rows)), ranges)

    return run


def _scored(norm: float, id_type: pa.DataType):
    def run(batches):
        for rows in _runs(batches, "chunk"):
            own = next(r for r in rows if r["kind"] == "a chunk")
            n_tokens, n_known, base, score = _met(rows).scores(norm)
            yield pa.record_batch([pa.array(own["ids"], id_type), pa.array(own["held"], pa.bool_()), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows where held_out is false."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    shape = T.StructType().add("ids", T.ArrayType(kind)).add("held", T.ArrayType(T.BooleanType())).add("tokens", "long").add("body", "binary")
    chunks = materialize(rows.mapInArrow(_chunks(id_type, CHUNK_TOKENS), shape).withColumn("chunk", F.monotonically_increasing_id()))
    size, n = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    ranges, parts = max(1, -(-size // RANGE_TOKENS)), max(1, n)

    def ask(question, answers: dict[str, DataFrame], answer) -> DataFrame:
        asked = _answered(chunks, answers, parts) if answers else chunks.select("chunk", F.lit("a chunk").alias("kind"), "body", "held")
        asked = asked.mapInArrow(_per_chunk(question, ranges), QUESTION)
        got = materialize(asked.repartitionById(ranges, "range").sortWithinPartitions("range", "chunk").mapInArrow(answer, ANSWER))
        tidy(spark)
        return got

    short = ask(Chunk.short_question, {}, _counted)
    tokens, words = short.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    norm = tokens + 0.5 * (words + 1)
    answers = {"short": short}
    answers["triple"] = ask(Chunk.triple_question, answers, _counted)
    answers["state"] = ask(Chunk.state_question, answers, _summed)
    shape = T.StructType().add("id", kind).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    out = _answered(chunks, answers, parts).mapInArrow(_scored(norm, id_type), shape)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
