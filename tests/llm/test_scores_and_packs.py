import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmend.llm.labelled import remainder
from tabmend.llm.ngram_lm import END, lm_scores, packed, packed_keys, unpacked, unpacked_keys, words_of
from tabmend.llm.packing import cutting_stock, pack
from tabmend.llm.queries import encoder
from tabmend.llm.shards import EXTRA, shard_by_sampled_splitters

from .conftest import WORDS


def test_base_scores_equal_brute_force(spark, make_docs, fold):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[: 2 + i % 18]) for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, None), (501, "Alpha ALPHA unseen")]
    out = {r["doc_id"]: r for r in lm_scores(make_docs(rows), remainder("doc_id", 5) == 1).collect()}
    counts = Counter()
    for i, t in rows:
        if fold(i, 5) != 1:
            counts.update([*words_of(t), END])
    n, norm = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for i, t in rows:
        tokens = [*words_of(t), END]
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / norm) for w in tokens), abs=1e-9)
        assert out[i]["held_out"] == (fold(i, 5) == 1)


def test_contexts_help_on_held_out_texts(spark, make_docs):
    rng = random.Random(8)
    text = lambda: " ".join(" ".join(WORDS[k : k + 3]) for k in (3 * rng.randrange(6) for _ in range(20)))
    out = lm_scores(make_docs([(i, text()) for i in range(150)]), remainder("doc_id", 5) == 1).collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["score"] > 0.6 * r["base_score"] for r in held)  # logarithms are negative


def backoff_model(rows, trains):
    """The probability of a word after two others where all n-grams seen twice or more are arcs, and the words of the training texts."""
    d, grams = 0.6, [Counter() for _ in range(3)]
    for i, t in rows:
        if trains(i):
            ids = [END, *words_of(t), END]
            grams[0].update(ids[1:])
            for n in (2, 3):
                grams[n - 1].update(zip(*(ids[k:] for k in range(n)), strict=False))
    one, two, three = grams
    two, three = ({g: c for g, c in x.items() if c >= 2} for x in (two, three))
    norm = sum(one.values()) + 0.5 * (len(one) + 1)
    uni = lambda w: (one[w] + 0.5) / norm
    p2 = lambda v, w: (two[v, w] - d) / one[v]
    kept, lower = Counter(), Counter()
    for v, w in two:
        kept[v] += p2(v, w)
        lower[v] += uni(w)
    for u, v, w in three:
        kept[u, v] += (three[u, v, w] - d) / two[u, v]
        lower[u, v] += p2(v, w)
    back = lambda s: max(1 - kept[s], 1e-12) / max(1 - lower[s], 1e-12)

    def p(u, v, w):
        if (u, v, w) in three:
            return (three[u, v, w] - d) / two[u, v]
        return back((u, v)) * (p2(v, w) if (v, w) in two else back(v) * uni(w))

    return p, one


def backoff_scores(rows, trains):
    p, _ = backoff_model(rows, trains)
    out = {}
    for i, t in rows:
        ids = [None, END, *words_of(t), END]
        out[i] = sum(math.log10(p(*ids[k : k + 3])) for k in range(len(ids) - 2))
    return out


@pytest.mark.parametrize(("chunk", "span"), [(1_000_000, 3_000_000), (150, 400), (1, 50)])
def test_scores_equal_brute_force_however_the_corpus_is_cut(spark, make_docs, fold, monkeypatch, chunk, span):
    monkeypatch.setattr("tabmend.llm.ngram_lm.CHUNK_TOKENS", chunk)
    monkeypatch.setattr("tabmend.llm.ngram_lm.RANGE_TOKENS", span)
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[: 3 + i % 17]) + rng.choice(["", "", "", str(i)]) for _ in range(rng.randrange(50)))) for i in range(120)] + [(500, None), (501, "Alpha ALPHA unseen")]
    out = {r["doc_id"]: r for r in lm_scores(make_docs(rows), remainder("doc_id", 5) == 1).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert len(out) == len(rows)
    for i, score in backoff_scores(rows, lambda i: fold(i, 5) != 1).items():
        assert out[i]["score"] == pytest.approx(score, abs=1e-9)


def test_states_are_distributions():
    rng = random.Random(3)
    p, words = backoff_model([(i, " ".join(rng.choice(WORDS[:6]) for _ in range(30))) for i in range(20)], lambda i: True)
    for u, v in [(END, b"alpha"), (b"alpha", b"beta"), (b"beta", b"gamma"), (b"unseen", b"alpha"), (b"unseen", b"other"), (None, END)]:
        assert sum(p(u, v, w) for w in words) + p(u, v, b"never") == pytest.approx(1, abs=1e-9)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(5)
    for keys in (np.unique(rng.integers(0, 2**63, 5000, np.uint64)), np.array([2**64 - 1], np.uint64), np.array([3, 2**63], np.uint64)):
        assert (unpacked_keys(packed_keys(keys)) == keys).all()
    for x in (np.array([0, 1, 2**40]), np.empty(0), rng.random(100)):
        assert (unpacked(packed(x), x.dtype) == x).all()


def test_lm_odd_rows(spark, make_docs, odd_rows):
    out = lm_scores(make_docs(odd_rows), remainder("doc_id", 5) == 1).collect()
    assert len(out) == len(odd_rows) and all(math.isfinite(r["score"]) for r in out)
    assert [r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm_scores(make_docs([]), remainder("doc_id", 5) == 1).collect() == []
    alone = lm_scores(make_docs([(1, "x y")]), F.lit(True)).collect()
    assert (alone[0]["train_tokens"], alone[0]["n_known"]) == (0, 0)


def check_packs(rows, out, length):
    import public_tokenizers
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), length):
            part = np.array(ids[start : start + length], "<u4")
            encoded[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == encoded
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert not filled or max(filled.values()) <= length
    return filled


def test_packs_hold_every_id_once_and_are_full(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 20, 60, 200, 700])))) for i in range(300)]
    filled = check_packs(rows, pack(make_docs(rows), encoder(), length=512).collect(), 512)
    assert sum(filled.values()) / (512 * len(filled)) > 0.95


def test_pack_odd_rows(spark, make_docs, odd_rows):
    check_packs(odd_rows, pack(make_docs(odd_rows), encoder()).collect(), 2048)
    assert pack(make_docs([]), encoder()).collect() == []


def test_cutting_stock_meets_demand_near_the_bound():
    size, demand = np.arange(1, 33), np.random.default_rng(1).integers(0, 400, 32)
    found = cutting_stock(size, demand, 64)
    assert (sum(n * p for n, p in found) == demand).all()
    assert all(p @ size <= 64 for _, p in found)
    assert sum(n for n, _ in found) <= 1.02 * (demand @ size) / 64 + 2
    assert cutting_stock(size[:0], demand[:0], 64) == []


def check_shards(rows, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + EXTRA, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter()
    for s in range(shards):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    return [sizes[s] for s in range(shards)]


def test_shards_are_nearly_equal_and_keep_copies(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(400)) if i % 3 else (i, "one text that a third of all rows hold") for i in range(3000)]
    rows += [(4000 + i, f"small group {i // 2}") for i in range(40)]
    out = shard_by_sampled_splitters(make_docs(rows).drop("size"), 8).collect()
    sizes = check_shards(rows, out, 8)
    assert max(sizes) - min(sizes) < 0.02 * max(sizes)
    shard = {r["doc_id"]: r["shard"] for r in out}
    assert all(shard[4000 + 2 * i] == shard[4001 + 2 * i] for i in range(20))
    assert len({shard[i] for i in range(0, 3000, 3)}) > 1  # the hot text is divided


def test_shards_divide_equal_rows(spark, make_docs):
    rows = [(7, "one row that occurs often " * 3)] * 4000 + [(i, f"some text {i} " * (i % 9)) for i in range(100, 2100)]
    sizes = check_shards(rows, shard_by_sampled_splitters(make_docs(rows), 8).collect(), 8)
    assert max(sizes) - min(sizes) < 0.02 * max(sizes)


def test_shards_keep_columns_of_any_name(spark):
    names = ["a_of_shard", "B_of_shard", "_size", "_slot", "slot", "shard", "size"]
    df = spark.createDataFrame([(i, f"text {i}", *range(7)) for i in range(50)], ["doc_id", "text", *names])
    out = shard_by_sampled_splitters(df, 3)
    assert sorted(out.columns) == sorted([*df.columns, "text_crc32"])
    row = out.collect()[0]
    assert (row["a_of_shard"], row["B_of_shard"], row["_size"], row["_slot"]) == (0, 1, 2, 3)


def test_shard_odd_rows(spark, make_docs, odd_rows):
    check_shards(odd_rows, shard_by_sampled_splitters(make_docs(odd_rows), 5).collect(), 5)
    assert shard_by_sampled_splitters(make_docs([]), 5).collect() == []
