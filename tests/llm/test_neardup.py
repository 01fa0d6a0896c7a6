import random
from collections import defaultdict

import numpy as np
import pytest

from tabmend.llm import neardup
from tabmend.llm.common import TokenHasher, shingle_hashes
from tabmend.llm.neardup import BANDS, band_keys, components, densify, donors, near_duplicates

from .conftest import WORDS


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_force(rows, percent=85):
    """Component id of each row: least id reachable over exact links."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    out = []
    for i, _ in enumerate(rows):
        ids = [k for k in least[find(i)] if k is not None]
        out.append(min(ids) if ids else None)
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"{rng.choice(WORDS)}{rng.randrange(99)}"
    return words


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_groups_of_near_copies_equal_brute_force(spark, make_docs, seed, percent):
    rng = random.Random(seed)
    rows = []
    for length in (8, 30, 120, 400):
        base = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(length)]
        for i in range(40):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, 1 + length // 25)))))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows), percent=percent).collect()}
    assert [got[i] for i, _ in rows] == brute_force(rows, percent)


def test_least_turns_by_parts_are_those_of_the_whole(spark):
    rows = [(key, i * 7919 % 501, bytes([i % 256, i // 256])) for key, n in (("hot", 500), ("small", 9), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, turn long, node binary")
    for most in (1, 10, 70, 1000):
        want = {(k, t) for key in ("hot", "small", "one") for k, t in sorted((k, t) for k, t, _ in rows if k == key)[:most]}
        for pushed in (0, 1000):
            got = [(r["key"], r["turn"]) for r in neardup.least_turns(df, most, pushed).collect()]
            assert len(got) == len(want) and set(got) == want


def test_chains_where_no_centre_meets_all(spark, make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "CENTRES", 2)
    monkeypatch.setattr(neardup, "MORE", 2)
    monkeypatch.setattr(neardup, "PUSHED", 1)
    # a window that slides over a long text: only neighbours are similar enough
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 150])) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows), percent=85).collect()}
    assert [got[i] for i, _ in rows] == brute_force(rows)


def test_odd_rows(spark, make_docs, odd_rows):
    out = near_duplicates(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert [by[i][0]["n_shingles"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 3, 1]
    assert [by[i][0]["component_id"] for i in (1, 2, 3, 4, 5, 6)] == [1, 2, 3, 4, 4, 6]
    assert sorted(str(r["component_id"]) for r in by[None]) == ["4", "None"]
    assert near_duplicates(make_docs([])).collect() == []


def test_white_space_and_case(spark, make_docs):
    out = near_duplicates(make_docs([(2, "A b\tC"), (1, "a  B c"), (3, "Ä b c"), (4, "ä b c")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 35), (36, 40), (50, 50)]
    df = spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in components(df).collect()}
    assert {k: got[k] for k in ("000", "015", "030", "035", "040")} == {"000": "000", "015": "000", "030": "000", "035": "035", "040": "035"}


def test_densified_bins_agree_in_proportion_to_similarity():
    rng = np.random.default_rng(3)
    table = donors()
    for size, shared in ((12, 11), (300, 270)):
        base = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        agree = []
        for _ in range(60):
            pool = rng.permutation(base)
            a, b = np.sort(pool[:size]), np.sort(np.r_[pool[:shared], pool[size : 2 * size - shared]])
            agree.append((band_keys([a], table) == band_keys([b], table)).mean())
        j = shared / (2 * size - shared)
        assert abs(np.mean(agree) - j**5) < 0.12
    full = densify(np.where(rng.random((5, 128)) < 0.97, np.uint64(2**64 - 1), np.uint64(7)), table)
    assert full.shape == (5, 128) and BANDS == 25


def test_token_hashes_do_not_depend_on_pieces():
    import pyarrow as pa

    texts = ["Ab c  d", "", None, "x" * 300_000 + " y", " ".join(map(str, range(90_000)))]
    seen = {}
    for rows in (texts, texts[::-1], [texts[4]], [texts[3]]):
        for first, stop, tokens, owner in TokenHasher().rows(pa.array(rows, pa.string())):
            for i in range(first, stop):
                own = tokens[owner == i]
                key = rows[i] or ""
                assert len(own) == len(key.split())
                assert seen.setdefault(key, own.tobytes()) == own.tobytes()
    assert len(shingle_hashes(np.arange(3, dtype=np.uint64))) == 1
