"""A plain-Python Order MinHash with the same hashes, to compare with."""

import re

import xxhash

from tabmend.llm.omh import BINS, CHARS, K, POSITION, TAKEN, UNSPACED

M = 2**64 - 1


def _of(parts, seed=42):
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & M).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def bins(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return [0] * BINS
    fine = len(w) <= K or len(text) > UNSPACED * len(w)
    parts, width = (list(text), CHARS) if fine else (w, K)
    seen, ring = {}, []
    low = (1 << POSITION) - 1
    for i in range(max(len(parts) - width + 1, 1)):
        h = _of(parts[i : i + width]) & ~low & M
        times = seen.get(h, 0)
        seen[h] = times + 1
        ring.append((_of([h, times]) & ~low & M if times else h, i + 1))
    # the circle starts at the least signed number
    turned = lambda h: (h + 2**63) & M
    ring = sorted((turned(h), i, h) for h, i in ring)
    out = []
    for b in range(BINS):
        ahead = [x for x in ring if x[0] >= b << 58]
        took = (ahead + ring + ring)[:TAKEN]
        took.sort(key=lambda x: x[1])
        out.append(_of([h for _, _, h in took]) & 0xFFFFFFFF)
    return out[::-1]


def fingerprint(text):
    return "".join(f"{x:08x}" for x in bins(text))


def likeness(a, b):
    pairs = [(x, y) for x, y in zip(bins(a), bins(b), strict=True) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0
