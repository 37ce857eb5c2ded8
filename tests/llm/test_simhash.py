import random
from collections import defaultdict

import xxhash

from attestry.llm.simhash import fingerprint, fingerprint_links, near_duplicates
from attestry.operators.graph import connected_components


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=3):
    values = sorted(values)
    part = {v: v for v in values}
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= radius and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if p == old else p for k, p in part.items()}
    return part


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["Über", "A", "bc", " x", "the", "z\n"]) for _ in range(n))
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n\t") == 0


def test_links_match_brute_force_also_in_large_buckets(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(3):
            w = v
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    core = rng.getrandbits(64)
    values |= {core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(90)}
    values |= {0, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = slow_components(values)
    for blocks, chunk in ((None, 2048), (4, 7), (6, 16)):
        got = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(fingerprint_links(df, 3, blocks, chunk)).collect()}
        sets = lambda m: {frozenset(s) for s in _classes(m).values() if len(s) > 1}
        assert sets(got) == sets(want)


def _classes(part):
    out = defaultdict(set)
    for k, v in part.items():
        out[v].add(k)
    return out


def test_edge_rows(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(5, a, 1), (5, a, 2), (3, a, 3), (9, None, 4), (8, "", 5), (None, a, 6), (7, "alone", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
