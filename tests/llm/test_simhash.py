from __future__ import annotations

import random

import numpy as np
import xxhash

from gridloom.llm import simhash
from gridloom.llm.graph import components
from gridloom.llm.grayindex import GrayIndex, gray_rank


def brute_fp(text, words=3):
    seq = (text or "").encode().lower().split()
    parts = [b" ".join(seq[i : i + words]) for i in range(len(seq) - words + 1)] or ([b" ".join(seq)] if seq else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(p, 42) >> bit & 1 for p in parts)
        out |= (2 * ones > len(parts)) << bit
    return out


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    cls = list(range(len(rows)))

    def root(i):
        while cls[i] != i:
            i = cls[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                cls[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f, least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    return sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(df).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 400))]
        for _ in range(rnd.randint(1, 3)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "A b"), (504, "a B"), (None, "a b"), (None, None), (505, "é " * 5000), (0, rows[0][1]), (0, rows[0][1])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_hot_blocks_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rnd = random.Random(1)
    fps = sorted({rnd.getrandbits(64) & ~0xFFFFFFFFFF00 ^ (1 << rnd.randrange(64)) for _ in range(150)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want, got = list(range(len(fps))), {}
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    at = {f: i for i, f in enumerate(signed)}
    have = list(range(len(fps)))
    for u, v in found:
        a, b = have[at[u]], have[at[v]]
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 64
        have = [min(a, b) if x in (a, b) else x for x in have]
    assert have == want


def test_the_index_serves_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vertices = simhash.fingerprints(docs).select("fp").distinct().cache()
    n = vertices.count()
    got = [r.asDict() for r in simhash.report(vertices).collect()]
    assert sum(r["codes"] for r in got) == 4 * n and all(r["nodes"] >= r["codes"] / 16 for r in got)
    pairs = sum(r["codes"] * (r["codes"] - 1) // 2 for r in got)
    met, dropped = sum(r["met"] for r in got), sum(r["other"] + r["far"] for r in got)
    assert dropped > met / 2 and met < pairs / 5 and sum(r["far"] for r in got) > 0


def test_index_by_blocks(monkeypatch):
    from gridloom.llm import grayindex

    monkeypatch.setattr(grayindex, "MEETINGS", 100)
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2**12, 500, dtype=np.uint64)
    block = np.sort(rng.integers(0, 40, 500))
    codes = codes[np.lexsort((gray_rank(codes), block))]
    codes = np.concatenate([c[np.argsort(gray_rank(c), kind="stable")] for c in (codes[block == b] for b in range(40))])
    got = {(int(i), int(j)) for a, b in GrayIndex(codes, block).pairs(3) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(500) for j in range(i + 1, 500) if block[i] == block[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}


def test_hot_keys_are_spread(spark, monkeypatch):
    from gridloom.llm import common

    rows = [(i, "a b c d") for i in range(30)] + [(100 + i, f"x{i} y{i} z{i}") for i in range(20)] + [(None, "a b c d"), (200, None)]
    want = run(spark, rows)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert run(spark, rows) == want == brute(rows)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 700, dtype=np.uint64) & np.uint64(0xFFFF0000FFFF)
    codes = np.r_[codes, codes[:200] ^ np.uint64(5)]
    codes = codes[np.argsort(gray_rank(codes))]
    for radius in (0, 3, 9):
        got = {(int(i), int(j)) for a, b in GrayIndex(codes).pairs(radius) for i, j in zip(a, b, strict=True)}
        want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= radius}
        assert got == want


def test_gray_neighbours_differ_by_one_bit():
    codes = np.array([i ^ i >> 1 for i in range(1024)], dtype=np.uint64)
    assert gray_rank(codes).tolist() == list(range(1024))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201)], "u long, v long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
