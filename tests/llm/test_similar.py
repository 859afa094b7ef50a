from __future__ import annotations

import random
import tracemalloc
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import common, similar, spm


def sets(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set())


def brute(rows):
    """The smallest doc_id of each class by all pairs."""
    root = list(range(len(rows)))
    parts = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            x, y = parts[i], parts[j]
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
                continue
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted({min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root})


def make(seed, n=50):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    rows = []
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 120, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(copy) // 60, len(copy) // 30])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy) + (" " + passage if rnd.random() < 0.4 else "")))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, vid int")
    out = similar.deduplicate(docs)
    assert out.columns == docs.columns
    return sorted((r.doc_id for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rows = make(1) + [(900, None), (901, ""), (902, " "), (903, "A B"), (904, "a\nb")]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def hot_corpus(seed):
    """Near copies of one text, unlike texts that share a long passage, and a second group that joins the passage, too."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = make(2, 15)
    for i in range(30):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(300)] = f"x{i}"
        rows.append((1000 + i, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(30):
        own = [f"q{i}x{k}" for k in range(30)]
        rows.append((2000 + 2 * i, passage + " " + " ".join(own)))
        if i % 3 == 0:
            own[7] = "other"
            rows.append((2001 + 2 * i, passage + " " + " ".join(own)))
    for i in range(20):
        copy = list(base[:40])
        copy[rnd.randrange(40)] = f"y{i}"
        rows.append((3000 + i, passage + " " + " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [4, 12, 40])
def test_hot_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "ANCHORS", 2)
    rows = hot_corpus(8)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_hot_blocks_keep_links_without_anchors(spark, monkeypatch):
    # The first pass joins little; the second has to find the links between chunks.
    monkeypatch.setattr(similar, "BLOCK", 5)
    monkeypatch.setattr(similar, "ANCHORS", 0)
    rows = hot_corpus(9)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_repeated_rows_and_null_ids(spark):
    assert run(spark, [(5, "a b c"), (5, "a b c"), (5, "x y z"), (None, "p q r"), (None, "p q r"), (7, "p q r")]) == [5, 5, 7]
    assert run(spark, [(None, "p q r"), (None, "p q r")]) == [None]
    assert run(spark, []) == []


def test_whole_table(spark):
    # Every pair of at least 0.8 among the documents themselves: none is missed.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(r.doc_id for r in similar.deduplicate(docs).collect()) == sorted(brute(rows))


def test_repeats_do_not_part_equal_sets(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(20):
        ring, rest = [f"r{k}x{i}" for i in range(5)], [f"w{rnd.randrange(10**6)}" for _ in range(95)]
        rows += [(2 * k, " ".join(ring * 2 + rest)), (2 * k + 1, " ".join(ring * 11 + rest))]
        assert sets(rows[-1][1]) == sets(rows[-2][1])
    assert run(spark, rows) == sorted(range(0, 40, 2), key=str)


def test_miss_rate_of_the_radius():
    # Sets of 4 and 5 shingles: the majorities differ if 2 of 4 bits are set and the fifth is.
    p = comb(4, 2) / 2**4 / 2
    assert sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(similar.RADIUS + 1, 65)) < 1.1e-6


def test_a_block_of_near_copies_takes_little_memory():
    """All pairs of a full block are within the radius; they come in parts of some megabytes."""
    rnd = np.random.default_rng(3)
    n = similar.BLOCK
    codes = np.zeros(n, np.uint64)
    for _ in range(6):
        codes ^= np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)
    least = np.tile(rnd.integers(0, 9, similar.KEYS), (n, 1))
    least[:, :-1] = rnd.integers(0, 1 << 60, (n, similar.KEYS - 1))
    table = pa.table({"block": np.zeros(n, np.int64), "own": np.full(n, 7, np.int32), "fp": codes.view(np.int64), "least": pa.array(list(least), pa.list_(pa.int64())), "class": np.arange(n)})
    tracemalloc.start()
    found = sum(len(i) for i, _ in similar._Meeting(table).candidates())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2
    assert peak < 80e6  # 166 million with MEETINGS at 1 << 17


def test_workers_let_go_of_other_stages_memory(spark):
    """What a worker remembers for one operator goes when it works for the near-duplicates."""
    made = []

    @common.kept
    def held(name):
        made.append(name)
        return name

    assert held("a") == held("a") and made == ["a"]
    common.forget()
    assert held("a") == "a" and made == ["a", "a"]

    spm.codec(public_tokenizers.path("piece_bpe_32k.model"))
    rows = pa.table({"doc_id": [1], "ident": ["=1:x"], "text": ["some words"]}).to_batches()

    class Docs:
        """In the place of a frame: runs a stage's function in this process."""

        def __init__(self):
            self.sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, stage, schema):
            return list(stage(iter(rows)))

    assert spm.codec.cache_info().currsize == 1
    assert len(similar.signatures(Docs(), "doc_id", "text")) == 1
    assert spm.codec.cache_info().currsize == 0
