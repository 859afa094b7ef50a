from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import functions as F

from gridloom.llm import mixing


def fill(sizes, epochs=3, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        share = {s: Fraction(left * w[s], sum(w[x] for x in names if x not in capped)) for s in names if s not in capped}
        above = {s for s, t in share.items() if t > epochs * sizes[s]}
        if not above:
            return {s: float(epochs * sizes[s]) if s in capped else float(share[s]) for s in names}
        capped |= above


def make(spark, rows):
    return spark.createDataFrame([(d, t, s, 7) for d, t, s in rows], "doc_id long, text string, source string, slot int")


def test_targets_and_taken(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["a", "b", "b", "b", "b", "b", "c", "é", "Z", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, "x", "tiny"), (None, "a b c", "b"), (5, rows[5][1], rows[5][2])]
    got = mixing.taken(make(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    sums = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.taken
    assert all(abs(sums[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(make(spark, rows)).collect()))


def test_schedule_keeps_shares_in_every_stretch(spark):
    docs = make(spark, [(i, "w " * 500, "abc"[i % 3]) for i in range(900)])
    rows, pieces = mixing.mix(docs)
    goals = mixing.targets(mixing.sizes(docs))
    slots = sorted((r.slot, r.ord, r.rank) for r in mixing.schedule(goals).collect())
    share = {r.ord: r.words for r in goals.collect()}
    total = sum(share.values())
    for at in range(0, len(slots) - 300, 150):
        part = slots[at : at + 300]
        for ord_, words in share.items():
            assert abs(sum(o == ord_ for _, o, _ in part) - 300 * words / total) <= 6
    for ord_ in share:
        assert [r for _, o, r in slots if o == ord_] == list(range(sum(o == ord_ for _, o, _ in slots)))
    blocks = [r.n for r in pieces.groupBy("slot").agg(F.sum("taken").alias("n")).collect()]
    assert max(blocks) - min(blocks) <= 0.05 * max(blocks)


def test_rows_follow_the_schedule(spark):
    docs = make(spark, [(i, f"w{i} " * 500, "abc"[i % 3]) for i in range(600)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    order = [r.source for r in out.collect()]
    assert len(order) == 600
    share = {s: order.count(s) / 600 for s in "abc"}
    assert share == {"a": 1 / 6, "b": 1 / 3, "c": 1 / 2}
    for at in range(0, 540, 30):
        assert all(abs(order[at : at + 60].count(s) - 60 * share[s]) <= 5 for s in "abc")


def test_ties_go_by_text(spark):
    rows = [(1, "a b c", "x"), (1, "d e f", "x"), (1, "g h i", "x"), (2, "w " * 30, "y")]
    first = sorted(tuple(r) for r in mixing.taken_rows(make(spark, rows)).collect())
    assert all(sorted(tuple(r) for r in mixing.taken_rows(make(spark, [rows[i] for i in p])).collect()) == first for p in ((2, 1, 0, 3), (3, 1, 2, 0)))


def test_empty(spark):
    assert mixing.taken(make(spark, [])).collect() == []
    assert [r.taken for r in mixing.taken(make(spark, [(1, None, None)])).collect()] == [0]


def test_many_sources_shuffle(spark, monkeypatch):
    docs = make(spark, [(i, "w " * (i % 7 * 40), f"s{i % 23}") for i in range(200)])
    want = sorted(map(str, mixing.taken(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.taken(docs).collect())) == want
