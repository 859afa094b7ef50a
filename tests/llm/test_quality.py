from __future__ import annotations

import re
from collections import Counter

import pytest

from gridloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a", "é ü#*$ %&|<> x\u00a0y", "same\nsame\n same\n\nsame", "x\x0by\x1cz", "a b c d " * 3000, "word " * 49, "one two three"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.measure(text.encode() if text is not None else None)[0] == brute(text)


def test_many_distinct_words(monkeypatch):
    monkeypatch.setattr(quality, "_MOST", 4)
    words = [b"%d" % (i % 97) for i in range(500)]
    assert quality.repeated_words(words) == brute(" ".join(str(i % 97) for i in range(500)))[4]


def unique(i, n=60):
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))


def test_lines_and_verdicts(spark):
    boiler = "All rights  reserved 20%02d here and there"
    rows = [(i, f"{unique(i)}\n{boiler % i}", "h", "dup") for i in range(40)]
    rows += [(100, (boiler % 7 + "\n") * 12, "h", "")]  # depleted
    rows += [(200 + i, unique(500), "h", "") for i in range(50)]  # exact copies count once
    rows += [(300 + i, f"{unique(600 + i)}\n{boiler % i}", "other", "") for i in range(5)]  # rare on this host
    rows += [(400, None, None, ""), (None, unique(700), None, ""), (401, unique(701), None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept and got[i].removed_words == 7 for i in range(40))
    assert not got[100].kept and got[100].removed_words == 84
    assert all(got[200 + i].kept for i in range(50))
    assert all(got[300 + i].kept and got[300 + i].removed_words == 0 for i in range(5))
    assert not got[400].kept and got[400].n_words == 0 and got[None].kept and got[401].kept
    out = quality.apply_rules(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert set(texts) == {d for d, r in got.items() if r.kept}
    assert texts[3] == unique(3) and texts[300] == f"{unique(600)}\n{boiler % 0}"


def test_limit_is_absolute(spark):
    # Eleven pages share a line: it goes from a host of eleven pages as from one of many; ten do not suffice.
    rows = [(i, f"{unique(i)}\nthe banner", "small") for i in range(11)] + [(100 + i, f"{unique(100 + i)}\nthe banner" if i < 11 else unique(100 + i), "large") for i in range(300)]
    rows += [(500 + i, f"{unique(500 + i)}\nthe banner", "ten") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r.doc_id for r in quality.judge(docs).filter("removed_words > 0").collect()}
    assert removed == set(range(11)) | set(range(100, 111))


def test_hot_text_and_many_lines(spark, monkeypatch):
    from gridloom.llm import common

    rows = [(i, f"{unique(i % 3)}\nline {'abc'[i % 3]}", "h") for i in range(60)] + [(200 + i, f"{unique(100 + i)}\nbanner", "h") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality.judge(docs).collect())), sorted(map(tuple, quality.apply_rules(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert (sorted(map(tuple, quality.judge(docs).collect())), sorted(map(tuple, quality.apply_rules(docs).collect()))) == want


def test_method_changes_verdicts(spark):
    # Pages that hold little but lines of their host pass the base rules and fail by depletion.
    menu = [f"menu entry number {unique(i, 6)}" for i in range(12)]
    rows = [(i, "\n".join(menu) + "\n" + unique(i, 12), "shop") for i in range(30)] + [(100 + i, unique(100 + i) + "\n" + menu[0], "shop") for i in range(5)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i in range(30)) and all(got[100 + i].kept and got[100 + i].removed_words > 0 for i in range(5))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(docs).collect() == [] and quality.apply_rules(docs).collect() == []
