from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing
from gridloom.llm.queries import QUERIES

KEY = hashlib.sha1(b"k").hexdigest()


def words(rnd, n):
    return " ".join(rnd.choice("abcdefghij") + rnd.choice("klmno") + rnd.choice("pqrstu") + rnd.choice("aeiou") for _ in range(n))


def corpus():
    rnd = random.Random(5)
    rows = [(i, words(rnd, 120), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    near = rows[7][1].split()
    near[50] = "other"
    rows += [(200, " ".join(near), "en", "s1")]
    rows += [(300, "too short", "en", "s0"), (301, None, "en", None), (302, "", "de", "s1")]
    rows += [(400, words(rnd, 80) + f'\ntoken = "{KEY}" and more\n' + words(rnd, 80), "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_and_run(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mixture", "tokens"]
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        seen.append(now.cache())
    good, unique, clean, mixed = seen
    assert {r.doc_id for r in good.collect()} == {r[0] for r in corpus()} - {300, 301, 302}
    assert {r.doc_id for r in unique.collect()} == set(range(60)) | {400}
    texts = {r.doc_id: r for r in clean.collect()}
    assert KEY not in texts[400].text and "[SECRET]" in texts[400].text and texts[400].n_chars == len(texts[400].text)
    assert all(texts[r.doc_id].text == r.text for r in unique.collect() if r.doc_id != 400)
    want = Counter({r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.taken(clean).collect()})
    assert Counter(r.doc_id for r in mixed.collect()) == +want and max(want.values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r.doc_id for r in out) == +want
    assert all(r.round_trip and r.n_tokens == len(r.ids) and list(r.ids) == library.encode(texts[r.doc_id].text) for r in out)


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 90), words(rnd, 90)
    docs = spark.createDataFrame([(1, a, "x", "k", "copy"), (1, a, "x", "k", "copy"), (None, b, None, "k", "copy"), (None, b, None, "k", "copy")], "doc_id long, text string, source string, key string, root string")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    assert {r.doc_id for r in now.collect()} == {1, None}
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").filter(~F.col("round_trip")).count() == 0


def internal_names():
    """Every name that operators give to columns of their own."""
    folder = os.path.dirname(mixing.__file__)
    names = set()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".py"):
            with open(os.path.join(folder, name)) as f:
                text = f.read()
            names |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed)\(\s*"(\w+)"', text))
            names |= set(re.findall(r'\("(\w+)", F\.', text))
            names |= set(re.findall(r'"(\w+)"', text)) & set(re.findall(r"\b(\w+)=F\.", text))
            names |= set(re.findall(r"packed\(docs, (.*)\)", text) and re.findall(r"\b(\w+)=", " ".join(re.findall(r"packed\(docs, (.*)\)", text))))
    return sorted({n.lower() for n in names} - {"doc_id", "text", "lang", "source", "n_chars"})


def test_clashing_names(spark):
    names = internal_names()
    assert len(names) > 60 and {"row", "ident", "host", "text_key", "gaps", "found", "slot", "n"} <= set(names)
    rows = [r for r in corpus() if r[0] < 20 or r[0] >= 100]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, schema)
    wide = spark.createDataFrame([(*r, *([f"{r[0]}"] * len(names))) for r in rows], schema + ", " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, plain, ""), stage(spark, wide, "")
        assert b.columns == wide.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(plain.columns).collect())), name
        assert all(all(v == (None if r.doc_id is None else str(r.doc_id)) for v in r[5:]) for r in b.collect()), name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(str, last(spark, plain, "").collect())) == sorted(map(str, last(spark, wide, "").collect()))


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = words(rnd, 60_000)
    rows = [(1, long, "a"), (2, long + " more", "b"), (3, words(rnd, 90), "a"), (4, "x" * 400_000 + " " + words(rnd, 80), "b"), (5, "\n".join(words(rnd, 3) for _ in range(20_000)), "c")]
    now = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES[:-2]:
        now = stage(spark, now, "").cache()
    texts = {r.doc_id: r.text for r in now.collect()}
    assert set(texts) == {1, 3, 4, 5} and all(texts[d] == t for d, t, _ in rows if d in texts)
    now = corpus_pipeline.STAGES[-2][1](spark, now, "").cache()
    assert {r.doc_id for r in now.collect()} and all(texts[r.doc_id] == r.text for r in now.collect())
    assert all(r.round_trip for r in corpus_pipeline.STAGES[-1][1](spark, now, "").collect())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
