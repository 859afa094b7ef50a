from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import sentencepiece

from gridloom.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = spm.Codec(PATH)
ODD = ["", "a", " a", "a ", "  a  b ", "\n", "a\nb", "a\n b", "a \nb", " \n ", "\n\n", " ", "é日本語\U0001f600", "<s> </s> <unk> <0x0A>", "a\tb\r\n", "x" * 3000, "aaaa " * 50, "▁", "▁a ▁b"]


def test_parity_and_round_trip():
    rnd = random.Random(0)
    texts = ODD + ["".join(rnd.choice(" \n▁ab<é.日the") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    got = CODEC.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == LIBRARY.encode(texts)
    assert CODEC.decode_all(got) == [t.replace("▁", " ") for t in texts]
    _, parity, back = CODEC.checked_all(texts)
    assert not CODEC.odd and all(parity) and back == [x == t for x, t in zip(CODEC.decode_all(got), texts, strict=True)]
    # Both ways of decoding agree, and both with the library, control and unknown pieces included.
    some = [[rnd.randrange(32000) for _ in range(rnd.randint(1, 30))] for _ in range(300)]
    assert [CODEC._spelled(x) for x in some] == LIBRARY.decode(some)
    assert CODEC.decode_all([np.array(x, "<u4").tobytes() for x in some]) == LIBRARY.decode(some)


def test_differences_are_reported():
    own = spm.Codec(PATH)
    good = own.bare

    class Wrong:
        def encode_batch(self, texts, **options):
            found = good.encode_batch(texts, **options)
            return [type("E", (), {"ids": x.ids + [9] if t == "▁two" else x.ids}) for t, x in zip(texts, found, strict=True)]

    own.bare = Wrong()
    ids, parity, _ = own.checked_all(["one two three", "one three"])
    assert parity == [False, True] and np.frombuffer(ids[0], "<u4").tolist() == LIBRARY.encode("one two three")


def test_long_parts_are_not_remembered():
    texts = ["x" * 3000 + " " + "é" * 500, "a " * 300 + "y" * 250]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode_all(texts)] == LIBRARY.encode(texts)
    assert all(len(p) <= spm.LONG for p in CODEC.words)


def test_rebuilt_pipeline_alone():
    texts = [t for t in ODD if "▁" not in t]
    assert [CODEC.full.encode(t, add_special_tokens=False).ids for t in texts] == [x if t else [] for t, x in zip(texts, LIBRARY.encode(texts), strict=True)]
    ids = CODEC.full.encode("Some plain words", add_special_tokens=False).ids
    assert CODEC.full.decode(ids) == "Some plain words"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -6.0, 1), ("▁a", -3.5, 1), ("the", -5.0, 1), ("t", -7.0, 1), ("h", -7.5, 1), ("e", -7.25, 1)]
    data = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    library, spec = sentencepiece.SentencePieceProcessor(model_file=str(path)), spm.Spec(str(path))
    assert spec.model == spm.UNIGRAM and spec.byte_fallback and spec.squeeze
    made = spm.rebuild(spec)
    for text in ["the ab", "a  b the", "tha", " abab ", "z the", "é"]:
        assert made.encode(text, add_special_tokens=False).ids == library.encode(text), text
    own = spm.Codec(str(path))
    assert not own.apart
    rnd = random.Random(4)
    texts = ["", "the ab", " ", "\0a", *("".join(rnd.choice("the ab  é") for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    ids, parity, back = own.checked_all(texts)
    assert back == [x == t for x, t in zip(own.decode_all(ids), texts, strict=True)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == library.encode(texts)
    assert sum(parity) >= 0.99 * len(texts)
    assert own.decode_all(ids) == library.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


def test_frames(spark):
    rows = [(1, "one two\nthree", "x"), (2, None, None), (3, "", "y"), (None, "é" * 40000, "z"), (1, "one two\nthree", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {tuple(r) for r in spm.digests(docs, PATH).collect()}
    assert len(got) == 4 and all(r[3] and r[4] for r in got)
    full = spm.encode(docs.withColumnRenamed("ids", "source"), PATH, keep=("source",)).collect()
    want = {(d, s): LIBRARY.encode(t or "") for d, t, s in rows}
    assert len(full) == 5 and all(want[r.doc_id, r.source] == r.ids and r.n_tokens == len(r.ids) for r in full)
    assert spm.digests(docs.limit(0), PATH).collect() == []
