from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import tokenfile
from gridloom.llm.common import Memory, folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = tokenfile.Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
AS_TEXT = Tokenizer.from_file(PATH)
AS_TEXT.encode_special_tokens = True


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\u00a0\u3000\x1c\x85'sab1é.<|>")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_agrees_with_the_library(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|> <|endof", "<|endoftext| >"])
def test_special_tokens(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenfile.Encoder(PATH, special=False).ids(text), "<u4").tolist() == AS_TEXT.encode(text, add_special_tokens=False).ids


def test_tokenizer_of_another_make():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Words, and  More\nof them", "", "é 12 <|endoftext|>", "word " * 300]
    assert not encoder.apart
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_are_not_remembered():
    encoder = tokenfile.Encoder(PATH)
    texts = ["x" * 5000 + " " + "ab" * 4000 + "\n" + "y" * 300, "a b c " + "é" * 1000 + ",", "z" * 201 + "."]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids_all(texts)] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert all(len(p) <= tokenfile.LONG for kind in encoder.seen for p in kind)


def test_many_words_at_once():
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choice("abcdeé日'1.,-") for _ in range(rnd.randint(1, 9))) for _ in range(3000)) for _ in range(3)]
    texts += ["\n".join(t.split(" ")) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.Encoder(PATH).ids_all(texts)] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 500)
    encoder = tokenfile.Encoder(PATH)
    text = " ".join(f"w{i % 13} x{i}" for i in range(200)) + "\nend <|endoftext|>"
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [2, 4])
def test_shards(width):
    rnd = random.Random(1)
    docs = [(i if i % 7 else None, np.array([rnd.randrange(50000) for _ in range(rnd.choice([0, 1, 90, 4000]))], "<u4").tobytes()) for i in range(60)]
    shards = [s + tokenfile.SEEK_MAGIC for s in tokenfile.pack(docs, width, 20_000)]
    assert len(shards) > 2
    held = [tokenfile.Shard(s) for s in shards]
    assert [d for s in held for d in s.docs] == [d for d, _ in docs]
    assert [s.ids(i).tobytes() for s in held for i in range(len(s.docs))] == [b for _, b in docs]
    assert held[0].of(3)[0].tobytes() == docs[3][1]
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(s, read_across_frames=True).read() for s in shards)
    assert len(plain) == sum(len(b) for _, b in docs) * width // 4
    bad = bytearray(shards[0])
    bad[int(held[0].starts[2]) + int(held[0].table["packed"][2]) - 3] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Shard(bytes(bad)).ids(2)


def test_round_trip(spark):
    rows = [(i * 3 % 101, f"text {i}\nline  two {'é' * i}", 5) for i in range(101)] + [(None, "first", 1), (200, None, 1), (201, "", 1), (7, "again", 1), (300, "long " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = tokenfile.new_path(spark)
    assert path.startswith(folder(spark))
    tokenfile.write(docs, PATH, path, end_id=0, shard=2000)
    got = sorted(tokenfile.positions(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    want = sorted((d if d is not None else -1, [*PLAIN.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    assert [(r.doc_id if r.doc_id is not None else -1) for r in got] == [d for d, _ in want]
    key = lambda d, n, c: (d, n, c)
    assert sorted(key(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_places_in_file_names(spark):
    names = ["x/part-00003-d8ef7c38-c367-41c6-c012-fffd9a8970f7-c012.txt", "x/part-00000-c0000000-c111-c222-c333-c44444444444-c000.txt.gz", "part-00012-1-c007"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [tuple(r) for r in df.select(tokenfile._place(df.path, 1), tokenfile._place(df.path, 2)).collect()]
    assert got == [(3, 12), (0, 0), (12, 7)]


def test_empty(spark):
    path = tokenfile.new_path(spark)
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert tokenfile.positions(spark, path).collect() == []


def test_known_words_are_looked_up_once():
    """A text costs one look a word, and none through all that is remembered."""
    asked = []

    class Watched(Memory):
        def get(self, piece, default=None):
            asked.append(piece)
            return super().get(piece, default)

        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

        def __iter__(self):
            raise AssertionError("went through the memory")

    encoder = tokenfile.Encoder(PATH)
    encoder.seen = [Watched(), Watched()]
    text = "one word or two words\nor three words"
    want = encoder.ids(text)
    assert np.frombuffer(want, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    asked.clear()
    assert encoder.ids(text) == want
    assert sorted(asked) == sorted(text.replace("\n", " ").split(" "))


def test_many_texts_look_up_distinct_words():
    """Where there are many words, each distinct one is looked up, not each occurrence."""
    rnd = random.Random(5)
    words = [*("".join(rnd.choice("abcé日'1.,-") for _ in range(rnd.randint(1, 9))) for _ in range(300)), "x" * 300 + ",", "z​", "a\x00b"]
    texts = ["".join(rnd.choice(words) + rnd.choice("   \n") for _ in range(2000)) + "end" for _ in range(8)]
    texts += ["", "a  b\t c", "x" * 300 + " y", "\n" + texts[0], "a <|endoftext|> b", " lead and trail ", "y " * 20 + "é"]
    asked = []

    class Watched(Memory):
        def get(self, piece, default=None):
            asked.append(piece)
            return super().get(piece, default)

    encoder = tokenfile.Encoder(PATH)
    encoder.seen = [Watched(), Watched()]
    want = [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        asked.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids_all(texts)] == want
    assert len(asked) < 4000  # of over 16,000 words
    assert [np.frombuffer(encoder.ids(t), "<u4").tolist() for t in texts] == want
