"""SentencePiece models on the tokenizers library.

The model file (a protobuf) is read by hand: pieces with scores and kinds, the trainer's kind of model and byte
fallback, the normaliser's settings. From these a tokenizers pipeline is rebuilt: normaliser, metaspace marker, unigram
scores or BPE merges (in the order of the merged pieces' scores), byte fallback, decoder.

Texts are encoded in batches, multithreaded, by that pipeline, and every result is held against the sentencepiece library
(`verify`). Where they differ the latter's ids are taken, and the text is reported: parity is a column of the results.
Where no piece of a BPE model holds a marker behind another character, no merge crosses from a character to a marker after
it, so a text can be cut there; each distinct part is then encoded, verified, and decoded by the pipeline's decoder, once: a
text whose parts all come back comes back. All other models, and texts that hold NUL, go through the pipeline whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import THREADS, Memory, kept, small_batches, stretches

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Bytes of parts of texts and their ids that a worker remembers before a turnover; longer parts aren't remembered.
REMEMBERED, LONG = 96 << 20, 200


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Spec:
    """What a model file says: pieces (text, score, kind) by id, and the settings that matter here."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.model, self.byte_fallback, self.charsmap = UNIGRAM, False, b""
        self.prefix = self.squeeze = self.escape = True
        self.suffix = False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.model, self.byte_fallback, self.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def rebuild(spec: Spec, normalise: bool = True):
    """A tokenizers pipeline for the model; without its normaliser for text that is normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if spec.suffix or spec.model not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker in front are rebuilt")
    if spec.model == UNIGRAM:
        # Pieces that no text may give keep their ids but can't win.
        scores = [(text, score if kind in (NORMAL, USER) else -1e9) for text, score, kind in spec.pieces]
        model = models.Unigram(scores, spec.unknown, byte_fallback=spec.byte_fallback)
    else:
        ids = {text: i for i, (text, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
        merges = []
        for text, score, kind in spec.pieces:
            if kind in (NORMAL, USER) and len(text) > 1:
                merges += [(-score, ids[text[:i]], ids[text[i:]], text[:i], text[i:]) for i in range(1, len(text)) if text[:i] in ids and text[i:] in ids]
        merges.sort()
        vocab = {text: i for i, (text, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, [m[3:] for m in merges], unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    made = Tokenizer(model)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if normalise and steps:
        made.normalizer = normalizers.Sequence(steps)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.prefix else [])])
    return made


class Codec:
    """Encode and decode whole texts."""

    def __init__(self, path: str, verify: bool = True):
        import sentencepiece

        self.spec = spec = Spec(path)
        self.full, self.bare = rebuild(spec), rebuild(spec, normalise=False)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None
        inner = any(MARK in text.lstrip(MARK) for text, _, kind in spec.pieces if kind in (NORMAL, USER))
        self.apart = not (spec.charsmap or spec.squeeze or inner) and spec.prefix and spec.escape and spec.model == BPE
        # A newline that no piece holds stands alone, too.
        self.lines = not any("\n" in text for text, _, kind in spec.pieces if kind in (NORMAL, USER)) and spec.byte_fallback
        self.newline = np.array([i for i, p in enumerate(spec.pieces) if p[0] == "<0x0A>" and p[2] == BYTE], dtype="<u4").tobytes()
        self.words, self.older = Memory(), Memory()  # older: those before the last turnover
        self.odd: set[str] = set()  # parts whose ids differ
        self.torn: set[str] = set()  # parts that don't come back
        self.plain = {i for i, (_, _, k) in enumerate(spec.pieces) if k not in (UNKNOWN, CONTROL, UNUSED)}
        self.bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else t.replace(MARK, " ").encode() for t, _, k in spec.pieces]

    def _learn(self, new: set[str]) -> None:
        """Afterwards self.words holds all of new, parts that it didn't hold."""
        known = [p for p in new if p in self.older]
        self.words.add(known, [self.older[p] for p in known])
        if not (asked := list(new.difference(known) if known else new)):
            return
        found = [x.ids for x in self.bare.encode_batch(asked, add_special_tokens=False)]
        if self.reference:
            # The library puts a marker in front; a part without one is asked for behind a newline, and both cut off.
            texts = ["\n" if p == MARK else p[1:].replace(MARK, " ") if p[0] == MARK else "\n" + p for p in asked]
            for i, (p, ids) in enumerate(zip(asked, self.reference.encode(texts, num_threads=THREADS), strict=True)):
                own = ids[:1] if p == MARK else ids if p[0] == MARK else ids[2:]
                if own != found[i]:
                    self.odd.add(p)
                    found[i] = own
        back = self.full.decode_batch(found, skip_special_tokens=False)
        # The decoder takes one blank, the first marker's, from the front.
        self.torn.update(p for p, b in zip(asked, back, strict=True) if b != (p[1:] if p[0] == MARK else p).replace(MARK, " "))
        held = [np.array(x, dtype="<u4").tobytes() for x in found]
        self.words.long = {p: x for p, x in zip(asked, held, strict=True) if len(p) > LONG}
        if self.words.long:
            asked, held = [p for p in asked if len(p) <= LONG], [x for p, x in zip(asked, held, strict=True) if len(p) <= LONG]
        self.words.add(asked, held)

    @staticmethod
    def _parts(text: str) -> list[list[str]]:
        """For each line, its parts: cut before each marker that follows another character."""
        out = []
        for line in (MARK + text.replace(" ", MARK)).split("\n"):
            if MARK + MARK in line or line.endswith(MARK):
                out.append(re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line))
            else:
                head, *rest = line.split(MARK)
                out.append([*([head] if head else []), *[MARK + p for p in rest]])
        return out

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Ids, parity and round trip of texts that go through the pipeline whole."""
        found = [x.ids for x in self.full.encode_batch(texts, add_special_tokens=False)] if texts else []
        wanted = self.reference.encode(texts, num_threads=THREADS) if self.reference and texts else found
        held = [np.array(w, dtype="<u4").tobytes() for w in wanted]
        return [(h, f == w, d == t) for h, f, w, d, t in zip(held, found, wanted, self.decode_all(held), texts, strict=True)]

    def checked_all(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """For each text its ids as little-endian 32-bit integers, without special tokens, whether both libraries agree, and
        whether decoding gives the text again."""
        out: list[tuple[bytes, bool, bool]] = []
        for some in stretches(texts):
            cut = [self._parts(t) if t and self.apart and self.lines and "\0" not in t else None for t in some]
            whole = iter(self._whole([t for t, lines in zip(some, cut, strict=True) if t and lines is None]))
            self.words.long = {}
            if self.words.size > REMEMBERED:
                self.words, self.older = Memory(), self.words
            parts: set[str] = set()
            unknown = self.words.__contains__
            for lines in cut:
                for line in lines or ():
                    parts.update(filterfalse(unknown, line))
            self._learn(parts)
            held = self.words.__getitem__
            for t, lines in zip(some, cut, strict=True):
                if lines:
                    ids = self.newline.join([b"".join(map(held, line)) for line in lines])
                    parity, back = (not bad or all(bad.isdisjoint(line) for line in lines) for bad in (self.odd, self.torn))
                    out.append((ids, parity, back and MARK not in t))  # a marker in the text comes back as a blank
                else:
                    out.append(next(whole) if t else (b"", True, True))
        return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.checked_all(texts)[0]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, texts: list[bytes]) -> list[str]:
        """Texts of ids by the pipeline's decoder; those with unknown or control pieces by the pieces' own texts, as sentencepiece has it."""
        lists = [np.frombuffer(x, "<u4").tolist() for x in texts]
        plain = [self.plain.issuperset(x) for x in lists]
        found = iter(self.full.decode_batch([x for x, p in zip(lists, plain, strict=True) if p], skip_special_tokens=False))
        return [next(found) if p else self._spelled(x) for x, p in zip(lists, plain, strict=True)]

    def _spelled(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        return (data[1:] if self.spec.prefix and data[:1] == b" " else data).decode("utf-8", "replace")

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, ids, n_tokens, round_trip, parity) for every row of docs.

    round_trip: decoding the ids gives the text again (for models that change nothing but spaces). parity: the rebuilt
    pipeline gives the sentencepiece library's ids. Null and empty texts have no ids, and both are true; texts are read
    whole, however long. Repeated rows give repeated results, an empty table an empty one; columns that aren't listed in
    keep are left out, so their names can't clash. A column of keep named like one of the results is left out.
    """
    small_batches(docs.sparkSession)
    made = ("doc_id", "ids", "n_tokens", "round_trip", "parity")
    names = [k for k in keep if k not in made]
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(f"`{k}`") for k in names), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]) + ", ids array<int>, n_tokens long, round_trip boolean, parity boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = [t or "" for t in part.columns[-1].to_pylist()]
                ids, parity, same = own.checked_all(texts)
                sizes = [len(x) // 4 for x in ids]
                held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], held, pa.array(sizes, pa.int64()), pa.array(same), pa.array(parity)], names=[*part.schema.names[:-1], *made[1:]])

    return frame.mapInArrow(rows, schema)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity): as encode, with the CRC-32 of the ids as little-endian integers."""
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, parity, same = own.checked_all(texts)
            n, crc = [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])

    return frame.mapInArrow(rows, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
