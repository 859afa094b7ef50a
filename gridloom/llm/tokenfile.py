"""Token-ID output: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard holds one zstandard frame for each document (its ids as little-endian unsigned integers), a skippable frame
with the directory (ids of the documents and their token counts), and the seek table of the public zstandard seekable
format: another skippable frame with, for each frame before it, compressed size, decompressed size and the low 32 bits
of the XXH64 of its content, and a footer that ends with the format's magic number. A reader finds the table from the
end of the file and decompresses only the frames of the documents it wants; any zstandard tool can decompress a shard.

Spark's text writer writes the shards, one row to a file, with the magic number as line separator, so that they are
committed like any table, on any store that Spark can write, and a lost executor leaves no torn file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress, count, filterfalse, islice, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import Memory, cut, folder, kept, small_batches, stretches

SEEK_MAGIC = b"\xb1\xea\x92\x8f"  # 0x8F92EAB1
SEEK_FRAME, DIRECTORY_FRAME = 0x184D2A5E, 0x184D2A50
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: Compressed bytes of a shard, about; a longer document makes a longer shard.
SHARD = 16 << 20
LEVEL = 3
#: Bytes of pieces and their ids that a worker remembers before a turnover, for each of two kinds.
REMEMBERED = 96 << 20
#: Pieces of more characters aren't remembered; pieces encoded as one text.
LONG, TOGETHER = 200, 500
#: Characters of texts at hand from which their words are numbered by Arrow first; characters taken together at most, about.
BULK, STRETCH = 20_000, 8_000_000


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, as its own encode gives them for whole texts.

    The usual splitting of a byte-level tokenizer never joins a character with white space that follows it, so a text can
    be cut before each single space or newline between words and its pieces encoded alone; the library sees each distinct
    piece once. Texts with other white space are cut only before spaces that follow a character that isn't white space. A
    tokenizer file of another make (a normaliser, another splitting), and texts that hold the string of an added token,
    go to the library whole. special: strings of special tokens in a text stand for them, as the library takes them;
    else they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        model = made["model"]
        self.apart = (
            model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and (made.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
        )
        self.seen, self.older = [Memory(), Memory()], [Memory(), Memory()]  # older: those before the last turnover
        if self.apart:
            # Each character of a byte-level token stands for a byte.
            self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.width[i] = len(token)
            self.newline = self._encode(["\n"])[0]
            self.marks = dict(zip(",.", self._encode([",", "."]), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, kind: int, words: list[str]) -> list[bytes]:
        """As _encode, for pieces without white space: some hundreds of them go as one text, whose ids are cut by their bytes."""
        gap = " " if kind else "\n"
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        joined = [gap * kind + gap.join(p) for p in parts]
        out: list[bytes] = []
        for part, text, found in zip(parts, joined, self.tokenizer.encode_batch(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            reached = np.cumsum(self.width[ids])
            data = np.frombuffer(text.encode(), np.uint8)
            ends = np.r_[np.flatnonzero(data == ord(gap))[kind:], len(data)]
            if len(ends) != len(part):  # a piece begins with blanks
                ends = np.cumsum([len(w.encode()) + 1 for w in part]) - (0 if kind else 1)
            last = np.searchsorted(reached, ends)
            if last[-1] >= len(ids) or not np.array_equal(reached[last], ends):
                out += self._encode([" " * kind + w for w in part])
                continue
            first = np.r_[0, last[:-1] + (1 if kind else 2)]
            data = ids.tobytes()
            out += [data[4 * a : 4 * b + 4] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return out

    def _turn(self) -> None:
        """A memory that is full becomes the older one."""
        for kind in (0, 1):
            self.seen[kind].long = {}
            if self.seen[kind].size > REMEMBERED:
                self.seen[kind], self.older[kind] = Memory(), self.seen[kind]

    def _learn(self, kind: int, new: set[str]) -> None:
        """Afterwards seen[kind] holds all of new, pieces that it didn't hold; kind 0 at a line's start, 1 behind a space."""
        seen, older = self.seen[kind], self.older[kind]
        known = [p for p in new if p in older]
        seen.add(known, [older[p] for p in known])
        asked = new.difference(known) if known else new
        # A full stop or comma behind a letter is a token of its own: the word is asked for without it.
        ends = [p for p in asked if p[-1:] in self.marks and 1 < len(p) <= LONG and p[-2] < "\u0250" and p[-2].isalpha()]
        asked = asked.difference(ends)
        asked.update(filterfalse(seen.__contains__, [p[:-1] for p in ends]))
        odd = [p for p in asked if len(p) > LONG or not p or not p.isprintable()]
        words = list(asked.difference(odd) if odd else asked)
        seen.add(words, self._words(kind, words))
        if odd:
            ids = dict(zip(odd, self._encode([" " * kind + p for p in odd]), strict=True))
            seen.long = {p: x for p, x in ids.items() if len(p) > LONG}
            short = [p for p in odd if len(p) <= LONG]
            seen.add(short, [ids[p] for p in short])
        seen.add(ends, [seen[p[:-1]] + self.marks[p[-1]] for p in ends])

    @staticmethod
    def _single(text: str) -> bool:
        """Whether the text's white space is blanks and newlines that stand single between words."""
        # Printable texts have no white space but blanks.
        if "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and text[0] not in " \n" and text[-1] not in " \n" and all(map(str.isprintable, text.split("\n"))):
            return True
        return " ".join(text.split()) == text.replace("\n", " ")

    @classmethod
    def _lines(cls, text: str) -> list[list[str]]:
        return [line.split(" ") for line in text.split("\n")] if cls._single(text) else [re.split(r"(?<=\S) ", text)]

    def _bulk(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts of single white space: Arrow numbers their words, and each distinct one is looked up once."""
        data = [b"\n" + t.encode() for t in texts]
        begins = np.cumsum([0, *map(len, data)])
        held = np.frombuffer(b"".join(data), np.uint8)
        # A word with the blank or newline before it, so that words touch and that byte tells the kind.
        cuts = np.flatnonzero((held == 32) | (held == 10))
        words = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(np.r_[cuts, len(held)]), pa.py_buffer(held)]).dictionary_encode()
        _, ends, content = words.dictionary.buffers()
        gaps = np.frombuffer(content, np.uint8)[np.frombuffer(ends, np.int64)[: len(words.dictionary)]]
        spelled = pc.utf8_slice_codeunits(words.dictionary, 1).to_numpy(zero_copy_only=False)
        ids = np.empty(len(spelled), dtype=object)
        for kind, gap in enumerate(b"\n "):
            places = np.flatnonzero(gaps == gap)
            pieces = spelled[places].tolist()
            found = list(map(self.seen[kind].get, pieces))
            new = list(compress(count(), map(not_, found)))
            self._learn(kind, set(map(pieces.__getitem__, new)))
            for i in new:
                found[i] = self.seen[kind][pieces[i]]
            ids[places] = found if kind else [self.newline + x for x in found]
        made = pa.array(ids, pa.large_binary()).take(words.indices)
        _, ends, content = made.buffers()
        at = np.frombuffer(ends, np.int64)[np.searchsorted(cuts, begins)].tolist()
        view, skip = memoryview(content), len(self.newline)  # no newline stands before a text
        return [view[a + skip : b].tobytes() for a, b in pairwise(at)]

    def ids_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for some in stretches(texts, STRETCH):
            whole = [not self.apart or any(a in t for a in self.added) for t in some]
            asked = [t for t, w in zip(some, whole, strict=True) if w]
            plain = iter(self._encode(asked) if asked else ())
            self._turn()
            single = [bool(t) and not w and self._single(t) for t, w in zip(some, whole, strict=True)]
            if sum(map(len, compress(some, single))) < BULK:
                single = [False] * len(some)
            bulk = iter(self._bulk(list(compress(some, single))) if any(single) else ())
            cut = [self._lines(t) if t and not w and not s else [] for t, w, s in zip(some, whole, single, strict=True)]
            starts, parts, held = set(), set(), []
            known = self.seen[1].get
            for lines in cut:
                for line in lines:
                    starts.add(line[0])
                    # One look at each word: its ids, or None where they have to be asked for.
                    found = list(map(known, islice(line, 1, None)))
                    new = list(compress(count(1), map(not_, found)))
                    parts.update(map(line.__getitem__, new))
                    held.append((found, new))
            self._learn(0, set(filterfalse(self.seen[0].__contains__, starts)))  # difference() would go through the memory
            self._learn(1, parts)
            first, rest, looked = self.seen[0], self.seen[1], iter(held)

            def line_ids(line: list[str]) -> bytes:
                found, new = next(looked)
                for i in new:
                    found[i - 1] = rest[line[i]]
                return first[line[0]] + b"".join(found)

            out += [next(plain) if w else next(bulk) if s else self.newline.join(map(line_ids, lines)) if lines else b"" for lines, w, s in zip(cut, whole, single, strict=True)]
        return out

    def ids(self, text: str) -> bytes:
        return self.ids_all([text])[0]


@kept
def encoder_of(path: str, special: bool = True) -> Encoder:
    """One for each Python worker: what it remembers serves all its tasks."""
    return Encoder(path, special)


def pack(frames: Iterable[tuple[int | None, bytes]], width: int = 4, limit: int = SHARD) -> Iterator[bytes]:
    """Shards, without the final magic number, of (doc_id, ids as 32-bit integers)."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    held: list[bytes] = []
    entries: list[tuple[int, int, int]] = []
    docs: list[int | None] = []
    bulk = 0

    def shard() -> bytes:
        known = np.array([d is not None for d in docs], dtype=np.uint8)
        body = struct.pack("<BQ", width, len(docs)) + known.tobytes() + np.array([d or 0 for d in docs], dtype="<i8").tobytes()
        directory = struct.pack("<II", DIRECTORY_FRAME, len(body)) + body
        table = np.array([*entries, (len(directory), 0, 0)], dtype=ENTRY)
        seek = table.tobytes() + struct.pack("<IB", len(table), CHECKSUMS)
        return b"".join([*held, directory, struct.pack("<II", SEEK_FRAME, len(seek) + 4), seek])

    for doc, ids in frames:
        data = ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
        held.append(press.compress(data))
        entries.append((len(held[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        docs.append(doc)
        bulk += len(held[-1])
        if bulk >= limit:
            yield shard()
            held, entries, docs, bulk = [], [], [], 0
    if held:
        yield shard()


class Shard:
    """Random access to a shard: only the frames of the documents asked for are decompressed."""

    def __init__(self, content: bytes):
        if content[-4:] != SEEK_MAGIC or content[-5] != CHECKSUMS:
            raise ValueError("not a shard: its seek table is missing")
        (n,) = struct.unpack_from("<I", content, len(content) - 9)
        at = len(content) - 9 - n * ENTRY.itemsize
        if struct.unpack_from("<II", content, at - 8) != (SEEK_FRAME, n * ENTRY.itemsize + 9):
            raise ValueError("damaged seek table")
        self.content, self.table = content, np.frombuffer(content, ENTRY, n, at)
        self.starts = np.r_[0, np.cumsum(self.table["packed"], dtype=np.int64)]
        at = int(self.starts[-2]) + 8
        self.width, count = struct.unpack_from("<BQ", content, at)
        known = np.frombuffer(content, np.uint8, count, at + 9)
        ids = np.frombuffer(content, "<i8", count, at + 9 + count)
        self.docs = [int(d) if k else None for k, d in zip(known, ids, strict=True)]
        self.counts = self.table["size"][:-1].astype(np.int64) // self.width
        self._press = zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document as unsigned 32-bit integers."""
        data = self._press.decompress(self.content[self.starts[i] : self.starts[i + 1]], max_output_size=int(self.table["size"][i])) if self.table["size"][i] else b""
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table["check"][i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def of(self, doc: int | None) -> list[np.ndarray]:
        return [self.ids(i) for i, d in enumerate(self.docs) if d == doc]


def _write(shards: DataFrame, path: str) -> None:
    text = shards.select(F.col("shard").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", SEEK_MAGIC.decode("latin-1")).text(path)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, special: bool = True) -> None:
    """Encode every whole text with a tokenizers file, append end_id and write shards in ascending order of doc_id.

    Null ids come first, rows with one id in the order of their texts' hashes; a null text is an empty one and gives
    end_id alone; texts are read whole, however long. special: see Encoder. Other columns of docs are left out, so their
    names can't clash. An empty table writes no shard.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = frame.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, special)
        width = 2 if max(end_id + 1, encoder.tokenizer.get_vocab_size()) <= 1 << 16 else 4
        end = struct.pack("<I", end_id)

        def frames() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    yield doc, ids + end

        for content in pack(frames(), width, shard):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["shard"])

    _write(dealt.mapInArrow(rows, "shard binary"), path)


def _place(path: Column, group: int) -> Column:
    """Task (1) and file (2) number in a written file's name; the job's id between them may hold -c and digits, too."""
    return F.regexp_extract(path, r"part-(\d+)-[^/]*-c(\d+)(?:\.[^/]*)?$", group).cast("long")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, index, doc_id, first, n_tokens, ids_crc32) of every document in the shards below path.

    first counts the ids of the documents before it in the same shard; every frame's checksum is verified.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 4").select(_place(F.col("path"), 1).alias("part"), _place(F.col("path"), 2).alias("file"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                held = Shard(content.as_py())
                n = len(held.docs)
                crc = [zlib.crc32(held.ids(i).tobytes()) for i in range(n)]
                columns = [np.full(n, part.as_py()), np.full(n, file.as_py()), np.arange(n), held.docs, np.cumsum(held.counts) - held.counts, held.counts, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "file", "index", "doc_id", "first", "n_tokens", "ids_crc32"])

    return files.mapInArrow(rows, "part long, file long, index long, doc_id long, first long, n_tokens long, ids_crc32 long")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts all ids before it.

    Shards are numbered by (part, file); their running sum is over shards, not documents.
    """
    found = cut(scan(spark, path))
    shards = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("p"))
    parts = parts.select("part", (F.sum("p").over(W.orderBy("part")) - F.col("p")).alias("below"))
    shards = shards.join(parts, "part").select("part", "file", (F.col("below") + F.sum("n").over(W.partitionBy("part").orderBy("file")) - F.col("n")).alias("base"))
    return found.join(shards, ["part", "file"]).select("doc_id", (F.col("base") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
