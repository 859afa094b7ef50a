"""Quality rules by cross-document line frequency.

Lines are normalised (words joined by one space, A-Z lowered, digits to 0) and hashed. For each host, a line counts
once for each distinct document that holds it; exact copies of one text are one document, so copies don't make their own
lines common. A line is removed if more than LIMIT documents of the host hold it, an absolute number, so a banner goes
from a host of thirty pages as from one of a hundred million. A document is depleted, and rejected, if the removal leaves
less than KEEP of its words; a short document that loses one line stays. The host is the document's source; null is a
host of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, forget, join_spread, packed, raw, small_batches

MIN_WORDS = 50
#: A document fails the base rules if more than this many hundredths of its words stand in repeated windows.
MAX_REPEAT = 50
#: Distinct documents of a host that may hold a line before it is removed.
LIMIT = 10
KEEP = 0.3
#: Removed lines up to this number (16 bytes of key each) are broadcast; beyond it the join shuffles.
BROADCAST_LINES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 inside a code point, 2 white space, 3 symbol
_CLASS[0x80:0xC0] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_MOST = 1 << 20

BASE = "doc_id long, host string, text_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: long, w: long>>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    two = code[:-1] * size + code[1:]
    if size >= _MOST:
        two = np.unique(two, return_inverse=True)[1].astype(np.int64)
    three = two[:-1] * size + code[2:]
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    at = order[np.flatnonzero(np.r_[same, False] | np.r_[False, same])]
    covered = np.zeros(n, dtype=bool)
    for d in range(3):
        covered[at + d] = True
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[tuple[int, ...], dict[int, int]]:
    """The five counts of a text, and for each distinct normalised line its hash and its words in all places."""
    if not text:
        return (0, 0, 0, 0, 0), {}
    words, dups, seen, lines = [], 0, set(), {}
    for line in text.split(b"\n"):
        if own := line.split():
            words += own
            dups += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(b" ".join(own).translate(_FOLD), 42)
            lines[h] = lines.get(h, 0) + len(own)
    kinds = np.zeros(4, dtype=np.int64)
    for at in range(0, len(text), 1 << 22):
        kinds += np.bincount(_CLASS[np.frombuffer(text[at : at + (1 << 22)], np.uint8)], minlength=4)
    return (len(words), int(kinds[0] + kinds[3]), int(kinds[3]), dups, repeated_words(words)), lines


def _host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit("-"))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts of every row of docs, with its host, the digest of its text and its lines (schema BASE)."""
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), _host(F.col(host_col)).alias("host"), _key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            counts, sizes, hs, ws = [], [0], [], []
            for text in raw(batch.column("text")):
                own, lines = measure(text)
                counts.append(own)
                hs.extend(lines)
                ws.extend(lines.values())
                sizes.append(len(hs))
            h = pa.array(np.array(hs, dtype=np.uint64).view(np.int64))
            held = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([h, pa.array(ws, pa.int64())], ["h", "w"]))
            columns = [pa.array(c, pa.int64()) for c in np.array(counts, dtype=np.int64).reshape(-1, 5).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns, held], names=[x.strip().split()[0] for x in BASE.split(", ")[:9]])

    return frame.mapInArrow(rows, BASE)


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def removed_lines(base: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, text_key, n, failed, n_words, removed, drop) for each distinct text of a host: its rows, its base verdict, its
    words, those in lines that go, and the hashes of these lines."""
    texts = base.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.count("*").alias("n"), F.max(_failed()).alias("failed"), F.max("n_words").alias("n_words"))
    texts = cut(texts)
    lines = texts.select("host", "text_key", F.inline("lines"))
    common = cut(lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
    held = lines.join(F.broadcast(common.drop("n")), ["host", "h"]) if common.count() <= BROADCAST_LINES else join_spread(lines, common, ["host", "h"])
    gone = held.groupBy("host", "text_key").agg(F.sum("w").alias("removed"), F.collect_set("h").alias("drop"))
    found = texts.drop("lines").join(gone, ["host", "text_key"], "left")
    return found.withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))


def _depleted() -> Column:
    return F.col("n_words") - F.col("removed") < KEEP * F.col("n_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept) for every row.

    A null or empty text has no words and fails the base rules; whole texts are read, however long. Repeated rows give
    repeated results; a null id stays null. An empty table gives an empty result. Other columns of docs are left out, so
    their names can't clash.
    """
    base = cut(base_rules(docs, id_col, text_col, host_col))
    texts = cut(removed_lines(base, limit).select("host", "text_key", "removed", "n"))
    found = join_spread(base.drop("lines"), texts, ["host", "text_key"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
        F.col("removed").alias("removed_words"), (~_failed() & ~_depleted()).alias("kept"),
    )


def _without(text: Column, drop: Column) -> Column:
    """The text's lines but for those whose hash is in drop."""

    def hashed(line: Column) -> Column:
        words = F.filter(F.split(line, "[ \\x09-\\x0D]+"), lambda w: w != "")
        return F.xxhash64(F.translate(F.array_join(words, " "), _UPPER, _LOWER))

    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(drop, hashed(line))), "\n")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """docs without rejected documents, and with common lines taken out of the texts.

    Null and empty texts are rejected; whole texts are read, however long. Repeated rows are judged alike and all stay or
    go; a null id or host is a value like others. An empty table gives an empty one. The columns stay as they are,
    whatever their names.
    """
    base = cut(base_rules(docs, id_col, text_col, host_col))
    kept = cut(removed_lines(base, limit).filter(~F.col("failed") & ~_depleted()).select("host", "text_key", "drop", "n"))
    found = join_spread(packed(docs, host=_host(F.col(host_col)), text_key=_key(F.col(text_col))), kept, ["host", "text_key"])
    text = F.col("row")[text_col]
    cleaned = F.when(F.col("drop").isNull(), text).otherwise(_without(text, F.col("drop")))
    return found.select(F.col("row").withField(f"`{text_col}`", cleaned).alias("row")).select("row.*")
