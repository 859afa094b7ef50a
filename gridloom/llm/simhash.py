"""SimHash near-duplicates through a Gray-order hierarchical index.

Texts become 64-bit fingerprints. Equal fingerprints are one vertex. Vertices are sorted by Gray rank, four times: each
time another quarter of the bits leads. A table sorted so is cut into ranges, one for each partition, and each partition
puts its codes under a tree of shared bit patterns (grayindex): a fingerprint descends the tree and drops whole groups
once the accumulated differences pass the radius. A partition gives only as many links as its classes need, not all
pairs. The classes are joined by stars (graph).

Why four orders. Two fingerprints that differ in at most 3 of their bits agree on at least one of 4 equal segments, so in
one of the orders both lie in the run of codes with that leading segment, a block. Ranges are cut between blocks, and a
group of other blocks counts as too far, so no group has to be sent to all the ranges that 3 flipped leading bits reach.
A block of more than BLOCK fingerprints is dealt again by 4 segments of the bits that are left, which loses no pair, and
so on; once 16 bits are left a block can't hold more than 65,536 codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_key, cut, join_spread, raw, small_batches
from gridloom.llm.graph import components
from gridloom.llm.grayindex import GrayIndex, gray_rank, merge

SEED = 42
#: Fingerprints in a block before it is dealt again, and bits left from which on it isn't.
BLOCK, LAST_BITS = 20_000, 16
#: Codes under one tree at least, where a partition has as many.
TREE = 1 << 16

#: For each byte, its bits in 8 byte lanes, first bit first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingles(text: bytes | None, words: int) -> list[bytes]:
    """Runs of words in the text with A-Z lowered, repeats included; the whole sequence if it is shorter."""
    if not text:
        return []
    seq = text.lower().split()
    if len(seq) < words:
        return [b" ".join(seq)] if seq else []
    return list(map(b" ".join, zip(*(seq[i:] for i in range(words)), strict=False)))


def hashes(parts: list[bytes]) -> np.ndarray:
    """XXH64 of each part as big-endian bytes, one row of 8 for each."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(x, SEED) for x in parts]), dtype=np.uint8).reshape(-1, 8)


def fingerprint(hashed: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half the rows."""
    n = len(hashed)
    if not n:
        return 0
    lanes = _LANES[hashed]
    if n > 255:
        sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
        counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    else:
        counts = lanes.sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs; a null text or one without a word has fingerprint zero."""
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(hashes(shingles(t, words))) for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return frame.mapInArrow(rows, "doc_id long, fp long")


def _rank(bits: Column, width: int) -> Column:
    """Gray rank of a number of so many bits."""
    step = 1
    while step < width:
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
        step *= 2
    return bits


def _deal(rows: DataFrame, width: int) -> DataFrame:
    """Deal (key, rest, fp) to the blocks of 4 equal segments of the `width` bits in rest.

    The first keys number the blocks of each order by the Gray rank of the leading segment; later ones are hashes.
    """
    size = width // 4

    def block(j: int) -> Column:
        segment = F.shiftrightunsigned("rest", j * size).bitwiseAND(F.lit((1 << size) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << (j * size)) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", (j + 1) * size), j * size) if j < 3 or width % 4 else F.lit(0).cast("long")
        key = F.lit(j << size).cast("long") + _rank(segment, size) if width == 64 else F.xxhash64("key", F.lit(j), segment)
        return F.struct(key.alias("key"), low.bitwiseOR(high).alias("rest"))

    return rows.select("fp", F.inline(F.array(*(block(j) for j in range(4)))))


def blocks(vertices: DataFrame) -> DataFrame:
    """(key, fp): the blocks in which fingerprints within 3 bits of each other meet."""
    rows, parts, width = vertices.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key")), [], 64
    while True:
        rows, width = _deal(rows, width), width - width // 4
        if width <= LAST_BITS:
            parts.append(rows)
            break
        hot = cut(rows.groupBy("key").count().filter(F.col("count") > BLOCK).select("key"))
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti"))
        rows = cut(rows.join(hot, "key", "left_semi"))
    out = parts[0].select("key", "fp")
    for more in parts[1:]:
        out = out.unionByName(more.select("key", "fp"))
    return out


def tree_of(table: pa.Table) -> GrayIndex:
    """The index over all blocks of a table (key, fp)."""
    keys = table.column("key").to_numpy()
    codes = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    return GrayIndex(codes, np.cumsum(np.r_[False, keys[1:] != keys[:-1]]))


def _link(tree: GrayIndex, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each class of each block to its smallest member."""
    label = np.arange(len(tree.codes))
    for i, j in tree.pairs(radius):
        merge(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return tree.codes[moved].view(np.int64), tree.codes[label[moved]].view(np.int64)


def _dealt(vertices: DataFrame, radius: int) -> DataFrame:
    if not 0 <= radius <= 3:
        raise ValueError("the blocks hold for at most 3 differing bits")
    small_batches(vertices.sparkSession)
    return blocks(vertices).repartitionByRange("key").sortWithinPartitions("key")


def links(vertices: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links whose classes are those of all pairs of fingerprints within radius (at most 3) bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "key", TREE):
            u, v = _link(tree_of(table), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _dealt(vertices, radius).mapInArrow(rows, "u long, v long")


def report(vertices: DataFrame, radius: int = 3) -> DataFrame:
    """(codes, nodes, met, other, far, near) of each tree that links builds: how many meetings of a fingerprint and a group
    were looked at, how many groups were dropped as other blocks or as too far, and the near pairs found."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "key", TREE):
            tree = tree_of(table)
            near = sum(len(i) for i, _ in tree.pairs(radius))
            found = [len(tree.codes), sum(len(x[0]) for x in tree.levels), tree.met, tree.other, tree.far, near]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in found], names=["codes", "nodes", "met", "other", "far", "near"])

    return _dealt(vertices, radius).mapInArrow(rows, "codes long, nodes long, met long, other long, far long, near long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id among the documents that links of at most radius bits reach. Rows are kept as
    they are: repeated rows give repeated rows, rows with one doc_id and different texts keep their own fingerprints.
    A null doc_id counts for no minimum, so a component without any id has a null component_id. Null texts and texts
    without a word have fingerprint zero and are linked like any other. An empty table gives an empty result; other
    columns of docs are left out, so their names can't clash.
    """
    signed = cut(fingerprints(docs, id_col, text_col, words))
    vertices = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = cut(components(links(vertices, radius)).withColumnRenamed("node", "fp"))
    least = roots.join(vertices, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = vertices.join(roots.join(least, "root").select("fp", "component_id"), "fp", "left")
    classes = cut(classes.select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return join_spread(signed, classes, ["fp"]).select("doc_id", "fp", "component_id")
