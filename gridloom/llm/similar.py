"""Near-duplicate documents by SimHash, down to a similarity of 0.8 in 5-word shingles.

Fingerprints are taken over the distinct shingles, as the similarity is, so that repeats don't count. At 0.8 they differ
in about 10 of 64 bits (12 for sets of 4 and 5 shingles, the worst case: a bit differs with probability 3/16), and up to
28 are looked at, beyond which a pair of 0.8 is missed with 1.1 in a million at most (binomial tail). That is too many
for blocks of equal bits. Fingerprints meet instead in blocks of texts that share the least shingle under one of KEYS
hash orders; texts of similarity s agree in each order with probability s, so a pair of 0.8 shares none of 8 with 3 in a
million. In a block the Gray-order index of the fingerprints (grayindex) finds the pairs within RADIUS bits; a pair is
left to the first block that it shares. Only texts that have such a pair send their shingles, and the pairs are checked
by the Jaccard similarity of the shingle sets, but for pairs that are joined already. Classes of all blocks are joined by
stars (graph).

Hot blocks, of more than BLOCK texts, are taken in two passes, so that no task holds more than a few times BLOCK texts and
no link is lost. First each text meets, for its first hot block alone, a chunk of that block and ANCHORS texts that go to
all its chunks; a large group of near copies becomes one class here, in linear work. Then only pairs of different classes
matter: hot blocks that still hold several are dealt again by KEYS fresh hash orders (missed, once more, with 3 in a
million), and blocks of one class are dropped. Of those that are hot even then, chunks of one class meet chunks of others,
so the work grows with what isn't joined yet, not with the square of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_key, cut, forget, join_spread, packed, raw, small_batches
from gridloom.llm.graph import components
from gridloom.llm.grayindex import GrayIndex, gray_rank
from gridloom.llm.simhash import fingerprint, hashes, shingles

WORDS, SIMILARITY, RADIUS = 5, 0.8, 28
#: Hash orders that deal the texts, and as many again for hot blocks.
KEYS = 8
#: Texts of a block before it counts as hot; texts of a chunk; texts that meet all chunks of their block.
BLOCK, ANCHORS = 2000, 64
#: Rows under one tree at least, where a partition has as many.
TREE = 1 << 13
#: Lists of hot blocks up to this number of rows (16 bytes each) are broadcast.
BROADCAST_BLOCKS = 200_000
_ODD = np.array([xxhash.xxh64_intdigest(b"order %d" % i) | 1 for i in range(2 * KEYS)], dtype=np.uint64)
_MEETING = "block long, own int, vid binary, fp long, least array<long>, class long"


def text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit("-"))


def ident(doc_id: Column, text: Column) -> Column:
    """Id and digest of the text as one string; null ids are told apart."""
    return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("long").cast("string")), F.lit("-")), F.lit(":"), text_key(text))


def _unique(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(hashes(shingles(text, words)).view(">u8").ravel().astype(np.uint64))


def set_fingerprint(distinct: np.ndarray) -> int:
    return fingerprint(distinct.astype(">u8").view(np.uint8).reshape(-1, 8))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(doc_id, ident, vid, fp, least): digests of the text and of its words, fingerprint, least shingle in 2 * KEYS orders."""
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), ident(F.col(id_col), F.col(text_col)).alias("ident"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            vids, fps, least, sizes = [], [], [], [0]
            for text in raw(batch.column("text")):
                vids.append(xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split())))
                distinct = _unique(text, words)
                fps.append(set_fingerprint(distinct))
                if len(distinct):
                    for odd in _ODD:
                        mixed = distinct * odd
                        least.append(int((mixed ^ (mixed >> np.uint64(29))).min()))
                sizes.append(len(least))
            held = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(least, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ident"), pa.array(vids, pa.binary()), pa.array(fps, pa.int64()), held], names=["doc_id", "ident", "vid", "fp", "least"])

    return frame.mapInArrow(rows, "doc_id long, ident string, vid binary, fp long, least array<long>")


def _listed(blocks: DataFrame) -> DataFrame:
    return F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks


def _chunks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _meetings(rows: DataFrame, block: Column, kind: Column) -> DataFrame:
    """Rows of _MEETING that aren't left to an earlier block; pairs of one class don't count."""
    return rows.select(block.alias("block"), F.lit(-1).alias("own"), "vid", "fp", F.array().cast("array<long>").alias("least"), kind.alias("class"))


def _dealt(vertices: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(meetings, hot): rows of _MEETING for the first pass; block, n, own, vid, fp, least of the texts in hot blocks, or None."""
    rows = vertices.select("vid", "fp", "least", F.posexplode(F.slice("least", 1, KEYS)).alias("own", "value"))
    rows = rows.select(F.xxhash64("own", "value").alias("block"), "own", "vid", "fp", "least")
    listed = cut(rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK))
    plain = rows.withColumn("least", F.slice("least", 1, KEYS)).withColumn("class", F.xxhash64("vid"))
    if listed.isEmpty():
        return plain, None
    listed = _listed(listed)
    hot = cut(rows.join(listed, "block"))
    first = hot.groupBy("vid").agg(F.min(F.struct("own", "block", "n", "fp")).alias("m")).select("vid", "m.block", "m.n", "m.fp")
    first = first.withColumn("chunk", F.pmod(F.xxhash64("vid"), _chunks(F.col("n"))).cast("int"))
    anchors = first.filter(F.pmod(F.xxhash64("vid", F.lit(7)), F.col("n")) < ANCHORS).withColumn("to", F.explode(F.sequence(F.lit(0), _chunks(F.col("n")) - 1))).filter("to <> chunk").withColumn("chunk", F.col("to"))
    both = first.unionByName(anchors.drop("to"))
    return plain.join(listed, "block", "left_anti").unionByName(_meetings(both, F.xxhash64("block", "chunk"), F.xxhash64("vid"))), hot


def _dealt_again(hot: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Rows of _MEETING for pairs of different classes in hot blocks, None if there are no such blocks. roots: vid, root."""
    labelled = hot.join(roots, "vid", "left").withColumn("class", F.xxhash64(F.coalesce("root", "vid")))
    labelled = cut(labelled.select("block", "vid", "fp", "class", F.slice("least", KEYS + 1, KEYS).alias("fresh")))

    def mixed(rows: DataFrame) -> DataFrame:
        """block, n of blocks of several classes."""
        found = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"))
        return cut(found.filter("a <> b").select("block", "n"))

    several = mixed(labelled)
    if several.isEmpty():
        return None
    again = labelled.join(_listed(several.select("block")), "block").select("vid", "fp", "class", "block", F.posexplode("fresh").alias("own", "value"))
    again = cut(again.select(F.xxhash64("block", "own", "value").alias("block"), "vid", "fp", "class"))
    several = _listed(mixed(again))
    again = again.join(several, "block")
    small = _meetings(again.filter(F.col("n") <= BLOCK), F.col("block"), F.col("class"))
    large = again.filter(F.col("n") > BLOCK)
    # Units of a block: each class of more than BLOCK texts, and all others together (0); their chunks meet those of other units.
    sizes = large.groupBy("block", "class").agg(F.count("*").alias("k"))
    units = cut(sizes.withColumn("unit", F.when(F.col("k") > BLOCK, F.col("class")).otherwise(0)))
    chunks = cut(units.groupBy("block", "unit").agg(_chunks(F.sum("k")).alias("chunks")))
    if chunks.isEmpty():
        return small
    sub = F.pmod(F.xxhash64(F.when(F.col("unit") == 0, F.col("class").cast("string").cast("binary")).otherwise(F.col("vid"))), F.col("chunks")).cast("int")
    rows = large.join(units.select("block", "class", "unit"), ["block", "class"]).join(chunks, ["block", "unit"]).withColumn("sub", sub).select("block", "unit", "sub", "vid", "fp", "class")
    a, b = (chunks.select("block", F.col("unit").alias(f"{x}_unit"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(f"{x}_sub")) for x in "ab")
    met = a.join(b, (a["block"] == b["block"]) & ((F.col("a_unit") < F.col("b_unit")) | ((F.col("a_unit") == 0) & (F.col("b_unit") == 0) & (F.col("a_sub") <= F.col("b_sub")))))
    met = met.select(a["block"], F.xxhash64(a["block"], "a_unit", "a_sub", "b_unit", "b_sub").alias("meeting"), F.array_distinct(F.array(F.struct(F.col("a_unit").alias("unit"), F.col("a_sub").alias("sub")), F.struct(F.col("b_unit").alias("unit"), F.col("b_sub").alias("sub")))).alias("sides"))
    met = met.select("block", "meeting", F.inline("sides"))
    return small.unionByName(_meetings(rows.join(met, ["block", "unit", "sub"]), F.col("meeting"), F.col("class")))


class _Meeting:
    """The candidates of a table of rows (_MEETING): all its blocks under one Gray-order tree."""

    def __init__(self, table: pa.Table):
        block = table.column("block").to_numpy()
        codes = table.column("fp").to_numpy().view(np.uint64)
        self.order = np.lexsort((gray_rank(codes), block))
        block = block[self.order]
        self.codes = codes[self.order]
        self.tree = GrayIndex(self.codes, np.cumsum(np.r_[False, block[1:] != block[:-1]]))
        self.own = table.column("own").to_numpy()[self.order]
        self.kind = table.column("class").to_numpy()[self.order]
        least = table.column("least").combine_chunks()
        sizes = np.diff(least.offsets.to_numpy())
        self.keys = np.zeros((len(sizes), KEYS), dtype=np.int64)
        self.keys[sizes > 0] = least.flatten().to_numpy().reshape(-1, KEYS)
        self.keys = self.keys[self.order]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (places in order) within RADIUS bits, of different classes, that share no earlier key than their block's."""
        before = np.arange(KEYS)
        for i, j in self.tree.pairs(RADIUS):
            apart = self.kind[i] != self.kind[j]
            i, j = i[apart], j[apart]
            own = self.own[i]
            later = np.flatnonzero(own > 0)
            shared = ((self.keys[i[later]] == self.keys[j[later]]) & (before < own[later][:, None])).any(axis=1)
            first = np.ones(len(i), dtype=bool)
            first[later[shared]] = False
            yield i[first], j[first]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _checked(meetings: DataFrame, vertices: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links whose classes are those of all candidates of the meetings that are at least so similar."""
    columns = [c.split()[0] for c in _MEETING.split(", ")]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table in by_key(batches, "block", TREE):
            met = _Meeting(table)
            seen = np.zeros(len(met.order), dtype=bool)
            for i, j in met.candidates():
                seen[i] = seen[j] = True
            yield from table.take(pa.array(np.sort(met.order[seen]))).combine_chunks().to_batches()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [_unique(t, words).tobytes() for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(found, pa.binary())], names=["vid", "parts"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table in by_key(batches, "block"):
            met = _Meeting(table)
            vids, held = table.column("vid"), table.column("parts")
            own = [np.frombuffer(held[int(x)].as_py(), np.uint64) for x in met.order]
            size = np.array([len(x) for x in own])
            parent, u, v = list(range(len(own))), [], []
            for i, j in met.candidates():
                fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
                near = np.argsort(np.bitwise_count(met.codes[i] ^ met.codes[j]), kind="stable")
                for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    ra, rb = _root(parent, a), _root(parent, b)
                    if ra == rb:
                        continue
                    both = len(np.intersect1d(own[a], own[b], assume_unique=True))
                    if both >= similarity * (len(own[a]) + len(own[b]) - both):
                        parent[rb] = ra
                        u.append(vids[int(met.order[a])].as_py())
                        v.append(vids[int(met.order[b])].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    dealt = meetings.select(*columns).repartition("block").sortWithinPartitions("block")
    some = cut(dealt.mapInArrow(paired, _MEETING))
    wanted = some.select("vid").distinct().join(vertices.select("vid", "ident"), "vid")
    held = texts.join(wanted, "ident").groupBy("vid").agg(F.first("text").alias("text"))
    full = some.join(held.select("vid", "text").mapInArrow(sets, "vid binary, parts binary"), "vid")
    return full.select(*columns, "parts").repartition("block").sortWithinPartitions("block").mapInArrow(compared, "u binary, v binary")


def links(vertices: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): links whose classes are those of all pairs of vertices at least so similar.

    vertices: vid, ident, fp, least, one row for each distinct sequence of words. texts: ident, text.
    """
    small_batches(vertices.sparkSession)
    meetings, hot = _dealt(vertices.filter(F.size("least") > 0))
    found = _checked(meetings, vertices, texts, words, similarity)
    if hot is None:
        return found
    found = cut(found)
    meetings = _dealt_again(hot, components(found).withColumnRenamed("node", "vid"))
    return found if meetings is None else found.unionByName(_checked(meetings, vertices, texts, words, similarity))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, ident, root) for every row of docs; rows of one near-duplicate group share their root.

    Texts with the same words (A-Z lowered) are copies; those without a word, null ones included, are copies of each
    other. ident is the id with the digest of the text. Repeated rows give repeated results, an empty table an empty one.
    """
    signed = cut(signatures(docs, id_col, text_col, words))
    vertices = cut(signed.groupBy("vid").agg(F.min("ident").alias("ident"), F.first("fp").alias("fp"), F.first("least").alias("least"), F.count("*").alias("n")))
    texts = docs.select(ident(F.col(id_col), F.col(text_col)).alias("ident"), F.col(text_col).alias("text"))
    roots = components(links(vertices, texts, words, similarity)).withColumnRenamed("node", "vid")
    roots = cut(vertices.select("vid", "n").join(roots, "vid", "left").select("vid", "n", F.coalesce("root", "vid").alias("root")))
    return join_spread(signed.select("doc_id", "ident", "vid"), roots, ["vid"]).select("doc_id", "ident", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest doc_id, null ids last, then the smallest digest.

    Of rows with the same id and text one stays. Null texts and texts without a word are one group; whole texts are read,
    however long. An empty table gives an empty one. The columns stay as they are, whatever their names.
    """
    found = cut(classes(docs, id_col, text_col, words, similarity))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ident")
    first = found.groupBy("root").agg(F.min(rank).alias("best")).select("best.ident")
    counts = found.groupBy("ident").agg(F.count("*").alias("n"))
    chosen = cut(first.join(counts, "ident"))
    keyed = packed(docs, ident=ident(F.col(id_col), F.col(text_col)))
    out = keyed.join(chosen.filter("n = 1"), "ident").select("row")
    repeated = chosen.filter("n > 1").select("ident")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, "ident").groupBy("ident").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
