"""Exact top-k by inner product through a pivot table.

Vectors become integers floor(SCALE * x). A table holds, computed once and written, each vector's distances to PIVOTS
chosen vectors. By the triangle inequality |d(q, p) - d(v, p)| is a lower bound of d(q, v) for every pivot p, and the
largest of them bounds the inner product from above: 2 <q, v> = |q|^2 + |v|^2 - d(q, v)^2.

The table is sorted by nearest pivot and the distance to it, and packed into blocks of BLOCK vectors with the least and
greatest distance to each pivot; a query drops a whole block whose bound is below its k-th score. In the other blocks it
takes candidates in batches by falling bounds and stops when the next bound is below its k-th score; equal bounds go
on, since ties count.

Queries are broadcast in waves of at most WAVE, a bound that doesn't grow with the input, and each task takes them
through all its blocks, so vectors are never shuffled or paired with copies of themselves. A wave first learns which block
looks best for each query, scores that one, and starts from the k-th score found there; a task carries its k-th scores
from block to block and sends on only what reaches the starting score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import cut, small_batches

SCALE = 256
PIVOTS = 32
#: Vectors read to choose the pivots from; any vectors give right bounds.
PIVOT_SAMPLE = 2000
#: Vectors of a block; queries broadcast at once at most; queries that go through a block together.
BLOCK, WAVE, TOGETHER = 2048, 16_384, 128
#: Candidates of the batches between two looks at the stopping rule; the last batch takes the rest.
BATCHES = (64, 448)


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to dim."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample, each the farthest from those chosen before."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Single-precision distances; bounds allow for the rounding."""
    a, p = m.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (a @ p.T))).astype(np.float32)


def pivot_table(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """(vec_id, asks, vector, gaps, near, gap): vectors as bytes, distances to the pivots as bytes, the nearest pivot."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(pa.concat_arrays([batch.column("vector")]), dim)
            gaps = distances(m, pivots) if len(pivots) else np.zeros((len(m), 1), np.float32)
            near = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("asks"), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in gaps], pa.binary()), pa.array(near.astype(np.int32)), pa.array(gaps[np.arange(len(m)), near].astype(np.float64))],
                names=["vec_id", "asks", "vector", "gaps", "near", "gap"],
            )

    return rows.select("vec_id", "asks", "vector").mapInArrow(measured, "vec_id long, asks boolean, vector binary, gaps binary, near int, gap double")


def packed_blocks(table: DataFrame, dim: int) -> DataFrame:
    """(low, high, most, ids, vectors, gaps): blocks of neighbours in the pivot table's order; most is the largest squared norm."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, gaps = [], [], []

        def block(n: int) -> pa.RecordBatch:
            g = np.frombuffer(b"".join(gaps[:n]), np.float32).reshape(n, -1)
            m = np.frombuffer(b"".join(vectors[:n]), np.int64).reshape(n, dim)
            most = float((m.astype(np.float64) ** 2).sum(axis=1).max())
            held = [g.min(axis=0).tobytes(), g.max(axis=0).tobytes(), most, np.array(ids[:n], np.int64).tobytes(), m.tobytes(), g.tobytes()]
            kinds = [pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            del ids[:n], vectors[:n], gaps[:n]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, kinds, strict=True)], names=["low", "high", "most", "ids", "vectors", "gaps"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += batch.column("vector").to_pylist()
            gaps += batch.column("gaps").to_pylist()
            while len(ids) >= BLOCK:
                yield block(BLOCK)
        if ids:
            yield block(len(ids))

    return table.select("vec_id", "vector", "gaps").mapInArrow(rows, "low binary, high binary, most double, ids binary, vectors binary, gaps binary")


class Wave:
    """Queries with the k best candidates found so far, and their k-th scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, k: int, start: np.ndarray | None = None):
        self.ids, self.vectors, self.gaps, self.k = ids, vectors.astype(np.float64), gaps, k
        self.norms = (self.vectors**2).sum(axis=1)
        self.start = np.full(len(ids), -np.inf) if start is None else start
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.met = self.by_block = self.scored = 0

    def bound(self, squared: np.ndarray, norms: np.ndarray, most: np.ndarray | float) -> np.ndarray:
        """Upper bound of the inner product; the slack allows for rounding, bounds may only be too high."""
        both = norms + most
        return (both - squared) / 2 + 4e-6 * both + 1

    def block_bounds(self, low: np.ndarray, high: np.ndarray, most: float) -> np.ndarray:
        gap = np.maximum(0, np.maximum(low - self.gaps, self.gaps - high).max(axis=1)).astype(np.float64)
        return self.bound(gap * gap, self.norms, most)

    def kth(self) -> np.ndarray:
        return np.maximum(self.start, self.scores[:, -1])

    def take(self, low: np.ndarray, high: np.ndarray, most: float, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, only: np.ndarray | None = None) -> None:
        """Take a block into account for all queries, or some of them."""
        asked = np.arange(len(self.ids)) if only is None else only
        alive = asked[(self.block_bounds(low, high, most) >= self.kth())[asked]]
        self.met += len(asked) * len(ids)
        self.by_block += (len(asked) - len(alive)) * len(ids)
        if not len(alive):
            return
        c = vectors.astype(np.float64)
        norms, across = (c * c).sum(axis=1), np.ascontiguousarray(gaps.T)
        for at in range(0, len(alive), TOGETHER):
            self._descend(alive[at : at + TOGETHER], ids, c, norms, across)

    def _descend(self, q: np.ndarray, ids: np.ndarray, c: np.ndarray, norms: np.ndarray, across: np.ndarray) -> None:
        """Candidates of a block for queries q, in batches by falling bounds, until the next bound is below the k-th score."""
        gap = np.zeros((len(q), len(ids)), dtype=np.float32)
        part = np.empty_like(gap)
        for p, column in enumerate(across):
            np.subtract(column[None, :], self.gaps[q, p][:, None], out=part)
            np.abs(part, out=part)
            np.maximum(gap, part, out=gap)
        gap = gap.astype(np.float64)
        bounds = self.bound(gap * gap, self.norms[q][:, None], norms)
        bounds[ids == self.ids[q][:, None]] = -np.inf  # a query's own rows
        edges = [e for e in np.cumsum(BATCHES) if e < len(ids)]
        order = np.argpartition(-bounds, edges, axis=1) if edges else np.broadcast_to(np.arange(len(ids)), bounds.shape)
        product = None
        for first, last in zip([0, *edges], [*edges, len(ids)], strict=True):
            take = order[:, first:last]
            held = np.take_along_axis(bounds, take, axis=1)
            going = held.max(axis=1) >= np.maximum(self.kth()[q], -1e300)
            q, take, held, order, bounds = q[going], take[going], held[going], order[going], bounds[going]
            if not len(q):
                return
            if last - first < len(ids) / 4:
                scores = np.einsum("qcd,qd->qc", c[take], self.vectors[q])
            else:
                product = self.vectors[q] @ c.T if product is None else product[going]
                scores = np.take_along_axis(product, take, axis=1)
            scores[np.isneginf(held)] = -np.inf
            self.scored += int(np.isfinite(scores).sum())
            self._keep(q, scores, ids[take])

    def _keep(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores of candidates into the k best of queries q: higher scores first, then smaller ids."""
        scores, ids = np.concatenate([self.scores[q], scores], axis=1), np.concatenate([self.found[q], ids], axis=1)
        least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        row, col = np.nonzero(scores >= least[:, None])
        s, i = scores[row, col], ids[row, col]
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < self.k
        self.scores[q[row[best]], place[best]] = s[best]
        self.found[q[row[best]], place[best]] = i[best]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, candidate ids, scores) that reach the starting scores."""
        row, col = np.nonzero(np.isfinite(self.scores) & (self.scores >= self.start[:, None]))
        return self.ids[row], self.found[row, col], self.scores[row, col].astype(np.int64)


def _block(row: dict, dim: int) -> tuple:
    ids = np.frombuffer(row["ids"], np.int64)
    return np.frombuffer(row["low"], np.float32), np.frombuffer(row["high"], np.float32), row["most"], ids, np.frombuffer(row["vectors"], np.int64).reshape(-1, dim), np.frombuffer(row["gaps"], np.float32).reshape(len(ids), -1)


def _prepared(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(pivot table, blocks, dim), both written."""
    small_batches(vectors.sparkSession)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = cut(rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    shape = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    dim = shape[0] or 1
    if dim * (shape[1] or 0) ** 2 >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()  # a bounded sample
    pivots = choose_pivots(np.array([[*r.vector, *[0] * (dim - len(r.vector))] for r in sample], dtype=np.int64).reshape(-1, dim))
    table = cut(pivot_table(rows, pivots, dim))
    blocks = packed_blocks(table.repartitionByRange("near", "gap").sortWithinPartitions("near", "gap"), dim)
    return table, cut(blocks.withColumn("block", F.monotonically_increasing_id())), dim


def _waves(table: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, gaps) of the queries, at most WAVE at a time."""
    asking = table.filter("asks")
    n = asking.count()
    waves = max(1, -(-2 * n // WAVE)) if n > WAVE else 1
    asking = cut(asking.withColumn("wave", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(waves)))) if waves > 1 else asking.withColumn("wave", F.lit(0))
    for wave in range(waves if n else 0):
        rows = asking.filter(F.col("wave") == wave).select("vec_id", "vector", "gaps").limit(WAVE + 1).collect()  # bounded
        if len(rows) > WAVE:
            raise RuntimeError("a wave holds more queries than its bound")
        if rows:
            yield np.array([r.vec_id for r in rows], np.int64), np.frombuffer(b"".join(r.vector for r in rows), np.int64).reshape(-1, dim), np.frombuffer(b"".join(r.gaps for r in rows), np.float32).reshape(len(rows), -1)


def _start(blocks: DataFrame, shared, n: int, dim: int, k: int) -> np.ndarray:
    """For each query of a wave the k-th score in the block whose bound is highest for it."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = Wave(*shared.value, k)
        high, block = np.full(n, -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = wave.block_bounds(np.frombuffer(row["low"], np.float32), np.frombuffer(row["high"], np.float32), row["most"])
                better = own > high
                high[better], block[better] = own[better], row["block"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(high), pa.array(block)], names=["query", "bound", "block"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wave = Wave(*shared.value, k)
                asked = np.array(row["queries"], np.int64)
                wave.take(*_block(row, dim), only=asked)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(wave.scores[asked, -1])], names=["query", "kth"])

    named = blocks.select("block", "low", "high", "most").mapInArrow(best, "query long, bound double, block long")
    named = named.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).groupBy("block").agg(F.collect_list("query").alias("queries"))
    found = blocks.join(F.broadcast(named), "block").select("low", "high", "most", "ids", "vectors", "gaps", "queries").mapInArrow(scored, "query long, kth double")
    start = np.full(n, -np.inf)
    for r in found.collect():  # one row for each query of the wave
        start[r["query"]] = r["kth"]
    return start


def _runs(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, made, schema: str) -> DataFrame:
    """made(wave) -> record batch, for each wave and each task once it has gone through its blocks."""
    spark = vectors.sparkSession
    table, blocks, dim = _prepared(vectors, is_query, id_col, vector_col)
    parts = []
    for queries in _waves(table, dim):
        start = _start(blocks, spark.sparkContext.broadcast(queries), len(queries[0]), dim, k)
        shared = spark.sparkContext.broadcast((*queries, k, start))

        def through(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wave = Wave(*shared.value)
            for batch in batches:
                for at in range(batch.num_rows):
                    wave.take(*_block(batch.slice(at, 1).to_pylist()[0], dim))
            yield made(wave)

        parts.append(cut(blocks.select("low", "high", "most", "ids", "vectors", "gaps").mapInArrow(through, schema)))
    out = spark.createDataFrame([], schema) if not parts else parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k largest integer inner products over all other rows.

    Ties go to the smaller vec_id. A query leaves out rows with its own id. Rows with a null id, and vectors that are
    null or hold a null or non-finite component, take no part; shorter vectors count as padded with zeros; an empty
    vector scores 0. Repeated rows are candidates each (equal score and id). Scores are whole numbers below 2^53;
    components so large that a score might pass that raise an error. An empty table gives an empty result; other
    columns are left out, so their names can't clash.
    """
    def made(wave: Wave) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in wave.results()], names=["query_id", "vec_id", "score"])

    found = _runs(vectors, is_query, k, id_col, vector_col, made, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: pairs of a query and a vector; of these dropped with a block, dropped by the bound order, and scored."""
    def made(wave: Wave) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (wave.met, wave.by_block, wave.scored)], names=["pairs", "by_block", "scored"])

    found = _runs(vectors, is_query, k, id_col, vector_col, made, "pairs long, by_block long, scored long").agg(*(F.sum(c).alias(c) for c in ("pairs", "by_block", "scored")))
    return found.select("pairs", "by_block", (F.col("pairs") - F.col("by_block") - F.col("scored")).alias("by_order"), "scored")
