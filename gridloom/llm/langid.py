"""Language identification by string kernels.

A text's features are the character n-grams of length 1 to NGRAM that occur in it (a blended spectrum, presence only),
hashed to BUCKETS; characters are lower-cased and every character that isn't a letter counts as a blank. The kernel is
the number of shared features over the geometric mean of both texts' numbers. Nystroem landmarks stand for the training
texts; one kernel ridge regression for each language, against the rest, is solved on them. As the kernel is linear in
the presence vectors, landmarks and weights fold into one matrix (BUCKETS x languages), and a batch of texts is scored
by one matrix product. Models are trained on a bounded sample; predictions read whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches

NGRAM = 3
BUCKETS = 1 << 15
#: Training texts for each language, and in all; with more languages than SAMPLE_ALL each has one.
SAMPLE, SAMPLE_ALL = 500, 20_000
LANDMARKS = 400
RIDGE = 1e-3
#: Code points hashed at once, and texts in one matrix product.
STRETCH, BATCH = 1 << 20, 64
#: Texts of which training holds floating vectors at once (128 KB each), besides those of the landmarks.
STEP = 256


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(text: str, out: np.ndarray) -> bool:
    """Set the buckets of the text's n-grams in out (bool, BUCKETS); whether the text has a letter."""
    letters, any_letter = _letters(), False
    for at in range(0, len(text), STRETCH):
        part = text[max(0, at - NGRAM + 1) : at + STRETCH].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = letters[code]
        any_letter = any_letter or bool(known.any())
        code = np.where(known, code, np.uint32(32))
        mixed = np.zeros(len(code), dtype=np.uint32)
        for n in range(NGRAM):
            mixed = (mixed[: len(code) - n] * np.uint32(0x9E3779B1) + code[n:] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            out[mixed >> np.uint32(17)] = True
    return any_letter


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


class Model:
    """Folded weights: score = presence @ weights / sqrt(number of features)."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            x = np.zeros((len(part), BUCKETS), dtype=bool)
            known = [t is not None and features(t, row) for t, row in zip(part, x, strict=True)]
            if not self.languages:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            f = (x.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
            best = f.argmax(axis=1)
            top = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
            names += [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            scores += [round(float(s), 6) if k else 0.0 for s, k in zip(top, known, strict=True)]
        return names, scores


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """x: presence (texts x BUCKETS, bool, or BUCKETS / 8, packed bits) in random order; landmarks are dealt evenly to the languages.

    Texts become floating vectors a few at a time, besides those of the landmarks.
    """
    x = np.packbits(x, axis=1) if x.dtype == bool else x

    def dense(rows) -> np.ndarray:
        return np.unpackbits(x[rows], axis=1).astype(np.float32)

    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    own = {lang: [i for i, y in enumerate(labels) if y == lang] for lang in languages}
    chosen = sorted(i for rows in own.values() for i in rows[: max(1, landmarks // len(languages))])
    size = np.sqrt(np.maximum(1, np.bitwise_count(x).sum(axis=1, dtype=np.int64))).astype(np.float32)[:, None]
    z = dense(chosen) / size[chosen]
    knm = np.empty((len(x), len(chosen)))
    for at in range(0, len(x), STEP):
        knm[at : at + STEP] = (dense(slice(at, at + STEP)) @ z.T) / size[at : at + STEP]
    kmm = knm[chosen]
    # Each language weighs as much as the rest against which it is set, however rare.
    share = np.array([1 / len(own[y]) for y in labels])[:, None]
    y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    left = knm.T @ (share * knm) + ridge * kmm + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, knm.T @ (share * y))
    return Model(languages, z.T @ alpha.astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out.

    Rows are drawn by a hash of id and text, so that reruns agree, with a rate for each language that keeps about twice
    SAMPLE of them; texts become presence vectors on the executors. Of each language those with the least draws are
    taken, SAMPLE or an equal share of SAMPLE_ALL at most, so at most SAMPLE_ALL such vectors (4 KB each) come to the driver,
    where they stay packed. Every language with a labelled text can be predicted.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row for each language
    if not counts:
        return fit(np.zeros((0, BUCKETS // 8), dtype=np.uint8), [])
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * each / r.n)) for r in counts], "lang string, rate double")
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("draw")
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw).join(F.broadcast(rates), "lang").filter("draw < rate")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, draws, bits = [], [], []
            for lang, at, text in zip(batch.column("lang").to_pylist(), batch.column("draw").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row = np.zeros(BUCKETS, dtype=bool)
                if text and features(text, row):
                    langs.append(lang)
                    draws.append(at)
                    bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(draws, pa.float64()), pa.array(bits, pa.binary())], names=["lang", "draw", "bits"])

    sample = drawn.select("lang", "draw", "text").mapInArrow(vectors, "lang string, draw double, bits binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))
    kept = sample.withColumn("place", place).filter(F.col("place") <= each).orderBy("draw", "lang", "bits").collect()
    x = np.frombuffer(b"".join(r.bits for r in kept), np.uint8).reshape(-1, BUCKETS // 8)
    return fit(x, [r.lang for r in kept])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Whole texts are read, however long. A text that is null or has no letter gets `und` and score 0, as does every text of a model without languages. A null
    id counts as the empty string in held_out. Repeated rows give repeated results, an empty table an empty one; other
    columns are left out, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return frame.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")
