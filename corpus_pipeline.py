"""Training-corpus pipeline: quality rules, near-duplicates, secrets, mixture, tokens.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what each stage
returns as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, quality, secrets, similar, spm
from gridloom.llm.common import cut, read


def _recounted(docs: DataFrame) -> DataFrame:
    """With n_chars as the text is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are taken out of the others.

    Null and empty texts, and texts of under 50 words, are rejected. Whole texts are read, however long; repeated rows are
    judged alike. A null id or source is a value like others. An empty table stays empty.
    """
    return _recounted(quality.apply_rules(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more) stays: the smallest id.

    Null texts and texts without a word are one group; null ids come last; of equal rows one stays. Whole texts are read,
    however long. An empty table stays empty.
    """
    return similar.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes, repeated rows stay repeated.

    A null text stays null, an empty one empty; whole texts are read, however long. An empty table stays empty.
    """
    return _recounted(secrets.redact(docs, secrets.trained(docs)))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of its schedule.

    Null and empty texts aren't taken; whole texts count, however long. Repeated rows get the copies of all of them; a
    null source is a source of its own. An empty table stays empty.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, round_trip, parity), a row for each row; lang and source where docs has them.

    Null and empty texts have no ids; whole texts are encoded, however long. An empty table stays empty.
    """
    return spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixture", source_mixture),
    ("tokens", tokens),
]

#: The similarity graph, the forest and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
