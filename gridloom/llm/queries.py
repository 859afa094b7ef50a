"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, licenses, mixing, quality, secrets, simhash, spm, tokenfile, topk, urlrules
from gridloom.llm.common import read, unsigned_hex
from gridloom.llm.sql import SQL as SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.new_path(spark)
    tokenfile.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return tokenfile.positions(spark, path)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.trained(docs))
    digests = F.transform("secrets", lambda x: F.sha2(x.cast("binary"), 256))
    return found.select("doc_id", "n_candidates", "n_secrets", digests.alias("secret_digests"), F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


#: Rules of op8: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(read(spark, sf_dir, "pages"), rules)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_language_id, op3_mixing, op4_topk, op5_token_file, op6_secret_scan, op7_quality, op8_url_filter, op9_sentencepiece, op10_license_scan)}
