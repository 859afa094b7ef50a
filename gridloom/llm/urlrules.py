"""URL rules by a sort-merge range join over reversed-host keys.

A key is the host's labels in reverse order, a slash and the path with its own slash: `https://www.example.org/es/1` -> `org.example.www//es/1`.
A host holds no slash, so the first slash ends it. A rule (host, path) fits a host and all its subdomains; therefore a
url gets one key for each suffix of its host, and then a rule is the interval of keys that start with its own key. A key
is as long as the longest rule's, and suffixes have as many labels as a rule's host at most: rules can't see beyond, so
urls of any length cost no more.
Rules and distinct url keys are sorted together (range partitions), and one sweep over each partition keeps a stack of
the rules that are open, each nested in the one below; the top of the stack is the longest rule for a key. What is open
where a partition starts are the rules whose keys are prefixes of its first key: they are looked up by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_spread, raw, small_batches


def lowered(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty for null or without ://."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))



def _keys(hosts: DataFrame, labels_most: int, length_most: int) -> DataFrame:
    """(host, path, key) for every suffix of the host that a rule might fit."""
    whole = F.size(F.split(F.substring_index("host", ".", -(labels_most + 1)), r"\."))  # labels, as far as they matter
    rows = hosts.select("host", "path", F.explode(F.sequence(F.lit(1), F.least(whole, F.lit(labels_most)))).alias("n"))
    suffix = F.expr("substring_index(host, '.', -n)")
    reverse = F.array_join(F.reverse(F.split(suffix, r"\.")), ".")
    return rows.select("host", "path", F.left(F.concat(reverse, F.lit("/"), F.left("path", F.lit(length_most))), F.lit(length_most)).alias("key"))


def match(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule_id) for every distinct (host, path) that a rule fits: the longest rule.

    rules: rule_id long, host, path. The longest is the one with most characters in its key; equal keys take the
    smaller rule_id.
    """
    host = lowered(F.col("host"))
    wanted = rules.select("rule_id", F.size(F.split(host, r"\.")).alias("labels"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), "path").alias("key"))
    wanted = cut(wanted.groupBy("key").agg(F.min("rule_id").alias("rule_id"), F.max("labels").alias("labels")))
    most = wanted.agg(F.coalesce(F.max("labels"), F.lit(1)), F.coalesce(F.max(F.length("key")), F.lit(1))).first()
    wanted = wanted.select("key", "rule_id")
    keyed = cut(_keys(hosts, *most))
    both = wanted.withColumn("n", F.lit(0).cast("long")).unionByName(keyed.groupBy("key").agg(F.count("*").alias("n")).withColumn("rule_id", F.lit(None).cast("long")))
    # Nulls last: a rule is opened before a url with the same key is seen.
    laid = cut(both.repartitionByRange("key").sortWithinPartitions("key", F.col("rule_id").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    heads = laid.groupBy("part").agg(F.min("key").alias("head"))
    # Rules that are open where a partition starts: prefixes of its first key, of the lengths that rules have.
    lengths = wanted.agg(F.collect_set(F.length("key")).alias("lengths"))
    heads = heads.crossJoin(F.broadcast(lengths)).select("part", "head", F.explode(F.filter("lengths", lambda n: n <= F.length("head"))).alias("n")).select("part", F.expr("left(head, n)").alias("key"))
    open_rules = heads.join(wanted, "key").select("key", "rule_id", F.lit(0).cast("long").alias("n"), "part", F.lit(True).alias("open"))
    sweep = laid.withColumn("open", F.lit(False)).unionByName(open_rules).repartition("part").sortWithinPartitions("part", F.col("open").desc(), "key", F.col("rule_id").asc_nulls_last())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, int]] = []
        now = None
        for batch in batches:
            keys, found, counts = [], [], []
            for part, key, rule, n in zip(batch.column("part").to_pylist(), raw(batch.column("key")), batch.column("rule_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if part != now:
                    stack, now = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, rule))
                elif stack:
                    keys.append(key.decode())
                    found.append(stack[-1])
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([r for _, r in found], pa.int64()), pa.array([len(k.decode()) for k, _ in found], pa.int64()), pa.array(counts, pa.int64())], names=["key", "rule_id", "length", "n"])

    fits = cut(sweep.mapInArrow(rows, "key string, rule_id long, length long, n long"))
    best = join_spread(keyed, fits, ["key"]).groupBy("host", "path").agg(F.max(F.struct("length", -F.col("rule_id"))).alias("best"))
    return best.select("host", "path", (-F.col("best.col2")).alias("rule_id"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: host, path, verdict. The longest rule that fits wins; rules that say the same twice are resolved to the
    first by verdict. A url of any length is read whole; rule is host and path of the winner, null if none fits; verdict is then `default`. Null urls and
    urls without :// have an empty host and path and get `default`. Repeated rows give repeated results, empty tables
    empty ones; other columns of pages are left out, so their names can't clash.
    """
    small_batches(pages.sparkSession)
    listed = cut(rules.select("host", "path", "verdict").distinct().withColumn("rule_id", F.xxhash64("host", "path", "verdict")))
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = cut(parsed)
    hosts = parsed.filter("host <> ''").select("host", "path").distinct()
    won = match(hosts, listed).join(listed.select("rule_id", F.concat("host", "path").alias("rule"), "verdict"), "rule_id").drop("rule_id")
    return parsed.join(won, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
