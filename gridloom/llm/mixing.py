"""Mixing sources to target weights by a low-discrepancy schedule.

Slots. Slot i of the mix takes the point frac((i + 1) / golden ratio) through the cumulative targets to a source, so any
stretch of the mix holds the sources in their shares. A slot's rank among the slots of its source is the block it takes.

Blocks. A source's documents are shuffled by the MD5 of their id (then by id, size and digest of the text) and laid end to end, again and again, up to the
source's target; this stretch is cut into as many equal-token blocks as the source has slots. Slots and blocks join on
(source, rank). A block gives pieces of documents, so every source meets its target to the word.

Targets. Sources in order of code point, null last, weigh 1, 2, 3, repeating; they share all words by weight. A target
stops at EPOCHS times its source's words; the rest is shared again by weight until no target is above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, cut, packed

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Slots of a schedule at most; blocks grow with the corpus.
SLOTS = 1 << 20
#: Words of a block at least.
LEAST_BLOCK = 256
#: Ranges of the shuffle key in which running sums are taken apart (3 hex digits).
DIGITS = 3
GOLDEN = 0.6180339887498949
#: Tables of sources up to this number of rows (about 60 bytes each) are broadcast.
BROADCAST_SOURCES = 50_000


def _text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit("-"))


def small(listed: DataFrame) -> DataFrame:
    """Broadcast a table with a row for each source if there are few; else the join shuffles."""
    return F.broadcast(listed) if listed.count() <= BROADCAST_SOURCES else listed


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, shuffle, text_key) for every row; a null text has size 0."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("shuffle"), _text_key(F.col(text_col)).alias("text_key"))


def targets(sized: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, ord, source_size, target, words): words is the target to the nearest whole word.

    One row for each source; sources are a listed set, so their windows run in one task.
    """
    listed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("long")
    listed = listed.withColumn("ord", F.row_number().over(order) - 1).withColumn("weight", weight)
    # Water filling: sources in order of cap / weight; one is capped if its cap is below its share of what is left.
    fill = W.orderBy((F.col("source_size") / F.col("weight")), "ord").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    listed = listed.withColumns({
        "before": F.coalesce(F.sum(F.col("source_size") * epochs).over(fill), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(fill), F.lit(0)),
        "total": F.sum("source_size").over(everything),
        "weight_total": F.sum("weight").over(everything),
    })
    left, weight_left = F.col("total") - F.col("before"), F.col("weight_total") - F.col("weight_before")
    listed = listed.withColumn("capped", F.col("source_size") * epochs * weight_left <= left * F.col("weight"))
    listed = listed.withColumns({
        "capped_words": F.sum(F.when(F.col("capped"), F.col("source_size") * epochs).otherwise(0)).over(everything),
        "capped_weight": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything),
    })
    share = (F.col("weight") * (F.col("total") - F.col("capped_words"))).cast("double") / (F.col("weight_total") - F.col("capped_weight")).cast("double")
    listed = listed.withColumn("target", F.when(F.col("capped"), (F.col("source_size") * epochs).cast("double")).otherwise(share))
    return listed.select("source", "ord", "source_size", "target", F.floor(F.col("target") + 0.5).alias("words"))


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, ord, rank, slots): the source and the rank among its source's slots of every slot of the mix.

    goals: one row for each source, small. A source whose target no point hits gets one slot behind the others.
    """
    spark = goals.sparkSession
    total, sources = goals.filter("words > 0").agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, ord int, rank long, slots long")
    n = max(1, min(SLOTS, total // LEAST_BLOCK))
    reached = F.sum("words").over(W.orderBy("ord"))  # one row for each source
    cuts = goals.filter("words > 0").select("ord", ((reached - F.col("words")) / total).alias("low"), (reached / total).alias("high"))
    cells = max(64, min(4 * sources, SLOTS))
    point = ((F.col("slot") + 1) * F.lit(GOLDEN)) % 1.0
    cell = F.floor(F.col("point") * cells)
    ranges = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", cell)
    hit = slots.join(small(ranges), "cell").filter("point >= low and (point < high or high >= 1.0)").select("slot", "ord")
    hit = hit.groupBy("slot").agg(F.min("ord").alias("ord"))
    missed = goals.filter("words > 0").join(hit.select("ord").distinct(), "ord", "left_anti").select((F.lit(n) + F.col("ord")).cast("long").alias("slot"), "ord")
    hit = cut(hit.unionByName(missed).withColumn("part", F.floor(F.col("slot") / 4096)))
    # Ranks by parts of the schedule: a source may hold most slots, so no task sorts a whole source.
    parts = hit.groupBy("ord", "part").agg(F.count("*").alias("n"))
    parts = parts.select("ord", "part", (F.sum("n").over(W.partitionBy("ord").orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(W.partitionBy("ord")).alias("slots"))
    within = F.row_number().over(W.partitionBy("ord", "part").orderBy("slot")) - 1
    return hit.withColumn("at", within).join(parts, ["ord", "part"]).select("slot", "ord", (F.col("base") + F.col("at")).alias("rank"), "slots")


def placed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized with each row's start in its source's shuffled stretch, and its source's goal.

    Running sums are taken within ranges of the shuffle key, on top of the sums of the ranges before, so that a
    source with a third of all rows isn't sorted in one task.
    """
    rows = sized.join(small(goals), sized["source"].eqNullSafe(goals["source"])).select("doc_id", sized["source"], "size", "shuffle", "text_key", "ord", "source_size", "target", "words")
    rows = rows.withColumn("range", F.substring("shuffle", 1, DIGITS))
    sums = rows.groupBy("ord", "range").agg(F.sum("size").alias("n"))
    sums = sums.select("ord", "range", (F.sum("n").over(W.partitionBy("ord").orderBy("range")) - F.col("n")).alias("base"))
    inner = W.partitionBy("ord", "range").orderBy("shuffle", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(sums, ["ord", "range"]).withColumn("start", F.col("base") + F.col("inner")).drop("range", "base", "inner", "shuffle")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    rows: doc_id, source, size, text_key, source_size, target, words, ord, start, row for every row of docs; row is a running
    number of rows. pieces: slot, row, epoch, first, taken: the words [first, first + taken) of the row's text that a
    slot of the mix takes. Reruns agree: the shuffle follows id and text, and equal rows
    can't be told apart. Null and empty texts
    have size 0 and are never taken; a null source is a source of its own, last in order; a source without words has
    target 0. An empty table gives empty results. Other columns are left out, so their names can't clash.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col))
    goals = cut(targets(sized, epochs, weights))
    rows = cut(placed(sized, goals).withColumn("row", F.monotonically_increasing_id()))
    slots = cut(schedule(goals))
    counts = slots.groupBy("ord").agg(F.max("slots").alias("slots"))
    laid = rows.filter("size > 0 and words > 0").join(small(counts), "ord")
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("begin", F.col("start") + F.col("epoch") * F.col("source_size"))
    laid = laid.withColumn("end", F.least(F.col("begin") + F.col("size"), "words")).filter("begin < end")
    # Block r of a source holds the words from floor(r * words / slots) on.
    def block(at: str):
        return F.expr(f"cast((cast({at} + 1 as decimal(38, 0)) * slots - 1) div words as bigint)")

    def edge(rank: str):
        return F.expr(f"cast((cast({rank} as decimal(38, 0)) * words) div slots as bigint)")

    pieces = laid.withColumn("rank", F.explode(F.sequence(block("begin"), block("(end - 1)"))))
    pieces = pieces.withColumns({"low": F.greatest("begin", edge("rank")), "high": F.least("end", edge("(rank + 1)"))}).filter("low < high")
    pieces = pieces.join(slots.select("slot", "ord", "rank"), ["ord", "rank"]).select("slot", "row", "epoch", (F.col("low") - F.col("begin")).alias("first"), (F.col("high") - F.col("low")).alias("taken"))
    return rows, pieces


def taken_rows(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, text_key, source_size, target, taken) for every row of docs."""
    rows, pieces = mix(docs, **options)
    used = pieces.groupBy("row").agg(F.sum("taken").alias("taken"))
    return rows.join(used, "row", "left").select("doc_id", "source", "size", "text_key", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs: the words that the mix takes of it."""
    return taken_rows(docs, **options).drop("text_key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them, whole and in its order: a row stands where the slot begins that takes its first word.

    A copy is there if the mix takes at least half of its words; only the document at the end of a source's stretch is
    taken in part, so the rounding moves one document for each source. The result is range-partitioned and sorted by
    slot, so the written files follow the schedule. Repeated rows give the copies of all of them. Null and empty texts
    are never taken; a null source is a source of its own. An empty table gives an empty one. The columns stay as they
    are, whatever their names.
    """
    rows, pieces = mix(docs, id_col, text_col, source_col, **options)
    copies = pieces.groupBy("row", "epoch").agg(F.sum("taken").alias("taken"), F.min_by("slot", "first").alias("slot"))
    on = ["id", "origin", "text_key"]
    placed_ = copies.join(rows.select("row", "size", _plain(F.col("doc_id")).alias("id"), _plain(F.col("source")).alias("origin"), "text_key"), "row").filter("2 * taken >= size")
    placed_ = cut(placed_.select(*on, "row", "slot"))
    counts = placed_.groupBy(*on).agg(F.count_distinct("row").alias("rows"))
    keyed = packed(docs, id=_plain(F.col(id_col).cast("long")), origin=_plain(F.col(source_col)), text_key=_text_key(F.col(text_col)))
    repeated = cut(counts.filter("rows > 1").select(*on))
    if not repeated.isEmpty():
        once = keyed.join(repeated, on, "left_semi").groupBy(*on).agg(F.first("row").alias("row"))
        keyed = keyed.join(repeated, on, "left_anti").unionByName(once)
    out = keyed.join(placed_.select(*on, "slot"), on)
    return out.repartitionByRange("slot", "id", "text_key").sortWithinPartitions("slot", "id", "text_key").select("row.*")


def _plain(column: Column) -> Column:
    """A string that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))
