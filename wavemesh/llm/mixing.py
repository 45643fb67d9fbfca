"""Mixing sources to target weights by weighted fair queueing.

Sources sorted by code point (null last) carry the weights in turn. Their targets share the budget by weight, stop at
a number of epochs of the source, and what is over goes to the others by weight. Within a source the documents stand
in a seeded hash order; a document's virtual finish time is the words of its source up to and with it, divided by the
target. All documents, once for each epoch, are range-sorted by that time over all sources, and the mix is the front of
that order up to the budget: the document that straddles the end is taken in part. So a source comes within a document
or two of its target.

Defined cases: a null or empty text has size 0 and is never taken; a null doc_id is shuffled like the empty string;
rows that repeat are documents of their own; a very long text counts in
whole, and if the end of the mix falls into it, so many of its words are taken; ties in the hash order go by doc_id and size; no rows or no words give
targets of 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, stored

WEIGHTS = (5, 2, 1)
#: Slices of a source whose words are summed ahead; a slice is what one window sorts.
SLICES = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(seed: str) -> Column:
    """What orders the documents of a source."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, epochs: int) -> DataFrame:
    """A row per source: src, no_src, source_size, target. sizes: src, no_src, size.
    Only the per-source sums meet in one task."""
    per = sizes.groupBy("no_src", "src").agg(F.sum("size").alias("source_size"))
    every = W.orderBy("no_src", "src")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * float(epochs)
    # sources fill in the order of cap / weight: a source is capped if, with all before it capped, its share exceeds its cap
    filling = W.orderBy(cap / F.col("weight"), "no_src", "src")
    past = filling.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({"budget": F.sum("source_size").over(all_rows) * budget_share, "capped_before": F.coalesce(F.sum(cap).over(past), F.lit(0.0)), "weight_left": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(past), F.lit(0.0))})
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    per = per.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return per.select("no_src", "src", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, epochs: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, text. Returns the documents (row_id, doc_id, size, source_size, target) and the mix: a row
    per document and epoch that is taken (row_id, epoch, virtual_finish, taken words, position in the mix)."""
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"), words_in(F.col("text")).alias("size"),
        shuffled(seed).alias("key"),
    ).withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % SLICES)
    sizes = stored(sizes, "mix-sizes")
    goal = targets(sizes, weights, budget_share, epochs)
    sums = sizes.groupBy("no_src", "src", "slice").agg(F.sum("size").alias("n"))
    ahead = sums.select("no_src", "src", "slice", F.coalesce(F.sum("n").over(W.partitionBy("no_src", "src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = W.partitionBy("no_src", "src", "slice").orderBy("key", "doc_id", "size", "row_id")
    rows = sizes.join(ahead, ["no_src", "src", "slice"]).join(goal, ["no_src", "src"])
    rows = rows.withColumn("begin", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    rows = stored(rows.select("row_id", "doc_id", "no_src", "src", "key", "size", "source_size", "target", "begin"), "mix-documents")

    budget = rows.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * budget_share).cast("long")).first()[0]
    entries = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("begin", F.col("begin") + F.col("epoch") * F.col("source_size"))
    entries = entries.withColumn("virtual_finish", (F.col("begin") + F.col("size")) / F.col("target"))
    taken = F.least(F.col("size"), F.lit(budget) - F.col("position")).cast("long")
    mixed = positions(entries).withColumn("taken", taken).where("taken > 0")
    return rows.drop("begin", "no_src", "src", "key"), mixed.select("row_id", "doc_id", "no_src", "src", "key", "size", "epoch", "virtual_finish", "taken", "position")


#: What the mix is sorted by, over all sources.
ORDER = ("virtual_finish", "no_src", "src", "begin", "row_id")


def positions(entries: DataFrame) -> DataFrame:
    """The entries sorted into ranges of ORDER over all sources, with position: the words ahead of each in the mix."""
    queue = stored(entries.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id()), "mix-queue")
    spans = queue.groupBy("range").agg(F.sum("size").alias("n"))  # a row for each range
    spans = spans.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return queue.join(F.broadcast(spans), "range").withColumn("position", F.col("ahead") + F.sum("size").over(W.partitionBy("range").orderBy(*ORDER)) - F.col("size"))


def cuts(entries: DataFrame) -> DataFrame:
    """no_src, src, epoch, cut: the last document that the mix takes of each source and epoch, in the order of its queue.
    A document is taken if its `place` isn't behind the cut, so texts needn't move to be mixed."""
    return entries.groupBy("no_src", "src", "epoch").agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))


def place(seed: str = "mix") -> Column:
    """A document's place in the queue of its source."""
    return F.struct(shuffled(seed).alias("key"), F.col("doc_id"), words_in(F.col("text")).alias("size"))
