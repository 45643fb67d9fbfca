"""The corpus pipeline: documents without toxic ones, one of each group of near copies, without benchmark items, mixed
to the sources' targets, and placed on shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Rows whose doc_id is null are never rejected as copies or for benchmark items
(they can't be told apart by id); rows that share a doc_id share its decision.

Defined cases: a null or empty text is no copy, holds no item and is toxic only if texts of no words score so; in the mix
it passes with the documents around it in its source's queue, once an epoch, and beyond the last of them not at all. Very
long texts are judged whole. Ties go as in each operator: of equal texts the least doc_id stays. An empty table gives no
rows. docs has to have all of COLUMNS; further columns, whatever their names, are dropped by the first stage that selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemesh.llm import decontamination, mixing, ngram_join, sharding, toxicity
from wavemesh.llm.shared import by_ids, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ends of sources in the mix that are broadcast; beyond, a source's documents are dealt over so many tasks.
MOST_CUTS, SALTS = 100_000, 64


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among the rejected ones; no id is only known by the driver."""
    return by_ids(docs, rejected, "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.REJECT_FROM).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram similarity, the one of least doc_id stays."""
    found = stored(ngram_join.join(docs), "pipeline-groups")
    return _without(docs, found.where("component_id <> doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_items(docs, items, keep=COLUMNS).where(F.size("finds") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each epoch that takes words of it; one that the mix's end cuts stays whole. Rows that
    share a doc_id and a size are taken together."""
    _, entries = mixing.mix(docs)
    cuts = stored(mixing.cuts(entries), "pipeline-cuts")  # a row per source and epoch
    queued = docs.select(*COLUMNS, F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"), mixing.place().alias("place"))
    key = ["no_src", "src"]
    if cuts.count() <= MOST_CUTS:
        cuts = F.broadcast(cuts)
    else:  # a source may hold a third of all documents, so each is dealt over several tasks
        cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        queued, key = queued.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")), [*key, "salt"]
    return queued.join(cuts, key).where("place <= cut").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]
#: Compression distance and edit matching have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
