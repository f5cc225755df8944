"""A training corpus from the documents: toxic texts and near copies go, benchmark passages go, sources are mixed to
their target weights, and what is left is packed in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import toxicity
from terrasift.llm.decontamination import drop_contaminated
from terrasift.llm.durable import written
from terrasift.llm.jaccard import drop_near_duplicates
from terrasift.llm.mixing import mixed_documents
from terrasift.llm.sharding import shard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below the threshold. Null and empty texts score the base rate and stay while that is low; equal
    texts are judged alike; without labels, or with one label only, all rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, toxicity.learnable()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that with the smallest id. Texts without words are no copies and stay, but
    rows of one id and text are one."""
    return drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a benchmark window. Texts without words hold none and stay; items without words have none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in order of position; null is a source. A row without words is taken in every
    whole pass over its source."""
    return mixed_documents(docs)


def pack_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots follow the order of the mix, which is that of the rows in the files of docs; without files, hashed order."""
    return shard(docs, place_in=(F.col("_metadata.file_path"), F.col("_metadata.row_index")) if docs.inputFiles() else None)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("sharding", pack_shards),
]

#: Nearest examples, connected components and greedy packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the stored rows of the one before.

    Texts that are null or have no words aren't toxic, are no copies, hold no windows, and weigh nothing in the mix, which
    takes them in every whole pass over their source. Rows of one id are one document from the second stage on; without an id, equal texts are. Ties
    go to the smaller id, then by hash. An empty table gives no rows; columns of any other name pass through to the last
    stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
