"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns they were given, whatever their names. Null and empty texts pass the
filters that they don't offend; an empty table passes all stages as one. This
module belongs to ``corpusloom.llm`` and goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.shared import discard, materialize, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity chain does not predict to be toxic; rows that repeat an id or a text fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):  # they hold while the rows are written; in batches of 10,000 rows a task's texts are held at once
        return materialize(toxicity.toxicity(docs, labels, carry=True).filter(F.col("predicted") == 0).select("_row.*"), "clean")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null as empty): that of the least id, a null id only if there is no other."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts, that of the least id; rows without words stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is one of its own, rows without words go."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens; texts of any length are cut, never dropped."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs if hasattr(docs, "_corpusloom_folder") else materialize(docs, f"stage{k}")
            discard(before)
    return docs
