"""A corpus pipeline over ``documents``: filter, deduplicate, decontaminate, redact, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.llm import bpe, decontaminate, near_dup, queries, secret_scan, toxicity
from lodestep.llm.session import Scratch

#: Documents of this score or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; the lexicon comes from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(toxicity.training_rows(docs, labels, held_out=queries.held_out(F.col("doc_id"))))
    return toxicity.score(docs, lexicon, out="_toxicity").where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8."""
    return near_dup.deduplicate(docs, words=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars brought up to date."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of every document, their number, and whether they decode to the text."""
    coded = bpe.round_trip(docs, queries.RANKS, queries.PATTERN, decoded=None, intact="intact")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        "intact",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret scan", redact_secrets),
    ("byte-level BPE", tokenise),
]

#: No SQL has the lexicon's fit or the merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
