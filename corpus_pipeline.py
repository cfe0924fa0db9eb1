"""The training-data pipeline: documents in, token ids of what is worth training on out.

Each stage works on all rows that its predecessor kept and returns the columns of `documents`; the last one returns ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, decontaminate, line_dedup, prefix_join, queries, repetition
from chronoweave.llm.common import from_row, table, whole_row
from chronoweave.session import shared_folder

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, row by row: another row's id or text doesn't matter."""
    return repetition.rules(docs, rows=True).where("kept").select(*from_row("row", docs.columns))


def line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; a document that loses all its words that way goes."""
    keyed = docs.select("doc_id", "text", whole_row(docs).alias("row"))
    cleaned = line_dedup.build(keyed).clean(keyed, carry=["row"])
    some_left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = cleaned.withColumn("text", F.col("text").cast("string")).where(some_left)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast("long")
    rows = dict(zip(docs.columns, from_row("row", docs.columns)))
    return left.select(*[F.when(F.col("n_dropped") > 0, new[c]).otherwise(F.col(f"row.c{i}")).alias(c) if c in new else rows[c] for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least id."""
    return prefix_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, question and answer, go, row by row."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), rows=True)
    return found.where("not contaminated").select(*from_row("row", docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number."""
    return bpe.encode(docs, queries.tokenizer_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("line dedup", line), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each writes a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
