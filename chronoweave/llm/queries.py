"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, compact_windows, decontaminate, fill_middle, line_dedup, packing, prefix_join, repetition, run_index, secret_scan, slots, splitters, whitening,
)
from .common import table

TOKENIZER = "CHRONOWEAVE_TOKENIZER"


def tokenizer_path() -> str:
    """The vocabulary file; a parameter of the operator, here from the environment or the public package."""
    if TOKENIZER in os.environ:
        return os.environ[TOKENIZER]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = line_dedup.build(docs).clean(docs, 5)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("kept_sha256"))


def op2_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar(table(spark, sf_dir, "documents"))


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = run_index.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(table(spark, sf_dir, "documents"))


def op6_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fit, _ = secret_scan.held_out(secret_scan.labelled_sample(docs))
    model = secret_scan.ratios(fit)
    return secret_scan.digest(secret_scan.scan(docs, model))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of token ids and reads them back: one row per sequence with its slot, shard and the checksum of its ids."""
    layout = slots.materialise(table(spark, sf_dir, "documents"), vocabulary_file=tokenizer_path())
    n_ids = (F.octet_length("ids") * layout.length / layout.stride).cast("long")
    return slots.read(spark, layout).select("slot", "shard", n_ids.alias("n_ids"), F.crc32("ids").alias("ids_crc32"))


def op9_bpe_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard(table(spark, sf_dir, "documents"), 8)


def op11_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
    return packed.placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_prefix_join, op3_run_index, op4_decontamination, op5_repetition_rules, op6_secret_models, op7_compact_windows, op8_training_order,
        op9_bpe_ranks, op10_sampled_splitters, op11_certified_packing, op12_embedding_whitening, op13_fill_middle,
    )
}
ORACLES: dict[str, str] = {"op13_fill_middle": fill_middle.SQL}
