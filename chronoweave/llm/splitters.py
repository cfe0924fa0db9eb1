"""Operator 10, sharding: sampled splitters.

Records are ordered by a key (the hash of the text, so equal texts lie together). A size-weighted sample of keys gives
quantile boundaries, the boundaries give ranges, and a range that is overfull (one key may hold a third of all rows) is
subdivided by a hash of the record. Running sizes over the ordered cells then put every record where its first byte falls.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import pin

FAN = 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most `key`: first among every 32nd, then among the 32 that follow."""
    if not splitters:
        return F.lit(0)
    every = F.array(*[F.lit(s) for s in splitters[::FAN]])
    blocks = F.array(*[F.array(*[F.lit(s) for s in splitters[i : i + FAN]]) for i in range(0, len(splitters), FAN)])
    at = F.size(F.filter(every, lambda s: s <= key))
    inner = F.size(F.filter(F.element_at(blocks, F.greatest(at, F.lit(1))), lambda s: s <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * FAN + inner)


def weighted_splitters(sizes: DataFrame, total: int, ranges: int, sample_rows: int) -> list[int]:
    """Quantile boundaries of a sample in which a record's chance grows with its size; about `sample_rows` rows at most."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(sample_rows / max(total, 1)))
    uniform = F.pmod(F.xxhash64("key", "tie", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sizes.where(uniform < chance).select("key", (F.col("size") / chance).alias("weight")).collect()
    drawn = sorted((r.key, r.weight) for r in drawn)
    step, run, cuts = sum(w for _, w in drawn) / ranges, 0.0, []
    for key, weight in drawn:
        run += weight
        if len(cuts) < ranges - 1 and run >= step * (len(cuts) + 1):
            cuts += [key] * (int(run / step) - len(cuts))
    # A key that fills whole ranges gets a range of its own, which is then subdivided.
    hot = {k for k, n in ((k, cuts.count(k)) for k in set(cuts)) if n > 1}
    return sorted({*cuts, *(k + 1 for k in hot if k < (1 << 63) - 1)})


def shard(
    docs: DataFrame, shards: int = 8, ranges_per_shard: int = 128, samples_per_range: int = 16, key: Column | None = None
) -> DataFrame:
    """Put every record into one of `shards` ranges of nearly equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. `samples_per_range * ranges` bounds the expected sample.
    NULL or empty text has size 1 and crc 0; a NULL doc_id is an ordinary value; repeated rows each get a slot of their own;
    no rows give no rows. Sizes of shards differ by less than one record each way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.xxhash64(text) if key is None else key.cast("long")).alias("key"),
        F.xxhash64(F.col("doc_id"), F.lit("tie")).alias("tie"),
    )
    sizes = pin(narrow)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    splitters = weighted_splitters(sizes, total, ranges, ranges * samples_per_range)
    ranged = sizes.withColumn("range", _range_of(F.col("key"), splitters))

    # Overfull ranges are subdivided; at most as many cells as 3 * ranges come out, so what is collected is bounded.
    most = max(1.0, 1.5 * total / ranges)
    full = {r["range"]: int(r["bytes"] // most) + 1 for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    parts = F.element_at(F.array(*[F.lit(full.get(i, 1)) for i in range(len(splitters) + 1)]), F.col("range") + 1)
    celled = ranged.withColumn("cell", F.when(parts > 1, F.pmod(F.col("tie"), parts)).otherwise(F.lit(0)).cast("int"))

    cells = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    cells = sorted((c["range"], c["cell"], c["bytes"], c["rows"]) for c in cells)
    spark, offsets, at_byte, at_row = docs.sparkSession, [], 0, 0
    for r, c, size, rows in cells:
        offsets.append((r, c, at_byte, at_row))
        at_byte, at_row = at_byte + size, at_row + rows
    offsets = spark.createDataFrame(offsets, "range int, cell int, byte_at long, row_at long")
    order = Window.partitionBy("range", "cell").orderBy("key", "tie", "doc_id", "size")
    placed = pin(
        celled.join(F.broadcast(offsets), ["range", "cell"])
        .withColumn("first_byte", F.col("byte_at") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.col("row_at") + F.row_number().over(order) - 1)
        .withColumn("shard", F.floor((F.col("first_byte") + F.col("size") / 2) * shards / F.lit(max(total, 1))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    starts = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


