"""Sharding by weighted rendezvous hashing.

Every record draws one number in (0, 1) for each shard from a hash of its key and the shard's number
and goes to the shard of the least -ln(draw) / weight. Shards so get records in proportion to their
weights, and a shard's draws do not depend on the others: a new shard takes records only into itself, and a
shard that goes gives its records to the others without moving anything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.session import number_rows

SHARDS = 8
DRAW_BITS = 52   # of a hash; with half a step added, a double holds them exactly


def key_text(key: str) -> Column:
    """The stable key of a record as text; a null key is the empty text."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(draw) / weight of a record for a shard; the least cost wins."""
    digits = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, DRAW_BITS // 4)
    draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << DRAW_BITS))
    return -F.log(draw) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights) - 1 of a record key; of equal costs the smaller shard."""
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("every shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights)])
    costs = F.transform(shards, lambda x: F.struct(cost(key, x["shard"], x["weight"]).alias("cost"), x["shard"].alias("shard")))
    return F.array_min(costs)["shard"]


def assign_shards(documents: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Where each record of ``documents`` goes: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    ``weights`` has one entry a shard, ``grown`` those after the change (None: one more shard of the mean weight). The key
    and the weights alone decide; records of one key go to one shard, be their texts equal or not. ``size`` is the text's
    UTF-8 bytes plus one. ``slot`` is the place in the shard, gapless from 0: records are put in the order of a
    hash of their keys, then by size and checksum, so a shard reads shuffled and alike on every run.

    A null text counts as empty; null keys are one key; repeated rows are placed as often as they come, one after the
    other; other columns are ignored, whatever their names; an empty table gives no rows. The texts are read once and not
    shuffled. Slots are counted over ranges of (shard, order), so neither a shard nor a key is one task's work.
    """
    grown = [*weights, sum(weights) / len(weights)] if grown is None else list(grown)
    whole = F.coalesce(F.col(text), F.lit(""))
    name = key_text(key)
    rows = documents.select(
        F.col(key).alias("doc_id"), (F.octet_length(whole).cast("bigint") + 1).alias("size"), F.crc32(whole).alias("text_crc32"),
        shard_of(name, weights).alias("shard"), shard_of(name, grown).alias("grown_shard"), F.md5(name).alias("order"))
    # Written, so that sampling the ranges does not read the texts again. Rows that are alike in all columns get a number of their own.
    rows = written(rows, "shards").withColumn("row", F.monotonically_increasing_id())
    placed = number_rows(rows, ["order", "size", "text_crc32", "row"], "slot", ["shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")


def write_shards(documents: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 1) -> None:
    """Write ``documents``, all columns as they are, to a Parquet folder ``shard=N`` for each shard, in up to ``files`` files each.

    Rows are dealt by shard and a hash of the whole row, so neither a hot key nor a hot shard is one task's work if ``files`` is
    set for the size of a shard. A column named shard is written as ``__shard`` (the folder bears the name).
    """
    if "shard" in documents.columns:
        documents = documents.withColumnRenamed("shard", "__shard")
    names = [F.col(f"`{c}`") for c in documents.columns]
    part = F.pmod(F.xxhash64(*names), F.lit(files))
    dealt = documents.withColumn("shard", shard_of(key_text(key), weights))
    dealt.repartition(len(weights) * files, "shard", part).write.partitionBy("shard").parquet(path)
