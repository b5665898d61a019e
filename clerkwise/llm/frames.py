"""Small Spark helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clerkwise.llm.text_arrays import SLICE_BYTES, slices
from clerkwise.session import shared_folder


Batches = Iterator[pa.RecordBatch]


def map_texts(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType,
              first: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """``run`` over bounded slices of ``df``; ``df`` has a column ``text``. Needs no shuffle.

    ``first`` goes over the batches before, in the same Python worker.
    """
    def work(batches: Batches) -> Batches:
        for part in slices(first(batches) if first else batches, "text", SLICE_BYTES):
            yield run(part)

    return df.mapInArrow(work, schema)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those whose id hashes lowest: the same rows on every run."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and fixes the rows for later steps.

    The shuffle files of the write go with its end, so a job of many steps needs the disk of
    one step. The tables may be deleted once the final result is stored.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def key_map(documents: DataFrame, wanted: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Callable[[Batches], Batches], Broadcast]:
    """``documents`` with a column __slot, a function over batches that leaves out most rows whose ``key`` is not in ``wanted``, and
    the bit map it uses, to be destroyed when the rows are written.

    The bit map of the hashed keys has at most 16 MB; no wanted row is missing. With more keys than bits only less is left out.
    """
    spark = documents.sparkSession
    bits = 1 << min(27, max(16, int(wanted.count() * 8).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = (wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("v")).toPandas())
    bitmap = np.zeros(bits // 32, dtype="<u4")
    bitmap[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)

    def pick(batches: Batches) -> Batches:
        for part in batches:
            s = part.column("__slot").to_numpy(zero_copy_only=False)
            keep = (shared.value[s // 32] >> (s % 32).astype(np.uint32)) & 1
            yield part.filter(pa.array(keep.astype(bool)))

    return documents.select("*", slot.alias("__slot")), pick, shared


def about(documents: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``documents`` less most rows whose ``key`` is not in ``wanted``, so that texts nobody asks for need not be shuffled.

    See ``key_map``. The caller still joins.
    """
    rows, pick, _ = key_map(documents, wanted, key)
    return rows.mapInArrow(pick, rows.schema).drop("__slot")


def join_one(rows: DataFrame, ones: DataFrame, key: str, times: str = "times") -> DataFrame:
    """Inner join of ``rows`` with ``ones``, which has one row for each ``key`` and in ``times`` how often the key comes in ``rows``.

    Keys that hold more than a five-hundredth of all rows, and there are fewer than five hundred of them, are dealt out: their rows go to as many
    tasks as it takes, and their one row to each of these.
    """
    most = max(10_000, rows.count() // 512)
    parts = F.ceil(F.col(times) / most).cast("int")
    hot = ones.where(F.col(times) > most).select(F.col(key).alias("__hot"), parts.alias("__parts"))
    # Below ``rows / most`` keys, so at most 512.
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    names = [F.col(f"`{c}`") for c in rows.columns]
    dealt = dealt.withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*names), F.col("__parts")))).drop("__hot", "__parts")
    copies = ones.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))))
    return dealt.withColumn("__part", F.col("__part").cast("bigint")).join(copies, [key, "__part"]).drop("__part")
