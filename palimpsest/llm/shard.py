"""Contiguous shards of equal bytes from global prefix sums. DataFrame functions only.

Slim rows (id, size, checksum; no text) are range-partitioned by id and written once. Per-partition totals of
bytes and rows, one row per partition, become each partition's starting point; a running sum inside the
partition does the rest. The total is cut at equal targets: a row goes to the shard its middle byte falls in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.lineage import cut


def shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``; ``law`` is 'bytes': shards are
    contiguous in doc_id (null first) and their sizes differ from an equal share by less than one document.
    ``slot`` counts from 0 inside a shard, ``grown_shard`` is null. Repeated rows are rows of their own, also
    when one id has most rows: a drawn last key spreads equal rows over partitions. An empty table gives no
    rows; columns besides id and text are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    slim = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.rand(7).alias("_draw"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # written once: partition numbers and draws are data from here on, the same in every branch and on every retry
    laid = cut(slim.repartitionByRange(parts, "doc_id", "text_crc32", "_draw").withColumn("_part", F.spark_partition_id()))

    # one row per partition
    totals = laid.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(W.partitionBy()).alias("_all"),
    )
    inside = W.partitionBy("_part").orderBy("doc_id", "text_crc32", "_draw").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        laid.withColumn("_upto", F.sum("size").over(inside)).withColumn("_n", F.count("*").over(inside))
        .join(F.broadcast(starts), F.col("_part") == F.col("_p"))
        .withColumn("_row", F.col("_rows0") + F.col("_n") - 1)
        .withColumn("_twice", 2 * (F.col("_bytes0") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (_twice * {n_shards}) div (2 * _all)) as int)"))
    )
    # one row per shard
    firsts = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("_s")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
