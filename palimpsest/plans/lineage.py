"""Cutting lineage of iterative jobs, and ranks over a whole table without a one-task sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame, *, laid: bool = False) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a scratch folder of its own. A checkpoint of an
    adaptive plan does not tell how its rows are dealt; ``laid`` plans it without, so that later windows, aggregates
    and joins on the same key need no shuffle. It is meant for plans whose inputs lie by that key already.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    if not laid:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def lay(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` into ``n`` partitions, in a layout that later plans know. What leads to it is planned
    adaptively and written first."""
    return cut(cut(df).repartition(n, key), laid=True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


#: A side is broadcast by hand only when a bounded count has shown that it holds no more rows than this.
BROADCAST_ROWS = 500_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``rows`` rows; the job stops as soon as it has seen more."""
    return df.limit(rows + 1).count() <= rows


def hash_rank(df: DataFrame, key: Column, out: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Row numbers (from 1) over md5 order, without sorting the table in one task.

    The first three hex digits of the key split every group into 4,096 even buckets; buckets are
    counted (map-side combined), the counts turned into offsets, and rows ranked inside their
    bucket. ``by`` restarts the numbering per group; a group that holds most rows still spreads
    over all buckets.
    """
    by = by or []
    keyed = df.withColumn("_key", key).withColumn("_b", F.left(F.col("_key"), F.lit(3)))
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
        - F.col("_n"),
    ).drop("_n")
    ranked = keyed.withColumn(
        "_r", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_key"))
    )
    joined = ranked.join(offsets, [*by, "_b"]) if by else ranked.join(offsets, "_b")
    return joined.withColumn(out, F.col("_r") + F.col("_off")).drop("_key", "_b", "_r", "_off")
