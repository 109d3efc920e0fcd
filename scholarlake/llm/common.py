"""Helpers shared by the training-data operators: shared scratch tables, stable
hash splits, and prefix sums that do not put a hot key into one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space code points that the contracts name.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: One or more of them, as a Java regular expression.
ASCII_SPACE_RE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and is local (tests, notebooks) a temporary
    folder is set and remembered in the session; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("scholarlake.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scholarlake-", dir="/tmp")
        spark.conf.set("scholarlake.scratch.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared scratch folder and read it back.

    The plan that follows starts at durable files, so that a lost executor costs
    its own tasks and never the stages before. Texts and token ids take less room by
    zstd than by the default.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of a few fixed-size columns are broadcast up to so many rows (some 100 bytes each in memory).
BROADCAST_ROWS = 500_000


def near(rows: int):
    """Marks a table of so many rows for broadcast where it is small, so that the other side is not shuffled; else leaves it."""
    return F.broadcast if rows <= BROADCAST_ROWS else lambda table: table


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def crc_remainder(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold rule of the contracts."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(modulus))


def blocked_prefix_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, blocks: int = 64
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come before.

    Rows of a key are dealt by hash over ``blocks`` blocks and ordered by (block,
    order). Only the sums of the blocks meet per key; rows are sorted within a
    (key, block) cell, so that a key with a third of all rows is split ``blocks``
    ways. ``value`` must be a non-negative long. Null keys form groups of their own.
    """
    keys = list(keys)
    cells = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks))).withColumn("_value", value.cast("long"))
    totals = cells.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    match = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cells.join(starts, match, "left").withColumn(out, F.col("_start") + F.col("_within"))
    return joined.select(*df.columns, out)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
