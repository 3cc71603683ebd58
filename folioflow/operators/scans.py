"""Running values over a book's pages, whatever a book's size.

A window over a whole book would put all its pages in one task. Here a book is
cut into blocks of pages; each block is a window of its own, and only one row
of each block takes part in the window over the book.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def cut(df: DataFrame) -> DataFrame:
    """Made once, as a table in the shared checkpoint folder: what follows reads it twice, and lineage ends here."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(folder)
    folder = folder if ":" in folder else "file://" + os.path.abspath(folder)
    path = f"{folder}/folioflow/scan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return cut(df.withColumn("_block", F.floor(F.col(order) / BLOCK)))


def _with_before(df: DataFrame, keys: list[str], total: Column, over_blocks) -> DataFrame:
    blocks = df.groupBy(*keys, "_block").agg(total.alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(blocks.select(*keys, "_block", over_blocks(F.col("_total")).over(w).alias("_before")), [*keys, "_block"], "left")


def running_sum(df: DataFrame, value: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """Sum of value over all rows of the same keys up to this one; order[0] is a number that blocks are cut by."""
    df = _with_before(_blocked(df, order[0]), keys, F.sum(value), F.sum)
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_block", "_before")


def running_max_before(df: DataFrame, value: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """Greatest value of all rows before this one; null for the first."""
    df = _with_before(_blocked(df, order[0]), keys, F.max(value), F.max)
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.greatest("_before", F.max(value).over(w))).drop("_block", "_before")


def carry_forward(df: DataFrame, value: str, out: str, keys: list[str], order: list[str], inclusive: bool = True) -> DataFrame:
    """The last value that isn't null, up to this row."""
    at = F.struct(*order, F.col(value))
    df = _with_before(_blocked(df, order[0]), keys, F.max(F.when(F.col(value).isNotNull(), at)), F.max)
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_before")[value])).drop("_block", "_before")


def carry_backward(df: DataFrame, value: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """The next value that isn't null, from this row on."""
    df = _blocked(df, order[0])
    at = F.struct(*order, F.col(value))
    blocks = df.groupBy(*keys, "_block").agg(F.min(F.when(F.col(value).isNotNull(), at)).alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    df = df.join(blocks.select(*keys, "_block", F.min("_total").over(w).alias("_after")), [*keys, "_block"], "left")
    own = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.first(value, ignorenulls=True).over(own), F.col("_after")[value])).drop("_block", "_after")


def previous(df: DataFrame, value: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """The value (not null) of the row before."""
    return carry_forward(df, value, out, keys, order, inclusive=False)
