"""Sidecars as a stream: each new file is a page to upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.sources.books import PAGE, ddl
from folioflow.sources.store import exists, upsert_pages, write_replacing


def sidecar_stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.schema(ddl(PAGE)).option("multiLine", True).option("pathGlobFilter", "*-areas.json").json(folder)
    return raw.withColumn("path", F.input_file_name()).filter("source_image IS NOT NULL")


def upsert_stream(pages: DataFrame, table: str, checkpoint: str, key: str = "source_image") -> StreamingQuery:
    """Keep a Parquet table of pages up to date; user fields already set stay."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (key, "path")]), "path").alias("p")).select(key, "p.*")
        old = spark.read.schema(new.schema).parquet(table) if exists(spark, table) else spark.createDataFrame([], new.schema)
        write_replacing(upsert_pages(old, new, [key]), table, "parquet")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
