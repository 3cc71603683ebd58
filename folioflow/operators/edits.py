"""Edits by hand: notes joined to the one before, or parted again; titles, paths and projects matched to books."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

PAGE = ["book", "page_idx"]
#: Marks that a terminal puts around pasted paths.
SMART_QUOTES = "'\"‘’“”"


def recipient(areas: DataFrame, book: str, page_idx: int, area_pos: int) -> DataFrame:
    """The last note area before this one that isn't consolidated: book, page_idx, area_pos, text (no row if there is none).

    An ignored page, or one without notes, between the two breaks the chain.
    """
    own = areas.filter((F.col("book") == book) & ((F.col("page_idx") < page_idx) | ((F.col("page_idx") == page_idx) & (F.col("area_pos") < area_pos))))
    pages = own.groupBy("page_idx").agg(F.max(F.coalesce("ignored", F.lit(False)) | F.lit(False)).alias("ignored"), F.max(F.col("type") == "footnote").alias("notes"))
    # the page itself has notes, whatever stands before the area
    broken = pages.filter((F.col("ignored") | ~F.col("notes")) & (F.col("page_idx") < page_idx)).agg(F.coalesce(F.max("page_idx"), F.lit(-1)).alias("broken"))
    notes = own.filter((F.col("type") == "footnote") & ~T.flag(areas, "consolidated")).join(F.broadcast(broken), F.col("page_idx") > F.col("broken"))
    return notes.orderBy(F.desc("page_idx"), F.desc("area_pos")).limit(1).select("book", "page_idx", "area_pos", "text")


def consolidate_area(areas: DataFrame, book: str, page_idx: int, area_pos: int) -> DataFrame:
    """Both areas as they are afterwards: book, page_idx, area_pos, text, consolidated. No rows where there is nothing to join to, or it is joined already."""
    target = areas.filter((F.col("book") == book) & (F.col("page_idx") == page_idx) & (F.col("area_pos") == area_pos) & ~T.flag(areas, "consolidated"))
    to = recipient(areas, book, page_idx, area_pos)
    both = target.select("book", F.col("page_idx").alias("p"), F.col("area_pos").alias("a"), F.col("text").alias("more")).join(to, "book")
    rows = F.array(
        F.struct("page_idx", "area_pos", T.join_hyphen(F.coalesce("text", F.lit("")), F.coalesce("more", F.lit(""))).alias("text"), F.lit(False).alias("consolidated")),
        F.struct(F.col("p").alias("page_idx"), F.col("a").alias("area_pos"), F.col("more").alias("text"), F.lit(True).alias("consolidated")),
    )
    return both.select("book", F.explode(rows).alias("r")).select("book", "r.*")


def deconsolidate_area(areas: DataFrame, book: str, page_idx: int, area_pos: int) -> DataFrame:
    """Both areas as they are afterwards: the text goes from the end of the one it was joined to (with the hyphen it cost).

    The area itself is told to be a new item (override false).
    """
    target = areas.filter((F.col("book") == book) & (F.col("page_idx") == page_idx) & (F.col("area_pos") == area_pos) & T.flag(areas, "consolidated"))
    to = recipient(areas, book, page_idx, area_pos)
    both = target.select("book", F.col("page_idx").alias("p"), F.col("area_pos").alias("a"), F.col("text").alias("more")).join(to, "book")
    base, cont = F.coalesce("text", F.lit("")), T.strip(F.coalesce("more", F.lit("")))
    left = lambda n: F.substring(base, F.lit(1), F.length(base) - F.length(cont) - n)
    undone = F.when(base.endswith(F.concat(F.lit(" "), cont)), left(1)).when(base.endswith(cont), F.concat(left(0), F.lit("-"))).otherwise(base)
    rows = F.array(
        F.struct("page_idx", "area_pos", undone.alias("text"), F.lit(False).alias("consolidated"), F.lit(None).cast("boolean").alias("override")),
        F.struct(F.col("p").alias("page_idx"), F.col("a").alias("area_pos"), F.col("more").alias("text"), F.lit(False).alias("consolidated"), F.lit(False).alias("override")),
    )
    return both.select("book", F.explode(rows).alias("r")).select("book", "r.*")


def nfc(df: DataFrame, column: str) -> DataFrame:
    """A string column in Unicode's composed form (NFC)."""
    at = df.columns.index(column)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f.isetitem(at, f.iloc[:, at].map(lambda x: x if x is None else unicodedata.normalize("NFC", x)))
            yield f

    return df.mapInPandas(run, df.schema)


def clean_path(c: Column) -> Column:
    """A pasted path without the quotes around it."""
    return T.strip(F.regexp_replace(c, f"^[{SMART_QUOTES}]+|[{SMART_QUOTES}]+$", ""))


def project_of(books: DataFrame, projects: DataFrame) -> DataFrame:
    """Books (book, folder) with their project: by the source's file stem in composed form, else by its folder."""
    b = nfc(books.select("book", "folder", F.col("book").alias("_stem")), "_stem")
    path = F.regexp_replace(clean_path(F.col("source_path")), "/+$", "")
    p = projects.withColumns({"_name": F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""), "_folder": F.regexp_replace(path, r"/[^/]*\.[^/.]*$", "")})
    p = nfc(p.select("id", "title", "author", "year", "_name", "_folder"), "_name")
    by_stem = b.join(p, F.col("_stem") == F.col("_name")).select("book", "id", "title", "author", "year", F.lit(0).alias("rank"))
    by_folder = b.join(p, F.regexp_replace("folder", "/+$", "") == F.col("_folder")).select("book", "id", "title", "author", "year", F.lit(1).alias("rank"))
    w = Window.partitionBy("book").orderBy("rank", "id")
    return by_stem.unionAll(by_folder).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "rank")


def synced_meta(books: DataFrame, matched: DataFrame) -> DataFrame:
    """Books (book, meta) with title, author and year of their project; what the project lacks stays."""
    m = matched.select("book", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "year")])
    j = books.join(m, "book", "left")
    new = F.col("meta")
    for c in ("title", "author", "year"):
        new = new.withField(c, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(f"meta.{c}")))
    return j.withColumn("meta", F.coalesce(new, F.struct(*[F.col(f"_{c}").alias(c) for c in ("title", "author", "year")], F.lit(None).cast("string").alias("cover_path"), F.lit(None).cast("string").alias("source_pdf")))).drop("_title", "_author", "_year")
