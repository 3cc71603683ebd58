"""Readers: book JSON, sidecars, page images, model lists, the project registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<left:int,top:int,right:int,bottom:int>"
AREA = "struct<id:string,type:string,polygon:array<array<int>>,text:string,table_html:string,illustration_id:string,linked_illustration_id:string,consolidated:boolean,is_running_continuation:boolean>"
PAGE = {
    "source_image": "string", "page_dimensions": "struct<width:int,height:int>", "content_bbox": BOX, "rotation": "int", "rotation_applied": "int", "skew_angle": "double", "skew_angle_applied": "double",
    "ignored": "boolean", "process_later": "boolean", "prohibited": "boolean", "polished": "boolean", "footnote_consolidated": "boolean", "detected_by": "string", "page_join": "string", "areas": f"array<{AREA}>",
}
BOOK = {
    "book": "string", "total_pages": "int", "footnote_regime": "string", "endnotes_start_page": "string",
    "meta": "struct<title:string,author:string,year:string,cover_path:string,source_pdf:string>", "pages": "array<struct<" + ",".join(f"{k}:{v}" for k, v in PAGE.items()) + ">>",
}
# The kinds of areas.
AREA_TYPES = (
    "header", "footer", "page_number", "illustration", "main_text", "illustration_caption", "footnote", "decoration",
    "chapter_title", "marginalia", "table", "subtitle", "quote", "title_page",
)


def ddl(fields: dict[str, str]) -> str:
    """Fields as a reader's schema."""
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per book file, with the fixed schema and its path; a file that can't be read has nulls."""
    return spark.read.schema(ddl(BOOK)).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())


def pages_of(books: DataFrame) -> DataFrame:
    """One row per page, in order. ``has_areas`` tells pages that were processed (and may hold none)."""
    name = F.coalesce("book", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    p = books.select(name.alias("book"), "footnote_regime", "endnotes_start_page", F.posexplode("pages").alias("page_idx", "page"))
    return p.select("book", "footnote_regime", "endnotes_start_page", F.col("page_idx").cast("long"), "page.*").withColumn("has_areas", F.col("areas").isNotNull())


def areas_of(pages: DataFrame) -> DataFrame:
    """One row per area that isn't null, with its place and the page's flags."""
    dims = [F.coalesce("page_dimensions.width", F.lit(1000)).alias("page_w"), F.coalesce("page_dimensions.height", F.lit(1000)).alias("page_h"), F.coalesce("rotation", F.lit(0)).alias("rotation")]
    keep = ["book", "page_idx", "source_image", "page_join", "ignored", "page_w", "page_h", "rotation"]
    a = pages.withColumn("ignored", F.coalesce("ignored", F.lit(False))).select(*keep[:5], *dims, F.posexplode("areas").alias("area_pos", "a"))
    a = a.filter("a IS NOT NULL").select(*keep, F.col("area_pos").cast("long"), "a.*")
    x, y = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    box = {"x0": F.array_min(x), "y0": F.array_min(y), "x1": F.array_max(x), "y1": F.array_max(y)}
    return a.withColumns({k: v.cast("long") for k, v in box.items()}).withColumn("override", F.col("is_running_continuation"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from ``*-areas.json`` files; of files for one page the last by name counts, unreadable ones don't."""
    raw = spark.read.schema(ddl(PAGE)).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*-areas.json").json(folder)
    raw = raw.withColumn("path", F.input_file_name()).filter("source_image IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("source_image").orderBy(F.col("path").desc())) == 1
    return raw.withColumn("last", last).filter("last").drop("last", "path")


def read_images(spark: SparkSession, folder: str, overlays: bool = False) -> DataFrame:
    """Page images by name, without dot files and (unless asked for) drawn overlays: path, page_no, image."""
    im = spark.read.format("image").option("dropInvalid", True).load(folder).withColumn("path", F.col("image.origin"))
    im = im.filter(~F.col("path").rlike(r"/\.[^/]*$"))
    if not overlays:
        im = im.filter(~F.col("path").rlike(r"-(areas|content)\.\w+$"))
    return im.withColumn("page_no", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int"))


# What counts as a page image.
IMAGE_ENDS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def number_images(files: DataFrame) -> DataFrame:
    """Files (path) of a folder as pages: those that are images and no dot files, by name, renumbered from 1: path, name, page, stem."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = files.withColumn("name", name).filter(~F.col("name").startswith(".") & F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*IMAGE_ENDS))
    k = F.row_number().over(Window.orderBy("name"))  # a folder's listing: one book's pages
    return own.select("path", "name", k.cast("long").alias("page")).withColumn("stem", F.format_string("page%04d", "page"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length of a folder's files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def find_book(spark: SparkSession, folder: str, name: str | None = None) -> str:
    """The path of a book's JSON: by its name, or the only one there is (``book.json`` apart)."""
    found = sorted(r.path for r in list_files(spark, folder, "*.json").collect())  # one row for each book
    found = [p for p in found if p.rpartition("/")[2] == f"{name}.json"] if name else [p for p in found if p.rpartition("/")[2] != "book.json"]
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}: {len(found)} book files" + (f" named {name}" if name else "; give a name"))
    return found[0]


def page_lookup(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Images (stem, width, height) with what is known of their pages; sizes of the image where the page has none."""
    p = pages.withColumn("stem", F.regexp_replace("source_image", r"\.[^.]*$", ""))
    j = images.join(p.select("stem", "book", "page_idx", "page_dimensions", "ignored", "has_areas"), "stem", "left")
    size = lambda c: F.coalesce(f"page_dimensions.{c}", c).alias(c)
    return j.select("stem", "book", "page_idx", size("width"), size("height"), F.coalesce("ignored", F.lit(False)).alias("ignored"), F.coalesce("has_areas", F.lit(False)).alias("processed"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``[N] provider:model``, in order: tag, provider, model; comments and other providers are left out."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    at = lambda k: F.regexp_extract("value", r"^\s*\[(\w+)\]\s+(\w+):(\S+)", k)
    return t.filter(~F.col("value").rlike(r"^\s*#")).select("line", at(1).alias("tag"), at(2).alias("provider"), at(3).alias("model")).filter(F.col("provider").isin("gemini", "openrouter"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The registry's projects; the old name of source_path still counts."""
    kind = "projects array<struct<id:string,title:string,author:string,year:string,source_path:string,pdf_path:string,cover_path:string,detect_content:boolean,styles:string,created_at:string,ocr_model:string>>"
    p = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("projects").alias("p")).select("p.*")
    return p.withColumn("source_path", F.coalesce("source_path", "pdf_path")).drop("pdf_path")
