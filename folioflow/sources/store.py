"""Upserts by key and sinks."""

from __future__ import annotations

import uuid
import zipfile
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that a user sets; a new detection doesn't touch them.
USER_FIELDS = ("ignored", "process_later", "rotation", "rotation_applied", "skew_angle", "skew_angle_applied", "content_bbox")


def upsert_pages(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = USER_FIELDS) -> DataFrame:
    """Rows of new over those of old with the same keys; fields of ``keep`` stay as they were where they were set."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    j = o.join(n, keys, "full_outer")
    out = list(keys)
    for c in old.columns:
        if c in keys:
            continue
        if c not in new.columns:
            out.append(F.col(f"o.{c}"))
        elif c in keep:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(*out)


def rebuild_books(pages: DataFrame) -> DataFrame:
    """Pages gathered to books, by image name, with their number."""
    cols = [c for c in pages.columns if c not in ("book", "page_idx", "footnote_regime")]
    b = pages.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("source_image", *[c for c in cols if c != "source_image"])), lambda a, b: F.when(a["source_image"] < b["source_image"], -1).when(a["source_image"] > b["source_image"], 1).otherwise(0)).alias("pages"))
    return b.select("book", F.size("pages").alias("total_pages"), "pages")


def dump(rows: DataFrame, path: str) -> None:
    """Raw answers and errors (book, name, text) as text, one folder for each book, beside what is there."""
    rows.select("book", F.to_json(F.struct("name", "text")).alias("value")).write.mode("append").partitionBy("book").text(path)


def backup(spark: SparkSession, path: str) -> str:
    """A copy of a file or table beside it (``.bak``), in place of an older one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    fs.delete(p(f"{path}.bak"), True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p(path), fs, p(f"{path}.bak"), False, conf)
    return f"{path}.bak"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table or file; where a replacement was broken off between its two renames, the old one is put back first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)) and (left := fs.globStatus(p(f"{path}.old-*"))):
        fs.rename(left[0].getPath(), p(path))
    return fs.exists(p(path))


def write_replacing(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write beside the target whole, then rename twice. Between these there is no table at its place: ``exists`` mends that."""
    spark = df.sparkSession
    part, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).save(part)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    if not fs.rename(p(part), p(path)):
        fs.rename(p(old), p(path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(p(old), True)


def write_html(parts: DataFrame, path: str, css: str = "") -> None:
    """(book, pos, html) as one HTML text per book."""
    page = F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{css}</style></head><body>\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n\n"), F.lit("\n</body></html>"))
    parts.groupBy("book").agg(page.alias("value")).write.partitionBy("book").option("lineSep", "\n").text(path)


def write_epub(path: str, title: str, author: str, body: str, toc: list[tuple[str, str]], css: str = "", images: dict[str, bytes] | None = None) -> None:
    """One book as EPUB 3; body is XHTML, toc has (id, text) in order."""
    nav = "".join(f'<li><a href="book.xhtml#{escape(i)}">{escape(t)}</a></li>' for i, t in toc)
    head = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{}</title><link rel="stylesheet" href="style.css"/></head><body>{}</body></html>'
    pics = "".join(f'<item id="im{k}" href="images/{escape(n)}" media-type="image/{"png" if n.endswith("png") else "jpeg"}"/>' for k, n in enumerate(images or {}))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, title + author)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>und</dc:language></metadata>'
        '<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="book" href="book.xhtml" media-type="application/xhtml+xml"/><item id="css" href="style.css" media-type="text/css"/>'
        f'{pics}</manifest><spine><itemref idref="nav"/><itemref idref="book"/></spine></package>'
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/nav.xhtml", head.format(escape(title), f'<nav epub:type="toc"><ol>{nav}</ol></nav>'))
        z.writestr("OEBPS/book.xhtml", head.format(escape(title), body))
        z.writestr("OEBPS/style.css", css)
        for n, data in (images or {}).items():
            z.writestr(f"OEBPS/images/{n}", data)
