"""Ordered areas from a table of plain texts, and the same view as SQL.

A text's source is its book, the text a page, each line an area. What the
lines lack (markers, leaders, rectangles, illustrations, flags) is set by
arithmetic on the page number and the line's place, alike in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA_KEYS = ["book", "page_idx", "area_pos"]


def area_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page_idx, area_pos, type, text, ignored, override, x0, y0, x1, y1, illustration_id, linked_illustration_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")
    e = d.select(F.col("source").alias("book"), F.col("doc_id").alias("page_idx"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line"))
    e = e.withColumn("area_pos", F.col("p").cast("long")).drop("p")
    m = lambda a, b: F.pmod(F.col("page_idx") * a + F.col("area_pos"), F.lit(b))
    kind = (
        F.when(F.col("area_pos") == 0, "chapter_title")
        .when(m(7, 5) == 0, "footnote")
        .when(m(5, 23) == 0, "illustration")
        .when(m(5, 23) == 1, "illustration_caption")
        .when(m(3, 29) == 2, "subtitle")
        .otherwise("main_text")
    )
    e = e.withColumn("type", kind)
    note, body = F.pmod(F.col("area_pos") * 3, F.lit(10)) + 1, F.pmod(F.col("area_pos"), F.lit(10)) + 1
    end = F.when(m(3, 11) == 0, "-").otherwise("")
    text = (
        F.when((F.col("type") == "footnote") & (m(1, 4) == 0), F.concat("line", end))
        .when((F.col("type") == "footnote") & (m(1, 9) == 1), F.concat(F.lit("* "), "line", end))
        .when(F.col("type") == "footnote", F.concat(note.cast("string"), F.when(m(1, 6) < 3, ". ").otherwise(" "), "line", end))
        .when((F.col("type") == "main_text") & (m(1, 9) == 1), F.concat("line", F.lit("<sup>*</sup>"), end))
        .when((F.col("type") == "main_text") & (m(1, 3) != 0), F.concat("line", F.lit("<sup>"), body.cast("string"), F.lit("</sup>"), end))
        .when((F.col("type") == "main_text") & (m(1, 12) == 0), F.concat(F.lit("He said \"so\""), body.cast("string"), F.lit(" "), "line", end))
        .when(F.col("type") == "illustration_caption", F.concat(F.when(m(1, 4) == 0, "<<< ").when(m(1, 4) == 1, ">>> ").otherwise(""), "line"))
        .when(F.col("type") == "illustration", None)
        .when((F.col("area_pos") == 0) & (F.pmod("page_idx", F.lit(40)) == 0), "Notes")
        .when((F.col("area_pos") == 0) & (F.pmod("page_idx", F.lit(8)) == 0), F.concat((F.floor(F.col("page_idx") / 8) % 12 + 1).cast("string"), F.lit(". "), "line"))
        .otherwise(F.col("line"))
    )
    left = (F.pmod("page_idx", F.lit(3)) == 0) & (F.pmod("area_pos", F.lit(2)) == 0)
    right = (F.pmod("page_idx", F.lit(3)) == 0) & (F.pmod("area_pos", F.lit(2)) == 1)
    e = e.withColumns({
        "text": text,
        "ignored": F.pmod("page_idx", F.lit(17)) == 0,
        "override": F.when(m(1, 13) == 0, True).when(m(1, 13) == 1, False),
        "x0": F.when(right, 540).otherwise(80).cast("long"),
        "x1": F.when(left, 460).otherwise(920).cast("long"),
        "y0": F.when(F.pmod("page_idx", F.lit(3)) == 0, 100 + 60 * F.floor(F.col("area_pos") / 2)).otherwise(100 + 60 * F.col("area_pos")).cast("long"),
        "illustration_id": F.when(F.col("type") == "illustration", F.concat(F.lit("illus_"), F.col("area_pos").cast("string"))),
        "linked_illustration_id": F.when((F.col("type") == "illustration_caption") & (m(1, 4) > 1), F.concat(F.lit("illus_"), (F.col("area_pos") - 1).cast("string"))),
    }).withColumn("y1", F.col("y0") + 50)
    return e.drop("line")


#: The view for DuckDB: put it before a query that selects from areas.
AREAS = r"""
WITH raw AS (
    SELECT source AS book, doc_id AS page_idx, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS area_pos,
           unnest(string_split(coalesce(text, ''), chr(10))) AS line
    FROM documents
), typed AS (
    SELECT *, CASE WHEN area_pos = 0 THEN 'chapter_title' WHEN (page_idx * 7 + area_pos) % 5 = 0 THEN 'footnote'
                   WHEN (page_idx * 5 + area_pos) % 23 = 0 THEN 'illustration' WHEN (page_idx * 5 + area_pos) % 23 = 1 THEN 'illustration_caption'
                   WHEN (page_idx * 3 + area_pos) % 29 = 2 THEN 'subtitle' ELSE 'main_text' END AS type,
           CASE WHEN (page_idx * 3 + area_pos) % 11 = 0 THEN '-' ELSE '' END AS ending,
           (area_pos * 3) % 10 + 1 AS note, area_pos % 10 + 1 AS body, page_idx + area_pos AS s
    FROM raw
), areas AS (
    SELECT book, page_idx, area_pos, type,
           CASE WHEN type = 'footnote' AND s % 4 = 0 THEN line || ending
                WHEN type = 'footnote' AND s % 9 = 1 THEN '* ' || line || ending
                WHEN type = 'footnote' THEN note || CASE WHEN s % 6 < 3 THEN '. ' ELSE ' ' END || line || ending
                WHEN type = 'main_text' AND s % 9 = 1 THEN line || '<sup>*</sup>' || ending
                WHEN type = 'main_text' AND s % 3 <> 0 THEN line || '<sup>' || body || '</sup>' || ending
                WHEN type = 'main_text' AND s % 12 = 0 THEN 'He said "so"' || body || ' ' || line || ending
                WHEN type = 'illustration_caption' THEN CASE s % 4 WHEN 0 THEN '<<< ' WHEN 1 THEN '>>> ' ELSE '' END || line
                WHEN type = 'illustration' THEN NULL
                WHEN area_pos = 0 AND page_idx % 40 = 0 THEN 'Notes'
                WHEN area_pos = 0 AND page_idx % 8 = 0 THEN ((page_idx // 8) % 12 + 1) || '. ' || line
                ELSE line END AS text,
           page_idx % 17 = 0 AS ignored,
           CASE s % 13 WHEN 0 THEN true WHEN 1 THEN false END AS override,
           CASE WHEN page_idx % 3 = 0 AND area_pos % 2 = 1 THEN 540 ELSE 80 END AS x0,
           CASE WHEN page_idx % 3 = 0 AND area_pos % 2 = 0 THEN 460 ELSE 920 END AS x1,
           CASE WHEN page_idx % 3 = 0 THEN 100 + 60 * (area_pos // 2) ELSE 100 + 60 * area_pos END AS y0,
           CASE WHEN page_idx % 3 = 0 THEN 150 + 60 * (area_pos // 2) ELSE 150 + 60 * area_pos END AS y1,
           CASE WHEN type = 'illustration' THEN 'illus_' || area_pos END AS illustration_id,
           CASE WHEN type = 'illustration_caption' AND s % 4 > 1 THEN 'illus_' || (area_pos - 1) END AS linked_illustration_id
    FROM typed
)
"""
