"""Queries over single pages: counts, markers, entries, clean-up, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import expand, layout, reports, sequence
from folioflow.plans.registry import query
from folioflow.sources.view import AREAS, area_view

BODY = "('main_text', 'quote', 'chapter_title', 'subtitle', 'table')"
BODY3 = "('main_text', 'chapter_title', 'subtitle')"
#: Strips as Unicode-aware trimming does.
TRIM = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
T_TEXT = TRIM.format("text")
LEAD = rf"TRY_CAST(coalesce(nullif(regexp_extract({T_TEXT}, '^<sup>(\d+)</sup>', 1), ''), nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '')) AS BIGINT)"
KEYS = ["book", "page_idx", "area_pos"]


@query(AREAS + rf"""
, p AS (
    SELECT book, page_idx,
           CAST(coalesce(sum(len(regexp_extract_all(text, '<sup>(\d+|[*†‡§¶|]+)</sup>'))) FILTER (type IN {BODY}), 0) AS BIGINT) AS sup_count,
           count(*) FILTER (type = 'footnote' AND override IS NOT TRUE AND {T_TEXT} <> '') AS fn_count,
           bool_or(type = 'footnote') AS has_fn
    FROM areas WHERE NOT ignored GROUP BY book, page_idx
)
SELECT book, page_idx, sup_count, fn_count, sup_count = fn_count AS matched, has_fn OR sup_count > 0 AS active, false AS is_cons,
       CASE WHEN NOT has_fn AND sup_count = 0 THEN 'none' WHEN sup_count <> fn_count THEN 'red' ELSE 'green' END AS state,
       CASE WHEN NOT has_fn AND sup_count = 0 THEN '' ELSE sup_count || '↑·' || fn_count || 'fn' END AS badge
FROM p
""")
def footnote_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.footnote_review(area_view(spark, sf_dir))


@query(AREAS + rf"""
SELECT book, count(DISTINCT page_idx) AS pages, count(DISTINCT page_idx) FILTER (ignored) AS ignored_pages,
       count(*) FILTER (NOT ignored AND type = 'main_text') AS n_main_text, count(*) FILTER (NOT ignored AND type = 'footnote') AS n_footnote,
       count(*) FILTER (NOT ignored AND type = 'chapter_title') AS n_chapter_title, count(*) FILTER (NOT ignored AND type = 'subtitle') AS n_subtitle,
       count(*) FILTER (NOT ignored AND type = 'illustration') AS n_illustration, count(*) FILTER (NOT ignored AND type = 'illustration_caption') AS n_illustration_caption,
       count(*) FILTER (NOT ignored AND type = 'illustration_caption' AND (contains(text, '<<<') OR contains(text, '>>>'))) AS cross_page_captions,
       count(*) FILTER (NOT ignored AND type = 'footnote' AND {T_TEXT} = '') AS blank_notes,
       count(DISTINCT page_idx) FILTER (NOT ignored AND (type = 'footnote' OR contains(lower(text), '<sup>'))) AS relevant_pages
FROM areas GROUP BY book
""")
def pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pipeline_state(area_view(spark, sf_dir))


@query(AREAS + rf"""
SELECT book, page_idx, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '<sup>(\d+|[*†‡§¶|]+)</sup>'))) AS BIGINT) AS markers,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '<sup>[*†‡§¶|]+</sup>'))) AS BIGINT) AS symbols
FROM areas WHERE NOT ignored AND type IN {BODY} GROUP BY book, page_idx
""")
def body_marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.marker_counts(area_view(spark, sf_dir))


@query(AREAS + rf"""
SELECT book, page_idx, count(*) FILTER (type = 'footnote' AND override IS NOT TRUE AND {T_TEXT} <> '') AS entries
FROM areas WHERE NOT ignored GROUP BY book, page_idx
""")
def note_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.note_counts(area_view(spark, sf_dir))


@query(AREAS + rf"""
SELECT book, page_idx, area_pos,
       TRY_CAST(nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '') AS BIGINT) AS consolidate,
       TRY_CAST(nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '') AS BIGINT) AS review,
       coalesce(nullif(regexp_extract({T_TEXT}, '^([*†‡§‖¶]+)', 1), ''), nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '')) AS assemble,
       TRY_CAST(nullif(regexp_extract({T_TEXT}, '^(\d+)\s', 1), '') AS BIGINT) AS renumber
FROM areas WHERE type = 'footnote'
""")
def leading_marker_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, t = area_view(spark, sf_dir).filter("type = 'footnote'"), F.col("text")
    return notes.select(*KEYS, T.leading_consolidate(t).alias("consolidate"), T.leading_review(t).alias("review"), T.leading_assemble(t).alias("assemble"), T.leading_renumber(t).alias("renumber"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note areas of a page as one packed text."""
    notes = area_view(spark, sf_dir).filter("type = 'footnote'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("area_pos", "text"))), lambda x: x["text"]), "\n")
    return notes.groupBy("book", "page_idx").agg(F.min("area_pos").alias("area_pos"), text.alias("text")).withColumns({"type": F.lit("footnote"), "override": F.lit(None).cast("boolean")})


PACKED = AREAS + rf"""
, lines AS (
    SELECT book, page_idx, area_pos, text, CASE WHEN regexp_matches({T_TEXT}, '^\d+[a-z]?[.\s]') THEN 1 ELSE 0 END AS starts
    FROM areas WHERE type = 'footnote'
), grouped AS (
    SELECT *, sum(starts) OVER (PARTITION BY book, page_idx ORDER BY area_pos) AS g, min(area_pos) OVER (PARTITION BY book, page_idx) AS first_pos FROM lines
), ent AS (
    SELECT book, page_idx, first_pos AS area_pos, g, {TRIM.format("string_agg(text, chr(10) ORDER BY lines_pos)")} AS text
    FROM (SELECT *, area_pos AS lines_pos FROM grouped) GROUP BY book, page_idx, first_pos, g
), entries AS (
    SELECT *, row_number() OVER (PARTITION BY book, page_idx ORDER BY g) - 1 AS k, count(*) OVER (PARTITION BY book, page_idx) AS n FROM ent WHERE text <> ''
)
"""


@query(PACKED + "SELECT book, page_idx, k, text FROM entries")
def entry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("book", "page_idx", F.posexplode(T.entries(F.col("text"))).alias("k", "text")).withColumn("k", F.col("k").cast("long"))


@query(PACKED + "SELECT book, page_idx, area_pos, 'area_' || area_pos || CASE WHEN n > 1 THEN '_s' || (k + 1) ELSE '' END AS id, text FROM entries")
def split_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.split_packed(_packed(spark, sf_dir))


@query(r"""
WITH l AS (
    SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), s AS (
    SELECT *, CASE WHEN i > 0 AND (regexp_matches(line, '^(\d{1,3}[.\s]|\+\s)')) THEN 1 ELSE 0 END AS starts FROM l
), g AS (
    SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s
)
SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS paragraphs, CAST(sum(length(line)) + count(*) - count(DISTINCT p) AS BIGINT) AS characters FROM g GROUP BY doc_id
""")
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = d.select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("characters"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([aeiou]) ([st])', '\1- \2', 'g'), ',', ' ,', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(text, '([\pL\pN_])-(?:[ \t\n]+(?:„|,,|-,)?|(?:„|,,|-,))[ \t]*([\pL\pN_])', '\1\2', 'g'), '([\pL\pN_]) +([,;])', '\1\2', 'g') AS text FROM t
""")
def hyphen_space_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    broken = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "([aeiou]) ([st])", "$1- $2"), ",", " ,")
    return d.select("doc_id", T.space_before_marks(T.repair_hyphens(broken)).alias("text"))


@query(AREAS + r"""
, b AS (SELECT book, page_idx, type, y0, y1, (x0 + x1) / 2.0 AS cx FROM areas WHERE type IN ('main_text', 'illustration', 'chapter_title', 'subtitle')),
hit AS (
    SELECT DISTINCT s.book, s.page_idx FROM b s JOIN b t ON s.book = t.book AND s.page_idx = t.page_idx AND s.y0 < t.y1 AND t.y0 < s.y1
    WHERE (s.type = 'main_text' AND t.type = 'main_text' AND s.cx < 500 AND t.cx > 500)
       OR (s.type = 'illustration' AND t.type <> 'illustration' AND abs(s.cx - 500) >= 100 AND (s.cx < 500) <> (t.cx < 500))
)
SELECT p.book, p.page_idx, hit.page_idx IS NOT NULL AS two_columns FROM (SELECT DISTINCT book, page_idx FROM areas) p LEFT JOIN hit ON p.book = hit.book AND p.page_idx = hit.page_idx
""")
def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.two_columns(area_view(spark, sf_dir))


READING = r"""
, b AS (SELECT *, (x0 + x1) / 2.0 AS cx FROM areas),
hit AS (
    SELECT DISTINCT s.book, s.page_idx FROM b s JOIN b t ON s.book = t.book AND s.page_idx = t.page_idx AND s.y0 < t.y1 AND t.y0 < s.y1
    WHERE (s.type = 'main_text' AND t.type = 'main_text' AND s.cx < 500 AND t.cx > 500)
       OR (s.type = 'illustration' AND t.type IN ('main_text', 'chapter_title', 'subtitle') AND abs(s.cx - 500) >= 100 AND (s.cx < 500) <> (t.cx < 500))
), z AS (
    SELECT b.*, hit.page_idx IS NOT NULL AS two, min(CASE WHEN type = 'main_text' AND x1 - x0 <= 650 THEN y0 END) OVER (PARTITION BY b.book, b.page_idx) AS top
    FROM b LEFT JOIN hit ON b.book = hit.book AND b.page_idx = hit.page_idx
), ro AS (
    SELECT *, row_number() OVER (PARTITION BY book, page_idx ORDER BY CASE WHEN NOT two THEN 0 WHEN y0 < coalesce(top, 0) AND NOT (type = 'illustration' AND x1 - x0 <= 650 AND abs(cx - 500) > 100) THEN 0 WHEN cx < 500 THEN 1 ELSE 2 END,
                                 y0, CASE WHEN two THEN 0 ELSE cx END, area_pos) AS reading_pos
    FROM z
)
"""


@query(AREAS + READING + "SELECT book, page_idx, area_pos, two AS two_columns, reading_pos FROM ro")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(area_view(spark, sf_dir))


@query(AREAS + READING + rf"""
, m AS (
    SELECT book, page_idx, arg_min(text, reading_pos) FILTER (type = 'main_text' AND {T_TEXT} <> '') AS t FROM ro WHERE NOT ignored GROUP BY book, page_idx
), w AS (
    SELECT book, page_idx, array_to_string(list_slice(string_split(regexp_replace({TRIM.format("t")}, '[\s\p{{Z}}]+', ' ', 'g'), ' '), 1, 10), ' ') AS own FROM m
)
SELECT book, page_idx, lead(own) OVER (PARTITION BY book ORDER BY page_idx) AS next_prefix FROM w
""")
def next_page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.next_prefix(area_view(spark, sf_dir))


@query(AREAS + READING + rf"SELECT book, page_idx, arg_max(area_pos, reading_pos) AS area_pos, arg_max(text, reading_pos) AS text FROM ro WHERE type = 'main_text' AND {T_TEXT} <> '' GROUP BY book, page_idx")
def last_main_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.last_main(area_view(spark, sf_dir))


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with rectangles tall enough to overlap."""
    return area_view(spark, sf_dir).withColumn("y1", F.col("y1") + 15 * F.pmod("page_idx", F.lit(3)))


@query(AREAS + r"""
, c AS (SELECT book, page_idx, area_pos, type, x0, x1, y0, y1 + 15 * (page_idx % 3) AS y1 FROM areas)
SELECT i.book, i.page_idx, i.area_pos AS illustration, t.area_pos AS text_area,
       CASE WHEN abs((i.y0 + i.y1) - (t.y0 + t.y1)) >= abs((i.x0 + i.x1) - (t.x0 + t.x1)) THEN 'vertical' ELSE 'horizontal' END AS axis
FROM c i JOIN c t ON i.book = t.book AND i.page_idx = t.page_idx AND i.x0 < t.x1 AND t.x0 < i.x1 AND i.y0 < t.y1 AND t.y0 < i.y1
WHERE i.type = 'illustration' AND t.type IN ('main_text', 'footnote', 'chapter_title', 'subtitle', 'illustration_caption')
""")
def bbox_clip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clip_candidates(_crowded(spark, sf_dir))


@query()
def clip_illustrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clip_illustrations(_crowded(spark, sf_dir))


@query(AREAS + r"""
, m AS (SELECT *, max(x1) OVER (PARTITION BY book, page_idx) <= 1000 AS mx, max(y1) OVER (PARTITION BY book, page_idx) <= 1000 AS my FROM areas)
SELECT book, page_idx, area_pos,
       CAST(greatest(0, least(CASE WHEN mx THEN round_even(x0 * 1653 / 1000.0, 0) ELSE x0 END, 1653)) AS BIGINT) AS x0, CAST(greatest(0, least(CASE WHEN my THEN round_even(y0 * 2339 / 1000.0, 0) ELSE y0 END, 2339)) AS BIGINT) AS y0,
       CAST(greatest(0, least(CASE WHEN mx THEN round_even(x1 * 1653 / 1000.0, 0) ELSE x1 END, 1653)) AS BIGINT) AS x1, CAST(greatest(0, least(CASE WHEN my THEN round_even(y1 * 2339 / 1000.0, 0) ELSE y1 END, 2339)) AS BIGINT) AS y1
FROM m
""")
def coord_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w, wide, high = Window.partitionBy("book", "page_idx"), F.lit(1653).cast("long"), F.lit(2339).cast("long")
    a = area_view(spark, sf_dir).withColumns({"mx": F.max("x1").over(w) <= 1000, "my": F.max("y1").over(w) <= 1000})
    return a.select(*KEYS, *[layout.scale(F.col(c), wide if c[0] == "x" else high, F.col("m" + c[0])).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(AREAS + r"""
, r AS (SELECT *, (page_idx % 4) * 90 AS rot FROM areas)
SELECT book, page_idx, area_pos,
       CAST(CASE rot WHEN 90 THEN y0 WHEN 180 THEN 1000 - x0 WHEN 270 THEN 4000 - y0 ELSE x0 END AS BIGINT) AS rx,
       CAST(CASE rot WHEN 90 THEN 1000 - x0 WHEN 180 THEN 4000 - y0 WHEN 270 THEN x0 ELSE y0 END AS BIGINT) AS ry, x0, y0
FROM r
""")
def rotate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = area_view(spark, sf_dir).withColumn("rot", F.pmod("page_idx", F.lit(4)) * 90)
    w, h = F.lit(1000), F.lit(4000)
    x, y = layout.rotate(F.col("x0"), F.col("y0"), F.col("rot"), w, h)
    a = a.withColumns({"rx": x.cast("long"), "ry": y.cast("long")})
    x, y = layout.rotate(F.col("rx"), F.col("ry"), F.col("rot"), w, h, back=True)
    return a.select(*KEYS, "rx", "ry", x.cast("long").alias("x0"), y.cast("long").alias("y0"))


@query(AREAS + "SELECT book, page_idx, area_pos, CAST(least(100, round_even((x1 - x0) * 100.0 / 1000, 0)) AS BIGINT) AS width_pct FROM areas WHERE type = 'illustration'")
def figure_width_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.figure_width(area_view(spark, sf_dir))


@query()
def normalise_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return expand.normalise_notes(packed)
