"""Queries over document order: running notes, numbering, gaps, matching, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import assemble, expand, images, jsonrepair, matching, reports, sequence
from folioflow.plans.page_queries import BODY, BODY3, T_TEXT, TRIM
from folioflow.plans.registry import query
from folioflow.sources.store import upsert_pages
from folioflow.sources.view import AREAS, area_view

ASSEMBLE = "('main_text', 'quote', 'chapter_title', 'subtitle')"
NUM = rf"TRY_CAST(nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '') AS BIGINT)"
TITLES = "('" + "', '".join(T.NOTES_TITLES) + "')"
LETTERS = TRIM.format(r"regexp_replace(coalesce(text, ''), '[^a-zA-Zа-яёА-ЯЁ\s]', '', 'g')")
REGIME_TITLES = "('" + "', '".join(T.REGIME_TITLES) + "')"

HEADS = AREAS + rf"""
, pages AS (SELECT book, page_idx, bool_or(ignored) OR NOT bool_or(type = 'footnote') AS breaks FROM areas GROUP BY book, page_idx),
chains AS (SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page_idx) AS chain FROM pages),
bodies AS (SELECT DISTINCT book, page_idx, CAST(unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS BIGINT) AS n FROM areas WHERE type IN {BODY3}),
notes AS (
    SELECT a.*, c.chain, {NUM} AS lead FROM areas a JOIN chains c ON a.book = c.book AND a.page_idx = c.page_idx AND NOT c.breaks
    WHERE type = 'footnote' AND {T_TEXT} <> ''
), cand AS (
    SELECT n.*, coalesce(n.override, b.n IS NULL) AS goes_on, lag(chain) OVER (PARTITION BY n.book ORDER BY n.page_idx, n.area_pos) AS chain_before
    FROM notes n LEFT JOIN bodies b ON n.book = b.book AND n.page_idx = b.page_idx AND n.lead = b.n
), heads AS (
    SELECT *, NOT goes_on OR chain_before IS NULL OR chain_before <> chain AS head FROM cand
), grp AS (
    SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page_idx, area_pos) AS g FROM heads
)
"""


@query(HEADS + rf"""
, l AS (SELECT book, g, list({T_TEXT} ORDER BY page_idx, area_pos) AS t, min_by(page_idx, page_idx * 1000000 + area_pos) AS page_idx, min_by(area_pos, page_idx * 1000000 + area_pos) AS area_pos,
               min_by(text, page_idx * 1000000 + area_pos) AS first_text FROM grp GROUP BY book, g)
SELECT book, page_idx, area_pos, CAST(len(t) AS BIGINT) AS pieces,
       CASE WHEN len(t) = 1 THEN first_text ELSE list_reduce(t, lambda a, b: CASE WHEN ends_with(a, '-') THEN substr(a, 1, length(a) - 1) || b ELSE a || ' ' || b END) END AS text
FROM l
""")
def consolidate_running_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.consolidate(area_view(spark, sf_dir))
    return found.withColumn("text", F.when(F.col("pieces") > 1, T.strip(F.col("text"))).otherwise(F.col("text")))


@query(HEADS + """
, h AS (SELECT book, g, page_idx, area_pos FROM grp WHERE head)
SELECT x.book, x.page_idx, x.area_pos, h.page_idx AS head_page, h.area_pos AS head_pos FROM grp x JOIN h ON x.book = h.book AND x.g = h.g WHERE NOT x.head
""")
def deconsolidate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.deconsolidation(area_view(spark, sf_dir))


@query(AREAS + rf"""
, e AS (SELECT DISTINCT book, page_idx, {NUM} AS n FROM areas WHERE NOT ignored AND type = 'footnote'),
w AS (SELECT DISTINCT book, page_idx, CAST(unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS BIGINT) AS n FROM areas WHERE NOT ignored AND type IN {BODY3})
SELECT book, page_idx, n FROM e WHERE n IS NOT NULL EXCEPT SELECT book, page_idx, n FROM w
""")
def orphan_sup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.orphan_markers(area_view(spark, sf_dir))


@query()
def orphan_sup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.wrap_orphans(area_view(spark, sf_dir))


@query(AREAS + rf"""
, p AS (SELECT book, page_idx, bool_or(ignored) AS ignored, bool_or(type = 'footnote') AS notes, count(*) FILTER (NOT ignored AND type = 'chapter_title' AND lower({T_TEXT}) IN {REGIME_TITLES}) AS heads FROM areas GROUP BY book, page_idx),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_idx) - 1 AS place FROM p),
b AS (SELECT book, count(*) FILTER (NOT ignored) AS active_pages, count(*) FILTER (NOT ignored AND notes) AS note_pages, CAST(sum(heads) AS BIGINT) AS headings, min(place) FILTER (heads > 0) AS place FROM o GROUP BY book)
SELECT book, active_pages, note_pages, headings,
       CASE WHEN headings > 1 AND place < floor(0.8 * active_pages) THEN 'inline_endnotes' WHEN headings > 0 AND note_pages > 0 THEN 'mixed' WHEN headings > 0 THEN 'endnotes' ELSE 'per_page' END AS regime
FROM b
""")
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detect_regime(area_view(spark, sf_dir))


SPACED = rf"TRY_CAST(nullif(regexp_extract({T_TEXT}, '^(\d+)\s', 1), '') AS BIGINT)"
RENUMBERED = AREAS + rf"""
, f AS (SELECT book, page_idx, {SPACED} AS old, min(area_pos) AS first_at FROM areas WHERE type = 'footnote' GROUP BY ALL),
b AS (SELECT DISTINCT book, page_idx, CAST(unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS BIGINT) AS n FROM areas WHERE type IN {BODY3}),
r AS (SELECT f.book, f.page_idx, old, row_number() OVER (PARTITION BY f.book ORDER BY f.page_idx, first_at) AS new FROM f JOIN b ON f.book = b.book AND f.page_idx = b.page_idx AND f.old = b.n)
"""


@query(RENUMBERED + "SELECT book, page_idx, old, new FROM r")
def renumber_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.renumbering(area_view(spark, sf_dir))


@query(RENUMBERED + rf"""
SELECT a.book, a.page_idx, a.area_pos, a.type, regexp_replace(a.text, '^\d+', CAST(r.new AS VARCHAR)) AS new_text
FROM areas a JOIN r ON a.book = r.book AND a.page_idx = r.page_idx AND TRY_CAST(nullif(regexp_extract({TRIM.format("a.text")}, '^(\d+)\s', 1), '') AS BIGINT) = r.old
WHERE a.type = 'footnote' AND r.new <> r.old
""")
def renumber_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.renumber(area_view(spark, sf_dir)).filter("type = 'footnote'")


@query()
def renumber_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.renumber(area_view(spark, sf_dir)).filter("type != 'footnote'")


@query(AREAS + rf"SELECT book, count(*) FILTER (NOT ignored AND type = 'footnote' AND regexp_matches({T_TEXT}, '^1[. ]')) AS starts, count(*) FILTER (NOT ignored AND type = 'footnote' AND regexp_matches({T_TEXT}, '^1[. ]')) > 1 AS resets FROM areas GROUP BY book")
def numbering_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.numbering_resets(area_view(spark, sf_dir))


NOTE_MARKS = AREAS + rf"""
, pg AS (SELECT DISTINCT book, page_idx FROM areas WHERE NOT ignored),
m AS (SELECT DISTINCT book, page_idx, {NUM} AS n FROM areas WHERE NOT ignored AND type = 'footnote'),
st AS (SELECT pg.*, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.book = pg.book AND m.page_idx = pg.page_idx AND n = 1) THEN 1 ELSE 0 END AS starts FROM pg),
ch AS (SELECT * FROM (SELECT book, page_idx, CAST(sum(starts) OVER (PARTITION BY book ORDER BY page_idx) AS BIGINT) AS chapter, max(starts) OVER (PARTITION BY book) AS has_start FROM st) WHERE chapter > 0 OR has_start = 0),
edges AS (SELECT book, chapter, min(page_idx) AS first_of FROM ch GROUP BY ALL),
cm AS (SELECT m.*, chapter FROM m JOIN ch ON m.book = ch.book AND m.page_idx = ch.page_idx WHERE n IS NOT NULL),
fm AS (SELECT book, chapter, n, min(page_idx) AS first_page, max(page_idx) AS last_page FROM cm GROUP BY ALL)
"""


@query(NOTE_MARKS + """
, g AS (SELECT *, lag(n) OVER w AS pn, lag(last_page) OVER w AS pp FROM fm WINDOW w AS (PARTITION BY book, chapter ORDER BY n))
SELECT g.book, g.chapter, coalesce(pn, 0) + 1 AS first_missing, n - 1 AS last_missing, coalesce(pp, first_of) AS after_page, first_page AS before_page
FROM g JOIN edges e ON g.book = e.book AND g.chapter = e.chapter WHERE n - coalesce(pn, 0) > 1
""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sequence_gaps(area_view(spark, sf_dir))


@query(NOTE_MARKS + """
, t AS (SELECT book, chapter, page_idx, max(n) AS top FROM cm GROUP BY ALL),
nx AS (SELECT book, chapter, page_idx, lead(page_idx) OVER (PARTITION BY book, chapter ORDER BY page_idx) AS next_page FROM ch),
o AS (SELECT f.book, f.first_page AS page_idx, f.chapter, f.n, max(t.top) AS seen FROM fm f JOIN t ON f.book = t.book AND f.chapter = t.chapter AND t.page_idx < f.first_page GROUP BY ALL HAVING f.n < max(t.top))
SELECT o.*, coalesce(next_page, o.page_idx) AS before_page FROM o JOIN nx ON o.book = nx.book AND o.chapter = nx.chapter AND o.page_idx = nx.page_idx
""")
def out_of_order_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.out_of_order(area_view(spark, sf_dir))


@query(AREAS + rf"""
, m AS (SELECT DISTINCT book, page_idx, CAST(unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS BIGINT) AS n FROM areas WHERE NOT ignored AND type IN {BODY}),
g AS (SELECT book, page_idx, n, lag(n) OVER (PARTITION BY book, page_idx ORDER BY n) AS pn FROM m)
SELECT book, page_idx, CAST(sum(n - pn - 1) AS BIGINT) AS n_missing, string_agg(CASE WHEN n - pn = 2 THEN CAST(n - 1 AS VARCHAR) ELSE (pn + 1) || '-' || (n - 1) END, ',' ORDER BY n) AS missing FROM g WHERE n - pn > 1 GROUP BY book, page_idx
""")
def internal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.internal_gaps(area_view(spark, sf_dir))


@query(AREAS + rf"""
, x AS (SELECT book, page_idx, area_pos, regexp_extract_all(text, '(?i)<sup>(\d+)</sup>', 1) AS l FROM areas WHERE NOT ignored AND type IN {BODY3}),
s AS (SELECT book, page_idx, area_pos, unnest(range(len(l))) AS k, CAST(unnest(l) AS BIGINT) AS n FROM x),
p AS (SELECT *, lag(n) OVER w AS pn, lag(page_idx) OVER w AS from_page FROM s WINDOW w AS (PARTITION BY book ORDER BY page_idx, area_pos, k))
SELECT book, from_page, page_idx AS to_page, unnest(range(pn + 1, n)) AS missing FROM p WHERE n - pn - 1 BETWEEN 1 AND 15
""")
def gap_fill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gap_candidates(area_view(spark, sf_dir))


@query()
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fill_gaps(area_view(spark, sf_dir))


@query(AREAS + """
SELECT i.book, i.page_idx, i.area_pos, i.illustration_id, coalesce(string_agg(c.text, ' ' ORDER BY c.area_pos), '') AS caption
FROM areas i LEFT JOIN areas c ON c.type = 'illustration_caption' AND c.book = i.book AND c.page_idx = i.page_idx AND c.linked_illustration_id = i.illustration_id
WHERE i.type = 'illustration' GROUP BY i.book, i.page_idx, i.area_pos, i.illustration_id
""")
def caption_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.captions(area_view(spark, sf_dir))


@query(AREAS + rf"""
, p AS (SELECT book, page_idx, bool_or(ignored) AS ignored FROM areas GROUP BY book, page_idx),
n AS (SELECT *, lag(page_idx) OVER w AS pb, lag(ignored) OVER w AS ib, lead(page_idx) OVER w AS pa, lead(ignored) OVER w AS ia FROM p WINDOW w AS (PARTITION BY book ORDER BY page_idx)),
c AS (
    SELECT a.book, a.page_idx, a.area_pos, a.text, CASE WHEN n.ignored THEN NULL WHEN contains(text, '<<<') THEN CASE WHEN NOT ib THEN pb END ELSE CASE WHEN NOT ia THEN pa END END AS to_page
    FROM areas a JOIN n ON a.book = n.book AND a.page_idx = n.page_idx WHERE type = 'illustration_caption' AND (contains(text, '<<<') OR contains(text, '>>>'))
), k AS (SELECT *, row_number() OVER (PARTITION BY book, to_page ORDER BY page_idx, area_pos) AS k FROM c),
free AS (
    SELECT i.book, i.page_idx, i.illustration_id, row_number() OVER (PARTITION BY i.book, i.page_idx ORDER BY i.area_pos) AS k FROM areas i
    WHERE type = 'illustration' AND NOT EXISTS (SELECT 1 FROM areas x WHERE x.type = 'illustration_caption' AND x.book = i.book AND x.page_idx = i.page_idx AND x.linked_illustration_id = i.illustration_id)
)
SELECT k.book, k.page_idx, k.area_pos, CASE WHEN f.illustration_id IS NOT NULL THEN to_page END AS to_page, f.illustration_id AS to_illustration, nullif({TRIM.format("CASE WHEN contains(k.text, '<<<') THEN replace(k.text, '<<<', '') ELSE replace(k.text, '>>>', '') END")}, '') AS caption
FROM k LEFT JOIN free f ON f.book = k.book AND f.page_idx = k.to_page AND f.k = k.k
""")
def caption_cross_page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.caption_moves(area_view(spark, sf_dir))


REFS = AREAS + rf"""
, refs AS (
    SELECT book, page_idx, area_pos, unnest(range(len(regexp_extract_all(text, '<sup>([^<]+)</sup>', 1)))) AS k, trim(unnest(regexp_extract_all(text, '<sup>([^<]+)</sup>', 1))) AS marker
    FROM areas WHERE NOT ignored AND type IN {ASSEMBLE}
), items AS (
    SELECT book, page_idx, area_pos, 0 AS k, coalesce(nullif(regexp_extract({T_TEXT}, '^([*†‡§‖¶]+)', 1), ''), nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '')) AS marker
    FROM areas WHERE NOT ignored AND type = 'footnote' AND {T_TEXT} <> ''
), rn AS (SELECT *, row_number() OVER (PARTITION BY book, page_idx, marker ORDER BY area_pos, k) AS n FROM refs),
itn AS (SELECT *, row_number() OVER (PARTITION BY book, page_idx, marker ORDER BY area_pos, k) AS n FROM items WHERE marker IS NOT NULL),
links AS (
    SELECT coalesce(r.book, i.book) AS book, coalesce(r.marker, i.marker) AS marker, coalesce(r.n, i.n) AS n, r.page_idx AS ref_page_idx, r.area_pos AS ref_area_pos, r.k AS ref_k,
           i.page_idx AS item_page_idx, i.area_pos AS item_area_pos, CAST(i.k AS BIGINT) AS item_k
    FROM rn r FULL JOIN itn i ON r.book = i.book AND r.page_idx = i.page_idx AND r.marker = i.marker AND r.n = i.n
)
"""


@query(REFS + r"SELECT * FROM links WHERE regexp_full_match(marker, '[*†‡§‖¶]+')")
def symbolic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nth_links(area_view(spark, sf_dir), symbols=True)


@query(REFS + r"SELECT *, row_number() OVER (PARTITION BY book ORDER BY ref_page_idx, ref_area_pos, ref_k) AS link FROM links WHERE regexp_full_match(marker, '\d+') AND ref_page_idx IS NOT NULL AND item_page_idx IS NOT NULL")
def page_numeric_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.numbered_links(area_view(spark, sf_dir))


@query(REFS + "SELECT book, CASE WHEN item_page_idx IS NULL THEN 'reference' ELSE 'item' END AS side, marker, count(*) AS n FROM links WHERE ref_page_idx IS NULL OR item_page_idx IS NULL GROUP BY ALL")
def unmatched_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unmatched(area_view(spark, sf_dir))


@query(REFS + r"""
, nl AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ref_page_idx, ref_area_pos, ref_k) AS link FROM links WHERE regexp_full_match(marker, '\d+') AND ref_page_idx IS NOT NULL AND item_page_idx IS NOT NULL),
x AS (SELECT i.book, i.page_idx, i.area_pos, CAST(i.k AS BIGINT) AS k, nl.link FROM items i LEFT JOIN nl ON i.book = nl.book AND i.page_idx = nl.item_page_idx AND i.area_pos = nl.item_area_pos AND i.k = nl.item_k),
y AS (SELECT *, coalesce(last_value(link IGNORE NULLS) OVER (PARTITION BY book, page_idx ORDER BY area_pos, k), 4611686018427387904) AS by_link FROM x)
SELECT book, page_idx, area_pos, k, link, row_number() OVER (PARTITION BY book, page_idx ORDER BY by_link, area_pos, k) AS place FROM y
""")
def sorted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.sorted_notes(area_view(spark, sf_dir))


CHAPTERS = REFS + r"""
, ca AS (SELECT *, CASE WHEN type = 'chapter_title' THEN TRY_CAST(coalesce(nullif(regexp_extract(text, '^\s*(\d{1,4})\.\s', 1), ''), nullif(regexp_extract(text, '(?i)^\s*chapter\s+(\d{1,4})\b', 1), '')) AS BIGINT) END AS own FROM areas WHERE NOT ignored),
cc AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY book ORDER BY page_idx, area_pos) AS chapter FROM ca)
"""


@query(CHAPTERS + r"""
, i AS (SELECT c.book, c.chapter, CAST(x.marker AS BIGINT) AS n, max(c.page_idx * 1000000 + c.area_pos) AS last_at FROM items x JOIN cc c USING (book, page_idx, area_pos) WHERE c.chapter IS NOT NULL AND regexp_full_match(x.marker, '\d+') GROUP BY ALL),
r AS (SELECT c.book, c.chapter, CAST(x.marker AS BIGINT) AS n, count(*) AS refs FROM refs x JOIN cc c USING (book, page_idx, area_pos) WHERE c.chapter IS NOT NULL AND regexp_full_match(x.marker, '\d+') GROUP BY ALL)
SELECT book, chapter, n, refs, last_at // 1000000 AS item_page, last_at % 1000000 AS item_area FROM r JOIN i USING (book, chapter, n)
""")
def chapter_endnote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.endnote_links(area_view(spark, sf_dir))


@query(CHAPTERS + rf"""
, b AS (SELECT DISTINCT book, chapter, CAST(unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS BIGINT) AS n FROM cc WHERE chapter IS NOT NULL AND type IN {ASSEMBLE}),
e AS (SELECT DISTINCT book, chapter, {NUM} AS n FROM cc WHERE chapter IS NOT NULL AND type = 'footnote'),
j AS (SELECT coalesce(b.book, e.book) AS book, coalesce(b.chapter, e.chapter) AS chapter, b.n AS bn, e.n AS en FROM b FULL JOIN (FROM e WHERE n IS NOT NULL) e ON b.book = e.book AND b.chapter = e.chapter AND b.n = e.n)
SELECT book, chapter, coalesce(string_agg(CAST(bn AS VARCHAR), ',' ORDER BY bn) FILTER (en IS NULL), '') AS missing_entries, coalesce(string_agg(CAST(en AS VARCHAR), ',' ORDER BY en) FILTER (bn IS NULL), '') AS missing_markers,
       CASE WHEN count(en) = 0 THEN 'body_only' WHEN count(bn) = 0 THEN 'notes_only' ELSE 'both' END AS found
FROM j GROUP BY book, chapter
""")
def chapter_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.chapter_crosscheck(area_view(spark, sf_dir))


@query(CHAPTERS + rf"""
, n AS (SELECT book, page_idx, chapter, count(*) FILTER ({T_TEXT} <> '') AS n, min(area_pos) AS first FROM cc WHERE chapter IS NOT NULL AND type = 'footnote' GROUP BY ALL)
SELECT book, page_idx, arg_max(chapter, n * 1000000 - first) AS chapter, max(n) AS entries FROM n GROUP BY book, page_idx
""")
def dominant_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.dominant_chapter(area_view(spark, sf_dir))


@query(AREAS + """
, p AS (SELECT book, page_idx, bool_or(type = 'footnote') AS notes FROM areas GROUP BY book, page_idx)
SELECT book, page_idx, coalesce(min(CASE WHEN notes THEN page_idx END) OVER (PARTITION BY book ORDER BY page_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), page_idx) AS owner FROM p
""")
def satellite_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.note_owners(area_view(spark, sf_dir))


@query(AREAS + rf"""
, p AS (SELECT book, page_idx, bool_or(type = 'footnote') AS notes FROM areas GROUP BY book, page_idx),
o AS (SELECT book, page_idx, coalesce(min(CASE WHEN notes THEN page_idx END) OVER (PARTITION BY book ORDER BY page_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), page_idx) AS owner FROM p),
m AS (SELECT DISTINCT book, page_idx, unnest(regexp_extract_all(text, '<sup>(\d+)</sup>', 1)) AS n FROM areas WHERE type IN {ASSEMBLE})
SELECT book, owner, count(DISTINCT page_idx) AS pages, count(DISTINCT n) AS markers FROM m JOIN o USING (book, page_idx) GROUP BY book, owner
""")
def owner_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.owner_markers(area_view(spark, sf_dir))


@query(AREAS + rf"""
, k AS (SELECT *, CASE WHEN type = 'chapter_title' THEN CASE WHEN lower({LETTERS}) IN {TITLES} THEN 'notes' ELSE 'body' END END AS kind FROM areas WHERE NOT ignored),
z AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER w, 'body') AS zone, CAST(sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS section FROM k WINDOW w AS (PARTITION BY book ORDER BY page_idx, area_pos))
SELECT book, section, zone, count(*) AS areas, count(DISTINCT page_idx) AS pages FROM z GROUP BY book, section, zone
""")
def section_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = matching.zones(area_view(spark, sf_dir))
    return z.groupBy("book", F.col("section").cast("long").alias("section"), "zone").agg(F.count("*").alias("areas"), F.countDistinct("page_idx").alias("pages"))


HINT = " OR ".join(f"contains(lower(replace(coalesce(text, ''), chr(10), ' ')), '{t}')" for t in T.NOTES_TITLES)


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with numbered subtitles and entry lines on some pages."""
    a = area_view(spark, sf_dir)
    i = F.col("page_idx") + F.col("area_pos")
    sub, ent = (F.col("type") == "main_text") & (i % 11 == 3), (F.col("type") == "main_text") & (i % 7 == 2)
    return a.withColumns({"type": F.when(sub, "subtitle").otherwise(F.col("type")), "text": F.when(sub, F.concat((i % 9).cast("string"), F.lit(". "), "text")).when(ent, F.concat((i % 30).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))})


@query(AREAS + rf"""
, ea AS (SELECT book, page_idx, type AS t0, CASE WHEN type = 'main_text' AND (page_idx + area_pos) % 11 = 3 THEN 'subtitle' ELSE type END AS type,
                CASE WHEN type = 'main_text' AND (page_idx + area_pos) % 11 = 3 THEN (page_idx + area_pos) % 9 || '. ' || text WHEN type = 'main_text' AND (page_idx + area_pos) % 7 = 2 THEN (page_idx + area_pos) % 30 || '. ' || text ELSE text END AS text FROM areas),
p AS (SELECT book, page_idx, bool_or(type = 'chapter_title') AS title, bool_or(type = 'chapter_title' AND ({HINT})) AS hint,
             bool_or(type = 'subtitle' AND regexp_matches(text, '^\s*\d+\.\s')) AS sub, bool_or(type = 'main_text' AND regexp_matches(text, '(?m)^\s*(?:<[^>]+>)*\s*(\d+)\.?\s*(?:</[^>]+>)*\.?\s')) AS ent FROM ea GROUP BY book, page_idx),
q AS (SELECT *, row_number() OVER w AS nth, bool_or(sub) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS subs, bool_or(ent) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ents, count(*) OVER (PARTITION BY book) AS n FROM p WINDOW w AS (PARTITION BY book ORDER BY page_idx))
SELECT book, count(*) AS pages, min(page_idx) FILTER (title AND nth > n // 3 AND ((subs AND ents) OR (hint AND (subs OR ents)))) AS start FROM q GROUP BY book
""")
def endnotes_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.endnotes_start(_endings(spark, sf_dir))


@query(AREAS + rf"""
, b AS (
    SELECT DISTINCT book, page_idx, trim(unnest(regexp_extract_all(text, '<sup>([^<]+)</sup>', 1))) AS m FROM areas WHERE NOT ignored AND type IN {ASSEMBLE}
), n AS (
    SELECT book, page_idx, area_pos, override, CASE WHEN override IS NULL THEN coalesce(nullif(regexp_extract({T_TEXT}, '^([*†‡§‖¶]+)', 1), ''), nullif(regexp_extract({T_TEXT}, '^(\d+)[.\s]', 1), '')) END AS m
    FROM areas WHERE NOT ignored AND type = 'footnote' AND {T_TEXT} <> ''
), s AS (
    SELECT n.*, CASE WHEN override IS NOT NULL THEN NOT override ELSE b.m IS NOT NULL AND row_number() OVER (PARTITION BY n.book, n.page_idx, n.m ORDER BY area_pos) = 1 END AS starts
    FROM n LEFT JOIN b ON n.book = b.book AND n.page_idx = b.page_idx AND n.m = b.m
)
SELECT book, page_idx, area_pos, CAST(0 AS BIGINT) AS paragraph, starts, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page_idx, area_pos) AS BIGINT) AS note FROM s
""")
def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.note_segments(area_view(spark, sf_dir))


@query()
def stitch_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = area_view(spark, sf_dir)
    how = F.when(F.pmod("page_idx", F.lit(4)) == 0, "merge_hyphen").when(F.pmod("page_idx", F.lit(4)) == 1, "merge_sentence").when(F.pmod("page_idx", F.lit(4)) == 2, "new_paragraph")
    return sequence.stitch(a.withColumn("page_join", how))


@query()
def book_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.to_txt(stitch_body(spark, sf_dir))


@query(AREAS + r"""
, t AS (SELECT *, sum(CASE WHEN type = 'chapter_title' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN type = 'subtitle' THEN 1 ELSE 0 END) OVER w AS n
        FROM areas WHERE NOT ignored AND type IN ('chapter_title', 'subtitle') WINDOW w AS (PARTITION BY book ORDER BY page_idx, area_pos)),
g AS (SELECT *, greatest(i, 1) AS ch FROM t)
SELECT book, 'ch-' || ch AS id, coalesce(arg_min(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), page_idx * 1000000 + area_pos) FILTER (type = 'chapter_title'), '') AS title,
       count(*) FILTER (type = 'subtitle') AS subtitles, coalesce(string_agg('sub-' || n, ',' ORDER BY page_idx, area_pos) FILTER (type = 'subtitle'), '') AS sub_ids
FROM g GROUP BY book, ch
""")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.contents(area_view(spark, sf_dir))


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with titles in neighbouring areas: lone numbers and all-capitals lines."""
    a = area_view(spark, sf_dir)
    lone = (F.col("area_pos") == 0) & (F.pmod("page_idx", F.lit(3)) == 0)
    second = (F.col("area_pos") == 1) & (F.pmod("page_idx", F.lit(6)) == 0)
    caps = (F.col("area_pos") == 1) & (F.pmod("page_idx", F.lit(5)) == 1)
    text = F.when(lone, F.concat((F.pmod("page_idx", F.lit(20)) + 1).cast("string"), F.lit("."))).when(caps, F.translate("text", LOWER, UPPER)).otherwise(F.col("text"))
    return a.withColumns({"text": text, "type": F.when(second, "chapter_title").when(caps, "main_text").otherwise(F.col("type"))})


TITLED = AREAS + r"""
, ta AS (
    SELECT book, page_idx, area_pos, CASE WHEN area_pos = 1 AND page_idx % 6 = 0 THEN 'chapter_title' WHEN area_pos = 1 AND page_idx % 5 = 1 THEN 'main_text' ELSE type END AS type,
           CASE WHEN area_pos = 0 AND page_idx % 3 = 0 THEN (page_idx % 20 + 1) || '.' WHEN area_pos = 1 AND page_idx % 5 = 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text
    , illustration_id FROM areas WHERE NOT ignored
), tb AS (
    SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lead(type) OVER w AS nt, lead(text) OVER w AS nx, row_number() OVER w AS nth
    FROM ta WHERE (type IN ('main_text', 'chapter_title', 'subtitle', 'quote', 'title_page') AND trim(coalesce(text, '')) <> '') OR (type = 'illustration' AND illustration_id IS NOT NULL) WINDOW w AS (PARTITION BY book ORDER BY page_idx, area_pos)
)
"""
LONE = r"regexp_full_match(trim({0}), '(\d+|[IVXLCDM]+)\.?')"
PLAIN = r"trim(regexp_replace({0}, '<[^>]*>', '', 'g'))"
JOINED = "{0} || CASE WHEN ends_with({0}, '.') THEN ' ' ELSE '. ' END || {1}"


@query(TITLED + rf"""
, tc AS (SELECT *, type = 'chapter_title' AND {LONE.format("text")} AS lone, coalesce(pt = 'chapter_title' AND {LONE.format("px")}, false) AS after FROM tb),
td AS (SELECT *, last_value(CASE WHEN NOT (lone AND after) THEN nth END IGNORE NULLS) OVER (PARTITION BY book ORDER BY nth) AS run FROM tc),
te AS (SELECT *, lone AND (nth - run) % 2 = 0 AND coalesce(nt = 'chapter_title', false) AS takes FROM td),
tf AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY book ORDER BY nth), false) AS taken FROM te)
SELECT book, page_idx, area_pos, CASE WHEN takes THEN {JOINED.format(PLAIN.format("text"), PLAIN.format("nx"))} ELSE text END AS text, takes AS merged FROM tf WHERE type = 'chapter_title' AND NOT taken
""")
def merge_split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.merge_split_titles(_titled(spark, sf_dir))


@query(TITLED + rf"""
, tc AS (SELECT *, regexp_replace({PLAIN.format("coalesce(nx, '')")}, '[^\pL\pN\pM_]', '', 'g') AS l FROM tb WHERE type = 'chapter_title'),
td AS (SELECT *, coalesce(nt = 'main_text' AND l <> '' AND l = upper(l), false) AS absorbed FROM tc)
SELECT book, page_idx, area_pos, CASE WHEN absorbed THEN {JOINED.format(PLAIN.format("text"), PLAIN.format("nx"))} ELSE text END AS text, absorbed FROM td
""")
def absorb_all_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.absorb_all_caps(_titled(spark, sf_dir))


@query(r"""
SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' | ') AS headings, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS BIGINT) AS paragraphs FROM pages
""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.headings(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.parse_elements(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query()
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr("""substring(to_json(struct(coalesce(text, '') AS t)), 7)""").alias("t"))
    d = d.withColumn("t", F.expr("left(t, length(t) - 2)"))  # the whole text, as it stands between the quotes of a JSON string
    n = F.pmod("doc_id", F.lit(5))
    whole = F.concat(F.lit('{"page_dimensions":{"width":9,"height":9},"areas":[{"id":"a","text":"'), "t", F.lit('"},{"id":"b","text":"'), "t", F.lit('"}]}'))
    raw = (
        F.when(n == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(n == 1, F.replace(whole, F.lit('"a","'), F.lit('"a","null,"')))
        .when(n == 2, F.substring(whole, F.lit(1), F.length(whole) - 5))
        .when(n == 3, F.replace(whole, F.lit(" "), F.lit("\n")))
        .otherwise(whole)
    )
    return jsonrepair.repair_json(d.select("doc_id", raw.alias("raw")), keep=False)


@query(AREAS + r"""
, v AS (SELECT *, (page_idx + area_pos) % 7 AS s FROM areas),
w AS (SELECT *, CASE WHEN s = 5 AND page_idx % 50 = 0 THEN 'error' WHEN s = 6 THEN 'drop' ELSE 'ok' END AS one FROM v)
SELECT book, page_idx, area_pos, CASE WHEN bool_or(one = 'error') OVER (PARTITION BY book, page_idx) THEN 'rejected' ELSE one END AS verdict FROM w
""")
def area_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = area_view(spark, sf_dir)
    s = F.pmod(F.col("page_idx") + F.col("area_pos"), F.lit(7))
    p = lambda x, y: F.array(x, y)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    four = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    poly = (
        F.when(s == 0, F.array(F.array(x0, y0, x1, y1)))
        .when(s == 1, F.array(F.array(x0, y0, x1, y0, x1, y1, x0, y1)))
        .when(s == 2, F.array(p(x0, y0), p(x1, y1)))
        .when((s == 5) & (F.pmod("page_idx", F.lit(50)) == 0), F.concat(four, F.array(p(x0 + 1, y0 + 1))))
        .when(s == 6, F.array(p(x0, y0), p(x0, y0)))
        .otherwise(four)
    )
    return jsonrepair.check_areas(a.select("book", "page_idx", "area_pos", poly.alias("polygon")), ["book", "page_idx"]).drop("polygon")


@query(r"""
WITH h AS (SELECT page_idx, v AS level, count(*) AS n FROM (SELECT doc_id AS page_idx, (ascii(unnest(string_split(text, ' '))) * 7) % 256 AS v FROM documents) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS bg, sum(n * level) OVER u AS sb, sum(n) OVER t AS total, sum(n * level) OVER t AS al FROM h WINDOW u AS (PARTITION BY page_idx ORDER BY level), t AS (PARTITION BY page_idx)),
s AS (SELECT *, round(CAST(bg AS DOUBLE) * CAST(total - bg AS DOUBLE) * (CAST(sb AS DOUBLE) / CAST(bg AS DOUBLE) - CAST(al - sb AS DOUBLE) / CAST(total - bg AS DOUBLE)) * (CAST(sb AS DOUBLE) / CAST(bg AS DOUBLE) - CAST(al - sb AS DOUBLE) / CAST(total - bg AS DOUBLE)), 6) AS var FROM c WHERE bg > 0 AND bg < total),
m AS (SELECT page_idx, max(var) AS top FROM s GROUP BY page_idx)
SELECT s.page_idx, CAST(CASE WHEN top > 0 THEN min(level) ELSE 0 END AS BIGINT) AS threshold FROM s JOIN m ON s.page_idx = m.page_idx AND s.var = m.top GROUP BY s.page_idx, top
""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_idx"), F.explode(F.split("text", " ")).alias("w"))
    h = d.withColumn("level", (F.ascii("w") * 7 % 256).cast("long")).groupBy("page_idx", "level").agg(F.count("*").alias("n"))
    return images.otsu(h, ["page_idx"])


@query(r"""
WITH o AS (SELECT doc_id, text, doc_id % 3 = 0 AS ignored, CASE WHEN doc_id % 2 = 0 THEN 90 END AS rotation FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, reverse(text) AS text, false AS ignored, 180 AS rotation FROM documents WHERE doc_id % 4 = 0 OR doc_id % 10 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.text ELSE o.text END AS text, coalesce(o.ignored, n.ignored) AS ignored, coalesce(o.rotation, n.rotation) AS rotation
FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    i = F.col("doc_id")
    old = d.filter(i % 10 != 0).select("doc_id", "text", (i % 3 == 0).alias("ignored"), F.when(i % 2 == 0, 90).alias("rotation"))
    new = d.filter((i % 4 == 0) | (i % 10 == 0)).select("doc_id", F.reverse("text").alias("text"), F.lit(False).alias("ignored"), F.lit(180).alias("rotation"))
    return upsert_pages(old, new, ["doc_id"])


@query(AREAS + r"""
, p AS (SELECT book, page_idx, bool_or(ignored) AS ignored, page_idx % 5 = 0 AS no_areas, page_idx % 7 = 0 AS later, CASE WHEN page_idx % 3 = 0 THEN 'opus:later:m' ELSE 'opus:m' END AS detected_by, page_idx % 4 = 0 AS polished FROM areas GROUP BY book, page_idx)
SELECT book, count(*) FILTER (NOT ignored) AS active, count(*) FILTER (no_areas AND NOT later) AS pending, count(*) FILTER (later AND NOT starts_with(detected_by, 'opus:later:')) AS pending_later, count(*) FILTER (NOT polished) AS to_polish FROM p GROUP BY book
""")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = area_view(spark, sf_dir).groupBy("book", "page_idx").agg(F.max("ignored").alias("ignored"))
    i = F.col("page_idx")
    p = p.withColumns({"no_areas": i % 5 == 0, "later": i % 7 == 0, "by": F.when(i % 3 == 0, "opus:later:m").otherwise("opus:m"), "polished": i % 4 == 0})
    return p.groupBy("book").agg(
        F.count(F.when(~F.col("ignored"), 1)).alias("active"),
        F.count(F.when(F.col("no_areas") & ~F.col("later"), 1)).alias("pending"),
        F.count(F.when(F.col("later") & ~F.col("by").startswith("opus:later:"), 1)).alias("pending_later"),
        F.count(F.when(~F.col("polished"), 1)).alias("to_polish"),
    )


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (3, 9, 57) OR doc_id BETWEEN 10 AND 20 OR doc_id BETWEEN 100 AND 150")
def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return expand.select_pages(d, "57, 3,9,10-20,100-150,30-25", "doc_id").select("doc_id", "source")
