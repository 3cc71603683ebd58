"""Counts and checks of books, pages and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

PAGE = ["book", "page_idx"]


def active(areas: DataFrame) -> DataFrame:
    """Areas of pages that are not ignored."""
    return areas.filter(~F.coalesce("ignored", F.lit(False)))


def marker_counts(areas: DataFrame) -> DataFrame:
    """Per page: numeric, superscript and symbolic markers in body areas."""
    body = active(areas).filter(F.col("type").isin(*T.BODY_REVIEW))
    return body.groupBy(*PAGE).agg(F.sum(T.count_markers(F.col("text"))).alias("markers"), F.sum(T.count_symbols(F.col("text"))).alias("symbols"))


def _own_note(areas: DataFrame) -> Column:
    """Note areas that begin something here: not blank, not consolidated, not a forced continuation."""
    return (F.col("type") == "footnote") & ~T.flag(areas, "consolidated") & ~T.flag(areas, "override") & (T.strip(F.coalesce("text", F.lit(""))) != "")


def _items(text: Column) -> Column:
    return F.greatest(F.size(T.entries_review(text)), F.lit(1)).cast("long")


def note_counts(areas: DataFrame) -> DataFrame:
    """Per page: entries in note areas, one at least for each that begins something."""
    return active(areas).groupBy(*PAGE).agg(F.coalesce(F.sum(F.when(_own_note(areas), _items(F.col("text")))), F.lit(0)).alias("entries"))


def footnote_review(areas: DataFrame, regime: str | None = None) -> DataFrame:
    """Per active page: markers against note entries, the state and the badge shown for it.

    regime: null, per_page, endnotes, mixed, per_chapter_endnotes or
    inline_endnotes. ``footnote_consolidated`` (of the page) is looked at where
    it is there.
    """
    end = regime in ("per_chapter_endnotes", "inline_endnotes")
    body = F.col("type").isin(*T.BODY_REVIEW)
    symbol_item = _own_note(areas) & F.col("text").rlike(r"(?U)^\s*[*†‡§¶|]")
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    page = active(areas).groupBy(*PAGE).agg(
        total(body, T.count_markers(F.col("text"))).alias("sup_count"),
        total(_own_note(areas), _items(F.col("text"))).alias("fn_count"),
        total(body, T.count_symbols(F.col("text"))).alias("sym_sup"),
        F.sum(symbol_item.cast("long")).alias("sym_fn"),
        F.max((F.col("type") == "footnote") & ~T.flag(areas, "consolidated")).alias("has_fn"),
        F.max(T.flag(areas, "footnote_consolidated")).alias("is_cons"),
    )
    up, cons, has = F.col("sup_count") > 0, F.col("is_cons"), F.col("has_fn")
    page = page.withColumn("active", up | cons if end else has | up | cons)
    page = page.withColumn("matched", F.lit(True) if end else F.col("sym_sup") == F.col("sym_fn") if regime == "mixed" else F.col("sup_count") == F.col("fn_count"))
    signs = (F.col("sym_sup") > 0) | (F.col("sym_fn") > 0)
    state = F.when(~F.col("active"), "none")
    if regime == "mixed":
        state = state.when(~signs & ~cons, "endnote")
    if end or regime == "endnotes":
        state = state.when(up & ~has & ~cons, "endnote")
    state = state.when(~F.col("matched"), "red").otherwise("green")
    pair = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("↑·"), F.col(b).cast("string"), F.lit("fn"))
    badge = F.when(cons & ~has & ~up, "continuation").when(~F.col("active"), "")
    if end:
        badge = badge.when(up, F.concat(F.col("sup_count").cast("string"), F.lit("↑"))).otherwise("")
    elif regime == "mixed":
        badge = badge.when(signs, pair("sym_sup", "sym_fn")).otherwise(pair("sup_count", "fn_count"))
    else:
        badge = badge.otherwise(pair("sup_count", "fn_count"))
    return page.select(*PAGE, "sup_count", "fn_count", "matched", "active", "is_cons", state.alias("state"), badge.alias("badge"))


def review_summary(review: DataFrame) -> DataFrame:
    """Per book of a footnote_review: its pages, those that are active and don't match, those consolidated."""
    n = lambda c: F.count(F.when(c, 1))
    return review.groupBy("book").agg(F.count("*").alias("total_relevant"), n(F.col("active") & ~F.col("matched")).alias("mismatched"), n(F.col("is_cons")).alias("consolidated"))


def pipeline_state(areas: DataFrame) -> DataFrame:
    """Per book: what is there and what is still to be done, in one pass."""
    on = ~F.coalesce("ignored", F.lit(False))
    kinds = ("main_text", "footnote", "chapter_title", "subtitle", "illustration", "illustration_caption")
    pages = F.countDistinct
    return areas.groupBy("book").agg(
        pages("page_idx").alias("pages"),
        pages(F.when(~on, F.col("page_idx"))).alias("ignored_pages"),
        *[F.count(F.when(on & (F.col("type") == k), 1)).alias(f"n_{k}") for k in kinds],
        F.count(F.when(on & (F.col("type") == "illustration_caption") & F.col("text").rlike("<<<|>>>"), 1)).alias("cross_page_captions"),
        F.count(F.when(on & (F.col("type") == "footnote") & (T.strip(F.coalesce("text", F.lit(""))) == ""), 1)).alias("blank_notes"),
        pages(F.when(on & ((F.col("type") == "footnote") | F.col("text").rlike("(?i)<sup>")), F.col("page_idx"))).alias("relevant_pages"),
    )


def project_state(pages: DataFrame, areas: DataFrame) -> DataFrame:
    """Per book, from its pages (as ``pages_of`` gives them) and their areas: all counts that the dashboard shows.

    Review counts are those of the page review; books of endnotes by chapter or
    inline have theirs from the chapter review.
    """
    on = ~F.coalesce("ignored", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    has = F.col("has_areas")
    joined, polished = F.col("page_join").isNotNull(), T.flag(pages, "polished")
    p = pages.groupBy("book").agg(
        F.first("footnote_regime", True).alias("footnote_regime"),
        n(on & has).alias("area_pages"), n(~on).alias("ignored_pages"), n(on).alias("json_active_pages"), n(on & ~has).alias("pending_area_pages"),
        n(on & T.flag(pages, "process_later") & ~F.coalesce(F.col("detected_by"), F.lit("")).startswith("opus:later:")).alias("process_later_pending"),
        n(joined).alias("polished_pages"), F.greatest(n(polished), n(joined)).alias("polished_count"),
    )
    table = F.col("type") == "table"
    a = active(areas).groupBy("book").agg(
        F.count("*").alias("total_areas"), F.countDistinct(F.when(table, F.col("page_idx"))).alias("table_pages"), n(table).alias("table_areas_total"),
        n(table & (F.coalesce(F.col("table_html"), F.lit("")) != "")).alias("table_areas_done"),
        n((F.col("type") == "illustration_caption") & F.col("text").rlike("<<<|>>>")).alias("cross_page_captions"),
    )
    flags = pages.select(*PAGE, "footnote_consolidated", "footnote_regime")
    marked = areas.join(flags, PAGE, "left")
    same = footnote_review(marked)
    signs = footnote_review(marked, "mixed").select(*PAGE, F.col("matched").alias("mixed_matched"))
    r = same.join(signs, PAGE).join(flags.select(*PAGE, "footnote_regime"), PAGE)
    matched = F.when(F.col("footnote_regime") == "mixed", F.col("mixed_matched")).otherwise(F.col("matched"))
    r = r.groupBy("book").agg(n(F.col("active")).alias("fn_review_relevant"), n(F.col("active") & ~matched).alias("fn_review_mismatched"), n(F.col("active") & F.col("is_cons")).alias("fn_review_consolidated"))
    out = p.join(a, "book", "left").join(r, "book", "left")
    counts = [c for c in out.columns if c not in ("book", "footnote_regime")]
    return out.select("book", "footnote_regime", F.col("footnote_regime").isNotNull().alias("fn_consolidation_done"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def pending_pages(pages: DataFrame) -> DataFrame:
    """Active pages that were never processed."""
    return pages.filter(~F.coalesce("ignored", F.lit(False)) & ~F.col("has_areas"))


def later_pages(pages: DataFrame) -> DataFrame:
    """Active pages put off and not yet processed by the later model."""
    return pages.filter(~F.coalesce("ignored", F.lit(False)) & T.flag(pages, "process_later") & ~F.coalesce(F.col("detected_by"), F.lit("")).startswith("opus:later:"))


def unpolished_pages(pages: DataFrame) -> DataFrame:
    """Active pages that a resumed polishing run takes."""
    return pages.filter(~F.coalesce("ignored", F.lit(False)) & ~T.flag(pages, "polished") & F.col("page_join").isNull())


def pending_tables(areas: DataFrame) -> DataFrame:
    """Tables of active pages without HTML."""
    return active(areas).filter((F.col("type") == "table") & (F.coalesce(F.col("table_html"), F.lit("")) == ""))


def missing_elements(areas: DataFrame, files: DataFrame) -> DataFrame:
    """Pages with an illustration that has no file: files has a column ``name`` (stem_illustration.png)."""
    stem = F.regexp_replace("source_image", r"\.[^.]*$", "")
    wanted = active(areas).filter((F.col("type") == "illustration") & F.col("illustration_id").isNotNull()).select(*PAGE, F.concat(stem, F.lit("_"), F.col("illustration_id"), F.lit(".png")).alias("name"))
    return wanted.join(files.select("name").distinct(), "name", "left_anti").groupBy(*PAGE).agg(F.count("*").alias("missing"))


def detect_regime(areas: DataFrame) -> DataFrame:
    """Per book: per_page, endnotes, mixed or inline_endnotes.

    Headings are chapter titles of active pages; notes that were consolidated
    don't count. More than one heading, and one among the first four fifths as
    many pages as are active, means notes inside.
    """
    on = ~F.coalesce("ignored", F.lit(False))
    title = on & (F.col("type") == "chapter_title") & F.lower(T.strip(F.coalesce("text", F.lit("")))).isin(*T.REGIME_TITLES)
    book = areas.groupBy("book").agg(
        F.countDistinct(F.when(on, F.col("page_idx"))).alias("active_pages"),
        F.countDistinct(F.when(on & (F.col("type") == "footnote") & ~T.flag(areas, "consolidated"), F.col("page_idx"))).alias("note_pages"),
        F.count(F.when(title, 1)).alias("headings"),
        F.min(F.when(title, F.col("page_idx"))).alias("first_heading"),
    )
    # a page's place is its rank among the book's pages: only the first heading's is needed
    first = book.select("book", "first_heading").filter("first_heading IS NOT NULL")
    place = areas.select("book", "page_idx").distinct().join(first, "book").filter("page_idx < first_heading").groupBy("book").agg(F.count("*").alias("place"))
    book = book.join(place, "book", "left")
    early = (F.col("headings") > 1) & (F.coalesce("place", F.lit(0)) < F.floor(0.8 * F.col("active_pages")))
    regime = F.when(early, "inline_endnotes").when((F.col("headings") > 0) & (F.col("note_pages") > 0), "mixed").when(F.col("headings") > 0, "endnotes").otherwise("per_page")
    return book.select("book", "active_pages", "note_pages", "headings", regime.alias("regime"))


def numbering_resets(areas: DataFrame) -> DataFrame:
    """Per book: note areas of active pages that begin with 1, and whether numbering starts over."""
    n = F.count(F.when(~F.coalesce("ignored", F.lit(False)) & (F.col("type") == "footnote") & T.strip(F.coalesce("text", F.lit(""))).rlike(r"^1[. ]"), 1))
    return areas.groupBy("book").agg(n.alias("starts"), (n > 1).alias("resets"))


def changed(before: DataFrame, after: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """What a pass did, per book: areas whose value differs, and the pages of these."""
    b, a = before.select(*keys, F.col(value).alias("_b")), after.select(*keys, F.col(value).alias("_a"))
    both = a.join(b, keys).filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.groupBy("book").agg(F.count("*").alias("areas"), F.countDistinct("page_idx").alias("pages"))


def first_unmatched(unmatched: DataFrame, n: int = 10) -> DataFrame:
    """The report's first ``n`` markers of each book and side."""
    w = Window.partitionBy("book", "side").orderBy("marker")
    return unmatched.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
