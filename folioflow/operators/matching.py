"""Matching: captions to illustrations, markers to notes, chapters to chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.scans import carry_backward, carry_forward, running_sum

BOOK, PAGE, ORDER = ["book"], ["book", "page_idx"], ["page_idx", "area_pos"]


def captions(areas: DataFrame) -> DataFrame:
    """Each illustration with the captions linked to it, in reading order."""
    pics = areas.filter(F.col("type") == "illustration").select(*PAGE, "area_pos", "illustration_id")
    caps = areas.filter((F.col("type") == "illustration_caption") & F.col("linked_illustration_id").isNotNull())
    caps = caps.groupBy(*PAGE, F.col("linked_illustration_id").alias("illustration_id")).agg(F.array_sort(F.collect_list(F.struct("area_pos", "text"))).alias("c"))
    return pics.join(caps, [*PAGE, "illustration_id"], "left").select(*PAGE, "area_pos", "illustration_id", F.coalesce(F.array_join(F.col("c.text"), " "), F.lit("")).alias("caption"))


def caption_moves(areas: DataFrame) -> DataFrame:
    """Captions with <<< (first) or >>> in them, with the page and illustration they move to; the mark goes, a blank caption is null.

    The k-th move into a page takes its k-th illustration that no caption is
    linked to. Moves from ignored pages, into ignored pages or without an
    illustration left have no target. Pages are neighbours in the book's order.
    """
    pages = areas.groupBy(*PAGE).agg(F.max(F.coalesce("ignored", F.lit(False))).alias("ignored"))
    pages = pages.withColumn("at", F.struct("page_idx", "ignored"))
    pages = carry_forward(pages, "at", "before", BOOK, ["page_idx"], inclusive=False)
    pages = carry_forward(pages.withColumn("_b", -F.col("page_idx")), "at", "after", BOOK, ["_b"], inclusive=False).drop("_b")
    back, on = F.col("text").contains("<<<"), F.col("text").contains(">>>")
    caps = areas.filter((F.col("type") == "illustration_caption") & (back | on)).join(pages.select(*PAGE, F.col("ignored").alias("off"), "before", "after"), PAGE)
    to = F.when(F.col("text").contains("<<<"), F.col("before")).otherwise(F.col("after"))
    caps = caps.withColumn("to", to).withColumn("to_page", F.when(~F.col("off") & ~F.col("to.ignored"), F.col("to.page_idx")))
    w = Window.partitionBy("book", "to_page").orderBy(*ORDER)
    caps = caps.withColumn("k", F.when(F.col("to_page").isNotNull(), F.row_number().over(w)))
    linked = areas.filter(F.col("type") == "illustration_caption").select(*PAGE, F.col("linked_illustration_id").alias("illustration_id")).dropna()
    free = areas.filter((F.col("type") == "illustration") & (F.coalesce("illustration_id", F.lit("")) != "")).join(linked, [*PAGE, "illustration_id"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE).orderBy("area_pos"))).select("book", F.col("page_idx").alias("to_page"), "k", F.col("illustration_id").alias("to_illustration"))
    out = caps.join(free, ["book", "to_page", "k"], "left")
    text = T.strip(F.when(F.col("text").contains("<<<"), F.replace("text", F.lit("<<<"))).otherwise(F.replace("text", F.lit(">>>"))))
    text = F.when(text != "", text)
    return out.select(*PAGE, "area_pos", F.when(F.col("to_illustration").isNotNull(), F.col("to_page")).alias("to_page"), "to_illustration", text.alias("caption"))


def references(areas: DataFrame) -> DataFrame:
    """Markers in body areas in order: book, page_idx, area_pos, k, marker."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)) & F.col("type").isin(*T.BODY_ASSEMBLE))
    return on.select(*PAGE, "area_pos", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)<sup>([^<]+)</sup>"), F.lit(1))).alias("k", "marker")).withColumn("marker", T.strip(F.col("marker")))


def items(areas: DataFrame) -> DataFrame:
    """Note areas' entries in order with their marker (null if they have none)."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)) & (F.col("type") == "footnote"))
    e = on.select(*PAGE, "area_pos", F.posexplode(T.entries_review(F.col("text"))).alias("k", "text"))
    return e.withColumn("marker", T.leading_assemble(F.col("text")))


def _nth(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER, "k")))


def nth_links(areas: DataFrame, symbols: bool, keys: tuple[str, ...] = ("book", "page_idx")) -> DataFrame:
    """The n-th reference of a marker meets the n-th item of the same marker among the same keys: a full match of both sides."""
    kind = F.col("marker").rlike(f"^[{T.SYMBOLS_LINK}]+$" if symbols else r"^\d+$")
    by = [*keys, "marker"]
    r = _nth(references(areas).filter(kind), by, "n").select(*by, "n", F.struct("page_idx", "area_pos", "k").alias("ref"))
    i = _nth(items(areas).filter(kind), by, "n").select(*by, "n", F.struct("page_idx", "area_pos", "k").alias("item"))
    out = r.join(i, [*by, "n"], "full_outer")
    at = lambda c, f: F.col(f"{c}.{f}").cast("long").alias(f"{c}_{f}")
    return out.select("book", "marker", F.col("n").cast("long").alias("n"), *[at(c, f) for c in ("ref", "item") for f in ("page_idx", "area_pos", "k")])


def numbered_links(areas: DataFrame, symbols: bool = False) -> DataFrame:
    """Matched references with their running number in the book."""
    m = nth_links(areas, symbols).filter("ref_page_idx IS NOT NULL AND item_page_idx IS NOT NULL").withColumn("one", F.lit(1))
    return running_sum(m, "one", "link", BOOK, ["ref_page_idx", "ref_area_pos", "ref_k"]).drop("one").withColumn("link", F.col("link").cast("long"))


def unmatched(areas: DataFrame) -> DataFrame:
    """References without an item and items without a reference, by marker."""
    m = nth_links(areas, False).unionAll(nth_links(areas, True))
    side = F.when(F.col("item_page_idx").isNull(), "reference").otherwise("item")
    return m.filter("ref_page_idx IS NULL OR item_page_idx IS NULL").groupBy("book", side.alias("side"), "marker").agg(F.count("*").alias("n"))


def chapters(areas: DataFrame) -> DataFrame:
    """Areas of active pages with their chapter's number and title, carried on from the last numbered title."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)))
    n = F.when(F.col("type") == "chapter_title", T.chapter_number(F.col("text")))
    on = on.withColumn("_c", F.when(n.isNotNull(), F.struct(n.alias("n"), T.squeeze(F.col("text")).alias("title"))))
    return carry_forward(on, "_c", "chapter", BOOK, ORDER).drop("_c")


def endnote_links(areas: DataFrame) -> DataFrame:
    """References met by the last item of their chapter and number, wherever in the book the chapter comes again."""
    c = chapters(areas).filter("chapter IS NOT NULL").select(*PAGE, "area_pos", F.col("chapter.n").alias("chapter"))
    number = F.when(F.col("marker").rlike(r"^\d{1,18}$"), F.col("marker").cast("long"))
    key = [*PAGE, "area_pos"]
    i = items(areas).join(c, key).withColumn("n", number).filter("n IS NOT NULL")
    last = i.groupBy("book", "chapter", "n").agg(F.max(F.struct("page_idx", "area_pos", "k")).alias("item"))
    r = references(areas).join(c, key).withColumn("n", number).filter("n IS NOT NULL")
    out = r.groupBy("book", "chapter", "n").agg(F.count("*").alias("refs")).join(last, ["book", "chapter", "n"])
    return out.select("book", "chapter", "n", "refs", F.col("item.page_idx").alias("item_page"), F.col("item.area_pos").alias("item_area"))


def chapter_crosscheck(areas: DataFrame) -> DataFrame:
    """Per chapter number: markers without entries, entries without markers, and where the chapter is found."""
    c = chapters(areas).filter("chapter IS NOT NULL").select("book", F.col("chapter.n").alias("chapter"), "type", "text")
    body = c.filter(F.col("type").isin(*T.BODY_ASSEMBLE)).select("book", "chapter", F.explode(T.body_numbers(F.col("text"))).alias("n"))
    notes = c.filter(F.col("type") == "footnote").select("book", "chapter", F.explode(T.entries(F.col("text"))).alias("e")).select("book", "chapter", T.leading_review(F.col("e")).alias("n")).dropna()
    b = body.groupBy("book", "chapter").agg(F.collect_set("n").alias("b"))
    e = notes.groupBy("book", "chapter").agg(F.collect_set("n").alias("e"))
    j = b.join(e, ["book", "chapter"], "full_outer")
    none = F.array().cast("array<bigint>")
    b, e = F.coalesce("b", none), F.coalesce("e", none)
    text = lambda x: F.array_join(F.transform(F.array_sort(x), lambda v: v.cast("string")), ",")
    where = F.when(F.size(e) == 0, "body_only").when(F.size(b) == 0, "notes_only").otherwise("both")
    return j.select("book", "chapter", text(F.array_except(b, e)).alias("missing_entries"), text(F.array_except(e, b)).alias("missing_markers"), where.alias("found"))


def note_owners(areas: DataFrame) -> DataFrame:
    """Each page with the nearest page, itself or later, that has notes (itself if none comes)."""
    p = areas.groupBy(*PAGE).agg(F.max(F.col("type") == "footnote").alias("notes"))
    p = carry_backward(p.withColumn("_n", F.when(F.col("notes"), F.col("page_idx"))), "_n", "owner", BOOK, ["page_idx"])
    return p.select(*PAGE, F.coalesce("owner", "page_idx").alias("owner"))


def owner_markers(areas: DataFrame) -> DataFrame:
    """Per owner: the markers of all pages that are its satellites."""
    body = areas.filter(F.col("type").isin(*T.BODY_ASSEMBLE)).select(*PAGE, F.explode(T.body_numbers(F.col("text"))).alias("n"))
    return body.join(note_owners(areas), PAGE).groupBy("book", "owner").agg(F.countDistinct("page_idx").alias("pages"), F.countDistinct("n").alias("markers"))


def zones(areas: DataFrame) -> DataFrame:
    """Areas of active pages with their zone: a Notes title opens a notes zone, any other chapter title a body zone."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)))
    title = F.col("type") == "chapter_title"
    kind = F.when(title & T.is_notes_title(F.col("text")), "notes").when(title, "body")
    on = on.withColumn("_k", kind).withColumn("_one", F.col("_k").isNotNull().cast("int"))
    on = carry_forward(on, "_k", "zone", BOOK, ORDER)
    return running_sum(on, "_one", "section", BOOK, ORDER).withColumn("zone", F.coalesce("zone", F.lit("body"))).drop("_k", "_one")


#: What begins an entry of endnotes: a line with a number, maybe in tags, and maybe a point. Pages' lines end in \\n alone.
ENTRY_LINE = r"(?md)^\s*(?:<[^>]+>)*\s*(\d+)\.?\s*(?:</[^>]+>)*\.?\s"


def entry_numbers(text: Column) -> Column:
    """Numbers of all entry lines of a text, in order."""
    n = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTRY_LINE), F.lit(1))
    return F.transform(F.filter(n, lambda x: F.length(x) <= 18), lambda x: x.cast("long"))


def endnotes_start(areas: DataFrame, ahead: int = 3) -> DataFrame:
    """Per book: the first page, from a third of the book on, where the endnotes begin.

    It has a chapter title. In the pages after it (``ahead`` of them, ignored
    ones too) numbered subtitles and entry lines follow; if the title holds a
    notes word, one of the two is enough.
    """
    text = F.coalesce("text", F.lit(""))
    title = F.col("type") == "chapter_title"
    low = F.coalesce(F.lower(F.replace(F.when(title, text), F.lit("\n"), F.lit(" "))), F.lit(""))
    hint = F.lit(False)
    for word in T.NOTES_TITLES:
        hint = hint | low.contains(word)
    p = areas.groupBy(*PAGE).agg(
        F.max(title).alias("title"),
        F.max(title & hint).alias("hint"),
        F.max((F.col("type") == "subtitle") & text.rlike(r"(?U)^\s*\d+\.\s")).alias("numbered"),
        F.max((F.col("type") == "main_text") & text.rlike(ENTRY_LINE)).alias("entries"),
    ).withColumn("one", F.lit(1))
    p = running_sum(p, "one", "nth", BOOK, ["page_idx"])
    seen = lambda c: p.filter(c).select("book", F.explode(F.sequence(F.col("nth") - ahead, F.col("nth") - 1)).alias("nth")).distinct().withColumn(f"_{c}", F.lit(True))
    size = p.groupBy("book").agg(F.count("*").alias("pages"))
    own = p.filter("title").select("book", "page_idx", "nth", "hint").join(seen("numbered"), ["book", "nth"], "left").join(seen("entries"), ["book", "nth"], "left").join(size, "book")
    n, e = F.coalesce("_numbered", F.lit(False)), F.coalesce("_entries", F.lit(False))
    good = own.filter("nth > pages DIV 3").filter((n & e) | (F.col("hint") & (n | e)))
    return size.join(good.groupBy("book").agg(F.min("page_idx").alias("start")), "book", "left").select("book", "pages", "start")


def sorted_notes(areas: DataFrame) -> DataFrame:
    """Items of a page by the number of their link; one without a link stays behind the one before it (leading ones last)."""
    linked = numbered_links(areas).select("book", F.col("item_page_idx").alias("page_idx"), F.col("item_area_pos").alias("area_pos"), F.col("item_k").alias("k"), "link")
    i = items(areas).join(linked, [*PAGE, "area_pos", "k"], "left")
    w = Window.partitionBy(*PAGE).orderBy("area_pos", "k")
    i = i.withColumn("by", F.coalesce(F.last("link", True).over(w), F.lit(2**62)))
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("by", "area_pos", "k"))
    return i.select(*PAGE, "area_pos", F.col("k").cast("long").alias("k"), "link", at.cast("long").alias("place"))


def dominant_chapter(areas: DataFrame) -> DataFrame:
    """Per page: the chapter with most entries, the first met on ties."""
    c = chapters(areas).filter("chapter IS NOT NULL AND type = 'footnote'").select(*PAGE, "area_pos", F.col("chapter.n").alias("chapter"), F.size(T.entries(F.col("text"))).cast("long").alias("n"))
    c = c.groupBy(*PAGE, "chapter").agg(F.sum("n").alias("n"), F.min("area_pos").alias("first"))
    return c.groupBy(*PAGE).agg(F.max_by("chapter", F.struct("n", -F.col("first"))).alias("chapter"), F.max("n").alias("entries"))
