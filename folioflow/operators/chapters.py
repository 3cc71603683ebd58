"""Reviews of endnotes: by chapter at the book's end, or in Notes sections inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.layout import top_order
from folioflow.operators.matching import ENTRY_LINE, entry_numbers
from folioflow.operators.scans import carry_backward, carry_forward, cut, running_sum

BOOK, PAGE = ["book"], ["book", "page_idx"]
#: Rank of chapters whose page isn't known.
LAST = 999999


def title_key(text: Column) -> Column:
    """A title without tags, number and ``Chapter IV -``, in lower case."""
    t = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.coalesce(text, F.lit(""))), "\n", " "), r"<[^>]+>", ""))
    t = T.strip(F.regexp_replace(t, r"(?sU)^\d+\.\s+(.*)$", "$1"))
    return F.lower(T.strip(F.regexp_replace(t, r"(?isU)^Chapter\s+[IVXLCDM]+\s*[—–\-:]\s*(.*)$", "$1")))


def _number(text: Column, pattern: str) -> Column:
    n = F.regexp_extract(T.strip(F.coalesce(text, F.lit(""))), pattern, 1)
    return F.when(n.rlike(r"^\d{1,18}$"), n.cast("long"))


NUMBERED, WORDED = r"(?U)^(\d+)\.\s", r"(?iU)^(?:<[^>]+>)*\s*Chapter\s+(\d+)"


def _key(n: Column, text: Column) -> Column:
    """A chapter: its number, or else its title's key."""
    return F.struct(n.alias("n"), F.when(n.isNull(), title_key(text)).alias("title"), F.replace(T.strip(text), F.lit("\n"), F.lit(" ")).alias("raw"))


def _sups(areas: DataFrame) -> DataFrame:
    """book, page_idx, n of body markers in <sup>."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)) & F.col("type").isin(*T.BODY_REVIEW))
    found = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)<sup>(\d+)</sup>"), F.lit(1)), lambda x: F.length(x) <= 18)
    return on.select(*PAGE, F.explode(found).alias("n")).select(*PAGE, F.col("n").cast("long"))


def body_chapters(areas: DataFrame, start: DataFrame) -> DataFrame:
    """book, page_idx, n, title, raw: the chapter of each active page before the endnotes (``start``: book, start).

    A page belongs to the last chapter title on it or before it; titles of
    notes begin none. Pages before the first title have no row.
    """
    on = areas.filter(~F.coalesce("ignored", F.lit(False))).select(*PAGE, "area_pos", F.when(F.col("type") == "chapter_title", F.coalesce("text", F.lit(""))).alias("_title"))
    n = _number(F.col("_title"), NUMBERED)
    begins = F.col("_title").isNotNull() & (n.isNotNull() | ~T.is_notes_title(F.col("_title")))
    pages = on.groupBy(*PAGE).agg(F.max(F.when(begins, F.struct("area_pos", _key(n, F.col("_title")).alias("k")))).alias("own"))
    pages = pages.join(start, "book", "left").filter(F.col("start").isNull() | (F.col("page_idx") < F.col("start"))).drop("start")
    pages = carry_forward(pages.withColumn("own", F.col("own.k")), "own", "k", BOOK, ["page_idx"])
    return pages.filter("k IS NOT NULL").select(*PAGE, "k.n", "k.title", "k.raw")


def note_chapters(areas: DataFrame, start: DataFrame, body: DataFrame) -> DataFrame:
    """book, page_idx, n, title, raw, begins, numbers: areas of the endnotes' pages under their chapter, from the top of each page.

    ``Chapter N`` begins one wherever it stands; another title does unless it is
    one of notes or an entry; so does a main text's first line that is a title
    known from elsewhere. ``numbers`` are the entries in main texts.
    """
    title, main = F.col("type").isin("subtitle", "chapter_title"), F.col("type") == "main_text"
    first = T.strip(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    line = F.when(main, first).otherwise(F.replace(T.strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")))
    # boxes rank all areas of a page; of their texts only lines that may begin a chapter go on
    start = cut(start.filter("start IS NOT NULL"))  # a table of known size: it is broadcast if it is small, and texts aren't dealt out by book
    on = areas.join(start, "book").filter(~F.coalesce("ignored", F.lit(False)) & (F.col("page_idx") >= F.col("start"))).withColumn("_line", F.when(title | main, line))
    on = on.withColumn("_n", _number(F.col("_line"), WORDED)).withColumn("_line", F.when(title | F.col("_n").isNotNull() | (F.length("_line") < 100), F.col("_line")))
    free = F.col("_n").isNull() & ~T.is_notes_title(F.col("_line")) & ~F.col("_line").rlike(ENTRY_LINE) & (F.col("_line") != "")
    on = on.withColumn("numbers", F.when(main, entry_numbers(F.col("text"))).otherwise(F.array().cast("array<bigint>")))
    on = top_order(on.select(*PAGE, "area_pos", *[c for c in ("y0",) if c in areas.columns], "_n", "_line", F.when(free, title_key(F.col("_line"))).alias("_title"), title.alias("_head"), main.alias("_main"), "numbers"))
    on = cut(on.filter("_head OR _main").drop("area_pos", "y0"))
    known = body.filter("n IS NULL").select("book", "title").unionAll(on.filter("_head AND _title IS NOT NULL").select("book", "_title")).distinct()
    # a title begins a chapter known or not; a main text must be looked up
    asks = F.col("_title").isNotNull() & ~F.col("_head")
    found = on.filter(asks).join(known.select("book", F.col("title").alias("_title"), F.lit(True).alias("_known")), ["book", "_title"], "left").select(*on.columns, "_known")
    on = found.unionByName(on.filter(~F.coalesce(asks, F.lit(False))).withColumn("_known", F.lit(None).cast("boolean")))
    begins = F.col("_n").isNotNull() | (F.col("_title").isNotNull() & (F.col("_head") | F.coalesce("_known", F.lit(False))))
    key = F.struct(F.col("_n").alias("n"), F.when(F.col("_n").isNull(), F.col("_title")).alias("title"), F.col("_line").alias("raw"))
    on = on.select(*PAGE, "reading_pos", F.when(begins, key).alias("_k"), "numbers")
    on = carry_forward(on, "_k", "k", BOOK, ["page_idx", "reading_pos"])
    return on.filter("k IS NOT NULL").select(*PAGE, "k.n", "k.title", "k.raw", F.col("_k").isNotNull().alias("begins"), "numbers", "reading_pos")


def _list(c: Column) -> Column:
    """Numbers as text, ascending."""
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


def _count_badge(a: Column, b: Column) -> Column:
    return F.concat(F.size(a).cast("string"), F.lit("↑·"), F.size(b).cast("string"), F.lit("fn"))


def chapter_review(areas: DataFrame, start: DataFrame) -> DataFrame:
    """One row per chapter: its titles in the body and in the notes, markers without entries, entries without markers, the state.

    name_match: exact, prefix_stripped, chapter_num_only, body_only, notes_only
    or mismatch. place: its rank by the first page of the body, else of the
    notes. Chapters without a number are told apart by their titles.
    """
    key = ["book", "n", "title"]
    body = body_chapters(areas, start)
    sups = body.withColumnRenamed("n", "ch").join(_sups(areas), PAGE).groupBy("book", F.col("ch").alias("c"), "title").agg(F.collect_set("n").alias("sups"))
    b = body.groupBy(*key).agg(F.min("page_idx").alias("b_page"), F.min_by("raw", "page_idx").alias("b_raw"), F.count("*").alias("b_pages"))
    b = b.join(sups, (b["book"] == sups["book"]) & b["n"].eqNullSafe(sups["c"]) & b["title"].eqNullSafe(sups["title"]), "left").select(b["book"], b["n"], b["title"], "b_page", "b_raw", "b_pages", "sups")
    ends = note_chapters(areas, start, body)
    own = F.col("begins") | (F.size("numbers") > 0)
    e = ends.groupBy(*key).agg(
        F.min(F.when(own, F.col("page_idx"))).alias("e_page"), F.min_by("raw", F.struct("page_idx", "reading_pos")).alias("e_raw"),
        F.countDistinct(F.when(own, F.col("page_idx"))).alias("e_pages"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("entries"),
    )
    j = b.alias("b").join(e.alias("e"), (F.col("b.book") == F.col("e.book")) & F.col("b.n").eqNullSafe(F.col("e.n")) & F.col("b.title").eqNullSafe(F.col("e.title")), "full_outer")
    none = F.array().cast("array<bigint>")
    cols = {c: F.coalesce(f"b.{c}", f"e.{c}") for c in key}
    j = j.select(*[v.alias(k) for k, v in cols.items()], "b_page", "b_raw", F.coalesce("b_pages", F.lit(0)).alias("body_pages"), F.coalesce("sups", none).alias("sups"), "e_page", "e_raw", F.coalesce("e_pages", F.lit(0)).alias("note_pages"), F.coalesce("entries", none).alias("entries"))
    bn, en = title_key(F.col("b_raw")), title_key(F.col("e_raw"))
    match = (
        F.when((F.size("sups") == 0) & (F.size("entries") == 0), "exact")
        .when(F.col("b_raw").isNull(), "notes_only").when(F.col("e_raw").isNull(), "body_only")
        .when(bn == en, F.when(F.lower("b_raw") == F.lower("e_raw"), "exact").otherwise("prefix_stripped"))
        .when(F.col("n").isNotNull() & T.plain(F.col("e_raw")).rlike(r"(?iU)^Chapter\s+\d+$"), "chapter_num_only")
        .when(F.col("n").isNull() & (en.contains(bn) | bn.contains(en)), "exact").otherwise("mismatch")
    )
    lost, odd = F.array_except("sups", "entries"), F.array_except("entries", "sups")
    good = (F.size(lost) == 0) & (F.size(odd) == 0) & match.isin("exact", "prefix_stripped", "chapter_num_only")
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.coalesce("b_page", "e_page", F.lit(LAST)), "n", "title"))
    return j.select(
        *key, F.col("b_raw").alias("body_title"), F.col("e_raw").alias("notes_title"), match.alias("name_match"), "body_pages", "note_pages",
        _list(lost).alias("missing_entries"), _list(odd).alias("missing_sups"), F.when(good, "green").otherwise("red").alias("state"), _count_badge(F.col("sups"), F.col("entries")).alias("badge"), place.cast("long").alias("place"),
    )


def review_totals(chapters: DataFrame) -> DataFrame:
    """Per book of a chapter review: chapters, those in red, those whose names don't match."""
    n = lambda c: F.count(F.when(c, 1))
    return chapters.groupBy("book").agg(F.count("*").alias("chapters"), n(F.col("state") != "green").alias("red"), n(F.col("name_match").isin("mismatch", "body_only", "notes_only")).alias("names"))


def sup_gaps(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_idx, n) of markers -> stretches missing between pages: first_missing, last_missing, after_page or before_page.

    Before the first page that has markers if it doesn't begin with 1, after the
    page before otherwise. What a page lacks inside is its own affair.
    """
    p = pages.groupBy(*keys, "page_idx").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p = carry_forward(p.withColumn("_at", F.struct("page_idx", "hi")), "_at", "prev", keys, ["page_idx"], inclusive=False)
    low = F.coalesce("prev.hi", F.lit(0)) + 1
    return p.filter(F.col("lo") > low).select(*keys, low.alias("first_missing"), (F.col("lo") - 1).alias("last_missing"), F.col("prev.page_idx").alias("after_page"), F.when(F.col("prev").isNull(), F.col("page_idx")).alias("before_page"))


def chapter_sup_gaps(areas: DataFrame, start: DataFrame) -> DataFrame:
    """Stretches of body markers missing from each chapter: book, chapter (number, else title) and ``sup_gaps``."""
    body = body_chapters(areas, start).select(*PAGE, F.coalesce(F.col("n").cast("string"), "title").alias("chapter"))
    return sup_gaps(body.join(_sups(areas), PAGE), ["book", "chapter"])


def sections(areas: DataFrame) -> DataFrame:
    """book, page_idx, section, zone (body or notes) of active pages, for notes that follow each chapter.

    A chapter title opens a section and its body, a Notes title its notes. Each
    page counts where its last title leaves it, and in every notes zone that a
    title on it opens; a page with notes but without any title is one of notes,
    and so are those after it. Pages before the first section have no row.
    """
    on = areas.filter(~F.coalesce("ignored", F.lit(False)))
    title = F.col("type") == "chapter_title"
    notes = title & T.is_notes_title(F.col("text"))
    p = on.groupBy(*PAGE).agg(
        F.sum((title & ~notes).cast("int")).alias("opened"), F.max(notes).alias("notes_title"), F.max(F.when(title, F.struct("area_pos", notes.alias("notes")))).alias("last"),
        F.max(F.col("type") == "footnote").alias("has_notes"), F.min(F.when(notes, F.col("area_pos"))).alias("first_notes"), F.min(F.when(title & ~notes, F.col("area_pos"))).alias("first_body"),
    )
    p = p.withColumn("turn", F.when(F.col("last").isNotNull(), F.when(F.col("last.notes"), "notes").otherwise("body")).when(F.col("has_notes"), "notes"))
    p = running_sum(carry_forward(p, "turn", "zone", BOOK, ["page_idx"]), "opened", "section", BOOK, ["page_idx"])
    main = p.filter("section > 0").select(*PAGE, F.col("section").cast("long").alias("section"), "zone")
    # a Notes title with a new chapter after it on the page: notes of the section before as well
    early = p.filter(F.col("notes_title") & (F.col("last.notes") == F.lit(False)) & (F.col("section") - F.col("opened") > 0) & (F.col("first_notes") < F.col("first_body")))
    return main.unionAll(early.select(*PAGE, (F.col("section") - F.col("opened")).cast("long"), F.lit("notes"))).distinct()


def inline_review(areas: DataFrame) -> DataFrame:
    """One row per section of a book with notes inside: markers without entries and entries without markers.

    A section without notes of its own borrows those of the next one that has
    some (its owner); the owner's markers are those of all that borrow from it.
    """
    s = sections(areas)
    spans = s.groupBy("book", "section").agg(F.sum((F.col("zone") == "body").cast("long")).alias("body_pages"), F.sum((F.col("zone") == "notes").cast("long")).alias("note_pages"))
    spans = carry_backward(spans.withColumn("_o", F.when(F.col("note_pages") > 0, F.col("section"))), "_o", "owner", BOOK, ["section"]).withColumn("owner", F.coalesce("owner", "section"))
    sups = s.select(*PAGE, "section").distinct().join(_sups(areas), PAGE).groupBy("book", "section").agg(F.collect_set("n").alias("sups"))
    found = areas.filter(~F.coalesce("ignored", F.lit(False)) & (F.col("type") == "footnote")).select(*PAGE, F.explode(entry_numbers(F.col("text"))).alias("n"))
    of_notes = s.filter("zone = 'notes'").join(found, PAGE).groupBy("book", F.col("section").alias("owner")).agg(F.collect_set("n").alias("notes"))
    mixed = s.filter("zone = 'body'").join(found, PAGE).groupBy("book", "section").agg(F.collect_set("n").alias("mixed"))
    none = F.array().cast("array<bigint>")
    j = spans.join(sups, ["book", "section"], "left").join(mixed, ["book", "section"], "left").join(of_notes, ["book", "owner"], "left")
    j = j.withColumns({"sups": F.coalesce("sups", none), "entries": F.array_union(F.coalesce("notes", none), F.coalesce("mixed", none))})
    group = j.groupBy("book", "owner").agg(F.array_distinct(F.flatten(F.collect_list("sups"))).alias("every"))
    j = j.join(group, ["book", "owner"])
    owns = F.col("owner") == F.col("section")
    effective = F.when(owns, F.col("every")).otherwise(F.col("sups"))
    lost, odd = F.array_except(effective, "entries"), F.when(owns, F.array_except("entries", "every")).otherwise(none)
    state = F.when((F.size(lost) == 0) & (F.size(odd) == 0), "green").otherwise("red")
    return j.select("book", "section", "owner", "body_pages", "note_pages", _list(lost).alias("missing_entries"), _list(odd).alias("missing_sups"), state.alias("state"), _count_badge(F.col("sups"), F.col("entries")).alias("badge"))


def range_badge(numbers: Column, arrows: bool) -> Column:
    """``3↑ [1–7]`` for markers, ``1–7`` for entries."""
    lo, hi = F.array_min(numbers).cast("string"), F.array_max(numbers).cast("string")
    span = F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("–"), hi))
    return F.when(F.size(numbers) > 0, F.concat(F.size(numbers).cast("string"), F.lit("↑ ["), span, F.lit("]")) if arrows else span).otherwise("")


def page_tiles(areas: DataFrame) -> DataFrame:
    """Tiles of a book with notes inside, in their order: a page's markers (body) and entries (endnote), each where it has some or its zone asks for it.

    kind: "" for the page's own zone, ":body" before it for markers on a page of
    notes, ":en" after it for entries on a page of the body.
    """
    s = sections(areas)
    sups = _sups(areas).groupBy(*PAGE).agg(F.array_sort(F.collect_set("n")).alias("sups"))
    found = areas.filter(~F.coalesce("ignored", F.lit(False)) & (F.col("type") == "footnote")).select(*PAGE, F.explode(entry_numbers(F.col("text"))).alias("n")).groupBy(*PAGE).agg(F.array_sort(F.collect_set("n")).alias("entries"))
    none = F.array().cast("array<bigint>")
    # of a page in two sections the later one counts
    p = s.groupBy(*PAGE).agg(F.max(F.struct("section", "zone")).alias("z")).select(*PAGE, "z.section", "z.zone").join(sups, PAGE, "left").join(found, PAGE, "left")
    p = p.withColumns({"sups": F.coalesce("sups", none), "entries": F.coalesce("entries", none)})
    body = F.col("zone") == "body"
    tile = lambda kind, order, zone, numbers: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.lit(zone).alias("zone"), numbers.alias("numbers"))
    tiles = F.array(
        F.when(~body & (F.size("sups") > 0), tile(":body", 0, "body", F.col("sups"))),
        F.when(body, tile("", 1, "body", F.col("sups"))).otherwise(tile("", 1, "endnote", F.col("entries"))),
        F.when(body & (F.size("entries") > 0), tile(":en", 2, "endnote", F.col("entries"))),
    )
    t = p.select(*PAGE, "section", F.explode(F.array_compact(tiles)).alias("t")).select(*PAGE, "section", "t.*")
    holes = F.exists(F.transform(F.slice("numbers", 2, F.size("numbers")), lambda x, k: x - F.col("numbers")[k]), lambda d: d > 1)
    state = F.when(F.col("zone") == "body", F.when(F.size("numbers") == 0, "none").when(holes, "red").otherwise("green"))
    badge = F.when(F.col("zone") == "body", range_badge(F.col("numbers"), True)).otherwise(range_badge(F.col("numbers"), False))
    t = t.withColumns({"state": state, "badge": badge})
    return t.withColumn("numbers", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",")).select(*PAGE, "section", "kind", "order", "zone", "numbers", "state", "badge")


def snippets(areas: DataFrame, around: int = 35) -> DataFrame:
    """Each number's first marker in each area, with the text around it: book, page_idx, area_pos, n, snippet."""
    on = areas.filter(~F.coalesce("ignored", F.lit(False)) & F.col("type").isin(*T.BODY_REVIEW))
    marks = on.select(*PAGE, "area_pos", "type", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)<sup>\d{1,18}</sup>"), F.lit(0)))).alias("mark"))
    at = F.expr("locate(mark, text)")
    lo, hi = F.greatest(F.lit(1), at - around), F.least(F.length("text") + 1, at + F.length("mark") + around)
    raw = F.replace(F.substring(F.col("text"), lo, hi - lo), F.lit("\n"), F.lit(" "))
    text = F.concat(F.lit("["), "type", F.lit("] "), F.when(lo > 1, "…").otherwise(""), raw, F.when(hi <= F.length("text"), "…").otherwise(""))
    return marks.select(*PAGE, "area_pos", F.regexp_extract("mark", r"(\d+)", 1).cast("long").alias("n"), text.alias("snippet"))
