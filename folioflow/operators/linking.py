"""Passes over a book's elements (book, pos, kind, text): notes linked to their markers, headings mended.

Elements are what ``sequence.stitch`` and the note groups give: chapter_title,
subtitle, paragraph, quote, table; notes are of kind ``note``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.chapters import title_key
from folioflow.operators.scans import carry_forward, cut, running_sum

BOOK = ["book"]
BODY = ("chapter_title", "subtitle", "paragraph", "quote", "table")


def misclassified_header(text: Column) -> Column:
    """``5. Rome``: a number, letters and spaces alone, shorter than 50 characters."""
    t = T.strip(F.coalesce(text, F.lit("")))
    return t.rlike(r"(?U)^\d{1,2}\.\s+[A-Za-z][A-Za-z\s]+$") & (F.length(t) < 50)


def unwrap_nested_sups(text: Column) -> Column:
    """``<sup><sup>1</sup></sup>`` as one, however deep."""
    depth = F.size(F.regexp_extract_all(text, F.lit(r"<sup[^>]*>\s*(?=<sup)"), F.lit(0)))
    return F.aggregate(F.sequence(F.lit(0), depth), text, lambda t, _: F.regexp_replace(t, r"<sup[^>]*>\s*(<sup[^>]*>[^<]*</sup>)\s*</sup>", "$1"))


def usup_tags(text: Column) -> Column:
    """Superscript digits as <sup>."""
    return T.usup_to_digits(F.regexp_replace(text, f"([{T.USUP}]+)", "<sup>$1</sup>"))


def reset_links(text: Column) -> Column:
    """Text without the ids, links and backlinks that linking adds."""
    t = F.regexp_replace(text, r'(?s)<a[^>]*class="backlink"[^>]*>.*?</a>', "")
    t = F.regexp_replace(t, r'<sup id="[^"]*"', "<sup")
    return F.regexp_replace(t, r"(?s)(<sup[^>]*>)\s*<a[^>]*>(.*?)</a>\s*(</sup>)", "$1$2$3")


def set_item_number(text: Column, n: Column) -> Column:
    """A note's own marker replaced by ``N. ``."""
    t = F.regexp_replace(T.strip(text), r"(?U)^<sup>\s*\d+\s*</sup>", "")
    t = F.regexp_replace(t, rf"(?U)^\s*(?:[{T.USUP}]+\s*|[{T.SYMBOLS_LINK}]+\s*|\d+\.\s*|\d+ )", "")
    return F.concat(n.cast("string"), F.lit(". "), F.regexp_replace(t, r"(?U)^\s+", ""))


def note_items(text: Column) -> Column:
    """A packed note as its notes: parted at lines that begin with superscripts, or else at <sup>digits</sup> inside.

    Only a note that begins with a superscript is parted.
    """
    t = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<a[^>]*class=[\"']backlink[\"'][^>]*>.*?</a>", ""))
    keep = lambda a: F.filter(F.transform(a, T.strip), lambda p: p != "")
    lines, tags = F.split(t, rf"\n+(?=[{T.USUP}])"), F.split(t, r"(?<=.)(?=<sup>\s*\d+\s*</sup>)")
    return F.when(~t.rlike(rf"^[{T.USUP}]"), F.array(T.strip(F.coalesce(text, F.lit(""))))).when(F.size(lines) > 1, keep(lines)).otherwise(keep(tags))


def split_items(elements: DataFrame) -> DataFrame:
    """Elements with packed notes as notes of their own: ``part`` counts those of one element."""
    parts = F.when(F.col("kind") == "note", note_items(F.col("text"))).otherwise(F.array("text"))
    return elements.select("book", "pos", "kind", F.posexplode(parts).alias("part", "text")).select("book", "pos", F.col("part").cast("long").alias("part"), "kind", "text")


def promote_headers(elements: DataFrame) -> DataFrame:
    """Paragraphs like ``5. Rome`` after the book's first Notes title become subtitles."""
    notes = elements.filter((F.col("kind") == "chapter_title") & T.is_notes_title(T.plain(F.col("text")))).groupBy("book").agg(F.min("pos").alias("_from"))
    e = elements.join(notes, "book", "left")
    wrong = (F.col("kind") == "paragraph") & (F.col("pos") > F.col("_from")) & misclassified_header(T.plain(F.col("text")))
    return e.withColumn("kind", F.when(wrong, "subtitle").otherwise(F.col("kind"))).drop("_from")


def chapter_key(text: Column) -> Column:
    """``3. Title`` or ``Chapter 3`` -> 3; another title -> itself."""
    t = T.plain(text)
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d+)\.", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)^Chapter\s+(\d+)", 1), F.lit("")))
    return F.coalesce(n, F.nullif(t, F.lit("")))


def link(elements: DataFrame) -> DataFrame:
    """Markers of the body in order with what they are linked to.

    book, pos, k, marker, way (symbol, chapter, paged, or null), item_pos,
    number: the running number of linked markers, null if there is no link.

    A symbol takes the next note of that symbol. A number takes the entry of
    its chapter in the section after the Notes title, however often it is cited;
    failing that, the next note of that number. With one Notes title the body
    ends there; with more, each starts the count of numbers anew.
    """
    flat = T.plain(F.col("text"))
    chapter_title = F.col("kind") == "chapter_title"
    title = F.col("kind").isin("subtitle", "chapter_title") | ((F.col("kind") == "paragraph") & misclassified_header(flat))
    entry = F.nullif(F.regexp_extract(flat, r"(?U)^(\d+)\.\s", 1), F.lit(""))
    own = F.coalesce(F.nullif(F.regexp_extract(flat, r"^(\d+)\.", 1), F.lit("")), F.nullif(F.regexp_extract(flat, r"(?i)^Chapter\s+(\d+)", 1), F.lit("")))
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)<sup[^>]*>([^<]+)</sup>"), F.lit(1))
    found = F.filter(F.transform(found, lambda m, k: F.struct(k.alias("k"), T.strip(m).alias("marker"))), lambda m: m["marker"].rlike(rf"^(?:[{T.SYMBOLS_LINK}]+|\d+)$"))
    # what the passes below ask of an element, once and without its text
    e = cut(elements.filter(F.col("kind").isin(*BODY, "note")).select(
        "book", "pos", "kind", (chapter_title & T.is_notes_title(flat)).cast("int").alias("_notes"), F.when(title, chapter_key(F.col("text"))).alias("_k"), F.when(title, title_key(F.col("text"))).alias("_name"),
        F.when(chapter_title, own).alias("_own"), F.when((F.col("kind") == "paragraph") & ~title, entry).alias("_entry"),
        F.when(F.col("kind") == "note", T.leading_assemble(F.col("text"))).alias("_leader"), F.when(F.col("kind") != "note", found).alias("_marks"),
    ))
    heads = e.filter("_notes = 1").groupBy("book").agg(F.min("pos").alias("first"), F.count("*").alias("heads"))
    body = e.filter(F.col("kind").isin(*BODY)).drop("_leader").join(heads, "book", "left")
    # entries of chapters after the Notes title
    tail = carry_forward(body.filter("pos > first").select("book", "pos", "_k", "_name", "_entry"), "_k", "chapter", BOOK, ["pos"])
    entries = tail.filter(F.col("chapter").isNotNull() & F.col("_entry").isNotNull()).select("book", "chapter", F.col("_entry").alias("marker"), "pos")
    entries = entries.groupBy("book", "chapter", "marker").agg(F.max("pos").alias("chapter_pos"))
    names = tail.filter(F.col("_k").isNotNull()).groupBy("book", "_name").agg(F.max_by("_k", "pos").alias("named"))
    some = entries.select("book").distinct().withColumn("_some", F.lit(True))
    # chapters of the body
    is_title = F.col("kind") == "chapter_title"
    titles = body.filter(is_title).join(some, "book", "left").withColumn("_name", F.when(F.col("_some"), F.col("_name"))).join(names, ["book", "_name"], "left").withColumn("_c", F.coalesce("_own", "named"))
    kept = ["book", "pos", "_notes", "first", "heads", "_marks", "_c"]
    body = titles.select(kept).unionByName(body.filter(~is_title).withColumn("_c", F.lit(None).cast("string")).select(kept))
    body = running_sum(carry_forward(body, "_c", "chapter", BOOK, ["pos"]), "_notes", "section", BOOK, ["pos"])
    walked = body.filter(F.col("first").isNull() | (F.col("heads") > 1) | (F.col("pos") < F.col("first"))).filter(F.col("_notes") == 0)
    section = F.when(F.col("heads") > 1, F.col("section")).otherwise(0)
    marks = walked.select("book", "pos", "chapter", section.alias("section"), F.explode("_marks").alias("_m")).select("book", "pos", "chapter", "section", "_m.k", "_m.marker")
    symbol = F.col("marker").rlike(f"^[{T.SYMBOLS_LINK}]+$")
    marks = marks.join(entries, ["book", "chapter", "marker"], "left")
    # the n-th marker that looks for a note, and the n-th note
    looks = F.col("chapter_pos").isNull()
    by = Window.partitionBy("book", "marker", F.when(symbol, F.lit(-1)).otherwise(F.col("section")), looks).orderBy("pos", "k")
    marks = marks.withColumn("nth", F.when(looks, F.row_number().over(by)))
    notes = e.filter("kind = 'note'").withColumn("marker", F.col("_leader")).filter("marker IS NOT NULL")
    notes = notes.withColumn("nth", F.row_number().over(Window.partitionBy("book", "marker").orderBy("pos"))).select("book", "marker", "nth", F.col("pos").alias("note_pos"))
    out = marks.join(notes, ["book", "marker", "nth"], "left").withColumn("item_pos", F.coalesce("chapter_pos", "note_pos"))
    out = out.withColumn("_hit", F.col("item_pos").isNotNull().cast("int"))
    out = running_sum(out, "_hit", "number", BOOK, ["pos", "k"])
    way = F.when(F.col("chapter_pos").isNotNull(), "chapter").when(F.col("note_pos").isNotNull(), F.when(symbol, "symbol").otherwise("paged"))
    return out.select("book", "pos", F.col("k").cast("long").alias("k"), "marker", way.alias("way"), "item_pos", F.when(F.col("_hit") == 1, F.col("number").cast("long")).alias("number"))


def linked_items(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Notes and entries that are linked, with their new text: the number of the first citation, backlinks of all."""
    got = links.filter("number IS NOT NULL").groupBy("book", F.col("item_pos").alias("pos")).agg(F.array_sort(F.collect_list("number")).alias("cited"))
    back = F.array_join(F.transform("cited", lambda n: F.concat(F.lit('<a href="#sup-fn-'), n.cast("string"), F.lit('" class="backlink">↩</a>'))), "")
    return elements.join(got, ["book", "pos"]).select("book", "pos", "kind", F.concat(F.lit("fn-"), F.col("cited")[0].cast("string")).alias("id"), F.concat(set_item_number(F.col("text"), F.col("cited")[0]), back).alias("text"))
