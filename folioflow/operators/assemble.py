"""Elements of a document, its title repairs, contents and exports."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.layout import in_order
from folioflow.operators.scans import carry_forward, running_sum

BOOK, PAGE, ORDER = ["book"], ["book", "page_idx"], ["page_idx", "area_pos"]


def _near(df: DataFrame, value: str, out: str, back: bool) -> DataFrame:
    """The value of the row before (or after, if not back)."""
    if back:
        return carry_forward(df, value, out, BOOK, ORDER, inclusive=False)
    df = df.withColumns({"_p": -F.col("page_idx"), "_a": -F.col("area_pos")})
    return carry_forward(df, value, out, BOOK, ["_p", "_a"], inclusive=False).drop("_p", "_a")


def emitted(areas: DataFrame) -> DataFrame:
    """Areas of active pages that become elements of the body."""
    text = (F.col("type").isin("main_text", "chapter_title", "subtitle", "quote", "title_page")) & (T.strip(F.coalesce("text", F.lit(""))) != "")
    table = (F.col("type") == "table") & (F.coalesce(F.col("table_html"), F.lit("")) != "") if "table_html" in areas.columns else F.lit(False)
    return areas.filter(~F.coalesce("ignored", F.lit(False)) & (text | table | ((F.col("type") == "illustration") & F.col("illustration_id").isNotNull())))


def _joined(a: Column, b: Column) -> Column:
    """Two titles as one: a point between them unless there is one."""
    return F.concat(a, F.when(a.endswith("."), " ").otherwise(". "), b)


def merge_split_titles(areas: DataFrame) -> DataFrame:
    """Title areas; a lone number (or upper-case roman) and the title right after it are one.

    Of lone numbers in a row the first takes the second, the third the fourth.
    """
    title, keys = F.col("type") == "chapter_title", [*PAGE, "area_pos"]
    # all elements are counted, without their texts; only titles go on, and neighbours are known by their count
    a = running_sum(emitted(areas).select(*keys, title.alias("_title"), F.when(title, F.col("text")).alias("text"), F.lit(1).alias("_one")), "_one", "_nth", BOOK, ORDER).filter("_title")
    a = a.select(*keys, "text", "_nth", T.is_lone_number(F.col("text")).alias("_lone"))
    a = a.withColumns({"_v": F.struct("_nth", "_lone"), "_w": F.struct("_nth", "text")})
    a = _near(_near(a, "_v", "prev", True).drop("_v"), "_w", "next", False).drop("_w")
    after = F.coalesce((F.col("prev._nth") == F.col("_nth") - 1) & F.col("prev._lone"), F.lit(False))
    a = a.withColumn("_begin", F.when(~(F.col("_lone") & after), F.col("_nth")))
    a = carry_forward(a, "_begin", "_run", BOOK, ORDER)
    even = (F.col("_nth") - F.col("_run")) % 2 == 0
    takes = F.col("_lone") & even & F.coalesce(F.col("next._nth") == F.col("_nth") + 1, F.lit(False))
    own = T.plain(F.col("text"))
    text = F.when(takes, _joined(own, T.plain(F.col("next.text")))).otherwise(F.col("text"))
    a = a.select(*keys, text.alias("text"), "_nth", takes.alias("merged"))
    # what takes the next element makes that one go
    a = carry_forward(a.withColumn("_took", F.when(F.col("merged"), F.col("_nth"))), "_took", "_taken", BOOK, ORDER, inclusive=False)
    return a.filter(~F.coalesce(F.col("_taken") == F.col("_nth") - 1, F.lit(False))).select(*keys, "text", "merged")


def absorb_all_caps(areas: DataFrame) -> DataFrame:
    """Titles with the all-capitals paragraph (digits may stand in it) that follows them."""
    title = F.col("type") == "chapter_title"
    first = T.plain(F.replace(F.get(F.filter(T.paragraphs(T.strip(F.col("text"))), lambda p: T.strip(p) != ""), F.lit(0)), F.lit("\n"), F.lit(" ")))
    # of what isn't a title only a first paragraph in capitals goes on
    caps = F.when((F.col("type") == "main_text") & T.is_all_caps(first), first)
    a = emitted(areas).select(*PAGE, "area_pos", title.alias("_title"), F.when(title, F.col("text")).alias("text"), F.struct(caps.alias("caps")).alias("_v"))
    a = _near(a, "_v", "next", False).filter("_title")
    caps = F.col("next.caps")
    return a.select(*PAGE, "area_pos", F.when(caps.isNotNull(), _joined(T.plain(F.col("text")), caps)).otherwise(F.col("text")).alias("text"), caps.isNotNull().alias("absorbed"))


def contents(areas: DataFrame) -> DataFrame:
    """Chapters with their subtitles in order; those before the first title belong to the first chapter.

    Ids are ch-i over all titles of a book and sub-n over all subtitles.
    """
    on = areas.filter(~F.coalesce("ignored", F.lit(False)) & F.col("type").isin("chapter_title", "subtitle"))
    on = on.withColumns({"c": (F.col("type") == "chapter_title").cast("int"), "s": (F.col("type") == "subtitle").cast("int")})
    on = running_sum(running_sum(on, "c", "i", BOOK, ORDER), "s", "n", BOOK, ORDER)
    on = on.withColumn("chapter", F.greatest(F.col("i"), F.lit(1)))
    one = F.when(F.col("s") == 1, F.struct("page_idx", "area_pos", F.concat(F.lit("sub-"), F.col("n").cast("string")).alias("id")))
    toc = on.groupBy("book", "chapter").agg(F.min_by(F.when(F.col("c") == 1, T.squeeze(F.col("text"))), F.when(F.col("c") == 1, F.struct(*ORDER))).alias("title"), F.array_sort(F.collect_list(one)).alias("subs"))
    return toc.select("book", F.concat(F.lit("ch-"), F.col("chapter").cast("string")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.size("subs").cast("long").alias("subtitles"), F.array_join(F.col("subs.id"), ",").alias("sub_ids"))


def to_html(kind: Column, text: Column, id: Column | None = None) -> Column:
    """One element as HTML by its kind."""
    at = F.lit("") if id is None else F.concat(F.lit(' id="'), id, F.lit('"'))
    tag = lambda a, z: F.concat(F.lit(a), at, F.lit(">"), text, F.lit(z))
    return (
        F.when(kind == "chapter_title", tag('<div class="chapter-title"', "</div>"))
        .when(kind == "subtitle", tag('<div class="subtitle"', "</div>"))
        .when(kind == "quote", tag('<blockquote class="quote-block"', "</blockquote>"))
        .when(kind == "title_page", tag('<p class="title-page-line"', "</p>"))
        .when(kind == "note", tag('<div class="footnote-item"', "</div>"))
        .when(kind == "figure", tag("<figure", "</figure>"))
        .otherwise(tag('<p class="main-text"', "</p>"))
    )


def html_text(c: Column) -> Column:
    """Plain text of inline HTML: <sup>x</sup> as [x] (nothing if blank), backlinks and tags dropped, references decoded."""
    t = F.regexp_replace(c, r"(?s)<a[^>]*class=\"backlink\"[^>]*>.*?</a>", "")
    t = F.regexp_replace(t, r"(?is)<sup[^>]*>\s*(?:<[^>]*>\s*)*</sup>", "")
    t = F.regexp_replace(t, r"(?is)<sup[^>]*>\s*(.*?)\s*</sup>", "[$1]")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def to_txt(elements: DataFrame) -> DataFrame:
    """Elements (book, pos, kind, text) as one plain text per book: # title, ## chapters, ### subtitles, paragraphs; --- and ## Footnotes.

    Quotes, tables and title pages are not exported. A text ends in one line feed.
    """
    e = elements.filter(F.col("kind").isin("book", "chapter_title", "subtitle", "paragraph", "figure", "note"))
    t = T.strip(html_text(F.col("text")))
    flow = F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n[ \t]*", " "), " {2,}", " ")
    kind = F.col("kind")
    line = (
        F.when(kind == "book", F.concat(F.lit("# "), t)).when(kind == "chapter_title", F.concat(F.lit("## "), t)).when(kind == "subtitle", F.concat(F.lit("### "), t))
        .when(kind == "figure", F.when(t != "", F.concat(F.lit("[Illustration: "), t, F.lit("]"))).otherwise("[Illustration]")).when(kind == "note", T.squeeze(t)).otherwise(flow)
    )
    # lines begin and end without white space, so line feeds in a row stand inside one
    e = e.select("book", "pos", kind.alias("kind"), F.regexp_replace(line, r"\n{3,}", "\n\n").alias("line")).groupBy("book").agg(F.filter(F.array_sort(F.collect_list(F.struct("pos", "kind", "line"))), lambda x: x["line"] != "").alias("l")).filter(F.size("l") > 0)
    notes, rest = F.filter("l", lambda x: x["kind"] == "note"), F.filter("l", lambda x: x["kind"] != "note")
    lines = lambda x: F.transform(x, lambda y: y["line"])
    every = F.concat(lines(rest), F.when(F.size(notes) > 0, F.concat(F.array(F.lit("---"), F.lit("## Footnotes")), lines(notes))).otherwise(F.array().cast("array<string>")))
    e = e.select("book", every.alias("l"))
    return e.select("book", F.concat(F.array_join(F.concat(F.slice("l", F.lit(1), F.size("l") - 1), F.array(T.strip(F.element_at("l", -1)))), "\n\n"), F.lit("\n")).alias("text"))


def preview(areas: DataFrame) -> DataFrame:
    """What each active page gives to the book, in reading order: book, page_idx, k, kind, text."""
    a = in_order(emitted(areas))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("reading_pos"))
    return a.select(*PAGE, k.cast("long").alias("k"), F.col("type").alias("kind"), T.squeeze(F.coalesce("text", F.lit(""))).alias("text"))


def rewrite_sources(html: Column, folder: str, url: str) -> Column:
    """Sources of images in a folder, as they are served."""
    return F.replace(F.replace(html, F.lit(f'src="{folder}/'), F.lit(f'src="{url}/')), F.lit(f"src='{folder}/"), F.lit(f"src='{url}/"))


def epub_body(elements: DataFrame) -> DataFrame:
    """Elements (book, pos, html) ready for EPUB: images from ``images/`` as JPEG; of equal figures in a book the first stays."""
    src = r"""(?i)src=["'](?:[^"']*/)?([^"'/]+)\.(?:png|jpe?g)["']"""
    e = elements.withColumns({"image": F.nullif(F.regexp_extract("html", src, 1), F.lit("")), "html": F.regexp_replace("html", src, 'src="images/$1.jpg"')})
    k = F.row_number().over(Window.partitionBy("book", F.coalesce("image", F.concat(F.lit("\n"), F.col("pos").cast("string")))).orderBy("pos"))
    return e.withColumn("_k", k).filter("_k = 1").drop("_k")


def illustration_ids(areas: DataFrame) -> DataFrame:
    """Illustrations of active pages with three corners or more, with the id and file they are cropped to; missing ids are counted over all of a page's."""
    a = areas.filter(~F.coalesce("ignored", F.lit(False)) & (F.col("type") == "illustration") & (F.size(F.coalesce("polygon", F.array().cast("array<array<int>>"))) >= 3))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("area_pos"))
    name = F.coalesce(F.nullif("illustration_id", F.lit("")), F.format_string("illus_%03d", k))
    return a.withColumn("illustration_id", name).withColumn("file", F.concat(F.regexp_replace("source_image", r"\.[^.]*$", ""), F.lit("_"), F.col("illustration_id"), F.lit(".png"))).select(*PAGE, "area_pos", "illustration_id", "file")


def overlay(areas: DataFrame) -> DataFrame:
    """Each page's areas as an SVG to lay over its image: book, page_idx, svg."""
    points = F.array_join(F.transform("polygon", lambda p: F.concat(p[0].cast("string"), F.lit(","), p[1].cast("string"))), " ")
    shape = F.concat(F.lit('<polygon class="'), "type", F.lit('" points="'), points, F.lit('"/>'))
    a = areas.filter("polygon IS NOT NULL").groupBy(*PAGE, "page_w", "page_h").agg(F.array_sort(F.collect_list(F.struct("area_pos", shape.alias("s")))).alias("l"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("page_w").cast("string"), F.lit(" "), F.col("page_h").cast("string"), F.lit('">'))
    return a.select(*PAGE, F.concat(head, F.array_join(F.col("l.s"), ""), F.lit("</svg>")).alias("svg"))


def compression_report(files: DataFrame) -> DataFrame:
    """(book, before, after) of files in bytes -> per book: files, sizes and the percentage saved."""
    r = files.groupBy("book").agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return r.withColumn("saved_pct", F.when(F.col("before") > 0, F.round((1 - F.col("after") / F.col("before")) * 100, 1)).otherwise(0.0))


def headings(pages: DataFrame, level: int = 1) -> DataFrame:
    """Pages' headings of a level and their number of paragraphs, by pattern (for HTML that is well-formed there)."""
    h = F.regexp_extract_all("html", F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
    return pages.select("page_id", F.array_join(h, " | ").alias("headings"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"))


class _Elements(HTMLParser):
    """Block elements of a page in order: (kind, class, text)."""

    BLOCKS = {"h1", "h2", "h3", "p", "blockquote", "figure", "figcaption", "li", "div"}
    SKIP = {"script", "style", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.kind, self.name, self.text, self.skip = "", "", [], 0

    def _flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.out.append((self.kind, self.name, text))
        self.text = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCKS:
            self._flush()
            self.kind, self.name = tag, dict(attrs).get("class") or ""
        elif tag == "br":
            self.text.append(" ")
        elif tag == "sup":
            self.text.append("[")

    def handle_endtag(self, tag) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self._flush()
            self.kind = self.name = ""
        elif tag == "sup":
            self.text.append("]")

    def handle_data(self, data) -> None:
        if not self.skip:
            self.text.append(data)


def parse_elements(pages: DataFrame) -> DataFrame:
    """Foreign HTML as elements: page_id, pos, kind, name, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, text in zip(f["page_id"], f["html"], strict=True):
                p = _Elements()
                p.feed(text or "")
                p.close()
                p._flush()
                rows += [(page, i, *x) for i, x in enumerate(p.out)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "name", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, kind string, name string, text string")


def file_stem(title: str) -> str:
    """A title as a file name."""
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|]+', "", html.unescape(title))).strip() or "book"
