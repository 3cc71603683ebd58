"""Polishing: requests per page, a model's answers, and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.layout import in_order
from folioflow.operators.sequence import last_main, next_prefix

PAGE = ["book", "page_idx"]
FIX = "struct<type:string,part1:string,part2:string,find:string,replace:string>"
ANSWER = f"array<struct<id:int,fixes:array<{FIX}>,page_join:string>>"
ITEM = "array<struct<id:int,type:string,text:string,is_last_main:boolean,next_page_prefix:string>>"


def parse_response(raw: Column) -> Column:
    """A model's answer as its list of results: fences and unknown escapes go. Null if it is no list."""
    t = F.regexp_replace(T.strip(raw), r"(?im)^```[a-z]*\s*|\s*```$", "")
    t = T.strip(F.regexp_replace(t, r'\\([^"\\/bfnrtu])', "$1"))
    return F.when(t.startswith("["), F.from_json(t, ANSWER))


def _quoted(c: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def apply_fixes(text: Column, fixes: Column) -> Column:
    """One fix after another: ``ocr_hyphen`` joins its two parts where they first stand with a hyphen; others replace the first find.

    A fix that finds nothing is passed over.
    """

    def step(t: Column, f: Column) -> Column:
        whole = F.concat(f["part1"], f["part2"])
        pattern = F.concat(F.lit("(?s)^(.*?)"), _quoted(f["part1"]), F.lit(r"(?U)-\s*(?-U)"), _quoted(f["part2"]))
        joined = F.regexp_replace(t, pattern, F.concat(F.lit("$1"), F.regexp_replace(whole, r"([\\$])", r"\\$1")))
        at = F.call_function("locate", f["find"], t)
        put = F.concat(F.substring(t, F.lit(1), at - 1), F.coalesce(f["replace"], F.lit("")), F.substring(t, at + F.length(f["find"]), F.length(t)))
        both = (F.coalesce(f["part1"], F.lit("")) != "") & (F.coalesce(f["part2"], F.lit("")) != "")
        hyphen = F.coalesce(f["type"] == "ocr_hyphen", F.lit(False))
        return F.when(hyphen, F.when(both, joined).otherwise(t)).when((F.coalesce(f["find"], F.lit("")) != "") & (at > 0), put).otherwise(t)

    return F.aggregate(F.coalesce(fixes, F.array().cast(f"array<{FIX}>")), text, step)


def cross_page(text: Column, fixes: Column) -> Column:
    """Fixes that join a word which the page's end cuts: its first part and a hyphen end the text."""
    end = lambda f: F.rlike(F.coalesce(text, F.lit("")), F.concat(_quoted(f["part1"]), F.lit(r"(?U)-\s*$")))
    return F.filter(F.coalesce(fixes, F.array().cast(f"array<{FIX}>")), lambda f: F.coalesce((f["type"] == "ocr_hyphen") & (f["part1"] != "") & end(f), F.lit(False)))


def prefixed(areas: DataFrame) -> DataFrame:
    """Areas with broken words and stray spaces mended, as they are sent."""
    mend = F.col("type").isin("main_text", "footnote") & (F.coalesce("text", F.lit("")) != "")
    return areas.withColumn("text", F.when(mend, T.space_before_marks(T.repair_hyphens(F.col("text")))).otherwise(F.col("text")))


def requests(areas: DataFrame) -> DataFrame:
    """One row per active page with text: items (as JSON) in reading order; the last main text says so, with the next page's first words."""
    on = prefixed(areas.filter(~F.coalesce("ignored", F.lit(False))))
    last = last_main(on).select(*PAGE, F.col("area_pos").alias("last_pos"))
    on = in_order(on).filter(F.col("type").isin("main_text", "footnote") & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    on = on.join(last, PAGE, "left").join(next_prefix(areas), PAGE, "left")
    is_last = (F.col("type") == "main_text") & (F.col("area_pos") == F.col("last_pos"))
    item = F.struct("reading_pos", "area_pos", "type", T.strip(F.col("text")).alias("text"), F.when(is_last, True).alias("is_last_main"), F.when(is_last & (F.col("next_prefix") != ""), F.col("next_prefix")).alias("next_page_prefix"))
    page = on.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("a"))
    items = F.transform("a", lambda x, k: F.struct(k.alias("id"), x["type"].alias("type"), x["text"].alias("text"), x["is_last_main"].alias("is_last_main"), x["next_page_prefix"].alias("next_page_prefix")))
    return page.select(*PAGE, F.to_json(items).alias("items"), F.transform("a", lambda x: x["area_pos"]).alias("areas"))


def apply_answers(areas: DataFrame, sent: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (book, page_idx, raw) to the requests sent -> changed areas (new_text), and pages (page_join, polished).

    Results meet their areas by ``id``; results without an area and areas
    without a result are passed over. A fix that joins a word cut by the page's
    end isn't made: the page is to be joined by its hyphen. Pages whose answer
    can't be read are left as they are; the last page of a book has no join.
    """
    r = sent.join(answers, PAGE).withColumn("results", parse_response(F.col("raw"))).filter("results IS NOT NULL")
    each = r.select(*PAGE, F.posexplode("areas").alias("k", "area_pos"), "results").withColumn("r", F.get(F.reverse(F.filter("results", lambda x: x["id"] == F.col("k"))), F.lit(0)))
    own = prefixed(areas).join(each.filter("r IS NOT NULL").select(*PAGE, "area_pos", "k", "r"), [*PAGE, "area_pos"])
    cut = cross_page(F.col("text"), F.col("r.fixes"))
    own = own.withColumn("_cut", cut).withColumn("_fixes", F.array_except(F.coalesce("r.fixes", F.array().cast(f"array<{FIX}>")), "_cut"))
    text = F.when(F.size("_fixes") > 0, T.revert_bad_sups(apply_fixes(T.strip(F.col("text")), F.col("_fixes")))).otherwise(F.col("text"))
    changed = own.select(*PAGE, "area_pos", text.alias("new_text"))
    join = F.coalesce(F.col("r.page_join"), F.when(F.size("_cut") > 0, "merge_hyphen"))
    joins = own.groupBy(*PAGE).agg(F.max_by(join, F.when(join.isNotNull(), F.col("k"))).alias("page_join"))
    more = next_prefix(areas).select(*PAGE, F.col("next_prefix").isNotNull().alias("more"))
    pages = r.select(*PAGE).join(joins, PAGE, "left").join(more, PAGE, "left")
    return changed, pages.select(*PAGE, F.coalesce("page_join", F.when(F.col("more"), "new_paragraph")).alias("page_join"), F.lit(True).alias("polished"))
