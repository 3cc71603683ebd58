"""Rows from rows: entries, packed notes, normalised pages, page specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

PAGE = ["book", "page_idx"]


def split_packed(areas: DataFrame) -> DataFrame:
    """Note areas by entries; those of more than one become children _s1, _s2 ... Forced continuations stay whole."""
    notes = areas.filter(F.col("type") == "footnote")
    whole = F.when(T.flag(areas, "override") | T.flag(areas, "consolidated"), F.array("text")).otherwise(T.entries(F.col("text")))
    e = notes.withColumn("e", whole).select(*PAGE, "area_pos", F.size("e").alias("n"), F.posexplode("e").alias("k", "text"))
    child = F.concat(F.lit("area_"), F.col("area_pos").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("_s"), (F.col("k") + 1).cast("string"))).otherwise(""))
    return e.select(*PAGE, "area_pos", child.alias("id"), "text")


def _cut_lines(text: Column, starts) -> Column:
    """Lines grouped so that each that starts something begins a group; starts(line, state) -> (bool, new state)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(None).cast("long").alias("lead"))

    def step(s: Column, line: Column) -> Column:
        begins, lead = starts(line, s["lead"])
        first = (s["open"] == "") & (F.size(s["done"]) == 0)
        fresh = F.struct(F.when(first, s["done"]).otherwise(F.concat(s["done"], F.array(T.strip(s["open"])))).alias("done"), line.alias("open"), lead.alias("lead"))
        more = F.struct(s["done"].alias("done"), F.when(first, line).otherwise(F.concat(s["open"], F.lit("\n"), line)).alias("open"), F.coalesce(s["lead"], F.when(first, lead)).alias("lead"))
        return F.when(begins & ~first, fresh).otherwise(more)

    return F.aggregate(lines, state, step, lambda s: F.concat(s["done"], F.array(T.strip(s["open"]))))


def normalise_notes(areas: DataFrame) -> DataFrame:
    """Body markers and note leaders in one form, note areas split by what begins an entry.

    The splits follow each other: at inline <sup>, at lines with superscripts,
    at lines whose number is larger than the last that split, at lines with a
    symbol. Children are numbered in order.
    """
    held = T.flag(areas, "override") | T.flag(areas, "consolidated")
    text = F.when(F.col("type").isin(*T.BODY_CONSOLIDATE), T.normalise_body(F.col("text"))).when((F.col("type") == "footnote") & ~held, T.normalise_leader(F.col("text"))).otherwise(F.col("text"))
    a = areas.withColumn("text", text).withColumn("_split", (F.col("type") == "footnote") & ~held)
    inline = lambda t: F.filter(F.transform(F.split(T.strip(t), r"(?i)(?=<sup>\d+</sup>)"), lambda p: T.strip(F.regexp_replace(p, r"(?i)^<sup>(\d+)</sup>", "$1 "))), lambda p: p != "")
    usup = lambda t: F.transform(_cut_lines(t, lambda line, lead: (T.strip(line).rlike(f"^[{T.USUP}]"), lead)), lambda p: F.when(p.rlike(f"^[{T.USUP}]"), T.normalise_leader(p)).otherwise(p))
    larger = lambda line, lead: (F.coalesce(T.leading_review(line) > lead, F.lit(False)), T.leading_review(line))
    symbol = lambda line, lead: (T.strip(line).rlike(r"^[*†‡§¶|]"), lead)
    for cut in (inline, usup, lambda t: _cut_lines(t, larger), lambda t: _cut_lines(t, symbol)):
        parts = F.when(F.col("_split"), cut(F.coalesce("text", F.lit("")))).otherwise(F.array("text"))
        parts = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
        order = [c for c in a.columns if c.startswith("_k")]
        a = a.select(*[c for c in a.columns if c != "text"], F.posexplode(parts).alias(f"_k{len(order)}", "text"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*PAGE, "area_pos").orderBy(*[c for c in a.columns if c.startswith("_k")]))
    return a.withColumn("part", k.cast("long")).select(*PAGE, "area_pos", "part", "type", "text")


def page_numbers(spec: str) -> Column:
    """``57``, ``9,10``, ``10-20`` or any mix, as an array of numbers."""
    t = F.split(F.lit(spec), r"\s*,\s*")
    lo, hi = lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).cast("long"), lambda x: F.regexp_extract(x, r"(\d+)\s*$", 1).cast("long")
    return F.array_distinct(F.flatten(F.transform(t, lambda x: F.when(lo(x) <= hi(x), F.sequence(lo(x), hi(x))).otherwise(F.array().cast("array<bigint>")))))


def select_pages(pages: DataFrame, spec: str, column: str = "page_idx") -> DataFrame:
    """Rows whose page the specification names."""
    wanted = pages.sparkSession.range(1).select(F.explode(page_numbers(spec)).alias(column))
    return pages.join(wanted, column, "left_semi")


def select_named(pages: DataFrame, spec: str, column: str = "page_idx", name: str = "source_image") -> DataFrame:
    """Like select_pages(), or the one page whose image has this name."""
    if spec.strip() and not any(c not in "0123456789-, " for c in spec):
        return select_pages(pages, spec, column)
    return pages.filter((F.col(name) == spec.strip()) | (F.regexp_replace(name, r"\.[^.]*$", "") == spec.strip()))
