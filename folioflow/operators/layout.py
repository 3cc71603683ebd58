"""Rectangles, columns, reading order, coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["book", "page_idx"]
WIDTH = 1000
ILLUSTRATION_TEXT = ("main_text", "footnote", "chapter_title", "subtitle", "illustration_caption")
MARGIN = 4


def bbox(polygon: Column) -> Column:
    """(x0, y0, x1, y1) of an array of [x, y]."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def rotate(x: Column, y: Column, rotation: Column, w: Column, h: Column, back: bool = False) -> tuple[Column, Column]:
    """A point after a turn by 0, 90, 180 or 270 degrees counter-clockwise on a page of w by h; back: the inverse."""
    if back:
        return (
            F.when(rotation == 90, w - y).when(rotation == 180, w - x).when(rotation == 270, y).otherwise(x),
            F.when(rotation == 90, x).when(rotation == 180, h - y).when(rotation == 270, h - x).otherwise(y),
        )
    return (
        F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, h - y).otherwise(x),
        F.when(rotation == 90, w - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y),
    )


def scale(v: Column, size: Column, mode: Column) -> Column:
    """A model's coordinate in page pixels: thousandths of the page if mode, clamped; halves to even."""
    return F.greatest(F.lit(0), F.least(F.when(mode, F.bround(v * size / 1000.0)).otherwise(v).cast("long"), size))


def _sized(areas: DataFrame, width: int) -> DataFrame:
    """Areas with their box as it is read (``_x0`` ...) and the page's reading width ``_w``; pages without size are ``width`` wide.

    ``page_w``, ``page_h`` and ``rotation`` are looked at where they are there.
    """
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in areas.columns else F.lit(d)
    w, h, turn = has("page_w", width), has("page_h", width), has("rotation", 0)
    (ax, ay), (bx, by) = (rotate(F.col(x), F.col(y), turn, w, h) for x, y in (("x0", "y0"), ("x1", "y1")))
    box = {"_x0": F.least(ax, bx), "_x1": F.greatest(ax, bx), "_y0": F.least(ay, by), "_y1": F.greatest(ay, by)}
    return areas.withColumns(box | {"_w": F.when(turn.isin(90, 270), h).otherwise(w), "_cx": (F.least(ax, bx) + F.greatest(ax, bx)) / 2})


def two_columns(areas: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per page: whether main texts overlap in height on both sides of the middle, or a side illustration faces text.

    Pages are small, so the pairs stay in the page's own arrays.
    """
    a = _sized(areas, width).filter(F.col("type").isin("main_text", "illustration", "chapter_title", "subtitle"))
    box = F.struct("type", F.col("_y0").alias("y0"), F.col("_y1").alias("y1"), F.col("_cx").alias("cx"), "_w")
    p = areas.select(*PAGE).distinct().join(a.groupBy(*PAGE).agg(F.collect_list(box).alias("b")), PAGE, "left")
    over = lambda s, t: (s["y0"] < t["y1"]) & (t["y0"] < s["y1"])
    main = F.filter("b", lambda s: s["type"] == "main_text")
    left, right = F.filter(main, lambda s: s["cx"] < s["_w"] / 2), F.filter(main, lambda s: s["cx"] > s["_w"] / 2)
    texts = F.exists(left, lambda s: F.exists(right, lambda t: over(s, t)))
    pics = F.filter("b", lambda s: (s["type"] == "illustration") & (F.abs(s["cx"] - s["_w"] / 2) >= s["_w"] * 0.1))
    faced = F.exists(pics, lambda s: F.exists(F.filter("b", lambda t: t["type"] != "illustration"), lambda t: over(s, t) & ((s["cx"] < s["_w"] / 2) != (t["cx"] < s["_w"] / 2))))
    return p.select(*PAGE, F.coalesce(texts | faced, F.lit(False)).alias("two_columns"))


def ranked(areas: DataFrame, width: int = WIDTH) -> DataFrame:
    """Areas with ``reading_pos``, their rank on the page.

    One column: by top, then centre. Two: what stands above the first narrow
    main text (side illustrations apart), then the left column, then the right,
    each by top; without a narrow main text nothing stands above. Ties keep
    their place in the list, and so do areas without a box.
    """
    a = _sized(areas.join(two_columns(areas, width), PAGE), width)
    narrow = (F.col("type") == "main_text") & ((F.col("_x1") - F.col("_x0")) <= F.col("_w") * 0.65)
    a = a.withColumn("_top", F.min(F.when(narrow, F.col("_y0"))).over(Window.partitionBy(*PAGE)))
    side = (F.col("type") == "illustration") & ((F.col("_x1") - F.col("_x0")) <= F.col("_w") * 0.65) & (F.abs(F.col("_cx") - F.col("_w") / 2) > F.col("_w") * 0.1)
    above = (F.col("_y0") < F.coalesce("_top", F.lit(0))) & ~side
    zone = F.when(~F.col("two_columns"), 0).when(above, 0).when(F.col("_cx") < F.col("_w") / 2, 1).otherwise(2)
    tie = F.when(~F.col("two_columns"), F.col("_cx")).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(zone, "_y0", tie, "area_pos"))
    return a.withColumn("reading_pos", rank.cast("long")).drop("_x0", "_x1", "_y0", "_y1", "_w", "_cx", "_top")


def reading_order(areas: DataFrame, width: int = WIDTH) -> DataFrame:
    """Areas' keys with their rank on the page."""
    return ranked(areas, width).select(*PAGE, "area_pos", "two_columns", "reading_pos")


def in_order(areas: DataFrame) -> DataFrame:
    """Areas with ``reading_pos``: their rank, or their place in the list where they have no boxes."""
    return ranked(areas) if "x0" in areas.columns else areas.withColumn("reading_pos", F.col("area_pos"))


def top_order(areas: DataFrame) -> DataFrame:
    """Areas with ``reading_pos`` by their top edge alone, those without a box last (as pages of endnotes are read)."""
    top = F.coalesce(F.col("y0"), F.lit(999999)) if "y0" in areas.columns else F.lit(0)
    return areas.withColumn("reading_pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(top, "area_pos")).cast("long"))


def rotated_box(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column, w: Column, h: Column) -> Column:
    """The box as the reader sees it, in the order x0, x1, y0, y1."""
    (ax, ay), (bx, by) = rotate(x0, y0, rotation, w, h), rotate(x1, y1, rotation, w, h)
    return F.struct(F.least(ax, bx).alias("x0"), F.greatest(ax, bx).alias("x1"), F.least(ay, by).alias("y0"), F.greatest(ay, by).alias("y1"))


def content_box(c: Column) -> Column:
    """(left, top, right, bottom); null if any of them is missing."""
    sides = [c[k] for k in ("left", "top", "right", "bottom")]
    whole = sides[0].isNotNull()
    for x in sides[1:]:
        whole = whole & x.isNotNull()
    return F.when(whole, F.struct(*[x.alias(k) for x, k in zip(sides, ("left", "top", "right", "bottom"), strict=True)]))


def rotated_content_box(c: Column, rotation: Column, w: Column, h: Column) -> Column:
    """A content box of the raw page in the page turned clockwise by 90, 180 or 270 degrees."""
    x0, y0, x1, y1 = (c[k] for k in ("left", "top", "right", "bottom"))
    at = lambda a, b, d, e: F.struct(a.alias("left"), b.alias("top"), d.alias("right"), e.alias("bottom"))
    return F.when(rotation == 90, at(h - y1, x0, h - y0, x1)).when(rotation == 180, at(w - x1, h - y1, w - x0, h - y0)).when(rotation == 270, at(y0, w - x1, y1, w - x0)).otherwise(at(x0, y0, x1, y1))


def effective_rotation(pages: DataFrame) -> Column:
    """What later steps must turn a page by: its own setting, never the turn that is in the image already."""
    return F.coalesce(F.col("rotation"), F.lit(0)) if "rotation" in pages.columns else F.lit(0)


def reading_size(w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as the reader sees them."""
    turned = rotation.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def crop_box(polygon: Column, skew: Column, w: Column, h: Column) -> Column:
    """Where to crop a polygon from a page deskewed about its centre: the turned corners' box within the polygon's own."""
    own = bbox(polygon)
    a = F.radians(skew)
    turned = F.transform(polygon, lambda p: F.array(F.cos(a) * (p[0] - w / 2) + F.sin(a) * (p[1] - h / 2) + w / 2, -F.sin(a) * (p[0] - w / 2) + F.cos(a) * (p[1] - h / 2) + h / 2))
    x, y = F.transform(turned, lambda p: F.bround(p[0])), F.transform(turned, lambda p: F.bround(p[1]))
    cut = F.struct(
        F.greatest(F.array_min(x), own["x0"].cast("double")).cast("long").alias("x0"), F.greatest(F.array_min(y), own["y0"].cast("double")).cast("long").alias("y0"),
        F.least(F.array_max(x), own["x1"].cast("double")).cast("long").alias("x1"), F.least(F.array_max(y), own["y1"].cast("double")).cast("long").alias("y1"),
    )
    plain = F.struct(*[own[k].cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])
    return F.when(F.coalesce(skew, F.lit(0.0)) == 0, plain).otherwise(cut)


def page_point(v: Column, span: Column, size: Column, left: Column) -> Column:
    """A model's coordinate on a crop, in page pixels: clamped to the model's span, scaled to the crop's size, moved by its offset."""
    return (F.bround(F.greatest(F.lit(0), F.least(span, v)) * size / span) + left).cast("long")


def clip_candidates(areas: DataFrame) -> DataFrame:
    """Pairs of an illustration and a text of the page whose rectangles overlap, with the axis to cut by."""
    key = [*PAGE]
    pic = areas.filter(F.col("type") == "illustration").select(*key, *[F.col(c).alias(f"i_{c}") for c in ("area_pos", "x0", "y0", "x1", "y1")])
    txt = areas.filter(F.col("type").isin(*ILLUSTRATION_TEXT)).select(*key, "area_pos", "x0", "y0", "x1", "y1")
    hit = (F.col("i_x0") < F.col("x1")) & (F.col("x0") < F.col("i_x1")) & (F.col("i_y0") < F.col("y1")) & (F.col("y0") < F.col("i_y1"))
    dx = F.abs((F.col("i_x0") + F.col("i_x1")) - (F.col("x0") + F.col("x1")))
    dy = F.abs((F.col("i_y0") + F.col("i_y1")) - (F.col("y0") + F.col("y1")))
    return pic.join(txt, key).filter(hit).select(*key, F.col("i_area_pos").alias("illustration"), F.col("area_pos").alias("text_area"), F.when(dy >= dx, "vertical").otherwise("horizontal").alias("axis"))


def _half(poly: list[list[int]], axis: int, limit: float, low: bool) -> list[list[int]]:
    """The part of a polygon on one side of a line."""
    out: list[list[int]] = []
    inside = (lambda p: p[axis] <= limit) if low else (lambda p: p[axis] >= limit)
    for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
        if inside(p):
            out.append(p)
        if inside(p) != inside(q):
            t = (limit - p[axis]) / (q[axis] - p[axis])
            out.append([round(p[0] + t * (q[0] - p[0])), round(p[1] + t * (q[1] - p[1]))])
    return out


def clip_polygon(poly: list[list[int]], texts: list[tuple[int, int, int, int]], margin: int = MARGIN) -> list[list[int]]:
    """Cut by each text's rectangle in turn, on the side away from it; under three points nothing is left."""
    for x0, y0, x1, y1 in texts:
        if len(poly) < 3:
            return []
        xs, ys = [p[0] for p in poly], [p[1] for p in poly]
        if not (min(xs) < x1 and x0 < max(xs) and min(ys) < y1 and y0 < max(ys)):
            continue
        dx, dy = (min(xs) + max(xs)) / 2 - (x0 + x1) / 2, (min(ys) + max(ys)) / 2 - (y0 + y1) / 2
        axis, d, lo, hi = (1, dy, y0, y1) if abs(dy) >= abs(dx) else (0, dx, x0, x1)
        poly = _half(poly, axis, lo - margin, True) if d < 0 else _half(poly, axis, hi + margin, False)
    return poly if len(poly) >= 3 else []


def clip_illustrations(areas: DataFrame) -> DataFrame:
    """Illustrations as polygons cut free of the page's texts, in the order of the texts (each cut works on what the one before it left).

    A cut only takes away, so texts that don't meet the whole rectangle never
    cut; only the others go to Python, which sees many pages at a time.
    """
    sides = ("x0", "y0", "x1", "y1")
    pic = F.col("type") == "illustration"
    a = areas.filter(F.col("type").isin("illustration", *ILLUSTRATION_TEXT)).select(*PAGE, pic.alias("_pic"), F.struct("area_pos", *[F.col(c).cast("long").alias(c) for c in sides]).alias("_box"))
    p = a.groupBy(*PAGE).agg(F.collect_list(F.when(F.col("_pic"), F.col("_box"))).alias("_pics"), F.collect_list(F.when(~F.col("_pic"), F.col("_box"))).alias("_texts"))
    p = p.select(*PAGE, F.explode("_pics").alias("_i"), "_texts")
    met = F.filter("_texts", lambda t: (F.col("_i.x0") < t["x1"]) & (t["x0"] < F.col("_i.x1")) & (F.col("_i.y0") < t["y1"]) & (t["y0"] < F.col("_i.y1")))
    p = p.select(*PAGE, F.col("_i.area_pos").alias("area_pos"), F.array(*[F.col(f"_i.{c}") for c in sides]).alias("box"), F.transform(F.array_sort(met), lambda t: F.array(*[t[c] for c in sides])).alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = []
            for (x0, y0, x1, y1), texts in zip((map(int, b) for b in f["box"]), f["texts"], strict=True):
                cut.append(clip_polygon([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], [tuple(map(int, t)) for t in texts]))
            yield f[[*PAGE, "area_pos"]].assign(polygon=cut)

    return p.mapInPandas(run, "book string, page_idx long, area_pos long, polygon array<array<long>>")


def figure_width(areas: DataFrame, content: int = WIDTH) -> DataFrame:
    """Illustrations' width in percent of the content's, 100 at most."""
    pics = areas.filter(F.col("type") == "illustration")
    return pics.select(*PAGE, "area_pos", F.least(F.lit(100), F.bround((F.col("x1") - F.col("x0")) * 100.0 / content)).cast("long").alias("width_pct"))
