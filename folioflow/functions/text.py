"""Column functions over area texts: markers, leaders, entries, joins, clean-up.

The rules for markers differ from use to use; each variant has its own name.
``(?U)`` gives word and space classes their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
USUP, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
SYMBOLS_LINK, SYMBOLS_REVIEW = "*†‡§‖¶", "*†‡§¶|"
BODY_CONSOLIDATE = ("main_text", "chapter_title", "subtitle")
BODY_REVIEW = ("main_text", "quote", "chapter_title", "subtitle", "table")
BODY_ASSEMBLE = ("main_text", "quote", "chapter_title", "subtitle")
#: Headings of notes, by the whole title in lower case; and by its letters alone.
REGIME_TITLES = ("notes", "notes on text sources", "notes on sources", "notes to the text", "примечания", "примечание", "сноски", "endnotes", "end notes", "references", "annotations")
NOTES_TITLES = ("notes", "note", "endnotes", "end notes", "references", "annotations", "notes on sources", "notes on text sources", "source notes", "примечания", "сноски")
#: Marks that may stand behind the end of a sentence, and those that end one.
CLOSING, TERMINAL = "\"')]}»“”‘’", ".!?…"


def flag(df: DataFrame, name: str) -> Column:
    """A boolean column that may be null or missing."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def plain(c: Column) -> Column:
    """Without tags, ends stripped."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", ""))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, ends stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def usup_to_digits(c: Column) -> Column:
    return F.translate(c, USUP, DIGITS)


def digits_to_usup(c: Column) -> Column:
    return F.translate(c, DIGITS, USUP)


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,18}$"), c.cast("long"))


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    g = F.regexp_extract(c, pattern, k)
    return F.when(g != "", g)


def leading_consolidate(text: Column) -> Column:
    """Superscripts, then <sup>N</sup>, then ``N.`` or ``N `` (integer)."""
    t = strip(F.coalesce(text, F.lit("")))
    return _int(F.coalesce(usup_to_digits(_group(t, f"^([{USUP}]+)")), _group(t, r"(?i)^<sup>(\d+)</sup>"), _group(t, r"(?U)^(\d+)[.\s]")))


def leading_review(text: Column) -> Column:
    """``N.`` or ``N ``, then <sup>N</sup>, then superscripts (integer)."""
    t = strip(F.coalesce(text, F.lit("")))
    return _int(F.coalesce(_group(t, r"(?U)^(\d+)[.\s]"), _group(t, r"(?i)^<sup>(\d+)</sup>"), usup_to_digits(_group(t, f"^([{USUP}]+)"))))


def leading_assemble(text: Column) -> Column:
    """A symbol, then superscripts, ``N.`` or ``N ``, <sup>N</sup> (string)."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.coalesce(_group(t, f"^([{SYMBOLS_LINK}]+)"), usup_to_digits(_group(t, f"^([{USUP}]+)")), _group(t, r"(?U)^(\d+)[.\s]"), _group(t, r"(?i)^<sup>([^<]+)</sup>"))


def leading_renumber(text: Column) -> Column:
    """Superscripts, <sup>N</sup>, or ``N`` before white space - a point is no leader here (integer)."""
    t = strip(F.coalesce(text, F.lit("")))
    return _int(F.coalesce(usup_to_digits(_group(t, f"^([{USUP}]+)")), _group(t, r"^<sup>(\d+)</sup>"), _group(t, r"(?U)^(\d+)(?=\s)")))


def body_numbers(text: Column) -> Column:
    """Distinct integers in <sup> or as superscripts."""
    t = F.coalesce(text, F.lit(""))
    sup = F.regexp_extract_all(t, F.lit(r"(?i)<sup>(\d+)</sup>"), F.lit(1))
    usup = F.transform(F.regexp_extract_all(t, F.lit(f"[{USUP}]+"), F.lit(0)), usup_to_digits)
    return F.transform(F.filter(F.array_union(sup, usup), lambda x: F.length(x) <= 18), lambda x: x.cast("long"))


def body_markers(text: Column) -> Column:
    """Distinct markers of any kind in <sup> or as superscripts (strings)."""
    t = F.coalesce(text, F.lit(""))
    sup = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)<sup>([^<]+)</sup>"), F.lit(1)), strip)
    return F.array_union(sup, F.transform(F.regexp_extract_all(t, F.lit(f"[{USUP}]+"), F.lit(0)), usup_to_digits))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("long")


def count_markers(text: Column) -> Column:
    """Numeric, superscript and symbolic markers."""
    return count_matches(text, r"(?i)<sup>\d+</sup>") + count_matches(text, f"[{USUP}]+") + count_symbols(text)


def count_symbols(text: Column) -> Column:
    return count_matches(text, r"(?i)<sup>[*†‡§¶|]+</sup>")


#: What begins an entry in a note area.
ENTRY_CONSOLIDATE = rf"(?:[{USUP}]+|<sup>\d+[a-z]?</sup>|\d+[a-z]?[.\s])"
ENTRY_RENUMBER = rf"(?:[{USUP}]+|<sup>\d+[a-z]?</sup>|\d+[a-z]?\s)"


def entries(text: Column, start: str = ENTRY_CONSOLIDATE) -> Column:
    """Lines from one entry start up to the next, as an array without blank ones."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?U)\n(?=\s*{start})")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def raw_entries(text: Column, start: str) -> Column:
    """Like entries(), with all white space: joined by line feeds these are the text."""
    return F.split(F.coalesce(text, F.lit("")), rf"(?U)\n(?=\s*{start})")


def entries_review(text: Column) -> Column:
    """Lines from one entry start up to the next; inside an entry that began with a symbol, ``N `` begins none.

    The fold carries whether the open entry is symbolic.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("sym"))

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        symbol = t.rlike(r"^[*†‡§¶|]")
        starts = symbol | t.rlike(rf"(?U)^(?:[{USUP}]+|<sup>\d+[a-z]?</sup>|\d+[a-z]?\.)") | (t.rlike(r"(?U)^\d+[a-z]?\s") & ~s["sym"])
        fresh = F.struct(F.when(strip(s["open"]) != "", F.concat(s["done"], F.array(strip(s["open"])))).otherwise(s["done"]).alias("done"), line.alias("open"), symbol.alias("sym"))
        more = F.struct(s["done"].alias("done"), F.when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit("\n"), line)).alias("open"), s["sym"].alias("sym"))
        return F.when(starts, fresh).otherwise(more)

    return F.aggregate(lines, state, step, lambda s: F.when(strip(s["open"]) != "", F.concat(s["done"], F.array(strip(s["open"])))).otherwise(s["done"]))


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"(?U)\n\n|\n(?=\d{1,3}[.\s]|\+\s)")


def repair_hyphens(text: Column) -> Column:
    """A hyphen inside a word goes if white space, a low quote or its look-alikes (,, and -,) follow, and these with it."""
    return F.regexp_replace(text, r"(?U)(\w)-(?=[ \t\n]|„|,,|-,)[ \t\n]*(?:„|,,|-,)?[ \t]*(\w)", "$1$2")


def space_before_marks(text: Column) -> Column:
    """Spaces between a word and a comma or semicolon go."""
    return F.regexp_replace(text, r"(?U)(\w) +([,;])", "$1$2")


def join_hyphen(a: Column, b: Column) -> Column:
    """Two pieces of one note: a closing hyphen joins, else a space."""
    a, b = F.regexp_replace(a, r"(?U)\s+$", ""), strip(b)
    return F.when(a == "", b).when(b == "", a).when(a.endswith("-"), F.concat(F.expr("''"), F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def revert_bad_sups(text: Column) -> Column:
    """``<sup>1</sup>898`` -> ``1898``; so do all in a row that a digit follows."""
    return F.regexp_replace(text, r"(?U)<sup>(\d+)</sup>(?=(?:<sup>\d+</sup>)*\d)", "$1")


def first_words(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(squeeze(F.coalesce(text, F.lit(""))), " "), 1, n), " ")


def normalise_body(text: Column) -> Column:
    """Superscripts into <sup>, nested ones unwrapped, ranges of up to 20 spelt out."""
    t = F.regexp_replace(text, f"([{USUP}]+)", "<sup>$1</sup>")
    t = F.translate(t, USUP, DIGITS)
    t = F.regexp_replace(t, r"<sup>\s*<sup>([^<]*)</sup>\s*</sup>", "<sup>$1</sup>")
    part = F.split(t, r"(?=<sup>\d{1,9}\s*[-–]\s*\d{1,9}</sup>)")

    def spelt(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^<sup>(\d{1,9})\s*[-–]\s*(\d{1,9})</sup>", 1), F.regexp_extract(p, r"^<sup>(\d{1,9})\s*[-–]\s*(\d{1,9})</sup>", 2)
        lo, hi = F.coalesce(_int(a), F.lit(0)), F.coalesce(_int(b), F.lit(0))
        rest = F.regexp_replace(p, r"^<sup>[^<]*</sup>", "")
        every = F.array_join(F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: F.concat(F.lit("<sup>"), n.cast("string"), F.lit("</sup>"))), "")
        return F.when((lo < hi) & (hi - lo <= 20), F.concat(every, rest)).otherwise(p)

    return F.array_join(F.transform(part, spelt), "")


def normalise_leader(text: Column) -> Column:
    """A note's leader as ``N `` or ``symbol ``."""
    t = strip(text)
    t = F.regexp_replace(t, r"(?i)^<sup>([^<]+)</sup>[.\s]*", "$1 ")
    t = F.when(t.rlike(f"^[{USUP}]"), F.concat(usup_to_digits(F.regexp_extract(t, f"^([{USUP}]+)", 1)), F.lit(" "), F.regexp_replace(t, f"^[{USUP}]+[.\\s]*", ""))).otherwise(t)
    return F.regexp_replace(t, r"^(\d+|[*†‡§¶|]+)[.\s]+", "$1 ")


def letters_only(text: Column) -> Column:
    """Latin and Russian letters and white space, in lower case."""
    return F.lower(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^a-zA-Zа-яёА-ЯЁ\s]", "")))


def is_notes_title(text: Column) -> Column:
    return letters_only(text).isin(*NOTES_TITLES)


def is_all_caps(text: Column) -> Column:
    """No lower-case letter, and a letter or digit."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\W", "")
    return (letters != "") & (letters == F.upper(letters))


def is_lone_number(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))).rlike(r"(?U)^(?:\d+|[IVXLCDM]+)\.?$")


def looks_cut(text: Column) -> Column:
    """Whether a paragraph goes on: without the elements, tags and closing marks behind it, it doesn't end in . ! ? or an ellipsis."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")

    def step(t: Column, _: Column) -> Column:
        t = F.regexp_replace(t, r"(?U)<\w+>[^<]*</\w+>\s*$|\s+$", "")
        return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+$", ""), r"(?U)<[^>]+>\s*$|\s+$", "")

    # a round that changes anything takes a tag away: as many rounds as there are tags reach the end
    tags = F.length(t) - F.length(F.replace(t, F.lit("<"), F.lit("")))
    t = F.when(t.endswith(">"), F.aggregate(F.sequence(F.lit(0), tags), t, lambda t, i: F.regexp_replace(step(t, i), r"(?U)\s+$", ""))).otherwise(t)
    t = F.regexp_replace(t, r"[\"')\]}»“”‘’]+$", "")
    return (t != "") & ~t.rlike(r"[.!?…]$")


def chapter_number(text: Column) -> Column:
    """``3. Title`` or ``Chapter 3``."""
    return _int(F.coalesce(_group(text, r"(?U)^\s*(\d{1,4})\.\s"), _group(text, r"(?iU)^\s*chapter\s+(\d{1,4})\b")))


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
