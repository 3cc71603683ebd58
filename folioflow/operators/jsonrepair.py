"""Repair of damaged JSON from models, and checks of the areas in it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import strip_fences

# A string, closed or not, or any other character: the text as a run of lexemes.
_LEX = re.compile(r'"(?:[^"\\]|\\.)*"?|[^"]', re.S)
_CLOSE = {"{": "}", "[": "]"}


def clean(raw: Column) -> Column:
    """The steps that are plain rewriting: fences, ``,"null,"``, invalid escapes, an unclosed polygon before text."""
    t = strip_fences(raw)
    t = F.regexp_replace(t, r',"null,"', ',"')
    t = F.regexp_replace(t, r'\\(?!["\\/bfnrtu])', "")
    return F.regexp_replace(t, r'(\[\[(?:-?\d+,\s*-?\d+\],\s*\[)*-?\d+,\s*-?\d+\])\s*,\s*"text"\s*:', '$1],"text":')


def escape_strings(s: str) -> str:
    """Control characters in strings escaped, and quotes that no ``, } ] :`` follows."""
    out, at, inside = [], 0, False
    for m in re.finditer(r'\\.|"|[\n\r\t]', s, re.S):
        out.append(s[at : m.start()])
        at, x = m.end(), m[0]
        if x == '"':
            follows = s[at:].lstrip(" \t\r\n")[:1]
            if inside and follows and follows not in ",}]:":
                x = '\\"'
            else:
                inside = not inside
        elif inside and x in "\n\r\t":
            x = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[x]
        out.append(x)
    return "".join([*out, s[at:]])


def _open_containers(s: str) -> tuple[list[str], str | None]:
    """What is open at the end: containers' closers, innermost last, and an unclosed string."""
    stack: list[str] = []
    for m in _LEX.finditer(s):
        x = m[0]
        if x in _CLOSE:
            stack.append(_CLOSE[x])
        elif x in "}]" and stack:
            stack.pop()
        elif x[0] == '"' and (len(x) == 1 or x[-1] != '"' or (len(x) - len(x[:-1].rstrip("\\")) - 1) % 2):
            return stack, x
    return stack, None


def whole_areas(s: str) -> dict | None:
    """The complete objects of the array ``areas``, and the page's size if it is there."""
    at = re.search(r'"areas"[^\[]*\[', s)
    if not at:
        return None
    body, depth, start, found = s[at.end() :], 0, 0, []
    for m in _LEX.finditer(body):
        if m[0] == "{":
            start, depth = (m.start() if depth == 0 else start), depth + 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                try:
                    found.append(json.loads(body[start : m.end()]))
                except ValueError:
                    continue
    if not found:
        return None
    size = re.search(r'"page_dimensions"\s*:\s*(\{[^}]+\})', s)
    return {"areas": found} | ({"page_dimensions": json.loads(size[1])} if size else {})


def close_open(s: str) -> dict | None:
    """A text that ends inside a string, closed: as a value first, then as a key."""
    stack, part = _open_containers(s)
    if part is None:
        return None
    part = part.rstrip()
    if (len(part) - len(part.rstrip("\\"))) % 2:
        part = part[:-1]
    head = s[: s.rindex(part.rstrip())] if part in s else s
    for more in ("", ':""'):
        try:
            return json.loads(f'{head}{part}"{more}{"".join(reversed(stack))}')
        except ValueError:
            continue
    return None


def repair(cleaned: str) -> tuple[dict | None, str]:
    """(value, how): as it is, escaped, from a fenced block, salvaged areas, or closed; (None, failed)."""
    tries = [("plain", lambda: json.loads(cleaned)), ("escaped", lambda: json.loads(escape_strings(cleaned)))]
    if block := re.search(r"```(?:json)?\s*(\{.*?\})\s*```", cleaned, re.S):
        tries.append(("fenced", lambda: json.loads(escape_strings(block[1]))))
    tries += [("salvaged", lambda: whole_areas(escape_strings(cleaned))), ("closed", lambda: close_open(escape_strings(cleaned)))]
    for how, f in tries:
        try:
            if isinstance(got := f(), dict):
                return got, how
        except (ValueError, RecursionError):
            continue
    return None, "failed"


#: Texts that are repaired together: as many as make so many bytes, or one.
SLICE = 1 << 20


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(start, count) of rows in a row that make SLICE bytes at most; a larger row is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE:
            yield start, i - start
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes) - start


def repair_json(df: DataFrame, column: str = "raw", keep: bool = True) -> DataFrame:
    """Adds json (compact, null if beyond repair) and how; without keep, the damaged texts go.

    A batch stays in Arrow's own memory; only a slice of it at a time becomes
    Python's strings and dicts, which take several times the room.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    clear = df.withColumn("_clean", clean(F.col(column)))
    df = df if keep else df.drop(column)
    schema = StructType([*df.schema.fields, StructField("json", StringType()), StructField("how", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_clean")), 0).to_pylist()
            rest = batch.select([c for c in batch.schema.names if c != "_clean"])
            for start, n in _slices(sizes):
                got = [repair(x or "") for x in batch.column("_clean").slice(start, n).to_pylist()]
                new = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) if v is not None else None for v, _ in got]
                yield pa.RecordBatch.from_arrays([*rest.slice(start, n).columns, pa.array(new, pa.string()), pa.array([h for _, h in got], pa.string())], [*rest.schema.names, "json", "how"])

    return (clear if keep else clear.drop(column)).mapInArrow(run, schema)


def check_polygon(p: Column) -> tuple[Column, Column]:
    """(polygon, verdict): rectangles from two corners or eight numbers, more than two dimensions cut; not four corners is an error, no area is dropped."""
    flat = p[0]
    rect = lambda x0, y0, x1, y1: F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    fixed = (
        F.when((F.size(p) == 1) & (F.size(flat) == 4), rect(flat[0], flat[1], flat[2], flat[3]))
        .when((F.size(p) == 1) & (F.size(flat) == 8), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(flat, i * 2 + 1, 2)))
        .otherwise(F.transform(p, lambda v: F.slice(v, 1, 2)))
    )
    x, y = F.transform(fixed, lambda v: v[0]), F.transform(fixed, lambda v: v[1])
    box = rect(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    fixed4 = F.when(F.size(F.array_distinct(fixed)) < 4, box).otherwise(fixed)
    verdict = F.when(p.isNull() | (F.size(p) == 0), "error").when(F.size(fixed4) != 4, "error").when(F.size(F.array_distinct(fixed4)) < 4, "drop").otherwise("ok")
    return fixed4, verdict


def check_areas(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per area (keys + polygon) -> polygon, verdict; an error rejects all areas of the same keys."""
    from pyspark.sql import Window

    fixed, verdict = check_polygon(F.col("polygon"))
    out = df.withColumns({"verdict": verdict, "fixed": fixed})
    bad = F.max(F.col("verdict") == "error").over(Window.partitionBy(*keys))
    return out.withColumn("verdict", F.when(bad, "rejected").otherwise(F.col("verdict"))).withColumn("polygon", F.when(F.col("verdict") == "ok", F.col("fixed"))).drop("fixed")
