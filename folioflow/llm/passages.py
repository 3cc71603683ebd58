"""Substring dedup (4): MinHash banding of paragraphs, and equal runs of words inside them.

A paragraph is a line. Paragraphs of equal words are one class; others meet by
bands of least shingle hashes and are linked at an exact Jaccard similarity of
SIMILARITY; components of these are what repeats. Passages also repeat inside
lines, so runs of SPAN words that begin where the text itself says (the least
hash of GRAM words in each window of WINDOW places) are looked up as they are;
a run of at least SPAN + WINDOW - 1 equal words has one in common. Where such
runs end, the windows beside them are looked up as well, so equal runs are
known to their first and last word. Texts are read four times; what is
exchanged are hashes with the least and the greatest document that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.near import save_sets, shared_keys, verified
from folioflow.llm.store import drop, mapped, pack, put, scratch, stored, unpack
from folioflow.llm.textops import LOWER, U, distinct, inside, mix, run_hashes, slices, span_hashes, utf8
from folioflow.llm.textops import spans as word_spans
from folioflow.llm.wordtable import spread, top

SPAN, WINDOW, GRAM, SHINGLE = 36, 15, 3, 5
#: At a similarity of 0.8 two paragraphs share one of eight bands of three rows with probability 0.997, at 0.9 with 0.99999.
BANDS, ROWS = 8, 3
SIMILARITY = 0.8
#: Records that a worker holds at most before they go out.
HELD = 1_500_000

_BLOB = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])
_DONE = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_SECOND = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("node", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("set", pa.binary()), ("keys", pa.list_(pa.int64()))])
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.schema([("id", pa.int64()), ("spans", _SPAN), ("remove", _SPAN), ("firsts", pa.list_(pa.int64()))])


class Words:
    """A slice of texts as word hashes, with its lines and anchored runs."""

    def __init__(self, b: pa.RecordBatch, least: int):
        data, off = utf8(b.column("text"))
        data = LOWER[data]
        starts, ends, self.at = word_spans(data, off)
        self.doc = b.column("id").to_numpy()
        self.w = span_hashes(data, starts, ends)
        edge = distinct(np.concatenate([self.at, np.searchsorted(starts, np.flatnonzero(data == 10))]))
        line, size = edge[:-1], np.diff(edge)
        self.line, self.size = line[size >= least], size[size >= least]
        self.line_text = np.searchsorted(self.at, self.line, "right") - 1
        self.line_hash = run_hashes(self.w, self.line, self.size) if len(self.line) else np.zeros(0, U)
        self.run = self._anchors()
        self.run_text = np.searchsorted(self.at, self.run, "right") - 1
        self.run_hash = self.hashes(self.run)

    def hashes(self, place: np.ndarray) -> np.ndarray:
        return run_hashes(self.w, place, SPAN) if len(place) else np.zeros(0, U)

    def _anchors(self) -> np.ndarray:
        place = inside(self.at, GRAM + WINDOW - 1)  # windows that stay in their text
        if not len(place):
            return np.zeros(0, np.int64)
        g = np.full(len(self.w), ~U(0))
        i = np.arange(len(self.w) - GRAM + 1)
        g[i] = run_hashes(self.w, i, GRAM)
        least = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        anchor = distinct(np.concatenate([place[k : k + (1 << 18)] + least[place[k : k + (1 << 18)]].argmin(axis=1) for k in range(0, len(place), 1 << 18)]))
        return anchor[anchor + SPAN <= self.at[np.searchsorted(self.at, anchor, "right")]]

    def shingles(self, line: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of lines, and where each line's begin and the last one's end. A line of fewer words is one shingle."""
        n = np.maximum(size - SHINGLE + 1, 1)
        place = spread(line, n)
        return run_hashes(self.w, place, np.minimum(np.repeat(size, n), SHINGLE)), np.concatenate([[0], np.cumsum(n)])


def band_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of BANDS keys for each line."""
    keys = np.zeros((len(at) - 1, BANDS), U)
    for k in range(BANDS * ROWS):
        m = mix(s ^ U(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * U(31) + np.minimum.reduceat(m, at[:-1]) + U(k))
    return keys


def _least(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, with the least and the greatest document."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)


def _squeeze(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(**arrays))


def _open(data: bytes) -> dict[str, np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(data))


class Out:
    """Holds records (hash, document) and sends each hash once, with the least and the greatest document, to its bucket."""

    def __init__(self, kind: int, bits: int):
        self.kind, self.bits, self.held, self.n = kind, bits, [], 0

    def add(self, h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            self.held.append(_least(h, doc, doc))
            self.n += len(self.held[-1][0])
        if self.n > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            h, lo, hi = _least(*map(np.concatenate, zip(*self.held, strict=True)))
            edge = np.searchsorted(top(h, self.bits), np.arange((1 << self.bits) + 1))
            own = np.flatnonzero(np.diff(edge))
            rows = [_squeeze(h=h[a:z], lo=lo[a:z], more=hi[a:z] - lo[a:z]) for a, z in zip(edge[own], edge[own + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own + (self.kind << self.bits), pa.int32()), pa.array(rows, pa.binary())], schema=_BLOB)
        self.held, self.n = [], 0


def _collect(folder: str, bits: int, names: list[str]):
    """Keep the hashes that more than one document has, with the first of these; one file for each bucket of each kind."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_open(r) for r in table.column("rows").to_pylist()]
        h, lo, hi = _least(*(np.concatenate(x) for x in ([p["h"] for p in parts], [p["lo"] for p in parts], [p["lo"] + p["more"] for p in parts])))
        many = (lo != hi) | names[bucket >> bits].startswith("end")  # ends are asked for, whoever has them
        put(f"{folder}/{names[bucket >> bits]}-{bucket & (1 << bits) - 1}", pack(h=h[many], first=lo[many]))
        return pa.table([[bucket], [int(many.sum())]], schema=_DONE)

    return run


class Sets:
    """Sorted arrays in the shared folder, memory-mapped; a hash's high bits say in which it is."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, {}

    def find(self, kind: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are in, and their first document."""
        hit, first = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        edge = np.searchsorted(top(h[order], self.bits), np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(edge)):
            if (kind, b) not in self.open:
                try:
                    self.open[kind, b] = mapped(f"{self.folder}/{kind}-{b}")
                except FileNotFoundError:  # nothing fell there
                    self.open[kind, b] = {}
            t, own = self.open[kind, b], order[edge[b] : edge[b + 1]]
            if t and len(t["h"]):
                i = np.minimum(np.searchsorted(t["h"], h[own]), len(t["h"]) - 1)
                hit[own] = t["h"][i] == h[own]
                first[own] = t["first"][i]
        return hit, first


def _first(bits: int, least: int):
    """Lines and runs by hash (kind 0); the lines' band keys, with the lines in the documents' place (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keys = Out(0, bits), Out(1, bits)
        for b in slices(batches):
            x = Words(b, least)
            yield from out.add(np.concatenate([x.run_hash, x.line_hash]), x.doc[np.concatenate([x.run_text, x.line_text])])
            h, one = np.unique(x.line_hash, return_index=True)
            if len(h):
                yield from keys.add(band_keys(*x.shingles(x.line[one], x.size[one])).ravel(), np.repeat(h, BANDS).view(np.int64))
        yield from out.flush()
        yield from keys.flush()

    return run


def _chains(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hits in order, which begin and which end a chain of runs that touch."""
    apart = (text[1:] != text[:-1]) | (place[1:] - place[:-1] > SPAN)
    return np.concatenate([[True], apart]), np.concatenate([apart, [True]])


def _second(folder: str, bits: int, least: int):
    """Hashes of the runs at which chains begin (kind 0) and end (kind 1), as blobs; and the lines that share a band, with their contents."""

    def blobs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in found:
            none = [pa.nulls(r.num_rows, f.type) for f in _SECOND][2:]
            yield pa.RecordBatch.from_arrays([*r.columns, *none], schema=_SECOND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, outs = Sets(folder, bits), [Out(0, bits), Out(1, bits)]
        for b in slices(batches):
            x = Words(b, least)
            hit, first = sets.find("same", x.run_hash)
            for own in (hit, hit & (first != x.doc[x.run_text])):
                i = np.flatnonzero(own)
                if len(i):
                    for out, ends in zip(outs, _chains(x.run_text[i], x.run[i]), strict=True):
                        yield from blobs(out.add(x.run_hash[i[ends]], x.doc[x.run_text[i[ends]]]))
            h, lo, hi = _least(x.line_hash, x.doc[x.line_text], x.doc[x.line_text]) if len(x.line) else (x.line_hash,) * 3
            if not len(h):
                continue
            one = np.unique(x.line_hash, return_index=True)[1]
            s, at = x.shingles(x.line[one], x.size[one])
            keys = band_keys(s, at)
            shared = sets.find("keys", keys.ravel())[0].reshape(keys.shape)
            some = np.flatnonzero(shared.any(axis=1))
            rows = [distinct(s[at[k] : at[k + 1]]).tobytes() for k in some]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shared[some].sum(axis=1))]), pa.int32()), pa.array(keys[some][shared[some]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(top(h[some], bits), pa.int32()), pa.nulls(len(some), pa.binary()), pa.array(h[some].view(np.int64)), pa.array(lo[some]), pa.array(hi[some]), pa.array(rows, pa.binary()), lists], schema=_SECOND)
        for out in outs:
            yield from blobs(out.flush())

    return run


def _beside(x: Words, hit: np.ndarray, sets: Sets) -> np.ndarray:
    """Places of the windows beside those hits at which a chain of some document begins or ends."""
    i = np.flatnonzero(hit)
    out = []
    for kind, way in (("end-left", -1), ("end-right", 1)):
        at = i[sets.find(kind, x.run_hash[i])[0]]
        place = (x.run[at][:, None] + way * np.arange(1, WINDOW)).ravel()
        text = np.repeat(x.run_text[at], WINDOW - 1)
        out.append(place[(place >= x.at[text]) & (place + SPAN <= x.at[text + 1])])
    return distinct(np.concatenate(out))


def _third(folder: str, bits: int, least: int):
    """Windows beside the ends (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, out = Sets(folder, bits), Out(0, bits)
        for b in slices(batches):
            x = Words(b, least)
            place = _beside(x, sets.find("same", x.run_hash)[0], sets)
            yield from out.add(x.hashes(place), x.doc[np.searchsorted(x.at, place, "right") - 1])
        yield from out.flush()

    return run


def _union(text: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    """Each text's runs of words, united where they touch."""
    if not len(text):
        return pa.array([[]] * n, _SPAN)
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    far = int(end.max()) + 2
    a, z = text * far + start, np.maximum.accumulate(text * far + end)
    at = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    last = np.append(at[1:], len(a)) - 1
    own = text[at]
    pairs = pa.StructArray.from_arrays([pa.array(start[at], pa.int32()), pa.array(z[last] - own * far, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), pairs)


def _last(folder: str, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder, bits)
        for b in slices(batches):
            x = Words(b, least)
            hit, first = sets.find("same", x.run_hash)
            place = _beside(x, hit, sets)
            near, near_first = sets.find("beside", x.hashes(place))
            line, line_first = sets.find("same", x.line_hash)
            alike, alike_first = sets.find("class", x.line_hash)
            text = np.concatenate([x.run_text[hit], np.searchsorted(x.at, place[near], "right") - 1, x.line_text[line], x.line_text[alike]])
            start = np.concatenate([x.run[hit], place[near], x.line[line], x.line[alike]])
            end = start + np.concatenate([np.full(hit.sum() + near.sum(), SPAN), x.size[line], x.size[alike]])
            first = np.concatenate([first[hit], near_first[near], line_first[line], alike_first[alike]])
            start, end, n = start - x.at[text], end - x.at[text], len(x.doc)
            late = first != x.doc[text]
            one = np.flatnonzero(late)
            pair = np.unique(np.stack([text[one], first[one]]), axis=1) if len(one) else np.zeros((2, 0), np.int64)
            firsts = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[0], np.arange(n + 1)), pa.int32()), pa.array(pair[1], pa.int64()))
            every = pa.RecordBatch.from_arrays([pa.array(x.doc), _union(text, start, end, n), _union(text[late], start[late], end[late], n), firsts], schema=_FOUND)
            yield every.take(pa.array(np.unique(text)))

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SPAN) -> DataFrame:
    """One row per input row that shares a passage with another document.

    id; component_id: the smallest id that it reaches over shared passages;
    spans: its repeated runs, in words; remove: those of them that an earlier
    document has as well. Every passage stays in the document of the smallest
    id. Runs of SPAN + WINDOW - 1 = 50 equal words or more are always found and
    known to their first and last word, equal lines of ``least`` words or more
    always, and lines alike at SIMILARITY with probability 0.997 or more.
    Null, empty and short texts have none. Rows with a repeated id are one
    document: what only they share isn't found, and each is returned. Rows
    without an id are left out; ids must be integers. Empty table: no rows.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "passages")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * parts - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    blob, done = "bucket int, rows binary", "bucket int, n long"

    def collect(blobs: DataFrame, names: list[str]) -> None:
        blobs.groupBy("bucket").applyInArrow(_collect(folder, bits, names), done).agg(F.sum("n")).first()

    collect(rows.mapInArrow(_first(bits, least), blob), ["same", "keys"])
    second = stored(rows.mapInArrow(_second(folder, bits, least), f"{blob}, node long, doc long, last long, set binary, keys array<long>"), "passages-second")
    collect(second.filter("rows IS NOT NULL").select("bucket", "rows"), ["end-left", "end-right"])
    # paragraphs that are alike
    sets = second.filter("node IS NOT NULL")
    save_sets(sets.select("bucket", "node", "set"), folder)
    each = sets.select(F.col("node").alias("id"), "node", F.explode("keys").alias("key")).distinct()
    named = components(stored(verified(stored(shared_keys(each), "line-candidates"), folder, bits), "line-edges"))
    of = sets.groupBy("node").agg(F.min("doc").alias("doc"), F.max("last").alias("last")).join(named, "node")
    whole = of.groupBy("component").agg(F.min("doc").alias("first"), F.max("last").alias("last")).filter("first != last").select("component", "first")
    classes = named.join(whole, "component").select(F.shiftrightunsigned("node", 64 - bits).cast("int").alias("bucket"), "node", "first")
    classes.groupBy("bucket").applyInArrow(_save_first(folder, "class"), done).agg(F.sum("n")).first()
    drop(spark, second)
    # equal runs to their ends
    collect(rows.mapInArrow(_third(folder, bits, least), blob), ["beside"])
    found = stored(rows.mapInArrow(_last(folder, bits, least), "id long, spans array<struct<start:int,end:int>>, remove array<struct<start:int,end:int>>, firsts array<long>"), "repeats")
    drop(spark, folder)
    linked = components(found.select(F.col("id").alias("a"), F.explode("firsts").alias("b")))
    out = found.join(linked, found["id"] == linked["node"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"), "spans", "remove")


def _save_first(folder: str, kind: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = table.column("node").to_numpy().view(U)
        order = np.argsort(h)
        put(f"{folder}/{kind}-{key[0].as_py()}", pack(h=h[order], first=table.column("first").to_numpy()[order]))
        return pa.table([[key[0].as_py()], [len(h)]], schema=_DONE)

    return run
