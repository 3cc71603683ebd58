"""LM scoring (7): an interpolated modified Kneser-Ney n-gram model of any order over the whole training corpus.

Words are 64-bit hashes, runs of words hashes of their prefixes. The longest
runs are counted where they stand and dealt out by their last word but one: a
task then sees all that follows a context, all that stands before a shorter
run, and so counts every order down to two. Only the lowest order is dealt out
again, and runs whose last word but one is hot (HOT of all tokens or more).
These are dealt by the words before it, too, and their shorter runs level by
level. Tables of hashes are kept in the shared folder; workers map them and
look sorted batches up. Each text is preceded by order - 1 begin marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import drop, mapped, pack, put, scratch, stored, unpack
from folioflow.llm.textops import U, mix, slices, sums, words

#: Hashes that stand for the begin and the end of a text.
BEGIN, END = U(0xB5297A4D3F84D5B5), U(0x1B56C4E9A2D7F38D)
#: Order of the model unless asked for another.
ORDER = 3
#: Tokens that a worker holds at most before their runs go out.
HELD = 3_000_000
LOOKUP_BYTES = 6 << 20
#: Files that a worker maps at once; Linux allows a process some 65,000 maps.
MAPS = 30_000

#: Tokens for each bucket of words and runs, about: buckets grow in number with the text, not in size.
BUCKET_TOKENS = 500_000
#: Share of the tokens from which on a word is hot.
HOT = 0.001

_HOT = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("of", pa.int64())])
_RUNS = pa.schema([("bucket", pa.int32()), ("runs", pa.binary())])
_MERGED = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("runs", pa.binary()), ("hot", pa.binary()), ("sums", pa.list_(pa.int64()))])
_MERGED_DDL = "order int, bucket int, runs binary, hot binary, sums array<long>"
_SCORED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0x9E3779B97F4A7C15) ^ second)


def tokens(col: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's begin marks, words and end as hashes; the places of words and ends among them; n + 1 offsets in these."""
    w, at = words(col)
    to = at + np.arange(len(at))
    places = np.arange(to[-1]) + (order - 1) * np.repeat(np.arange(1, len(at)), np.diff(to))
    out = np.full(to[-1] + (order - 1) * (len(at) - 1), BEGIN)
    body = np.ones(len(places), bool)
    body[to[1:] - 1] = False
    out[places[body]] = w
    out[places[~body]] = END
    return out, places, to


def columns(marked: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """The run of ``order`` tokens that ends at each place, word by word."""
    return [marked[places - k] for k in range(order - 1, -1, -1)]


def prefixes(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the first one, two, ... words of each run; the last is that of the run."""
    out = cols[:1]
    for c in cols[1:]:
        out = [*out, pair_hash(out[-1], c)]
    return out


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


@dataclass
class Deal:
    """Which bucket a run belongs to."""

    bits: int
    #: Sorted hashes of hot words, and how many bits of the words before one take part.
    hot: np.ndarray
    parts: np.ndarray

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(words), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)] == words

    def __call__(self, cols: list[np.ndarray], hot: np.ndarray | None = None) -> np.ndarray:
        """By the last word but one; where that is hot by the words before it, too, or, if there are none, by the run."""
        if len(cols) == 1:
            return _top(cols[0], self.bits)
        key = cols[-2].copy()
        own = np.flatnonzero(self.is_hot(key) if hot is None else hot)
        if len(own):
            word, part = key[own], prefixes([c[own] for c in cols])
            if len(cols) == 2:
                key[own] = part[-1]
            else:
                part = part[-3] >> U(1) >> (63 - self.parts[np.searchsorted(self.hot, word)]).astype(U)
                key[own] = pair_hash(word, part)
        return _top(key, self.bits)


def _hot(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marked, places, _ = tokens(b.column("text"), order)
            h, n = np.unique(marked[places - 1] if order > 1 else marked, return_counts=True)
            many = n >= HOT * len(places)
            h, n = np.append(U(0), h[many]), np.append(0, n[many])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.where(np.arange(len(n)) == 0, len(places), 0))], schema=_HOT)

    return run


@dataclass
class Runs:
    """Runs of words, each word a place in ``words`` (hashes); counts, and how often each run stands in the texts."""

    words: np.ndarray
    cols: list[np.ndarray]
    n: np.ndarray
    raw: np.ndarray

    def distinct(self) -> Runs:
        """Each run once, sums of counts; in the order of the last word but one, the words before it, the last."""
        by = [*self.cols[-2:-1], *self.cols[:-2], self.cols[-1]]
        size = max(1, len(self.words).bit_length())
        if size * len(by) < 64:
            key = np.zeros(len(self.n), np.int64)
            for c in by:
                key = key << size | c
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        else:
            order = np.lexsort(by[::-1])
            new = _new([c[order] for c in by])
        at = np.flatnonzero(new)
        n, raw = (np.add.reduceat(x[order], at) if len(at) else x for x in (self.n, self.raw))
        return Runs(self.words, [c[order[at]] for c in self.cols], n, raw)

    def pick(self, which: np.ndarray, cut: int = 0) -> Runs:
        return Runs(self.words, [c[which] for c in self.cols[cut:]], self.n[which], self.raw[which])

    def hashes(self) -> list[np.ndarray]:
        return [self.words[c] for c in self.cols]

    def shorter(self) -> Runs:
        """Without the first word: each run counts once."""
        return Runs(self.words, self.cols[1:], np.ones(len(self.n), np.int64), self.raw).distinct()

    def blobs(self, deal: Deal, file: str = "") -> tuple[list[int], list[bytes]]:
        """By bucket, in order. A word that the rows below share, with all words before it in that order, is written once.

        Words are numbers: places in ``words`` if these are kept in a file, else places in the blob's own.
        """
        to = deal(self.hashes())
        order = np.argsort(to.astype(np.uint16) if deal.bits <= 16 else to, kind="stable")
        cols, n, raw, to = [c[order] for c in self.cols], self.n[order], self.raw[order], to[order]
        cols = [*cols[-2:-1], *cols[:-2], cols[-1]]
        edge = np.searchsorted(to, np.arange((1 << deal.bits) + 1))
        buckets = np.flatnonzero(np.diff(edge))
        out = []
        for a, z in zip(edge[buckets], edge[buckets + 1], strict=True):
            part = [c[a:z] for c in cols]
            at = [np.flatnonzero(_new(part[: k + 1])) for k in range(len(part) - 1)]
            heads = [*(c[x] for c, x in zip(part, at, strict=False)), part[-1]]
            if file:
                words = {"file": np.frombuffer(file.encode(), np.uint8)}
            else:
                used, back = np.unique(np.concatenate(heads), return_inverse=True)
                heads, words = np.split(back, np.cumsum(list(map(len, heads)))[:-1]), {"words": self.words[used]}
            same = {f"same{k}": _planes(np.diff(np.append(x, z - a))) for k, x in enumerate(at)}
            out.append(_pack(**words, **same, **{f"word{k}": _planes(x) for k, x in enumerate(heads)}, n=_planes(n[a:z]), raw=_planes(raw[a:z] - n[a:z])))
        return buckets.tolist(), out


def _new(cols: list[np.ndarray]) -> np.ndarray:
    """Whether, in sorted rows, a row differs from the one before it."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers as all their lowest bytes, all their next ones, and so on, the number of bytes first; zero or more, or just below."""
    x = _narrow(x) if not len(x) or x.min() >= 0 else x.astype(np.int64)
    return np.append(np.uint8(x.itemsize), x.view(np.uint8).reshape(len(x), x.itemsize).T.ravel())


def _number(planes: np.ndarray) -> np.ndarray:
    x = planes[1:].reshape(planes[0], -1)
    return np.ascontiguousarray(x.T).view(f"<{'i' if planes[0] == 8 else 'u'}{planes[0]}").ravel().astype(np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(**arrays))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(data))


def _runs(blobs: list[bytes], order: int) -> Runs:
    parts = [_unpack(b) for b in blobs]
    files = {f: mapped(f)["words"] for f in {p["file"].tobytes().decode() for p in parts if "file" in p}}
    known = [files[p["file"].tobytes().decode()] if "file" in p else p["words"] for p in parts]
    heads = [[w[_number(p[f"word{k}"])] for p, w in zip(parts, known, strict=True)] for k in range(order)]
    words, back = np.unique(np.concatenate([h for own in heads for h in own]), return_inverse=True)
    back = np.split(back, np.cumsum([sum(map(len, own)) for own in heads])[:-1])
    same = [np.concatenate([_number(p[f"same{k}"]) for p in parts]) for k in range(order - 1)]
    cols = [*map(np.repeat, back[:-1], same), back[-1]]
    n = np.concatenate([_number(p["n"]) for p in parts])
    raw = n + np.concatenate([_number(p["raw"]) for p in parts])
    return Runs(words, [*cols[1:-1], *cols[: order > 1], cols[-1]], n, raw).distinct()


def _count(folder: str, order: int, deal: Deal):
    """Distinct runs by bucket; the words of all that went out together are a file, frequent ones first."""

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        start = np.cumsum([0, *(len(m) for m, _ in held)])
        places = np.concatenate([p + s for (_, p), s in zip(held, start, strict=False)])
        words, ids, often = np.unique(np.concatenate([m for m, _ in held]), return_inverse=True, return_counts=True)
        by = np.argsort(-often, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        file = f"{folder}/{uuid.uuid4().hex}"
        put(file, pack(words=words[by]))
        one = np.ones(len(places), np.int64)
        to, blobs = Runs(words[by], columns(rank[ids], places, order), one, one).distinct().blobs(deal, file)
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in slices(batches):
            held.append(tokens(b.column("text"), order)[:2])
            if sum(len(p) for _, p in held) > HELD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return run


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which of them stands where (np.unique sorts stably for that: slower)."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    at = np.flatnonzero(new)
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[at], order[at], back


def _coded(name: str, *fields: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of numbers: the distinct rows, and which of them stands where. Most counts are alike."""
    _, at, back = _once(fields[0])
    for f in fields[1:]:
        _, at, back = _once(back * (int(f.max()) + 1 if len(f) else 1) + f)
    return {f"{name}-rows": np.stack([f[at] for f in fields], axis=1).ravel(), f"{name}-code": _narrow(back)}


def _table(name: str, h: np.ndarray, *fields: np.ndarray) -> dict[str, np.ndarray]:
    """A hash's first bits are its slot, of some 32; the next 40 are kept, in order: one in 3 * 10**10 unknown ones is taken for another."""
    by = np.argsort(h)
    h, q = h[by], (len(h) // 32).bit_length()
    rest = h << U(q) >> U(24)
    at = np.searchsorted(h >> U(1) >> U(63 - q), np.arange((1 << q) + 1).astype(U))
    return {f"{name}-at": at.astype(np.uint32), f"{name}-high": (rest >> U(8)).astype(np.uint32), f"{name}-low": rest.astype(np.uint8), **_coded(name, *(x[by] for x in fields))}


def _look_up(t: dict[str, np.ndarray], name: str, h: np.ndarray, width: int) -> np.ndarray:
    """Rows of fields for each hash, 0 where there is none."""
    out = np.zeros((len(h), width), np.int64)
    if f"{name}-at" not in t or not len(t[f"{name}-high"]):
        return out
    at, high, low = (t[f"{name}-{k}"] for k in ("at", "high", "low"))
    q = (len(at) - 1).bit_length() - 1
    slot, rest = (h >> U(1) >> U(63 - q)).astype(np.int64), h << U(q) >> U(24)
    a, z = at[slot].astype(np.int64), at[slot + 1].astype(np.int64)
    last = z
    for _ in range(int((z - a).max()).bit_length()):
        mid = a + z >> 1
        i = np.minimum(mid, len(high) - 1)
        less = (mid < z) & ((high[i].astype(U) << U(8) | low[i]) < rest)
        a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
    i = np.minimum(a, len(high) - 1)
    hit = np.flatnonzero((a < last) & ((high[i].astype(U) << U(8) | low[i]) == rest))
    out[hit] = t[f"{name}-rows"].reshape(-1, width)[t[f"{name}-code"][i[hit]]]
    return out


def _sums(r: Runs) -> list[int]:
    return [*(int((r.n == k).sum()) for k in (1, 2, 3, 4)), len(r.n), int(r.n.sum()), int(r.raw.sum())]


def _contexts(r: Runs, found: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of each context, what SEEN says of it, and where its runs begin."""
    at = np.flatnonzero(_new([*r.cols[:-1]]))
    seen = [np.add.reduceat((r.n == k).astype(np.int64), at) for k in (1, 2)]
    seen += [np.diff(np.append(at, len(r.n))) - seen[0] - seen[1], np.add.reduceat(r.n, at)]
    return [found[-2][at], *seen, at]


def _merge(folder: str, top: int, order: int, deal: Deal):
    """Write a bucket's runs and contexts, down to two words; hand on the words, and shorter runs of hot words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        r = _runs(table.column("runs").to_pylist(), order)
        file, counts = {}, [[0] * 7 for _ in range(top + 1)]
        rows: list[tuple[int, int, bytes]] = []
        of_hot = b""
        for k in range(order, 0, -1):
            if k == 1 and order > 1:
                break
            counts[k] = _sums(r)
            found = prefixes(r.hashes())
            file |= _table(f"runs{k}", found[-1], r.n) if k > 1 else _table("runs1", found[-1], r.raw, r.n)
            if k == 1:
                break
            context, *seen, at = _contexts(r, found)
            hot = deal.is_hot(r.words)[r.cols[-2]]
            if k == 2:
                of = hot[at]
                of_hot = np.stack([context[of].view(np.int64), *(x[of] for x in seen)]).tobytes() if of.any() else b""
                context, seen = context[~of], [x[~of] for x in seen]
            file |= _table(f"contexts{k}", context, *seen)
            if k == 2:
                r = r.shorter()
                rows += [(1, b, x) for b, x in zip(*r.blobs(deal), strict=True)]
                break
            if hot.any():
                rows += [(k - 1, b, x) for b, x in zip(*r.pick(hot).shorter().blobs(deal), strict=True)]
                r = r.pick(~hot)
                if not len(r.n):
                    break
            r = r.shorter()
        put(f"{folder}/{order}-{bucket}", pack(**file))
        rows = rows or [(0, bucket, b"")]
        rest = len(rows) - 1
        to, buckets, blobs = zip(*rows, strict=True)
        flat = sum(counts, [])
        return pa.table([pa.array(to, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary()), pa.array([of_hot] + [b""] * rest, pa.binary()), pa.array([flat] + [[0] * len(flat)] * rest, pa.list_(pa.int64()))], schema=_MERGED)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, 3 and more; halves where a count of counts is missing."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.05), k) for k, x in enumerate(d[1:], 1))])


#: What is kept of a context: words after it that count once, twice, more often; the sum of their counts.
SEEN = ("n1", "n2", "n3", "total")


@dataclass
class Model:
    """Where the tables are, and the few sums that hold for all of them."""

    folder: str
    order: int
    deal: Deal
    vocabulary: int
    tokens: int
    #: Sum of the counts of the lowest order, and what its discounts take off them for all words alike.
    followed: int
    left_over: float
    #: By order.
    discounts: dict[int, np.ndarray]
    #: What SEEN says of each hot word as a context.
    hot_seen: np.ndarray

    @property
    def bits(self) -> int:
        return self.deal.bits

    @property
    def hot(self) -> np.ndarray:
        return self.deal.hot

    def _find(self, name: str, keys: np.ndarray, width: int, file: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Rows of fields for distinct keys, found in the buckets ``to`` of the files; 0 where there is none."""
        out = np.zeros((len(keys), width), np.int64)
        to = file << self.bits | to
        order = np.argsort(to.astype(np.uint16) if (self.order + 1) << self.bits <= 1 << 16 else to, kind="stable")
        to = to[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
        for i, j in zip(edge, edge[1:], strict=False):
            f, b = to[i] >> self.bits, to[i] & (1 << self.bits) - 1
            if (f, b) not in self.open:
                if len(self.open) >= MAPS:
                    self.open.clear()
                try:
                    self.open[f, b] = mapped(f"{self.folder}/{f}-{b}")
                except FileNotFoundError:  # nothing fell there
                    self.open[f, b] = {}
            own = order[i:j]
            out[own] = _look_up(self.open[f, b], name, keys[own], width)
        return out

    def _longer(self, order: int, cols: list[np.ndarray], low: np.ndarray) -> np.ndarray:
        """Probabilities of one order from those of the order below."""
        found, d = prefixes(cols), self.discounts[order]
        hot = self.deal.is_hot(cols[-2])
        to, file = self.deal(cols, hot), np.where(hot, order, self.order)
        h, first, back = _once(found[-1])
        c = self._find(f"runs{order}", h, 1, file[first], to[first])[back, 0]
        h, first, back = _once(found[-2])
        seen = self._find(f"contexts{order}", h, len(SEEN), file[first], to[first])
        if order == 2 and len(self.hot):
            hot = np.flatnonzero(hot[first])
            seen[hot] = self.hot_seen[:, np.searchsorted(self.hot, h[hot])].T
        n1, n2, n3, total = seen.T
        weight = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        return np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)[back] + weight[back] * low

    def score(self, col: pa.Array) -> list[np.ndarray]:
        """For each text: tokens, known tokens, base score, score (log10)."""
        if not hasattr(self, "open"):
            self.open: dict = {}
        marked, places, at = tokens(col, self.order)
        w, back = np.unique(marked[places], return_inverse=True)
        n, c = self._find("runs1", w, 2, np.ones(len(w), np.int64), self.deal([w])).T
        if self.followed:
            low = (np.maximum(c - self.discounts[1][np.minimum(c, 3)], 0) + self.left_over / (self.vocabulary + 1)) / self.followed
        else:
            low = np.full(len(w), 1 / (self.vocabulary + 1))
        prob = low[back]
        for k in range(2, self.order + 1):
            prob = self._longer(k, columns(marked, places, k), prob)
        base = np.log10((n + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        return [np.diff(at), sums((n > 0)[back].astype(np.int64), at), np.add.reduceat(base[back], at[:-1]), np.add.reduceat(np.log10(prob), at[:-1])]


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count all texts of docs (null: empty) and write the model. Rows without or with a repeated id count like any other."""
    if order < 1:
        raise ValueError("the order of a model is 1 or more")
    spark = docs.sparkSession
    folder = scratch(spark, "ngram")
    texts = docs.select(F.col(text_col).alias("text"))
    many = texts.mapInArrow(_hot(order), "word long, n long, of long")
    many = stored(many.groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of")), "ngram-many")
    every = many.agg(F.sum("of")).first()[0] or 0
    bits = max(1, (every // BUCKET_TOKENS).bit_length())
    hot = many.filter(F.col("n") >= max(1, HOT * every)).collect() if order > 1 else []
    hot = sorted((r.word & (1 << 64) - 1, r.n) for r in hot)
    deal = Deal(bits, np.array([h for h, _ in hot], U), np.array([(4 * n // BUCKET_TOKENS).bit_length() for _, n in hot], np.int64))
    drop(spark, many)
    words = scratch(spark, "ngram-words")
    runs = texts.mapInArrow(_count(words, order, deal), "bucket int, runs binary")
    sums_of, hot_seen, levels = np.zeros((order + 1, 7), np.int64), np.zeros((len(SEEN), len(hot)), np.int64), []
    for k in range(order, 0, -1):
        if k < order:
            left = [x.filter(F.col("order") == k).select("bucket", "runs") for x in (levels if k == 1 else levels[-1:])]
            runs = reduce(DataFrame.unionAll, left)
        merged = stored(runs.groupBy("bucket").applyInArrow(_merge(folder, order, k, deal), _MERGED_DDL), f"ngram-{k}")
        levels.append(merged)
        if k == order:
            drop(spark, words)
        spark.sparkContext._jvm.System.gc()  # with its plan, an exchange that nothing reads any more leaves the disk
        found = merged.agg(*(F.sum(F.col("sums")[i]) for i in range(sums_of.size))).first()
        sums_of += np.array([x or 0 for x in found], np.int64).reshape(sums_of.shape)
        for r in merged.filter(F.length("hot") > 0).select("hot").toLocalIterator():
            x = np.frombuffer(r.hot, np.int64).reshape(1 + len(SEEN), -1)
            np.add.at(hot_seen, (slice(None), np.searchsorted(deal.hot, x[0].view(U))), x[1:])
    for x in levels:
        drop(spark, x)
    taken = {k: discounts(*sums_of[k, :4].tolist()) for k in range(1, order + 1)}
    c1, c2, _, _, vocabulary, followed, every = sums_of[1].tolist()
    d = taken[1]
    # what the discounts take off all words' counts goes to all words alike
    left = d[1] * c1 + d[2] * c2 + d[3] * (vocabulary - c1 - c2)
    return Model(folder, order, deal, vocabulary, every, followed, float(left), taken, hot_seen)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=LOOKUP_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, model.score(b.column("text")))], schema=_SCORED)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id (long), n_tokens, n_known, base_score, score.

    Scores are log10 probabilities of the whole text with its end; null and
    empty texts are the end alone. Rows with a repeated id are all returned.
    An empty training table leaves the uniform distribution over the unknown
    word alone. Empty table: no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "id long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
