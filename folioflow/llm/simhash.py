"""SimHash near-dedup (10): fingerprints, a Gray-order hierarchical index, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.store import stored
from folioflow.llm.textops import U

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Rows of one prefix node that one task takes; more are dealt out in pairs of blocks.
BLOCK_ROWS = 50_000
FAN = 8

_PRINT = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set where more than half of the shingles' hashes have it."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        at = [0, *accumulate(len(w) + 1 for w in words)]
        h = xxhash.xxh64_intdigest
        hashes = [h(whole[a : z - 1], seed) for a, z in zip(at, at[shingle:])]  # noqa: B905
    total = np.zeros(64, np.int64)
    every = np.array(hashes, U).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 1 << 16):
        total += np.unpackbits(every[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(U)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, last = [], {}
        for t in b.column("text"):
            raw = b"" if (x := t.as_py()) is None else x.encode()
            if (fp := last.get(key := hash(raw))) is None or fp[0] != raw:
                fp = last[key] = (raw, fingerprint(raw))
            found.append(fp[1])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(found, U).view(np.int64))], schema=_PRINT)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def bands(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, width) of distance + 1 parts of the 64 bits: of two words that near, one part is equal."""
    edge = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    return [(a, z - a) for a, z in zip(edge, edge[1:], strict=False)]


class Nodes:
    """The tree over words in Gray order: each node has the bits that all its words share.

    Level 0 holds the words themselves; a node above stands for FAN of the level
    below and holds the mask of the bits on which they agree, with their pattern.
    Longer fingerprints are rows of several words.
    """

    def __init__(self, words: np.ndarray):
        self.levels = [(np.full(words.shape, ~U(0)), words)]
        while len(self.levels[-1][1]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            lead = np.repeat(pattern[at], np.diff([*at, len(mask)]), axis=0)
            shared = ~np.bitwise_or.reduceat((pattern ^ lead) | ~mask, at, axis=0)
            self.levels.append((shared, pattern[at] & shared))


def _set_bits(x: np.ndarray) -> np.ndarray:
    """Bits set in each word, or in each row of words."""
    n = np.bitwise_count(x)
    return n if n.ndim == 1 else sum(c.astype(np.int64) for c in n.T)


def near_pairs(left: np.ndarray, right: np.ndarray | None, distance: int = DISTANCE) -> np.ndarray:
    """A root for each word: two words have one root if they are linked through near words given here.

    Both trees are walked from their tops. A pair of nodes carries the bits in
    which it differs so far; going down adds only those on bits that the nodes
    above did not share yet. Beyond the distance, the pair's whole groups go;
    so do pairs of groups that are one root's already.
    """
    words = left if right is None else np.concatenate([left, right])
    n, root = len(left), np.arange(len(words))
    trees = [Nodes(left), Nodes(left if right is None else right)]
    tops = len(trees[0].levels) - 1, len(trees[1].levels) - 1
    shift = 0 if right is None else n
    zero = np.zeros(1, np.int64)
    stack = [(*tops, zero, zero, zero, np.zeros((1, *left.shape[1:]), U))]
    while stack:
        la, lb, a, b, spent, known = stack.pop()
        (ma, pa_), (mb, pb) = trees[0].levels[la], trees[1].levels[lb]
        both = ma[a] & mb[b]
        spent = spent + _set_bits((pa_[a] ^ pb[b]) & both & ~known)
        keep = spent <= distance
        if right is None and la == lb:
            keep &= a <= b
        if la == lb == 0:
            keep &= root[a] != root[b + shift]
            _join(root, a[keep], b[keep] + shift)
            continue
        a, b, spent, known = a[keep], b[keep], spent[keep], both[keep]
        if la == lb == 1 and len(a):  # one root's already?
            lo, hi = (f.reduceat(root[:n], np.arange(0, n, FAN)) for f in (np.minimum, np.maximum))
            m = len(words) - shift
            lo2, hi2 = (f.reduceat(root[shift:], np.arange(0, m, FAN)) for f in (np.minimum, np.maximum))
            open_ = (lo[a] != hi[a]) | (lo2[b] != hi2[b]) | (lo[a] != lo2[b])
            a, b, spent, known = a[open_], b[open_], spent[open_], known[open_]
        if not len(a):
            continue
        for i in range(0, len(a), 1 << 12):
            x, y, s, k = a[i : i + (1 << 12)], b[i : i + (1 << 12)], spent[i : i + (1 << 12)], known[i : i + (1 << 12)]
            da, db = la >= lb, lb >= la  # the taller goes down first
            x, y, s, k = (np.repeat(v, (FAN if da else 1) * (FAN if db else 1), axis=0) for v in (x, y, s, k))
            step = np.tile(np.arange((FAN if da else 1) * (FAN if db else 1)), len(x) // ((FAN if da else 1) * (FAN if db else 1)))
            if da:
                x = x * FAN + (step // FAN if db else step)
            if db:
                y = y * FAN + step % FAN
            real = (x < len(trees[0].levels[la - da][1])) & (y < len(trees[1].levels[lb - db][1]))
            stack.append((la - da, lb - db, x[real], y[real], s[real], k[real]))
    return root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all words linked by the pairs one root, the least."""
    while len(a):
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, hi, lo)
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up
        left = root[a] != root[b]
        a, b = a[left], b[left]


def _link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of one prefix node, or of two blocks of it, as edges to roots."""
    ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy().view(U)
    part = table.column("part").to_numpy()
    order = np.argsort(gray_rank(fps), kind="stable")
    ids, fps, part = ids[order], fps[order], part[order]
    one = part == part.min() if len(part) else part == 0
    root = near_pairs(fps, None) if one.all() else near_pairs(fps[one], fps[~one])
    if not one.all():
        ids = np.concatenate([ids[one], ids[~one]])
    far = root != np.arange(len(ids))
    return pa.table([ids[far], ids[root[far]]], schema=_EDGE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long, the 64 bits) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_prints, "id long, fp long")


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct (id, fp) -> (a, b): edges whose components are those of all pairs within the distance.

    The order is taken from distance + 1 rotations of the word. In one of them
    two near words share the leading part, so they lie below one prefix node of
    the index. Each node is a group; one of more than BLOCK_ROWS rows is cut in
    blocks by a hash, and each two of its blocks are a group: nothing is dropped.
    """
    parts = F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("prefix"))
        for i, (a, w) in enumerate(bands(distance))
    ])
    at = stored(nodes.select("id", "fp", F.explode(parts).alias("p")).select("id", "fp", "p.band", "p.prefix"), "bands")
    large = stored(at.groupBy("band", "prefix").count().filter(F.col("count") > BLOCK_ROWS).select("band", "prefix", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        at = at.select("id", "fp", "band", "prefix", F.lit(0).alias("part"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    else:
        at = at.join(large, ["band", "prefix"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        at = at.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        at = at.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    return at.groupBy("band", "prefix", "x", "y").applyInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fingerprint (long), component_id: the smallest id it reaches.

    Fingerprints link at ``distance`` or fewer differing bits. Null and blank
    texts have fingerprint 0 and link like any other. Rows with a repeated id
    are all returned. Empty table: no rows. Other columns are not looked at.
    Equal fingerprints are one node, named by its smallest id, so copies add
    nothing to the search.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = components(links(nodes, distance))
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(stored(named, "named"), "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
