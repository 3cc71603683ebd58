"""Near copies for the pipeline: operator 10's fingerprints and index find candidates, exact Jaccard similarity decides.

At a similarity of 0.8 SimHash fingerprints differ in about 15 of 100 bits, so
with one of 64 bits no distance both finds such texts and tells them from
others. A text here has several fingerprints of WIDE bits by shingle hashes of
their own. Each equal part of one puts two texts below one prefix node of the
index, and there, in Gray order, near_pairs finds those within DISTANCE.

A first look, below a few nodes of each text, links most of a large group of
near copies. In the search below all nodes, what is linked already is one label:
a group of candidates has a row for each label, not for each of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.simhash import gray_rank, near_pairs
from folioflow.llm.store import drop, mapped, pack, put, scratch, stored
from folioflow.llm.textops import U, distinct, distinct_pairs, give_back, mix, run_hashes, slices, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and how many may differ: at a similarity of 0.8 about 19 do, without any 64.
WIDE, DISTANCE = 128, 32
#: Share of bits that are equal at a similarity of 0.8, 1 - acos(0.89) / pi, and of pairs there that may lie below no common node.
ALIKE, MISSED = 0.848, 1e-4
#: Texts below a prefix node, about; one with more than NODE_ROWS is cut in blocks, each two of which are compared.
NODE_TEXTS, NODE_ROWS = 500, 8000
#: Prefix nodes of each text in the first look, which only spares work: all that it misses is left to the search.
LOOKS = 4
#: Texts of one label that are kept and compared together; one with more meets the other labels piece by piece.
PIECE = 256
#: Texts of one band key that one task takes; more are dealt out in pairs of blocks.
BLOCK_ROWS = 4000
#: Band keys are broadcast up to this many; beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000
#: Shingles compared at once.
HELD = 1 << 20

_PRINT = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("words", pa.list_(pa.int64()))])
_CROWD = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
_CELL = pa.schema([("task", pa.int32()), ("cell", pa.int64()), ("part", pa.int32()), ("id", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
_CANDIDATE = pa.schema([("key", pa.int64()), ("id", pa.int64())])
_SET = pa.schema([("bucket", pa.int32()), ("node", pa.int64()), ("text", pa.int64()), ("set", pa.binary())])
_DONE = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: A byte's bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U)[:, 0]


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, their n + 1 offsets, and a hash of each text's words.

    A text of fewer words is one shingle, and one without words is one, too.
    """
    w, at = words(col)
    size = np.diff(at)
    node = mix(run_hashes(w, at[:-1], size) + size.astype(U) * U(0x9E3779B97F4A7C15))
    count = np.maximum(size - SHINGLE + 1, 1)
    to = np.concatenate([[0], np.cumsum(count)])
    place = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    s = run_hashes(w, place, np.minimum(np.repeat(size, count), SHINGLE))
    return s, to, node


def plan(n: int) -> tuple[int, int]:
    """For n texts: bits of a prefix, and the number of fingerprints of which all but MISSED similar pairs share a prefix."""
    width = min(32, max(10, (n // NODE_TEXTS).bit_length()))
    parts = math.log(MISSED) / math.log(1 - ALIKE**width)
    return width, math.ceil(parts / (64 // width * (WIDE // 64)))


def fingerprints(sets: list[np.ndarray], n: int) -> np.ndarray:
    """SimHash of each set of shingle hashes, n times WIDE bits: a bit is set where more than half of the hashes have it."""
    s, size = np.concatenate(sets), np.array(list(map(len, sets)))
    runs = -(-size // 255)  # counters of one byte each
    first = np.cumsum(runs) - runs
    at = np.repeat(np.cumsum(size) - size - 255 * first, runs) + 255 * np.arange(runs.sum())
    out = np.empty((len(sets), n * WIDE // 64), U)
    for k, seed in enumerate(np.random.default_rng(5).integers(0, 1 << 63, out.shape[1], U)):
        h = mix(s ^ seed).view(np.uint8).reshape(-1, 8)
        votes = np.stack([np.add.reduceat(_SPREAD[h[:, j]], at) for j in range(8)], axis=1).view(np.uint8)
        votes = np.add.reduceat(votes, first, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(U)[:, 0]
    return out


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            s, at, node = shingles(b.column("text"))
            words = fingerprints([distinct(s[i:j]) for i, j in zip(at, at[1:], strict=False)], n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(node.view(np.int64)), lists], schema=_PRINT)

    return run


def _cells(batch: pa.RecordBatch, width: int, looks: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their words, and a column for each prefix node that a text lies below, or for the first ``looks`` of them."""
    ids = batch.column("id").to_numpy()
    words = batch.column("words").flatten().to_numpy().view(U).reshape(len(ids), -1)
    per = 64 // width
    cells = np.empty((len(ids), min(words.shape[1] * per, looks or 1 << 30)), np.int64)
    for k in range(cells.shape[1]):
        cells[:, k] = (words[:, k // per] >> U(k % per * width) & U((1 << width) - 1)).astype(np.int64) | k << 32
    return ids, words, cells


def _crowds(width: int, looks: int | None, n: int, most: int):
    """Nodes of ``most`` texts or more have their share of them in some batch: counts of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, count = np.unique(_cells(b, width, looks)[2], return_counts=True)
            many = count * n >= most * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(cell[many]), pa.array(count[many])], schema=_CROWD)

    return run


def _below(width: int, looks: int | None, tasks: int, crowded: np.ndarray, blocks: np.ndarray):
    """A row for each text and node; where a node is cut in blocks, one for each pair of blocks that its own is in.

    The first look compares each block to itself only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            ids, words, cells = _cells(b, width, looks)
            row, k = (x.ravel() for x in np.indices(cells.shape))
            cell, part = cells.ravel(), np.zeros(cells.size, np.int64)
            if len(crowded):
                i = np.minimum(np.searchsorted(crowded, cell), len(crowded) - 1)
                m = np.where(crowded[i] == cell, blocks[i], 1)
                deal = ids.view(U)
                for x in words.T:
                    deal = mix(deal ^ x)
                other = part = (deal[row] % m.astype(U)).astype(np.int64)
                if not looks:
                    other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    row, k, cell, part, m = (np.repeat(x, m) for x in (row, k, cell, part, m))
                pair = (np.minimum(part, other) * m + np.maximum(part, other) + 1).astype(U)
                cell = np.where(m > 1, mix(mix(cell.astype(U)) ^ pair).view(np.int64), cell)
            k = k // (64 // width) // 2 * 2
            task = (mix(cell.view(U)) % U(tasks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (task, cell, part.astype(np.int32), ids[row], words[row, k].view(np.int64), words[row, k + 1].view(np.int64))], schema=_CELL)

    return run


def _near(distance: int):
    """Each node's groups of fingerprints that are linked within the distance, under a key made of all their ids."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, part, ids, high, low = (table.column(c).to_numpy() for c in ("cell", "part", "id", "high", "low"))
        high, low = high.view(U), low.view(U)
        order = np.lexsort((gray_rank(high), part, cell))
        cell, part, ids, words = cell[order], part[order], ids[order], np.stack([high[order], low[order]], axis=1)
        edge = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
        keys, found = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for i, j in zip(edge, edge[1:], strict=False):
            if j - i < 2:
                continue
            cut = i + int(np.searchsorted(part[i:j], part[i], "right"))
            root = near_pairs(words[i:j], None, distance) if cut == j else near_pairs(words[i:cut], words[cut:j], distance)
            far = np.flatnonzero(root != np.arange(j - i))
            if len(far):
                own = np.union1d(far, root[far])
                own = own[distinct_pairs(root[own], ids[i:j][own])]
                own = own[np.bincount(root[own])[root[own]] > 1]
                name = np.zeros(j - i, U)
                np.add.at(name, root[own], mix(ids[i:j][own].view(U) + U(1)))
                keys.append(name[root[own]])
                found.append(ids[i:j][own])
        give_back()
        return pa.table([np.concatenate(keys).view(np.int64), np.concatenate(found)], schema=_CANDIDATE)

    return run


def candidates(nodes: DataFrame, width: int, n: int, looks: int | None = None) -> DataFrame:
    """(id, words) -> (key, id): groups of two ids or more whose texts are near by some fingerprint. Several texts may have one id."""
    spark = nodes.sparkSession
    crowded, blocks = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > NODE_ROWS:
        counts = nodes.mapInArrow(_crowds(width, looks, n, NODE_ROWS), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        many = sorted(counts.filter(F.col("n") >= NODE_ROWS).collect())  # at most parts * n / NODE_ROWS
        crowded, blocks = np.array([r.cell for r in many], np.int64), np.array([r.n // NODE_ROWS + 1 for r in many], np.int64)
    tasks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 10_000)
    at = nodes.select("id", "words").mapInArrow(_below(width, looks, tasks, crowded, blocks), "task int, cell long, part int, id long, high long, low long")
    return at.groupBy("task").applyInArrow(_near(DISTANCE), "key long, id long").distinct()


def _sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s, at, text = shingles(b.column("text"))
            sets = [distinct(s[i:j]).tobytes() for i, j in zip(at, at[1:], strict=False)]
            node = b.column("node").to_numpy().view(U)
            yield pa.RecordBatch.from_arrays([pa.array(node >> U(64 - bits), pa.int32()), b.column("node"), pa.array(text.view(np.int64)), pa.array(sets, pa.binary())], schema=_SET)

    return run


def _save(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, sets = table.column("node").to_numpy().view(U), table.column("set").to_pylist()
        one = distinct_pairs(node, table.column("text").to_numpy() if "text" in table.column_names else node)
        each, first = np.unique(node[one], return_index=True)
        sets = [np.frombuffer(sets[i], U) for i in one]
        put(f"{folder}/set-{key[0].as_py()}", pack(node=each, first=np.append(first, len(one)), at=np.cumsum([0, *map(len, sets)]), set=np.concatenate(sets)))
        return pa.table([[key[0].as_py()], [len(each)]], schema=_DONE)

    return run


def jaccard(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Exact similarity of a to each of the sets, all sorted and distinct; 0 where the sizes alone are too far apart."""
    out, size = np.zeros(len(sets)), np.array(list(map(len, sets)))
    fit = np.flatnonzero(np.minimum(size, len(a)) >= SIMILARITY * np.maximum(size, len(a)))
    part = np.cumsum(size[fit]) // HELD
    for p in distinct(part):
        own = fit[part == p]
        x = np.concatenate([sets[i] for i in own])
        both = np.add.reduceat(a[np.minimum(np.searchsorted(a, x), len(a) - 1)] == x, np.cumsum(size[own]) - size[own], dtype=np.int64)
        out[own] = both / (len(a) + size[own] - both)
    return out


def linked(sets: list[np.ndarray], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar sets whose components are those of all such pairs; sets of one label are linked already."""
    a, b = [], []
    label = np.arange(len(sets)) if label is None else label
    left, todo = np.arange(len(sets)), []
    while len(left):  # what is linked goes, with all of its label; what is left is compared to each that went
        if not todo:
            own = label[left] == label[left[0]]
        else:
            at = todo.pop()
            hit = left[jaccard(sets[at], [sets[x] for x in left]) >= SIMILARITY]
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            a += [at] * len(hit)
            b += hit.tolist()
            own = np.isin(label[left], label[hit])
        todo += left[own].tolist()
        left = left[~own]
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(folder: str, bits: int):
    """Edges of each band key's texts: any two that are similar enough are linked, by one edge or over others."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        files: dict[int, dict[str, np.ndarray]] = {}

        def load(node: np.uint64) -> list[np.ndarray]:
            bucket = int(node >> U(64 - bits))
            if bucket not in files:
                files[bucket] = mapped(f"{folder}/set-{bucket}")
            t = files[bucket]
            i = int(np.searchsorted(t["node"], node))
            return [t["set"][t["at"][x] : t["at"][x + 1]] for x in range(t["first"][i], t["first"][i + 1])]

        k, node, name = (table.column(c).to_numpy() for c in ("key", "node", "id"))
        one = distinct_pairs(k, node)
        k, node, name = k[one], node[one].view(U), name[one]
        edge = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
        a, b = [], []
        for i, j in zip(edge, edge[1:], strict=False):
            sets = [load(x) for x in node[i:j]]
            label = np.repeat(name[i:j], list(map(len, sets)))
            _, own, size = np.unique(label, return_inverse=True, return_counts=True)
            order = np.argsort(size[own], kind="stable")  # the smallest labels are compared to all others at once
            sets, label = [x for s in sets for x in s], label[order]
            x, y = linked([sets[q] for q in order], label)
            a += label[x].tolist()
            b += label[y].tolist()
        give_back()
        return pa.table([np.array(a, np.int64), np.array(b, np.int64)], schema=_EDGE)

    return run


def shared_keys(each: DataFrame, texts: Column | None = None) -> DataFrame:
    """(id, node, key) -> the rows whose key more than one node has, with the number of blocks that the key is cut in.

    A node is one text, or as many as ``texts`` says.
    """
    counts = each.groupBy("key").agg(F.count("*").alias("count"), F.sum(F.lit(1) if texts is None else texts).alias("texts"))
    shared = stored(counts.filter("count > 1").select("key", F.ceil(F.col("texts") / BLOCK_ROWS).cast("int").alias("blocks")), "near-keys")
    return each.join(F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared, "key")


def save_sets(sets: DataFrame, folder: str) -> None:
    """(bucket, node, set), and text where a node has several: sorted shingle hashes, kept in the shared folder for ``verified``."""
    sets.groupBy("bucket").applyInArrow(_save(folder), "bucket int, n long").agg(F.sum("n")).first()


def verified(at: DataFrame, folder: str, bits: int) -> DataFrame:
    """Rows of ``shared_keys`` -> edges (a, b) between ids whose components are those of all similar pairs of one key.

    A key with many nodes is cut in blocks by a hash, and each two of its
    blocks are a task: nothing is dropped.
    """
    buckets = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = at.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    at = at.withColumn("task", F.when(F.col("blocks") > 1, pair).otherwise(F.pmod("key", F.lit(4 * buckets))))
    return at.select("task", "key", "node", "id").groupBy("task").applyInArrow(_verify(folder, bits), "a long, b long").distinct()


def _met(near: DataFrame, units: DataFrame) -> DataFrame:
    """(key, id) -> (key, id, node, texts): units of labels, of which each two of one old key and of two labels share a key.

    A label of PIECE texts or less is one unit and keeps its keys. One of more
    is cut in pieces; each piece and each unit that it shared a key with have a
    key of their own, once for all keys they met by.
    """
    each = stored(near.join(units, "id"), "near-units")
    small = each.select("key", "id", "node", "texts").filter("NOT large")
    a, b = each.filter("large").alias("a"), each.alias("b")
    if each.filter("large").isEmpty():
        return small
    sides = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("id", "node", "texts")]).alias(x) for x in "ab"]
    pairs = a.join(b, "key").filter("a.id != b.id AND (a.id < b.id OR NOT b.large)").select(F.xxhash64("a.node", "b.node").alias("key"), *sides).distinct()
    return stored(small.unionByName(pairs.select("key", F.explode(F.array("a", "b")).alias("x")).select("key", "x.*")), "near-met")


def _units(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """Texts (id, words, label) with the unit that each is kept in: node, and whether its label has several."""
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1)))
    found = nodes.join(F.broadcast(large), "label", "left")  # at most one in PIECE texts is a label there
    return stored(found.select("id", "words", "label", F.xxhash64("label", piece).alias("node"), F.col("pieces").isNotNull().alias("large")), "near-texts")


def _links(rows: DataFrame, texts: DataFrame, width: int, n: int, looks: int | None = None) -> DataFrame:
    """Edges (a, b) between labels with similar texts: over labels and edges any two candidates are linked that are similar.

    rows: id, text of the table. texts: what ``_units`` gives.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "near")
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    near = stored(candidates(texts.select(F.col("label").alias("id"), "words"), width, n, looks), "near-groups")
    units = texts.groupBy(F.col("label").alias("id"), "node", "large").agg(F.count("*").alias("texts"))
    at = stored(shared_keys(_met(near, units), F.col("texts")), "near-candidates")
    wanted = texts.select("id", "node").join(at.select("node").distinct(), "node").distinct()
    save_sets(rows.join(wanted, "id").select("node", "text").mapInArrow(_sets(bits), "bucket int, node long, text long, set binary"), folder)
    edges = stored(verified(at, folder, bits), "near-edges")
    drop(spark, folder)
    return edges


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with an id: id, component_id: the smallest id it reaches.

    Texts link at a Jaccard similarity of SIMILARITY or more of their sets of
    SHINGLE words. Null and blank texts are alike. Texts of equal words are one
    node, named by its smallest id. Rows without an id are left out; ids must
    be integers. Empty table: no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    n = rows.count()
    width, several = plan(n)
    prints = stored(rows.mapInArrow(_prints(several), "id long, node long, words array<long>"), "near-prints")
    nodes = stored(prints.groupBy("node").agg(F.min("id").alias("id"), F.first("words").alias("words")), "near-nodes")
    alone = nodes.select("id", "words", F.col("id").alias("label"))
    first = _links(rows, _units(alone, docs.sparkSession.createDataFrame([], "label long, pieces long")), width, n, LOOKS)
    known = stored(components(first).select(F.col("node").alias("id"), F.col("component").alias("label")), "near-labels")
    large = known.groupBy("label").count().filter(F.col("count") >= PIECE).select("label", F.ceil((F.col("count") + 1) / PIECE).alias("pieces"))
    labelled = nodes.join(known, "id", "left").select("id", "words", F.coalesce("label", "id").alias("label"))
    named = components(first.unionAll(_links(rows, _units(labelled, large), width, n)))
    of = nodes.select("node", "id").join(named.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("component_id"))
    return prints.select("id", "node").join(of, "node").select(F.col("id").alias(id_col), "component_id")
