"""Benchmark decontamination (8): latent semantic retrieval, then subsequence and answer checks.

Passages are windows of two blocks of BLOCK words. Their terms are the words of
the benchmark, weighted by how rare they are over all passages of the corpus.
One distributed pass sketches the Gram matrix of all passages; a Nystroem step
on the driver turns the sketch into the leading right singular vectors. Passages
and items meet in that space; pairs of a high cosine are read word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textops import U, plain_words, slices

BLOCK = 32
RANK, MORE = 96, 32
COSINE = 0.45
#: Part of an item's words that stand in a passage in order; the lower one needs the answer as well.
SAME, PARAPHRASE = 0.8, 0.6
#: Terms in more than this part of all blocks weigh nothing, unless an item would keep fewer than LEAST_TERMS.
COMMON, LEAST_TERMS = 0.003, 4
#: Shorter items count only where they stand word for word.
SHORT = 8
#: Items that are searched for at once: what is broadcast is bounded by these.
ITEMS = 1000

_DF = pa.schema([("term", pa.int32()), ("n", pa.int64())])
_SKETCH = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
_LEAK = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())])
_SENTENCE = re.compile(r"[.!?]\s+")


@dataclass
class Items:
    """Benchmark items as words, and the model's part that rests on them."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    screen: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @classmethod
    def read(cls, rows: list[tuple[int, str]]) -> Items:
        ids, words, answers = [], [], []
        for i, text in rows:
            w = plain_words(pa.array([text or ""]))[0]
            if not len(w):
                continue
            last = [s for s in _SENTENCE.split((text or "").strip()) if s.strip()]
            answer = plain_words(pa.array([last[-1] if last else ""]))[0]
            if not 3 <= len(answer) <= 12:
                answer = w[-5:]
            ids.append(i)
            words.append(w)
            answers.append(answer)
        terms = np.unique(np.concatenate(words)) if words else np.zeros(0, U)
        screen = np.zeros(1 << 16, bool)
        screen[(terms & U(0xFFFF)).astype(np.int64)] = True
        return cls(ids, words, answers, terms, screen)

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and which."""
        at = np.flatnonzero(self.screen[(w & U(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, w[at]), len(self.terms) - 1)
        hit = self.terms[k] == w[at]
        return at[hit], k[hit]

    def chunks(self) -> list[tuple[int, np.ndarray]]:
        """(item, terms) for each run of two blocks of an item."""
        out = []
        for i, w in enumerate(self.words):
            n = max(1, round(len(w) / (2 * BLOCK)))
            out += [(i, np.searchsorted(self.terms, part)) for part in np.array_split(w, n)]
        return out


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block number of each text, and the number of blocks of each (none share a text)."""
    n = -(-np.diff(at) // BLOCK)
    return np.cumsum(n) - n, n


def _block_of(position: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.searchsorted(at, position, "right") - 1
    return _blocks(at)[0][text] + (position - at[text]) // BLOCK, text


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(items.terms)
        n = np.zeros(v + 1, np.int64)
        for b in slices(batches):
            w, at = plain_words(b.column("text"))
            p, k = items.find(w)
            block, _ = _block_of(p, at)
            pair = np.sort(block * v + k)
            n[:v] += np.bincount(pair[_runs(pair)] % v, minlength=v)
            n[v] += _blocks(at)[1].sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], schema=_DF)

    return run


def _weighted(items: Items, col: pa.Array):
    """Blocks, texts, positions and terms of all words that weigh something, in order; each block's term once in block order."""
    w, at = plain_words(col)
    p, k = items.find(w)
    some = items.weight[k] > 0
    p, k = p[some], k[some]
    block, text = _block_of(p, at)
    return w, at, block, text, k


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _omega(v: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((v, min(RANK + MORE, v))))[0].astype(np.float32)


def _sketch(items: Items, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _omega(len(items.terms))
        z = np.zeros(omega.shape, np.float32)
        for b in slices(batches):
            _, _, block, _, k = _weighted(items, b.column("text"))
            edges = _runs(block)
            for a in range(0, len(edges), 20_000):
                e = edges[a : a + 20_001]
                lo, hi = e[0], e[20_000] if len(e) > 20_000 else len(block)
                e, t = e[:20_000] - lo, k[lo:hi]
                row = items.weight[t][:, None] * omega[t]
                y = np.add.reduceat(row, e, axis=0)
                y /= np.sqrt(np.add.reduceat(items.weight[t] ** 2, e))[:, None] ** 2  # passages of length 1
                back = items.weight[t][:, None] * np.repeat(y, np.diff(np.append(e, len(t))), axis=0)
                order = np.argsort(t, kind="stable")
                first = _runs(t[order])
                z[t[order][first]] += np.add.reduceat(back[order], first, axis=0)
        found = np.array_split(z, parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], schema=_SKETCH)

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("sums"):
        v = np.frombuffer(x.as_py(), np.float32)
        total = v.astype(np.float64) if total is None else total + v
    return pa.table([[key[0].as_py()], [total.astype(np.float32).tobytes()]], schema=_SKETCH)


def leading_vectors(z: np.ndarray, omega: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading eigenvectors of a Gram matrix G from z = G @ omega."""
    z, omega = z.astype(np.float64), omega.astype(np.float64)
    shift = 1e-7 * max(float(np.linalg.norm(z)), 1e-12)
    z = z + shift * omega
    c = np.linalg.cholesky((lambda m: (m + m.T) / 2)(omega.T @ z) + shift * np.eye(omega.shape[1]))
    u, _, _ = np.linalg.svd(np.linalg.solve(c, z.T).T, full_matrices=False)
    return u[:, :rank].astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, all of a's positions at once in the bits of one number."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _contains(words: list[int], run: list[int]) -> bool:
    return any(words[i : i + len(run)] == run for i, x in enumerate(words) if x == run[0])


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, target = [], []
        for i, t in items.chunks():
            owner.append(i)
            target.append(items.weight[t] @ items.basis[t])
        owner, target = np.array(owner), np.array(target)
        target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-9)
        words = [x.tolist() for x in items.words]
        answers = [x.tolist() for x in items.answers]
        bags = [set(x) for x in words]
        for b in slices(batches):
            ids = b.column("id").to_pylist()
            w, at, block, text, k = _weighted(items, b.column("text"))
            first = _blocks(at)[0]
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}
            edge = _runs(block)
            if not len(edge):
                continue
            # a block's vector; a passage adds that of the next block of the same text
            for a in range(0, len(edge), 20_000):
                e = edge[a : a + 20_001]
                lo, hi = e[0], e[20_000] if len(e) > 20_000 else len(block)
                own = e[:20_000] - lo
                t = k[lo:hi]
                vec = np.add.reduceat(items.weight[t][:, None] * items.basis[t], own, axis=0)
                which, whose = block[e[:20_000]], text[e[:20_000]]
                if len(e) > 20_000:  # the passage over the edge
                    z = edge[a + 20_001] if a + 20_001 < len(edge) else len(block)
                    vec = np.vstack([vec, (items.weight[k[hi:z]] @ items.basis[k[hi:z]])[None]])
                    which, whose = np.append(which, block[hi]), np.append(whose, text[hi])
                pair = (which[1:] == which[:-1] + 1) & (whose[1:] == whose[:-1])
                for v, at_block, of, size in ((vec, which, whose, 1), (vec[:-1][pair] + vec[1:][pair], which[:-1][pair], whose[:-1][pair], 2)):
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    near = v @ target.T
                    for r, c in zip(*np.nonzero(near >= COSINE), strict=True):
                        d, i = int(of[r]), int(owner[c])
                        key, cos = (d, i), float(near[r, c])
                        old = best.get(key)
                        if old and old[1] == 1.0:
                            continue
                        n = len(words[i])
                        start = at[d] + (at_block[r] - first[d]) * BLOCK
                        near_words = w[max(at[d], start - n) : min(at[d + 1], start + size * BLOCK + n)].tolist()
                        if len(bags[i].intersection(near_words)) < PARAPHRASE * len(bags[i]) * 0.9:
                            continue
                        part = lcs(words[i], near_words) / n
                        if part < PARAPHRASE:
                            continue
                        answer = _contains(near_words, answers[i])
                        leak = _contains(near_words, words[i]) if n < SHORT else part >= SAME or answer
                        if leak and (not old or part > old[1]):
                            best[key] = (cos, part, answer)
            if best:
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d, _ in best], pa.int64()), pa.array([items.ids[i] for _, i in best], pa.int64()),
                    *(pa.array([x[j] for x in best.values()], _LEAK.types[j + 2]) for j in range(3)),
                ], schema=_LEAK)

    return run


def fit(texts: DataFrame, items: Items) -> Items:
    """Weights of the terms and the basis of the latent space, from all texts."""
    v = len(items.terms)
    df = np.zeros(v + 1, np.int64)
    for r in texts.mapInArrow(_count(items), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        df[r.term] = r.n
    n = max(int(df[v]), 1)
    idf = np.log((n + 1) / (df[:v] + 1)) + 1e-3
    weight = np.where(df[:v] > COMMON * n, 0.0, idf)
    for w in items.words:
        t = np.unique(np.searchsorted(items.terms, w))
        if (weight[t] > 0).sum() < LEAST_TERMS:  # its rarest terms weigh something all the same
            t = t[np.argsort(df[t], kind="stable")[:LEAST_TERMS]]
            weight[t] = idf[t]
    items.weight = weight.astype(np.float32)
    omega = _omega(v)
    parts = max(1, min(16, v // 256))
    got = {r.part: r.sums for r in texts.mapInArrow(_sketch(items, parts), "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary").collect()}
    z = np.concatenate([np.frombuffer(got[i], np.float32).reshape(-1, omega.shape[1]) for i in range(parts)]) if got else np.zeros_like(omega)
    # the items' own rows, with as much energy as the corpus has, so that their directions stay
    rows = np.zeros((len(items.chunks()), v))
    for i, (_, t) in enumerate(items.chunks()):
        np.add.at(rows[i], t, items.weight[t])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    own = rows.T @ (rows @ omega)
    z = z + own * max(1.0, float(np.linalg.norm(z)) / max(float(np.linalg.norm(own)), 1e-9))
    items.basis = leading_vectors(z, omega)
    return items


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs, answer): each document with each benchmark item that stands in it.

    An item stands in a document if some passage near it in the latent space
    has, in order, 0.8 of the item's words; or 0.6 and the answer, word for
    word (the last sentence, or the last five words). Items under SHORT words
    must stand word for word. Case and signs don't count. Null and empty texts
    and items match nothing. Rows with a repeated id each give their own rows.
    Empty tables: no rows. Other columns are not looked at. Items are taken
    ITEMS at a time, each lot against all documents.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).filter(F.col(item_text).isNotNull()).orderBy(item_col)
    found, lot = [], []

    def search() -> None:
        items = Items.read(lot)
        if items.ids:
            found.append(texts.mapInArrow(_search(fit(texts.select("text"), items)), "id long, item_id long, cosine double, lcs double, answer boolean"))

    for r in rows.toLocalIterator():
        lot.append(tuple(r))
        if len(lot) == ITEMS:
            search()
            lot = []
    search()
    out = found[0] if found else texts.sparkSession.createDataFrame([], "id long, item_id long, cosine double, lcs double, answer boolean")
    for f in found[1:]:
        out = out.unionAll(f)
    return out.withColumnRenamed("id", id_col)
