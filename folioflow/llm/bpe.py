"""Byte-level BPE (9): Spark's higher-order functions fold the merges of each distinct word once."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import drop, mapped, pack, put, scratch, stored
from folioflow.llm.textops import slices, span_hashes, utf8
from folioflow.llm.wordtable import CHECK, DONE, Ids, Seen, blobs, distinct, gathered, save, spread

#: Shifts of the literal rank map. No token has rank NONE.
PARTS, NONE = 1 << 15, 1 << 30

_WORD = pa.schema([("bucket", pa.int32()), ("word", pa.binary())])
#: ASCII white space and separators; all but these, and all of other white space, may stand beside a cut.
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14), *range(28, 32)]] = True
# White space beyond ASCII, in UTF-8.
_WIDE_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = _WHITE[data]
    for lead in {w[0] for w in _WIDE_WHITE}:
        at = np.flatnonzero(data == lead)
        for w in (w for w in _WIDE_WHITE if w[0] == lead):
            hit = at[at + len(w) <= len(data)]
            for k, x in enumerate(w[1:], 1):
                hit = hit[data[hit + k] == x]
            for k in range(len(w)):
                white[hit + k] = True
    return white


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into units whose matches don't depend on what stands around them.

    A cut lies before a space, and after a line feed, that stands between two
    characters other than white space: a match begins there whatever came
    before. Gives starts, ends, the texts' offsets in the units, and which
    units are plain: they begin with a space and don't end in white space, so
    that plain units stay apart when they are joined.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64), np.zeros(0, bool)
    white = _white(data)
    alone = np.zeros(len(data), bool)
    alone[1:-1] = ~white[:-2] & ~white[2:]
    edge = off[:-1][off[1:] > off[:-1]]
    alone[edge] = False
    alone[off[1:][off[1:] > off[:-1]] - 1] = False
    begins = alone & (data == 32)
    begins[1:] |= alone[:-1] & (data[:-1] == 10)
    begins[edge] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, off), (data[starts] == 32) & ~white[ends - 1] & ~white[np.minimum(starts + 1, len(data) - 1)]


def matches(pattern: regex.Pattern, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of units: their bytes, starts and ends in these, and each unit's offsets in the words.

    Plain units are matched in one go, the others each alone.
    """
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    size = (ends - starts)[order]
    own = data[spread(starts[order], size)]
    n = int(size[: plain.sum()].sum())
    raw = own.tobytes()
    words = pattern.findall(raw[:n].decode())
    at = n
    for x in size[plain.sum() :].tolist():
        words += pattern.findall(raw[at : at + x].decode())
        at += x
    chars = np.flatnonzero((own & 0xC0) != 0x80)  # where characters begin
    to = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    if to[-1] != len(chars):
        raise ValueError("the pattern must match every character")
    byte = np.append(chars, len(own))[to]
    first = np.searchsorted(byte[:-1], np.cumsum(size) - size)  # of each unit, in this order
    each = np.diff(np.append(first, len(words)))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    # words again in the units' own order
    take = spread(first[back], each[back])
    return own, byte[:-1][take], byte[1:][take], np.concatenate([[0], np.cumsum(each[back])])


def _distinct(pattern: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, of_units, of_words = regex.compile(pattern), Seen(), Seen()
        for b in slices(batches):
            data, off = utf8(b.column("text"))
            starts, ends, _, plain = units(data, off)
            h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK)
            one, _ = distinct(h, check, False)
            one = one[of_units.new(h[one], check[one])]
            data, starts, ends, _ = matches(match, data, starts[one], ends[one], plain[one])
            h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK)
            one, _ = distinct(h, check, False)
            one = one[of_words.new(h[one], check[one])]
            yield blobs(data, starts[one], ends[one], h[one], bits)

    return run


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    data, starts, ends, _, _ = gathered(table.column("pieces").to_pylist())
    size = ends - starts
    if size.sum() >= 1 << 31:
        raise ValueError("more than 2 GB of words in one bucket")
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data[spread(starts, size)])])
    return pa.table([pa.array(np.full(len(size), key[0].as_py()), pa.int32()), words], schema=_WORD)


def distinct_words(docs: DataFrame, pattern: str, text_col: str = "text", bits: int = 4) -> DataFrame:
    """Each match of the pattern in any text, once, as bytes: bucket, word."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_distinct(pattern, bits), "bucket int, pieces binary")
    return found.groupBy("bucket").applyInArrow(_merged, "bucket int, word binary")


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: a perfect hash of the tokens, of three flat arrays.

    The low bits of a token's XXH64 choose a shift; this, and the bits from
    ``bit`` on, lead to its slot, which holds the hash again and the rank. So a
    look-up is three array accesses. (Spark searches a literal map from its
    begin to its end.)
    """
    hashes = np.array([token_hash(t) for t in ranks], np.int64).view(np.uint64)
    slots = 1 << max(4, int(1.25 * len(ranks)).bit_length())
    for bit in range(20, 64 - slots.bit_length()):
        if (found := _perfect(hashes, list(ranks.values()), slots, bit)) is not None:
            return F.from_json(F.lit(json.dumps(found)), "bit int, shift array<int>, check array<bigint>, rank array<int>")
    raise ValueError("the tokens' hashes have no perfect hash")


def _perfect(hashes: np.ndarray, ranks: list[int], slots: int, bit: int) -> dict | None:
    own = (hashes >> np.uint64(bit)).astype(np.int64) & (slots - 1)
    part = (hashes & np.uint64(PARTS - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(PARTS + 1))
    shift, check, rank_at, full = [0] * PARTS, [0] * slots, [NONE] * slots, np.zeros(slots, bool)
    for k in np.argsort(-np.diff(edge), kind="stable").tolist():
        keys = order[edge[k] : edge[k + 1]]
        if len(np.unique(own[keys])) < len(keys):
            return None
        for at in range(0, slots if len(keys) else 0, 64):
            free = ~full[own[keys][:, None] ^ np.arange(at, min(at + 64, slots))].any(axis=0)
            if free.any():
                break
        else:
            if len(keys):
                return None
            continue
        shift[k] = at + int(np.argmax(free))
        for i in keys.tolist():
            to = int(own[i]) ^ shift[k]
            full[to], check[to], rank_at[to] = True, int(hashes[i].astype(np.int64)), ranks[i]
    return {"bit": bit, "shift": shift, "check": check, "rank": rank_at}


def token_hash(token: bytes) -> int:
    h = xxhash.xxh64_intdigest(token, 42)
    return h - (1 << 64) if h >> 63 else h


def rank_of(ranks: Column, token: Column) -> Column:
    """Rank of a binary token; NONE if it is null or no token."""

    def look(h: Column) -> Column:
        slot = F.call_function("shiftrightunsigned", h, ranks["bit"]).bitwiseXOR(ranks["shift"][h.bitwiseAND(F.lit(PARTS - 1)).cast("int")].cast("long")).bitwiseAND(F.size(ranks["check"]) - 1).cast("int")
        return F.when(ranks["check"][slot] == h, ranks["rank"][slot]).otherwise(NONE)

    return F.transform(F.array(F.xxhash64(token)), look)[0]


def fold(word: Column, ranks: Column) -> Column:
    """Token ids (array of int) of one binary word.

    A word that is a token is one. Else it begins as its bytes: ``b`` holds
    the borders of its pieces, ``r`` the rank of the pair at each border (NONE
    at both ends). A step of the fold drops the leftmost border of the lowest
    rank and ranks the pairs at the two borders beside it anew. Once no pair
    has a rank, the steps that remain pass the state on. Steps cost as much as
    there are pieces left, so a word costs the square of its length.
    """
    n, none = F.length(word), F.array(F.lit(NONE))

    def piece(a: Column, z: Column) -> Column:
        return rank_of(ranks, F.substring(word, a, z - a))

    def step(s: Column, _: Column) -> Column:
        def drop(i: Column) -> Column:
            def beside(b: Column) -> Column:
                left = F.filter(s["r"], lambda x, k: k != i)
                fresh = F.transform(left, lambda x, k: F.when((k <= i) & (k >= i - 1), piece(F.get(b, k - 1), F.get(b, k + 1))).otherwise(x))
                return F.struct(b.alias("b"), fresh.alias("r"))

            return F.transform(F.array(F.filter(s["b"], lambda x, k: k != i)), beside)[0]

        at = F.array(F.array_position(s["r"], F.array_min(s["r"])).cast("int") - 1)
        return F.when(F.array_min(s["r"]) < NONE, F.transform(at, drop)[0]).otherwise(s)

    places = F.slice(F.sequence(F.lit(1), n), F.lit(1), n - 1)
    pairs = F.transform(places, lambda i: piece(i, i + 2))
    begin = F.struct(F.sequence(F.lit(1), n + 1).alias("b"), F.concat(none, pairs, none).alias("r"))
    done = F.aggregate(places, begin, step, lambda s: F.transform(F.slice(s["b"], 2, F.size(s["b"])), lambda z, k: piece(s["b"][k], z)))
    return F.transform(F.array(rank_of(ranks, word)), lambda whole: F.when(whole < NONE, F.array(whole)).otherwise(done))[0]


def vocabulary(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """bucket, word -> bucket, word, ids. The literal is bound once, to a name that all look-ups share."""
    ids = F.transform(F.array(rank_literal(ranks)), lambda m: fold(F.col("word"), m))[0]
    return words.filter(F.length("word") > 0).select("bucket", "word", ids.alias("ids"))


def _save(folder: str, kind: type):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, ids = (table.column(c).combine_chunks() for c in ("word", "ids"))
        _, off, data = words.buffers()
        off = np.frombuffer(off, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        h, check = span_hashes(data, off[:-1], off[1:]), span_hashes(data, off[:-1], off[1:], CHECK)
        order = np.lexsort((check, h))
        at = ids.offsets.to_numpy().astype(np.int64)
        size = np.diff(at)[order]
        flat = ids.values.to_numpy()[spread(at[:-1][order], size)]
        save(folder, key[0].as_py(), h[order], check[order], size, flat.astype(kind))
        return pa.table([[key[0].as_py()], [len(words)]], schema=DONE)

    return run


def _pieces(ranks: dict[bytes, int]) -> bytes:
    """Each id's bytes, one after another."""
    every = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, i in ranks.items():
        every[i] = t
    return pack(at=np.cumsum([0, *map(len, every)]), data=np.frombuffer(b"".join(every), np.uint8))


def decode(ids: np.ndarray, pieces: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all ids, concatenated, and where each id's piece begins (and the last one ends)."""
    start = pieces["at"][ids]
    size = pieces["at"][ids + 1] - start
    return pieces["data"][spread(start, size)], np.concatenate([[0], np.cumsum(size)])


def _encode(pattern: str, folder: str, bits: int, kind: type, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, table, pieces = regex.compile(pattern), Ids(folder, bits, kind), mapped(f"{folder}/pieces")
        for b in slices(batches):
            data, off = utf8(b.column("text"))
            starts, ends, at, plain = units(data, off)
            one, back = distinct(span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK))
            own, s, e, unit = matches(match, data, starts[one], ends[one], plain[one])
            h, check = span_hashes(own, s, e), span_hashes(own, s, e, CHECK)
            word, of = distinct(h, check)
            start, size, ids = table.of(h[word], check[word])
            ids = ids[spread(start[of], size[of])]  # of all distinct units, one after another
            first = np.concatenate([[0], np.cumsum(size[of])])[unit]
            n = np.diff(first)[back]
            ids = ids[spread(first[:-1][back], n)].astype("<u4")  # of all texts
            to = np.concatenate([[0], np.cumsum(n)])[at]
            text, place = decode(ids.astype(np.int64), pieces)
            place = place[to].tolist()
            raw, to = memoryview(ids).cast("B") if len(ids) else memoryview(b""), to.tolist()
            text = memoryview(text)
            out = [b.column("id"), pa.array(np.diff(to), pa.int64())]
            out.append(pa.array([hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(to, to[1:], strict=False)], pa.string()))
            out.append(pa.array([hashlib.sha256(text[a:z]).hexdigest() for a, z in zip(place, place[1:], strict=False)], pa.string()))
            if with_ids:
                out.append(pa.array([raw[4 * a : 4 * z].tobytes() for a, z in zip(to, to[1:], strict=False)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, ids (binary, 32-bit little-endian; left out without with_ids).

    The first reading finds the distinct words (matches of the pattern), of
    which the folds are made once and kept as sorted hash arrays in the shared
    folder. The second looks its words up there, joins their ids, and decodes
    these again by concatenating pieces. No text is shuffled, and a worker
    holds mapped pages and one slice of texts. Words of any length are folded
    alike. The pattern must match every character, and begin a match at a space
    or after a line feed between two other characters.
    Null and empty texts have no ids. Rows with a repeated or null id are all
    returned; ids may be of any type. Empty table: no rows. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "bpe")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * n - 1).bit_length())
    kind = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32
    put(f"{folder}/pieces", _pieces(ranks))
    # without a fixed number of partitions, Spark would join the small ones, and the folds with them
    words = distinct_words(docs, pattern, text_col, bits).repartition(4 * n, "word")
    # the literal would stand in every description of the plan that the driver keeps
    length = spark.conf.get("spark.sql.maxPlanStringLength", None)
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    try:
        found = stored(vocabulary(words, ranks), "vocabulary")
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", length) if length else spark.conf.unset("spark.sql.maxPlanStringLength")
    found.groupBy("bucket").applyInArrow(_save(folder, kind), "bucket int, n long").agg(F.sum("n")).first()
    drop(spark, found)
    same = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return same.mapInArrow(_encode(pattern, folder, bits, kind, with_ids), kinds).withColumnRenamed("id", id_col)
