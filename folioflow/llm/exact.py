"""Exact dedup (3): counting quotient filters, then the bytes themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import pack, stored, unpack
from folioflow.llm.textops import tally

SPACES = r"[\x20\x09-\x0D]+"
#: Fingerprints of this many repeated texts may be broadcast (8 bytes each).
BROADCAST_KEYS = 1_000_000
BLOCK_BITS = 10

_BLOCK = pa.schema([("block", pa.int32()), ("filter", pa.binary())])
_REPEATED = pa.schema([("fp", pa.int64()), ("seen", pa.int64())])


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints, kept exactly, as a counting quotient filter.

    A fingerprint's high ``q`` bits, the quotient, aren't stored: they are the
    place of its run. A run holds the remainders (64 - q bits, in whole bytes)
    of one quotient in ascending order. Three bits tell the slots apart:
    ``occupied`` (one for each quotient: it has a run), ``ends`` (a run ends in
    this slot) and ``counter`` (this slot belongs to the count of the remainder
    before it). A count of one has no slot, a larger one as many as its digits
    take. Two filters merge run by run, in the order of quotients and
    remainders: counts of equal fingerprints add up, and nothing is lost.
    """

    def __init__(self, q: int, occupied: np.ndarray, ends: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.occupied, self.ends, self.counter, self.slots = q, occupied, ends, counter, slots

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, q: int | None = None) -> CountingQuotientFilter:
        """From fingerprints, with their counts or one each; q so that runs are about one slot long."""
        h, n = tally(fingerprints.astype(np.uint64), np.ones(len(fingerprints), np.int64) if counts is None else counts.astype(np.int64))
        q = max(1, int(len(h)).bit_length()) if q is None else q
        r, width = 64 - q, -(-(64 - q) // 8)
        quotient = (h >> np.uint64(r)).astype(np.int64)
        remainder = h & np.uint64((1 << r) - 1)
        digits = np.zeros(len(h), np.int64)  # base 2**(8 * width), of the count less one
        more = (n - 1).astype(np.uint64)
        left = more.copy()
        while (left > 0).any():
            digits += left > 0
            left = left >> np.uint64(8 * width) if width < 8 else np.zeros_like(left)
        at = np.cumsum(digits + 1) - digits - 1
        size = int((digits + 1).sum())
        value, counter, ends = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
        value[at] = remainder
        for k in range(int(digits.max(initial=0))):
            own = digits > k
            to = at[own] + 1 + k
            counter[to] = True
            value[to] = more[own] >> np.uint64(8 * width * k) & np.uint64((1 << 8 * width) - 1)
        last = np.append(quotient[1:] != quotient[:-1], True) if len(h) else np.zeros(0, bool)
        ends[(at + digits)[last]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        return cls(q, np.packbits(occupied), np.packbits(ends), np.packbits(counter), value.view(np.uint8).reshape(-1, 8)[:, :width].copy())

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, each once, with their counts."""
        width, size = self.slots.shape[1], len(self.slots)
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = self.slots
        value = wide.view(np.uint64).ravel()
        ends, counter = (np.unpackbits(x, count=size).astype(bool) for x in (self.ends, self.counter))
        quotients = np.flatnonzero(np.unpackbits(self.occupied))
        run = np.cumsum(ends) - ends
        at = np.flatnonzero(~counter)
        h = quotients[run[at]].astype(np.uint64) << np.uint64(64 - self.q) | value[at]
        n = np.ones(len(at), np.int64)
        place = np.flatnonzero(counter)
        own = np.cumsum(~counter)[place] - 1
        digit = place - at[own] - 1
        np.add.at(n, own, (value[place] << (np.uint64(8 * width) * digit.astype(np.uint64))).astype(np.int64))
        return h, n

    def add(self, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return self.merge(CountingQuotientFilter.of(fingerprints))

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        parts = [x.items() for x in (self, *others)]
        return CountingQuotientFilter.of(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]))

    def __len__(self) -> int:
        """Slots in use."""
        return len(self.slots)

    def blocks(self, bits: int = BLOCK_BITS) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Cut by the first ``bits`` bits of the quotient (or of the fingerprint, if it is shorter)."""
        h, n = self.items()
        at = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for k, (a, z) in enumerate(zip(at, [*at[1:], len(h)], strict=True)):
            if z > a:
                # within a block the first bits are the block's number: they go, and the quotient follows
                yield k, CountingQuotientFilter.of(h[a:z] << np.uint64(bits), n[a:z], max(1, int(z - a).bit_length()))

    def dumps(self) -> bytes:
        return pack(q=np.array([self.q, self.slots.shape[1]]), occupied=self.occupied, ends=self.ends, counter=self.counter, slots=self.slots.ravel())

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        x = unpack(data)
        return cls(int(x["q"][0]), x["occupied"], x["ends"], x["counter"], x["slots"].reshape(-1, int(x["q"][1])))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    full = CountingQuotientFilter.of(np.zeros(0, np.uint64))
    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) > 1 << 20:
            full, held = full.add(np.concatenate(held)), []
        if len(full) > 1 << 22:  # bounded memory: what is full goes out
            yield from _out(full)
            full = CountingQuotientFilter.of(np.zeros(0, np.uint64))
    if held:
        full = full.add(np.concatenate(held))
    yield from _out(full)


def _out(full: CountingQuotientFilter) -> Iterator[pa.RecordBatch]:
    found = list(full.blocks())
    yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([f.dumps() for _, f in found], pa.binary())], schema=_BLOCK)


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = [CountingQuotientFilter.loads(x) for x in table.column("filter").to_pylist()]
    h, n = (parts[0].merge(*parts[1:]) if len(parts) > 1 else parts[0]).items()
    many = n > 1
    whole = h[many] >> np.uint64(BLOCK_BITS) | np.uint64(key[0].as_py() << 64 - BLOCK_BITS)
    return pa.table([whole.view(np.int64), n[many]], schema=_REPEATED)


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Fingerprints (long) seen more than once, with their counts: fp, seen.

    One filter is built in each partition and cut into 2**BLOCK_BITS blocks;
    blocks of the same quotients merge. A filter holds a fingerprint once, so a
    text that fills a third of the table adds one entry for each partition.
    """
    return prints.select(F.col(column)).mapInArrow(_build, "block int, filter binary").groupBy("block").applyInArrow(_merge, "fp long, seen long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (binary).

    Texts are equal when their bytes are, once each run of ``[\\x20\\x09-\\x0D]``
    is one space; null is the empty text. The row with the smallest id stays.
    Rows with a repeated id are all returned; those with the kept id stay. Rows
    without an id are kept and count in their group; where no row of a group has
    one, keep_id is null. Ids may be of any type that can be compared. Empty table: no rows. Other columns are not looked at.

    Texts are read twice. The first reading leaves an id and two digests of
    each; quotient filters find the fingerprints that repeat, and the second
    reading compares the bytes of just those texts, grouped before the shuffle.
    """
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ").alias("norm"))
    prints = stored(norm.select("id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "prints")
    repeated = stored(repeated_fingerprints(prints), "repeated")
    few = repeated.count() <= BROADCAST_KEYS
    keys = F.broadcast(repeated.select("fp")) if few else repeated.select("fp")
    same = (
        norm.withColumn("fp", F.xxhash64("norm"))
        .join(keys, "fp", "left_semi")
        .groupBy("norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    same = stored(same, "same")
    out = prints.join(same, "sha", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.coalesce("keep_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
