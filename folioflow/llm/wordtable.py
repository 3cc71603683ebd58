"""Token ids of distinct pieces of text, in sorted hash arrays that workers memory-map.

A piece is known by two independent 64-bit hashes of its bytes. Pieces travel
as compressed blobs, one for each bucket (the high bits of the first hash), so
that neither rows nor hashes are exchanged; the hashes are made again where
they are needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from folioflow.llm.store import mapped, pack, put, unpack
from folioflow.llm.textops import U, give_back, span_hashes

CHECK = 77
#: Hashes of pieces that a worker remembers at most before it begins anew (a piece then may go out twice).
MEMORY = 4_000_000

BLOB = pa.schema([("bucket", pa.int32()), ("pieces", pa.binary())])
DONE = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def distinct(h: np.ndarray, check: np.ndarray, inverse: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct (h, check) in the order of h, and (if asked for) for each place which of these it is."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    a, b = h[order], check[order]
    new = a[1:] != a[:-1]
    if (b[1:][~new] != b[:-1][~new]).any():  # two pieces of one first hash
        order = np.lexsort((check, h))
        a, b = h[order], check[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.concatenate([[True], new])
    back = np.empty(len(h) if inverse else 0, np.int64)
    if inverse:
        back[order] = np.cumsum(new) - 1
    return order[new], back


def top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


class Seen:
    """What a task has sent already, so that it sends each piece once."""

    def __init__(self):
        self.h, self.check = np.zeros(0, U), np.zeros(0, U)

    def new(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Which of these distinct pieces, in the order of h, weren't there before (or might not have been)."""
        i = np.searchsorted(self.h, h)
        at = np.minimum(i, max(len(self.h) - 1, 0))
        fresh = (self.h[at] != h) | (self.check[at] != check) if len(self.h) else np.ones(len(h), bool)
        if len(self.h) < MEMORY:
            self.h, self.check = np.insert(self.h, i[fresh], h[fresh]), np.insert(self.check, i[fresh], check[fresh])
        else:
            self.h, self.check = h, check
        return fresh


def blobs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, bits: int) -> pa.RecordBatch:
    """The pieces data[starts:ends], dealt out by h."""
    order = np.argsort(h)
    starts, size = starts[order], (ends - starts)[order]
    edge = np.searchsorted(top(h[order], bits), np.arange((1 << bits) + 1))
    to = np.flatnonzero(np.diff(edge))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = []
    for b in to:
        a, z = edge[b], edge[b + 1]
        out.append(squeeze(pack(size=size[a:z].astype(np.uint32), data=data[spread(starts[a:z], size[a:z])])))
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(out, pa.binary())], schema=BLOB)


def gathered(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pieces of a bucket's blobs: bytes, starts, ends, and both hashes, in the order of the first."""
    parts = [unpack(zstandard.ZstdDecompressor().decompress(b)) for b in blobs]
    data = np.concatenate([p["data"] for p in parts])
    size = np.concatenate([p["size"] for p in parts]).astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK)
    one, _ = distinct(h, check, False)
    return data, starts[one], ends[one], h[one], check[one]


def save(folder: str, bucket: int, h: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
    """One bucket's pieces (distinct, in the order of h) with their ids, one piece's after another's."""
    put(f"{folder}/ids-{bucket}", pack(hash=h, check=check, at=np.concatenate([[0], np.cumsum(size)]), ids=ids))
    give_back()


class Ids:
    """Looks pieces up in the saved buckets, a batch at a time."""

    def __init__(self, folder: str, bits: int, kind: type):
        self.folder, self.bits, self.kind, self.open = folder, bits, kind, {}

    def of(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces in the order of h, all of which are there: where each one's ids begin, how many they are, and all of them."""
        edge = np.searchsorted(top(h, self.bits), np.arange((1 << self.bits) + 1))
        start, size, ids, full = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), [], 0
        for b in np.flatnonzero(np.diff(edge)):
            if b not in self.open:
                self.open[b] = mapped(f"{self.folder}/ids-{b}")
            t, a, z = self.open[b], edge[b], edge[b + 1]
            i = np.searchsorted(t["hash"], h[a:z])
            last = len(t["hash"]) - 1
            while len(wrong := np.flatnonzero(t["check"][np.minimum(i, last)] != check[a:z])):
                i[wrong] += 1
                if (i > last).any():
                    raise KeyError("a piece isn't in its table")
            size[a:z] = t["at"][i + 1] - t["at"][i]
            start[a:z] = full + np.cumsum(size[a:z]) - size[a:z]
            ids.append(t["ids"][spread(t["at"][i], size[a:z])])
            full += len(ids[-1])
        return start, size, np.concatenate(ids) if ids else np.zeros(0, self.kind)
