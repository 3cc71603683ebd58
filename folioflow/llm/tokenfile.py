"""Token-ID files (2): independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard ``tokens-NNNNN.zst`` holds documents in ascending order of id:

* frames, each on its own: the payload is ``n`` (u32), the width of an id in
  bytes (u32), ``n`` document ids (i64), ``n`` lengths (u32), then all ids;
* a skippable frame (magic ``0x184D2A5D``) with the first document id of each
  frame (i64), so that a reader knows which frames it needs;
* a skippable frame with the seek table of the public zstd seekable format:
  for each frame compressed size, size and checksum (the low 32 bits of its
  payload's XXH64), then the number of frames, a flag byte and a magic number.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import drop, filesystem, scratch, stored
from folioflow.llm.textops import LOWER, slices, span_hashes, spans, utf8
from folioflow.llm.wordtable import CHECK, DONE, Ids, Seen, blobs, distinct, gathered, save, spread

SKIP, FIRSTS, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_TOKENS = 1 << 16
#: A mark after a letter begins a piece of its own for the tokenizer (an apostrophe need not).
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[[ord(c) for c in ".,;:!?"]] = True
LETTER[ord("a") : ord("z") + 1] = True
LEVEL = 3

_SHARD = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("frames", pa.int32())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class TokenWriter:
    """Writes one shard, frame by frame; no more than a frame is in memory."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=LEVEL).compress
        self.table, self.firsts, self.ids, self.held = [], [], [], []
        self.size = self.tokens = self.docs = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: of ``width`` bytes each, little-endian."""
        self.ids.append(doc_id)
        self.held.append(ids)
        self.docs += 1
        self.tokens += len(ids) // self.width
        self.size += len(ids)
        if self.size >= FRAME_TOKENS * self.width:
            self.flush()

    def flush(self) -> None:
        if self.ids:
            n = len(self.ids)
            body = b"".join([struct.pack("<II", n, self.width), np.array(self.ids, "<i8").tobytes(), np.array([len(x) // self.width for x in self.held], "<u4").tobytes(), *self.held])
            frame = self.pack(body)
            self.out.write(frame)
            self.table.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
            self.firsts.append(self.ids[0])
        self.ids, self.held, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        firsts = np.array(self.firsts, "<i8").tobytes()
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", FIRSTS, len(firsts)) + firsts + struct.pack("<II", SKIP, len(seek)) + seek)


class TokenReader:
    """Reads documents of one shard; only frames that hold them are decompressed."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flag != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.firsts = np.frombuffer(self._at(table - 8 - 8 * n, 8 * n), "<i8")
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def frame(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        size, full, check = map(int, self.table[i])
        body = self.unpack(self._at(int(self.starts[i]), size), max_output_size=full)
        if len(body) != full or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i}: its checksum differs")
        n, width = struct.unpack_from("<II", body)
        ids = np.frombuffer(body, "<i8", n, 8)
        at = 8 + 12 * n + width * np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", n, 8 + 8 * n), dtype=np.int64)])
        for doc, (a, z) in zip(ids.tolist(), pairwise(at.tolist()), strict=True):
            yield doc, np.frombuffer(body, f"<u{width}", (z - a) // width, a)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.table)):
            yield from self.frame(i)

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Documents of these ids, in ascending order."""
        want = np.unique(np.fromiter(wanted, np.int64))
        last = np.concatenate([self.firsts[1:], [np.iinfo(np.int64).max]])  # a repeated id may begin the next frame
        for i in np.flatnonzero(np.searchsorted(want, last, "right") > np.searchsorted(want, self.firsts)):
            yield from ((d, x) for d, x in self.frame(int(i)) if np.isin(d, want))


def _bytes(col: pa.Array, special: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces between ASCII spaces, and within these between a letter and a mark; A-Z in lower case (as the tokenizer has it).

    Special tokens are matched before letters are lowered, so words with a byte
    that begins one stay whole and as they are.
    """
    raw, off = utf8(col)
    data = LOWER[raw]
    starts, ends, at = spans(data, off)
    found = np.flatnonzero(np.isin(raw, special)) if special else ()
    cut = np.zeros(len(data), bool)
    cut[1:] = MARK[data[1:]] & LETTER[data[:-1]]
    if len(found):
        own = np.unique(np.searchsorted(starts, found, "right") - 1)
        keep = spread(starts[own], ends[own] - starts[own])
        data[keep] = raw[keep]
        cut[keep] = False
    cut[off[:-1][off[1:] > off[:-1]]] = False
    cuts = np.flatnonzero(cut)
    at = at + np.searchsorted(cuts, off)  # pieces before each text
    return data, np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), at


def _special(tokenizer: str) -> list[int]:
    """First bytes of the tokens that the library looks for in the raw text."""
    from tokenizers import Tokenizer

    return sorted({t.content.encode()[0] for t in Tokenizer.from_file(tokenizer).get_added_tokens_decoder().values()})


def _words(bits: int, special: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in slices(batches):
            data, starts, ends, _ = _bytes(b.column("text"), special)
            h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK)
            one, _ = distinct(h, check, False)
            one = one[seen.new(h[one], check[one])]
            yield blobs(data, starts[one], ends[one], h[one], bits)

    return run


def _encode(folder: str, tokenizer: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        data, starts, ends, h, check = gathered(table.column("pieces").to_pylist())
        raw = data.tobytes()
        words = [raw[a:z].decode() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, size = [], []
        for at in range(0, len(words), 10_000):
            for e in tok.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False):
                x = e.ids
                ids += x
                size.append(len(x))
        kind = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        save(folder, key[0].as_py(), h, check, np.array(size, np.int64), np.array(ids, kind))
        return pa.table([[key[0].as_py()], [len(words)]], schema=DONE)

    return run


def _write(folder: str, words: str, bits: int, width: int, end: int, special: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        table, last = Ids(words, bits, np.dtype(f"<u{width}").type), int(end).to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{shard:05d}.zst"
        fs, path = filesystem(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            w = TokenWriter(out, width)
            for b in slices(batches):
                data, starts, ends, at = _bytes(b.column("text"), special)
                h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, CHECK)
                one, back = distinct(h, check)
                start, size, ids = table.of(h[one], check[one])
                n = size[back]
                ids = ids[spread(start[back], n)].astype(f"<u{width}")
                to = np.concatenate([[0], np.cumsum(n)])[at].tolist()
                for doc, a, z in zip(b.column("id").to_pylist(), to, to[1:], strict=False):
                    w.add(doc, ids[a:z].tobytes() + last)
            w.close()
        fs.move(part, path)  # a task that runs twice leaves one whole file
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, uri, w.docs, w.tokens, len(w.table))], names=_SHARD.names).cast(_SHARD)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all texts; return the table of shards: shard, uri, docs, tokens, frames.

    Ranges of ids are the shards, so shards and the documents in them ascend.
    Words between ASCII spaces, without the marks behind them, are encoded on
    their own, each once in all: the tokenizer must drop white space, part
    letters from marks, and look across neither in its normaliser and split. Their ids lie in sorted hash arrays in the shared folder, which
    the writers map. ``end`` follows each document. Tokens that the tokenizer
    calls special are what the library makes of them by default.
    Null and empty texts have the end alone; repeated ids stay side by side in
    no set order. Ids must be integers; a null id raises an error. Empty table:
    shards without documents. Other columns are not looked at.
    """
    from tokenizers import Tokenizer

    folder = folder or scratch(docs.sparkSession, "tokens")
    words = scratch(docs.sparkSession, "token-words")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * n - 1).bit_length())
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    special = _special(tokenizer)
    given = F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit(f"{id_col} must be an integer and not null")).cast("long"))
    rows = docs.select(given.alias("id"), F.col(text_col).alias("text"))
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_words(bits, special), "bucket int, pieces binary")
    found.groupBy("bucket").applyInArrow(_encode(words, tokenizer), "bucket int, n long").agg(F.sum("n")).first()
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    shards = stored(rows.mapInArrow(_write(folder, words, bits, width, end, special), "shard int, uri string, docs long, tokens long, frames int"), "shards")
    drop(docs.sparkSession, words)
    return shards


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, at in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
            out = []
            for doc, ids in TokenReader(uri):
                out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, schema=_READ)


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a table of shards."""
    a, b = shards.select("shard", "tokens"), shards.select("shard", "uri", "docs")
    base: dict[int, int] = {}
    at = 0
    for r in sorted(a.collect()):  # one row for each shard
        base[r.shard], at = at, at + r.tokens
    spark = shards.sparkSession
    starts = spark.createDataFrame(list(base.items()) or [], "shard int, base long")
    each = b.filter("docs > 0").join(F.broadcast(starts), "shard").select("uri", "base")
    return each.repartition(max(1, len(base)), "uri").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
