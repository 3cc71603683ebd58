"""Scratch space that the driver and all executors share.

Spark writes tables there to cut lineage; workers write and memory-map raw
arrays there. All of it lies under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, table: DataFrame | str) -> None:
    """Delete a stored table, or a folder, that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in [table] if isinstance(table, str) else {f.rpartition("/")[0] for f in table.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data) -> None:
    """Write a file whole: a retried or speculative task leaves the same bytes under the same name."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(data).cast("B") if len(data) else b"")
    fs.move(part, path)


def local_copy(uri: str) -> str:
    """A path that can be memory-mapped: the file itself where the shared folder is mounted, else a worker's copy."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    to = os.path.join(tempfile.gettempdir(), "folioflow-cache", path.strip("/").replace("/", "_"))
    if not os.path.exists(to):
        os.makedirs(os.path.dirname(to), exist_ok=True)
        part = f"{to}.{uuid.uuid4().hex}"
        with fs.open_input_stream(path) as src, open(part, "wb") as out:
            while block := src.read(1 << 24):
                out.write(block)
        os.replace(part, to)
    return to


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays in one file: a JSON head, then each array at a multiple of 8 bytes."""
    head, body, at = [], [], 0
    for k, x in arrays.items():
        raw = np.ascontiguousarray(x)
        head.append([k, raw.dtype.str, len(raw), at])
        body += [raw.tobytes(), bytes(-raw.nbytes % 8)]
        at += raw.nbytes + -raw.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *body])


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped: pages come and go as they are read. No descriptor stays open for them."""
    with open(local_copy(uri), "rb") as f:
        return unpack(np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8))


def unpack(data) -> dict[str, np.ndarray]:
    raw = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for k, kind, n, at in json.loads(raw[8 : 8 + size].tobytes()):
        out[k] = raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)
    return out
