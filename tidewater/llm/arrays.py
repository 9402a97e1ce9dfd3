"""Sorted arrays of 64-bit keys in the shared folder, memory-mapped by tasks.

Keys are dealt to ``2**bits`` shards by their top bits. Tasks count what they see, pack the counts by
shard (``pack``) and send one row a shard and flush; the task that gathers a shard writes one ``.npy``
file a field. A file is written under a name of its own and then renamed, so a repeated task leaves
the same shard. Readers map the files: pages are read as keys need them and can be dropped again, so
a worker's memory does not grow with the store. Queries are sorted, so a shard is walked in order.

The folder must be one that the driver and all workers mount (a ``file:`` folder below
``spark.checkpoint.dir``, or one given by the caller): arrays in an object store can't be mapped.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import zstandard
from pyspark.sql import SparkSession

from tidewater.llm.common import scratch_path

#: Mapped files that a worker holds open at most.
MAPPED = 2048


def shared_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """Path, as tasks open it, of a new folder for a store."""
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        raise ValueError(f"{path}: arrays are memory-mapped; give a folder that the driver and all workers mount")
    path = there.toUri().getPath()
    os.makedirs(path, exist_ok=True)
    return path


def shard_bits(spark: SparkSession) -> int:
    """Bits of as many shards as the session has shuffle partitions, or up to twice as many."""
    return max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` (not negative) in the smallest unsigned type that holds it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*columns: np.ndarray, rising: bool = False) -> bytes:
    """Columns of unsigned numbers as compressed byte planes; with ``rising`` the first one as steps."""
    out = [struct.pack("<?B", rising, len(columns))]
    for i, c in enumerate(columns):
        c = narrow(np.diff(c, prepend=c.dtype.type(0)) if rising and i == 0 else c)
        out += [struct.pack("<BQ", c.itemsize, len(c)), c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    """The columns of ``pack``, as uint64."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    rising, n = struct.unpack_from("<?B", raw)
    at, out = 2, []
    for i in range(n):
        size, length = struct.unpack_from("<BQ", raw, at)
        at += 9
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        c = np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}").astype(np.uint64)
        out.append(np.cumsum(c, dtype=np.uint64) if rising and i == 0 else c)
        at += size * length
    return out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def by_shard(keys: np.ndarray, bits: int):
    """(shard, row numbers in their order) of the shards that ``keys`` fall in."""
    shard = shard_of(keys, bits)
    order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
    shard = shard[order]
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(shard))):
        yield int(shard[a]), order[a:b]


def runs(ordered: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def write_shard(folder: str, name: str, shard: int, **fields: np.ndarray) -> None:
    for field, values in fields.items():
        path = f"{folder}/{name}-{shard:06d}.{field}.npy"
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            np.save(out, np.ascontiguousarray(values))
        os.replace(own, path)


class Store:
    """Reader of the shards called ``name``."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits, self.maps = folder, name, bits, {}

    def __getstate__(self):
        return {**self.__dict__, "maps": {}}

    def column(self, shard: int, field: str) -> np.ndarray | None:
        """A field of a shard; None of a shard that holds nothing."""
        at = (shard, field)
        if at not in self.maps:
            if len(self.maps) >= MAPPED:
                self.maps.clear()
            path = f"{self.folder}/{self.name}-{shard:06d}.{field}.npy"
            self.maps[at] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[at]

    def find(self, keys: np.ndarray):
        """(rows, shard, places in the shard) of the sorted ``keys`` that are stored, shard by shard."""
        shard = shard_of(keys, self.bits)
        cut = runs(shard)
        for a, b in zip(cut, np.append(cut[1:], len(keys))):
            have = self.column(int(shard[a]), "key")
            if have is None or not len(have):
                continue
            at = np.searchsorted(have, keys[a:b])
            ok = np.flatnonzero(have[np.minimum(at, len(have) - 1)] == keys[a:b])
            yield a + ok, int(shard[a]), at[ok]
