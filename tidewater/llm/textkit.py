"""Vectorised text kernels on Arrow string buffers (NumPy, no per-word Python).

A batch of texts is one UTF-8 byte buffer with offsets. Words are maximal runs of word bytes inside
one text; their 64-bit hashes come from prefix sums of a polynomial, so the cost is a few array
operations per byte whatever the number of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Texts are processed in groups of about so many bytes; one longer text forms a group of its own.
CHUNK_BYTES = 1 << 20

#: Word bytes: letters, digits and every byte of a non-ASCII character.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Word bytes when words are split at the six ASCII white-space characters only.
NONSPACE = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 arrays."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        if n > 8 * CHUNK_BYTES:  # don't hold the powers of one very long text
            up, down = _powers["up"], _powers["down"]
            _powers.clear()
            return up[:n], down[:n]
    return _powers["up"][:n], _powers["down"][:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, slice) parts of ``arr`` of about ``limit`` bytes."""
    if not len(arr):
        return
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(size):
        if i > first and total + n > limit:
            yield first, arr.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    yield first, arr.slice(first)


class Words:
    """Words of a group of texts: byte positions, owner text and 64-bit hash of each."""

    def __init__(self, arr: pa.Array, table: np.ndarray = ALNUM, lower: bool = True):
        if lower:
            arr = pc.utf8_lower(arr)
        self.raw, self.offsets = buffers(arr)
        self.texts = len(self.offsets) - 1
        raw = self.raw
        n = len(raw)
        inside = table[raw] if n else np.zeros(0, dtype=bool)
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = self.offsets[1:-1]
            before[edge[edge < n]] = False
            after[edge[(edge > 0)] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        # text of each word, and the word range of each text
        self.first = np.searchsorted(self.starts, self.offsets[:-1], side="left")
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.owner = np.repeat(np.arange(self.texts), self.counts)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((raw.astype(U) + U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))

    def grams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, owner, first word) of every window of ``n`` consecutive words of one text.

        With ``short`` a text of 1 to n - 1 words gives one window of all its words.
        """
        m = len(self.hash)
        if m >= n:
            h = np.zeros(m - n + 1, dtype=U)
            for i in range(n):
                h = (h + self.hash[i : m - n + 1 + i]) * BASE
            ok = np.flatnonzero(self.owner[: m - n + 1] == self.owner[n - 1 :])
            h, own = mix(h[ok]), self.owner[ok]
        else:
            h, own, ok = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if short:
            few = np.flatnonzero((self.counts > 0) & (self.counts < n))
            if len(few):
                own2 = np.repeat(few, self.counts[few])
                at = np.concatenate([np.arange(self.first[i], self.first[i] + self.counts[i]) for i in few])
                pos = at - self.first[own2]
                part = mix(self.hash[at] + pos.astype(U) * BASE)
                cut = np.cumsum(self.counts[few]) - self.counts[few]
                h2 = mix(np.add.reduceat(part, cut) + self.counts[few].astype(U))
                h, own, ok = np.append(h, h2), np.append(own, few), np.append(ok, self.first[few])
                order = np.argsort(own, kind="stable")
                h, own, ok = h[order], own[order], ok[order]
        return h, own, ok


def distinct_counts(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in order with their counts."""
    if not len(h):
        return h, own, np.zeros(0, dtype=np.int64)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.empty(len(h), dtype=bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return h[at], own[at], np.diff(np.append(at, len(h)))
