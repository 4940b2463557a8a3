"""Wavelet matrix over token ids in one compressed, self-contained shard file.

Layout (little endian): magic ``WVM2``, planes u8, three zero bytes, documents u32, tokens u64; then a zstd frame
with its length before it (u32) for each of: document starts (u32 x (documents + 1)), doc_ids (i64), whether a doc_id
is null (u8). For every plane, highest bit first: zeros u64, then for each block of ``BLOCK`` bits the ones before it
(u32) and the end of its frame (u32), then the blocks' bits as zstd frames. Rank and select decompress the one block
they look into; the blocks before it are counted by the directory.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVM2"
#: Bits of a block, a multiple of 8.
BLOCK = 1 << 16
LEVEL = 3
_HEAD = struct.Struct("<4sB3xIQ")


def build(ids: np.ndarray, starts: np.ndarray, planes: int, doc_ids: list[int | None] | None = None) -> bytes:
    """``starts`` holds the offset of every document and, last, the number of ids."""
    n, packer = len(ids), zstandard.ZstdCompressor(level=LEVEL)
    names = list(doc_ids) if doc_ids is not None else [None] * (len(starts) - 1)
    out = [_HEAD.pack(MAGIC, planes, len(starts) - 1, n)]
    for part in (np.asarray(starts, "<u4"), np.array([x or 0 for x in names], "<i8"), np.array([x is None for x in names], np.uint8)):
        frame = packer.compress(part.tobytes())
        out += [struct.pack("<I", len(frame)), frame]
    current = np.ascontiguousarray(ids)
    for p in range(planes - 1, -1, -1):
        bits = current & current.dtype.type(1 << p) != 0
        packed = np.packbits(bits.view(np.uint8), bitorder="little")
        cuts = range(0, len(packed), BLOCK // 8)
        ones = np.array([0, *(int(np.bitwise_count(packed[a : a + BLOCK // 8]).sum()) for a in cuts)])
        frames = [packer.compress(packed[a : a + BLOCK // 8].tobytes()) for a in cuts]
        zeros = np.compress(~bits, current)
        ends = np.cumsum([len(f) for f in frames]) if frames else np.zeros(0)
        out += [struct.pack("<Q", len(zeros)), np.cumsum(ones)[:-1].astype("<u4").tobytes(), ends.astype("<u4").tobytes(), *frames]
        current = np.concatenate((zeros, np.compress(bits, current)))
    return b"".join(out)


class WaveletMatrix:
    """Read one shard: token access, counting, occurrence lookup, whole decode."""

    def __init__(self, blob: bytes):
        magic, self.planes, docs, self.n = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        self._blob, self._unpack = memoryview(blob), zstandard.ZstdDecompressor()
        at, parts = _HEAD.size, []
        for _ in range(3):
            size = struct.unpack_from("<I", blob, at)[0]
            parts.append(self._unpack.decompress(self._blob[at + 4 : at + 4 + size]))
            at += 4 + size
        self.starts = np.frombuffer(parts[0], "<u4").astype(np.int64)
        self.doc_ids = [None if gone else x for x, gone in zip(np.frombuffer(parts[1], "<i8").tolist(), parts[2], strict=True)]
        blocks = -(-self.n // BLOCK)
        self.zeros, self.ranks, self.frames = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.ranks.append(np.frombuffer(blob, "<u4", blocks, at + 8))
            ends = np.frombuffer(blob, "<u4", blocks, at + 8 + 4 * blocks).astype(np.int64)
            at += 8 + 8 * blocks
            self.frames.append(at + np.concatenate(([0], ends)))
            at = int(self.frames[-1][-1])
        self._bits = lru_cache(maxsize=8 * self.planes)(self._block)

    def _block(self, plane: int, k: int) -> np.ndarray:
        a, z = self.frames[plane][k : k + 2].tolist()
        return np.frombuffer(self._unpack.decompress(self._blob[a:z]), np.uint8)

    def _bit(self, plane: int, i: int) -> int:
        return int(self._bits(plane, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0 or not self.n:
            return 0
        k = min(i // BLOCK, len(self.ranks[plane]) - 1)
        within = i - k * BLOCK
        held = self._bits(plane, k)[: -(-within // 8)]
        ones = int(np.bitwise_count(held).sum())
        if within % 8:
            ones -= (int(held[-1]) >> (within % 8)).bit_count()
        return int(self.ranks[plane][k]) + ones

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane: the block by its directory, the place within it by its bits."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        size = min(BLOCK, self.n - block * BLOCK)
        held = np.unpackbits(self._bits(plane, block), count=size, bitorder="little")
        return block * BLOCK + int(np.flatnonzero(held == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self.rank1(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, a: int, z: int) -> tuple[int, int]:
        for p in range(self.planes):
            one_a, one_z = self.rank1(p, a), self.rank1(p, z)
            a, z = (self.zeros[p] + one_a, self.zeros[p] + one_z) if token >> (self.planes - 1 - p) & 1 else (a - one_a, z - one_z)
        return a, z

    def count(self, token: int, a: int = 0, z: int | None = None) -> int:
        """Occurrences of a token among ids a to z."""
        if token >> self.planes:
            return 0
        low, high = self._range(token, a, self.n if z is None else z)
        return high - low

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token; -1 if there are not so many."""
        if token >> self.planes:
            return -1
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        i = low + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self.select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        dtype = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, dtype)
        for p in range(self.planes - 1, -1, -1):
            raw = np.concatenate([self._block(p, k) for k in range(len(self.ranks[p]))]) if self.n else np.zeros(0, np.uint8)
            bits = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            values[self.zeros[p] :] |= dtype(1 << (self.planes - 1 - p))
            parent = np.empty(self.n, dtype)
            parent[np.concatenate((np.flatnonzero(~bits), np.flatnonzero(bits)))] = values
            values = parent
        return values
