"""Directly addressable codes for token ids.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first
chunk of every id, level k the k-th chunk of the ids that have one. A bitmap
per level tells whether the id goes on at the next level, and a rank
directory (ones before each 512-bit block) finds its place there in constant
time. Any id, or any run of ids, is read without decoding what precedes it.

Layout of a segment (all integers little-endian):
    magic "DAC1", u32 levels, u64 ids,
    per level: u64 chunks, chunk bytes, bitmap bytes, directory (u64 each)
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    out, levels, n = [], 0, len(rest)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.zeros(len(ones) + 1, dtype="<u8")
        np.cumsum(ones, out=ranks[1:])
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        levels += 1
        if not more.any():
            break
        rest = rest[more] >> 8
    return b"".join([MAGIC, struct.pack("<IQ", levels, n), *out])


class Segment:
    """Random access to an encoded segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        levels, self.n = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(blob, "<u8", -(-n // BLOCK) + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, at: int) -> int:
        """Ones before place `at` of the level's bitmap."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK
        start = block * BLOCK // 8
        whole, tail = divmod(at - block * BLOCK, 8)
        n = int(ranks[block]) + int.from_bytes(bits[start : start + whole].tobytes(), "little").bit_count()
        return n + (int(bits[start + whole]) & ((1 << tail) - 1)).bit_count() if tail else n

    def access(self, at: int) -> int:
        """The id at place `at`."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[at]) << shift
            if not bits[at >> 3] >> (at & 7) & 1:
                return value
            at, level, shift = self._rank(level, at), level + 1, shift + 8

    def slice(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start`; reads those places and their ranks only."""
        if start < 0 or n < 0 or start + n > self.n:
            raise IndexError((start, n))
        chunks, bits, _ = self.levels[0]
        value = chunks[start : start + n].astype("<u4")
        where, level, shift = slice(None), 0, 8
        while n:
            first = start >> 3
            more = np.unpackbits(bits[first : (start + n + 7) >> 3], bitorder="little")[start - 8 * first :][:n].astype(bool)
            count = int(np.count_nonzero(more))
            if not count:
                break
            start = self._rank(level, start)
            level += 1
            where = np.flatnonzero(more) if isinstance(where, slice) else where[more]
            value[where] |= self.levels[level][0][start : start + count].astype("<u4") << shift
            bits, n, shift = self.levels[level][1], count, shift + 8
        return value
