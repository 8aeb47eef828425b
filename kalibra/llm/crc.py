"""CRC-32 of joined strings from the CRCs of their parts: what follows a part shifts its CRC by a matrix over GF(2)."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words beyond so many bytes are given to zlib one by one; shorter ones are stepped side by side.
LONG = 64


def _bytes_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _bytes_table()
BITS = np.uint32(1) << np.arange(32, dtype=np.uint32)


def applied(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """matrix (32 columns of 32 bits) times each of the vectors v, over GF(2)."""
    out = np.zeros_like(v)
    for bit, column in enumerate(matrix):
        out ^= np.where((v >> np.uint32(bit)) & 1, column, np.uint32(0)).astype(np.uint32)
    return out


#: The matrix of one zero byte.
BYTE = TABLE[BITS & 255] ^ (BITS >> np.uint32(8))


@cache
def shifts(level: int) -> np.ndarray:
    """Tables (64 x 4 x 256, flat) of the matrices that shift by d * 64**level bytes, d < 64: the image of each value of each of the
    four bytes of a CRC."""
    unit, out = BYTE, np.empty((64, 4, 256), np.uint32)
    for _ in range(6 * level):
        unit = applied(unit, unit)
    m, values = BITS, np.arange(256, dtype=np.uint32)
    for d in range(64):
        for j in range(4):
            out[d, j] = applied(m, values << np.uint32(8 * j))
        m = applied(unit, m)
    return out.reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC as its share in the CRC of a string that goes on for length bytes: crc32(a + b) == shifted(crc32(a), len(b)) ^ crc32(b)."""
    out, level = crc.astype(np.uint32), 0
    most = int(length.max()) if len(length) else 0
    while most >> (6 * level):
        digit = (length >> (6 * level)) & 63
        at = np.flatnonzero(digit)
        own, row, table = out[at], digit[at] * 1024, shifts(level)
        out[at] = table[row + (own & 255)] ^ table[row + 256 + ((own >> np.uint32(8)) & 255)] ^ table[row + 512 + ((own >> np.uint32(16)) & 255)] ^ table[row + 768 + (own >> np.uint32(24))]
        level += 1
    return out


def of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of data (bytes), a byte of all slices at a time, longest first."""
    order = np.argsort((255 - np.minimum(lengths, 255)).astype(np.uint8), kind="stable")
    at, left = starts[order], np.minimum(lengths, LONG + 1)[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    more = len(at) - np.cumsum(np.bincount(left, minlength=LONG + 2))  # how many have over j bytes
    for j in range(LONG):
        m = int(more[j])
        if not m:
            break
        own = crc[:m]
        crc[:m] = TABLE[(own ^ data[at[:m] + j]) & 255] ^ (own >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[: int(more[LONG])]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out
