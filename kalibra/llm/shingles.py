"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Multipliers of the splitmix64 finalizer and its step.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
#: Bytes hashed at once.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + _STEP
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(256, dtype=np.uint64))
#: An odd base and its inverse modulo 2**64: a word's hash doesn't depend on where it stands.
_BASE = 0x2545F4914F6CDD1D
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * BLOCK, _BASE, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)]))


def _hashes(data: np.ndarray, widths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data (with widths: a row of them, then one of the words' first bytes for each width), and where they start."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if len(data) < len(_POWERS):
        powers, inverse = _POWERS, _INVERSE
    else:  # a single word of over two blocks
        powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)], dtype=np.uint64)])
    up_to = lambda end: mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return np.stack([up_to(end), *[up_to(np.minimum(end, start + w)) for w in widths]]) if widths else up_to(end), start


def word_hashes(texts: list[bytes | None], widths: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Memory is bounded by BLOCK and the longest word."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        h, start = _hashes(data, widths)
        cuts = np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))
        return iter(np.split(h, cuts, axis=-1)[:-1])

    for x in texts:
        x = (x or b"").lower()
        if len(x) > BLOCK:
            if held:
                yield from flush()
                held, size = [], 0
            parts, at = [], 0
            while at < len(x):
                end = at + BLOCK
                while end < len(x) and x[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
                parts.append(_hashes(np.frombuffer(x, np.uint8, min(end, len(x)) - at, at), widths)[0])
                at = end
            yield np.concatenate(parts, axis=-1)
            continue
        held.append(x)
        size += len(x)
        if size > BLOCK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


#: ASCII marks, which bare words are parted by.
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def bare_words(texts: list[bytes | None], widths: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """Hashes of each text's words where ASCII marks part words and all letters are lower-cased: edited copies differ in these often."""
    lower = lambda x: x if x.isascii() else x.decode().lower().encode()  # noqa: E731  word_hashes lowers A-Z itself
    return word_hashes([lower(x or b"").translate(_TO_SPACE) for x in texts], widths)


def in_order(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k words; of all words as one where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h ^ words[i : n - width + 1 + i])
    return h


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(in_order(words, k))
