"""Vectorised 64-bit hashing of bytes, words and word runs for tasks in Python.

A polynomial over a random byte table, modulo 2**64, gives the hash of every substring
from one running sum; a finaliser spreads it over all bits. Texts are hashed in
blocks, so temporary arrays stay a fixed size however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit word (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U64) + U64(seed * 1000)) * U64(BASE))


TABLE = byte_table(1)
#: A-Z hash as a-z
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]

IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[9, 10, 11, 12, 13, 32]] = True

_POWERS = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, kept between calls."""
    if _POWERS["n"] < n:
        size = max(n, 2 * BLOCK)
        up, down = np.full(size, BASE, dtype=U64), np.full(size, pow(BASE, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Sums s with: hash of buf[i:j] = (s[j] - s[i]) * inverse ** i."""
    s = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(table[buf] * powers(len(buf))[0], out=s[1:])
    return s


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] for arrays of positions."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(U64))


def word_hashes(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a block that begins and ends between words."""
    black = np.zeros(len(buf) + 2, dtype=np.int8)
    black[1:-1] = ~IS_WHITE[buf]
    edge = np.diff(black)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, spans(running(buf, table), start, end)


def pieces(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` cut at white space into blocks of about ``size`` bytes; no word is cut."""
    at = 0
    while len(data) - at > 2 * size:
        view = np.frombuffer(data, np.uint8, offset=at + size)
        cut = size
        for k in range(0, len(view), size):
            white = np.flatnonzero(IS_WHITE[view[k:k + size]])
            if len(white):
                cut += k + int(white[0])
                break
        else:
            break
        yield data[at:at + cut]
        at += cut
    yield data[at:]


def text_words(texts: list[bytes], table: np.ndarray = LOWER_TABLE) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; short texts are hashed together."""
    group: list[bytes] = []
    held = 0

    def flush():
        if not group:
            return
        ends = np.cumsum([len(t) + 1 for t in group])
        start, h = word_hashes(np.frombuffer(b" ".join(group), np.uint8), table)
        yield from np.split(h, np.searchsorted(start, ends[:-1]))

    for t in texts:
        if held + len(t) > BLOCK and group:
            yield from flush()
            group, held = [], 0
        if len(t) > BLOCK:
            yield np.concatenate([word_hashes(np.frombuffer(p, np.uint8), table)[1] for p in pieces(t)])
            continue
        group.append(t)
        held += len(t)
    yield from flush()


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; with fewer words, of the whole sequence; sorted, distinct."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = mix(words[:len(words) - k + 1] + U64(k))
    for j in range(1, k):
        h = mix(h + words[j:len(words) - k + 1 + j])
    return np.unique(h)
