"""MD5 of many short words at once."""

from __future__ import annotations

import hashlib

import numpy as np

ONE_BLOCK = 55  # bytes of a word that MD5 takes in one block
AT_ONCE = 2**13  # words whose sums stay in the cache

_TURNS = ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21])
_STEPS = [
    (np.uint32(int(abs(np.sin(i + 1)) * 2**32)), (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.uint32(_TURNS[i // 16][i % 4]))
    for i in range(64)
]  # what is added, the number that is read, by how many bits it is turned
_START = tuple(map(np.uint32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)  # of four bytes, the first so many
_ENDED = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)  # the bit after the last byte


def _short(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First number of the MD5 of words of one block; ``numbers`` has the four bytes from every place."""
    read = {14: (sizes * 8).astype(np.uint32)}
    for i in range(int(sizes.max()) // 4 + 1):
        left = sizes - 4 * i
        part = np.clip(left, 0, 4)
        read[i] = numbers[np.where(left > 0, starts + 4 * i, 0)] & _KEPT[part] | np.where(left >= 0, _ENDED[part], np.uint32(0))
    a, b, c, d = (np.full(len(starts), x) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i, (added, number, bits) in enumerate(_STEPS):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += added
        if number in read:
            f += read[number]
        np.left_shift(f, bits, out=turned)
        np.right_shift(f, np.uint32(32) - bits, out=f)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap()


def md5_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number that the first eight hexadecimal digits of the MD5 of each word make.

    Word i is the ``sizes[i]`` bytes of ``data`` from ``starts[i]`` on.
    """
    found = np.empty(len(starts), np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    numbers = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    short = np.flatnonzero(sizes <= ONE_BLOCK)
    for at in range(0, len(short), AT_ONCE):
        some = short[at : at + AT_ONCE]
        found[some] = _short(numbers, starts[some], sizes[some])
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        found[i] = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
    return found
