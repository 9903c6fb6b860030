"""Poisson counts that any engine can redraw: read from the MD5 of a text, a batch of texts at a time."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: 65,536 times the chance that a Poisson count of mean 1 is at most 0, 1, ... 6.
POISSON = (24109, 48218, 60273, 64291, 65296, 65497, 65530)
#: Blocks whose counts are held at a time, and hashes that are computed side by side.
CHUNK, LANES = 256, 32768

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = tuple(int(abs(np.sin(i + 1)) * 2**32) for i in range(64))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_lanes(words: Sequence[np.ndarray | int], shape: tuple[int, ...]) -> np.ndarray:
    """MD5 digests, four words each, of messages of one block; word i of all messages is an array or one number."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if kind == 3:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        else:
            x, y, z = ((c, d, b), (b, c, d), (c, d, b))[kind]
            np.bitwise_xor(x, y, out=f)
            if kind == 2:
                np.bitwise_xor(f, z, out=f)
            else:
                np.bitwise_and(f, z, out=f)
                np.bitwise_xor(f, y, out=f)
        np.add(f, a, out=f)
        word = words[at]
        np.add(f, np.uint32((SINES[i] + (word if isinstance(word, int) else 0)) % 2**32), out=f)
        if not isinstance(word, int):
            np.add(f, word, out=f)
        turn = SHIFTS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    out = np.empty((*shape, 4), np.uint32)
    for i, x in enumerate((a, b, c, d)):
        np.add(x, np.uint32(START[i]), out=out[..., i])
    return out


def _hashed(heads: Sequence[bytes], tails: np.ndarray) -> np.ndarray:
    """(heads, tails, 8): eight numbers of four hex digits of the MD5 of each head and tail; heads are as long as each other, and so are tails."""
    h, t = len(heads[0]), tails.shape[1]
    n, m = len(heads), len(tails)
    if h + t > 55:  # more than one block of MD5
        whole = [hashlib.md5(x + y.tobytes()).digest() for x in heads for y in tails]
        return np.frombuffer(b"".join(whole), ">u2").reshape(n, m, 8)
    left, right = np.zeros((n, 64), np.uint8), np.zeros((m, 64), np.uint8)
    left[:, :h] = np.frombuffer(b"".join(heads), np.uint8).reshape(n, h)
    right[:, h : h + t], right[:, h + t] = tails, 0x80
    right[:, 56:58] = np.frombuffer((8 * (h + t)).to_bytes(2, "little"), np.uint8)
    left, right = left.view("<u4"), right.view("<u4")
    words: list[np.ndarray | int] = []
    for i in range(16):
        some = i * 4 <= h + t
        words.append((left[:, i, None] | right[None, :, i]) if some else int(right[0, i]))
    return md5_lanes(words, (n, m)).astype("<u4", copy=False).view(">u2").reshape(n, m, 8)


def poisson_counts(blocks: Sequence[str | None], seed: int, replicates: int) -> np.ndarray:
    """(blocks, replicates): how often each block counts in each replicate; a null block is left out of its text."""
    counted = np.searchsorted(np.array(POISSON), np.arange(65536), side="right").astype(np.uint8)
    eights = -(-replicates // 8)
    out = np.empty((len(blocks), eights, 8), np.uint8)
    texts = [b"" if b is None else b"-" + str(b).encode() for b in blocks]
    heads = [f"{seed}-{q}".encode() for q in range(eights)]
    tails: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        tails.setdefault(len(t), []).append(i)
    for size, at in tails.items():
        data = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), size)
        for long in {len(h) for h in heads}:
            mine = [q for q, h in enumerate(heads) if len(h) == long]
            side = max(1, LANES // len(at))
            for k in range(0, len(mine), side):
                qs = mine[k : k + side]
                got = counted[_hashed([heads[q] for q in qs], data)]
                out[np.ix_(at, qs)] = got.transpose(1, 0, 2)
    return out.reshape(len(blocks), eights * 8)[:, :replicates]
