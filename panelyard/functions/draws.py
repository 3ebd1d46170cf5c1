"""Portable random draws: the same in Spark, numpy and SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts) -> Column:
    """A number from 0 to 2^32 - 1 for literals and columns (by name or as Column)."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols))), 1, 8), 16, 10).cast("long")


#: A well-known mixing of 32 bits by two multiplications: products stay below 2^63 in every engine.
FACTOR, STEP, WORD = 0x45D9F3B, 0x9E3779B9, (1 << 32) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """32 mixed bits of 32 bits (held in uint64)."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(FACTOR) & np.uint64(WORD)
    return (x >> np.uint64(16)) ^ x


def key(seed: int, draws: np.ndarray) -> np.ndarray:
    """The key of each draw."""
    return mix(mix(np.uint64([seed & WORD])) ^ np.asarray(draws, np.uint64) & np.uint64(WORD))


def words(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The j-th random word of each state."""
    return mix(state + n * np.uint64(STEP) & np.uint64(WORD))


def ones(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n fair coins, drawn from each state, show ones: exact binomial counts of probability one half."""
    out = np.bitwise_count(words(state, np.zeros(1, np.uint64)) >> np.maximum(32 - n, 0).astype(np.uint64)).astype(np.int64)
    more = np.flatnonzero(n > 32)  # what one word does not cover
    if len(more):
        rest = n[more] - 32
        blocks = (rest + 31) // 32
        start = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        j = np.arange(int(blocks.sum())) - np.repeat(start, blocks)
        left = np.minimum(32, np.repeat(rest, blocks) - 32 * j)
        bits = words(np.repeat(state[more], blocks), (j + 1).astype(np.uint64)) >> (32 - left).astype(np.uint64)
        out[more] += np.add.reduceat(np.bitwise_count(bits).astype(np.int64), start)
    return out


#: Nodes of all draws' trees that are held at once: about what a processor's cache holds.
_MOST_NODES = 1 << 18


def multiplicities_of(low: int, high: int, groups: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each draw takes each of the groups low..high-1 when it takes `groups` times one of as many: (high - low, draws).

    A draw's slots are points of [0, 2^32), group g owning the points u with u * groups >> 32 = g. They are never listed: a node of the binary tree
    over the points knows how many fall into it, and as many fair coins, seeded by draw and node, say how many go left. So any range
    of groups finds its own numbers by itself, on the way down from the root, and all ranges agree."""
    out = np.zeros((high - low, len(draws)), np.int32)
    size = max(1, _MOST_NODES // (groups // 16 + 2 * (high - low) + 1))
    for at in range(0, len(draws), size):
        keys = key(seed, draws[at : at + size])
        d, p, n = np.arange(len(keys)), np.zeros(len(keys), np.uint64), np.full(len(keys), groups, np.int64)
        cells, counts = [], []
        for level in range(33):
            width = np.uint64(32 - level)
            first = ((p << width) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            last = (((p + np.uint64(1) << width) - np.uint64(1)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            within = (n > 0) & (last >= low) & (first < high)
            done = within & (first == last)
            cells.append((first[done] - low) * len(keys) + d[done])
            counts.append(n[done])
            open_ = np.flatnonzero(within & (first != last))
            if not len(open_):
                break
            d, p, n = d[open_], p[open_], n[open_]
            left = ones(mix(keys[d] ^ (np.uint64(1) << np.uint64(level) | p)), n)
            d, p, n = np.concatenate([d, d]), np.concatenate([p << np.uint64(1), p << np.uint64(1) | np.uint64(1)]), np.concatenate([left, n - left])
        taken = np.bincount(np.concatenate(cells), weights=np.concatenate(counts), minlength=(high - low) * len(keys))
        out[:, at : at + len(keys)] = taken.reshape(high - low, len(keys))
    return out


#: Rounds of the permutation below.
ROUNDS = 24


def permuted(x: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..size-1 takes x, elementwise. A Feistel network on the grid of a rows and b columns, a being
    the least number whose square is size or more and b the least number of columns that holds all; a point that leaves the range walks on until it is back."""
    size = np.asarray(size, np.uint64)
    a = np.ceil(np.sqrt(size.astype(float))).astype(np.uint64)
    a += a * a < size
    a -= (a > 1) & ((a - np.uint64(1)) ** np.uint64(2) >= size)
    b = (size + a - np.uint64(1)) // a
    out, todo = np.asarray(x, np.uint64).copy(), np.arange(len(x))
    while len(todo):
        i, j = out[todo] // b[todo], out[todo] % b[todo]
        for r in range(ROUNDS):
            f = words(keys[todo] ^ mix((i if r % 2 else j) & np.uint64(WORD)), np.full(len(todo), r + 1, np.uint64))
            if r % 2:
                j = (j + f) % b[todo]
            else:
                i = (i + f) % a[todo]
        out[todo] = i * b[todo] + j
        todo = todo[out[todo] >= size[todo]]
    return out
