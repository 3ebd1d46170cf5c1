"""Spanning links of one group, found without listing all of its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Links (i, those reached from i) that connect just what all near pairs of 0..n-1 connect.

    near(i, others) says which of the others are near i. Breadth first; each of the n is
    reached once at most, so there are fewer than n links whatever the group's size."""
    left = np.arange(n)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                yield i, found
                front.extend(map(int, found))
