"""Content-defined cut positions of a text by a rolling hash over its last characters."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def rolling_hits(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions i with h(i) = 0, where h(i) = sum of points[i-j] * 2^j over j < bits, modulo 2^bits.

    The hash looks at the last ``bits`` characters only, so equal passages are cut alike wherever they stand.
    """
    h = np.zeros(len(points), dtype=np.uint32)
    for j in range(min(bits, len(points))):
        h[j:] += points[: len(points) - j] << np.uint32(j)
    hits = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0)
    return hits[hits >= bits - 1]


def cut_positions(text: str, *, bits: int, least: int, most: int) -> list[int]:
    """Ends of the content-defined pieces of a non-empty text, the last being its length."""
    n = len(text)
    if n <= least:
        return [n]
    ends = (rolling_hits(code_points(text), bits) + 1).tolist()
    cuts, at = [], 0
    for end in ends:
        while end - at > most:
            at += most
            cuts.append(at)
        if end - at >= least and end < n:
            cuts.append(end)
            at = end
    while n - at > most:
        at += most
        cuts.append(at)
    return [*cuts, n]
