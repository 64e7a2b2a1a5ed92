"""Content-defined cuts by a windowed gear hash, over whole batches of streams."""

from __future__ import annotations

import numpy as np

#: The hash covers this many values (a power of two); shorter chunks than that are never cut.
WINDOW = 32


def gear(values: np.ndarray) -> np.ndarray:
    """sum over k < WINDOW of values[i - k] << k, by doubling."""
    out, span = values.copy(), 1
    while span < WINDOW:
        shifted = out[:-span] << np.uint64(span)
        out[span:] += shifted
        span *= 2
    return out


def cuts(values: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """For each stream, the ends of its chunks, relative to its start. A cut needs a hash whose top bits are zero.

    values: a random 64-bit number for each unit; least >= WINDOW, so that no cut depends on a neighbouring stream.
    """
    hit = np.flatnonzero(gear(values) >> np.uint64(64 - bits) == 0) + 1 if len(values) > WINDOW else np.empty(0, np.int64)
    first = np.searchsorted(hit, offsets[:-1], "right")
    last = np.searchsorted(hit, offsets[1:], "left")
    out = []
    for i in range(len(offsets) - 1):
        start, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        ends, at = [], 0
        for h in hit[first[i] : last[i]].tolist():
            h -= start
            while h - at > most:
                at += most
                ends.append(at)
            if h - at >= least:
                at = h
                ends.append(at)
        while n - at > most:
            at += most
            ends.append(at)
        if n > at:
            ends.append(n)
        out.append(ends)
    return out
