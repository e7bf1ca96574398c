"""Word and window arithmetic over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII white space: space and the bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Longer words are hashed one by one.
LONG = 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts laid into one buffer, a line feed after each text.

    ``start`` and ``end`` are byte positions, ``doc`` the text of each word,
    ``first`` the number of words before each text (one entry more than texts).
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
        size = len(self.data) - 8
        white = WHITE[self.data[:size]]
        before = np.concatenate(([True], white[:-1]))
        self.start = np.flatnonzero(~white & before)
        self.end = np.flatnonzero(white & ~before)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        size = self.end - self.start
        h = size.astype(np.uint64) * _A
        at, at_start, left = np.arange(len(size)), self.start, size
        lane = 0
        while len(at) and lane < LONG:
            v = lanes[at_start + lane]
            short = left < 8
            v[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[at] = mix((h[at] ^ v) + _A)
            more = left > 8
            at, at_start, left = at[more], at_start[more], left[more] - 8
            lane += 8
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i]:self.end[i]].tobytes())
        return h

    def joined(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The kept words, each followed by one space, and where each text's words begin in that."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start[keep]] += 1
        edge[self.end[keep] + 1] -= 1  # the byte after a word is white, and becomes the space
        chosen = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        data = self.data.copy()
        data[self.end] = 0x20
        size = np.concatenate(([0], np.cumsum(np.where(keep, self.end - self.start + 1, 0))))
        return data[chosen].tobytes(), size[self.first]


def grams(h: np.ndarray, size: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    n = max(0, len(h) - size + 1)
    g = np.zeros(n, np.uint64)
    for j in range(size):
        g = g * np.uint64(multiplier) + h[j:j + n]
    return mix(g)


def anchors(words: Words, g: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor: the place, inside the window, of the least hash of ``size`` words (the leftmost of equals).

    Windows that share their words have their anchor at the same place in the
    window. Returns the anchor's word number and the first and last window
    that it stands for, of each run of windows with the same anchor. Windows
    reach over no text's end.
    """
    none = np.zeros(0, np.int64)
    if len(words.start) < window:
        return none, none, none
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, of = 1, window - size + 1
    while span * 2 <= of:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < of:
        least = np.minimum(least[:len(least) - (of - span)], least[of - span:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.flatnonzero(words.doc[:len(at)] == words.doc[window - 1:window - 1 + len(at)])
    if not len(inside):
        return none, none, none
    own = at[inside]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(own) - 1]))
    return own[new], inside[new], inside[last]


def classes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of ``table`` by their columns, and how many leading columns each shares with the one before."""
    rows = np.ascontiguousarray(table.astype(">u8")).view(f"V{8 * table.shape[1]}").ravel()
    order = np.argsort(rows, kind="stable")
    sorted_ = table[order]
    differ = sorted_[1:] != sorted_[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    return order, np.concatenate(([0], shared)) if len(order) else shared
