"""Words of whole texts as 64-bit hashes, a numpy pass over the bytes of many documents at a time.

A word's hash is the sum of a random number per byte times a power of an odd base, modulo 2^64: sums over runs of
bytes are what numpy does fast, and an inverse power makes the hash independent of the place. Such sums have known
collisions among long strings, so a word of more than LONG bytes gets a cryptographic hash instead.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPAN = 1 << 18
LONG = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that are neither letters nor digits.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, np.uint64(base)
    while filled < n:
        k = min(filled, n - filled)
        out[filled : filled + k] = out[:k] * step
        filled += k
        step = np.uint64(int(step) * int(step) & _MASK) if filled < n else step
    return out


class Words:
    """Cuts bytes into words; fold: A-Z count as a-z."""

    def __init__(self, breaks: np.ndarray = SPACE, fold: bool = True):
        self.fold = np.arange(256, dtype=np.uint8)
        if fold:
            self.fold[ord("A") : ord("Z") + 1] = self.fold[ord("a") : ord("z") + 1]
        values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        values[breaks] = 0
        self.values, self.inside = values, ~breaks
        with np.errstate(over="ignore"):
            self.up, self.down = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)

    def starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The offsets at which words start; a document's first byte never continues the one before."""
        inside = self.inside[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        firsts = ends[:-1][ends[:-1] < ends[1:]]
        head[firsts] = inside[firsts]
        return np.flatnonzero(head)

    def hashes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes in order, and the n + 1 offsets of the documents among them."""
        starts = self.starts(data, ends)
        out = np.empty(len(starts), np.uint64)
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        at = 0
        with np.errstate(over="ignore"):
            while at < len(starts):
                lo = int(starts[at])
                to = int(np.searchsorted(stops, lo + _SPAN, side="right"))
                if to <= at:  # one word, or what follows it, longer than the table of powers
                    out[at] = self._one(data[lo : int(stops[at])])
                    at += 1
                    continue
                hi = int(stops[to - 1])
                place = starts[at:to] - lo
                out[at:to] = np.add.reduceat(self.values[data[lo:hi]] * self.up[: hi - lo], place) * self.down[place]
                at = to
            for k in np.flatnonzero(stops - starts > LONG).tolist():
                out[k] = self._one(data[int(starts[k]) : int(stops[k])])
            return mix(out), np.searchsorted(starts, ends)

    def _one(self, data: np.ndarray) -> np.uint64:
        """The hash of the word that data begins with."""
        breaks = np.flatnonzero(~self.inside[data])
        word = data[: int(breaks[0])] if len(breaks) else data
        if len(word) <= LONG:
            return (self.values[word] * self.up[: len(word)]).sum(dtype=np.uint64)
        return np.uint64(int.from_bytes(hashlib.blake2b(self.fold[word].tobytes(), digest_size=8).digest(), "little"))


_TURNS = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def _turn(k: int) -> np.uint64:
    return np.uint64((_TURNS[k % 5] + 2 * 0x632BE59BD9B4E019 * (k // 5)) & _MASK | 1)


def shingles(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words, by document and in order; a document of fewer words has its whole sequence
    as one, one without words has none. Returns the hashes and the n + 1 offsets."""
    counts = np.diff(ends)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        if len(words) >= width:
            every = words[: len(words) - width + 1] * _turn(0)
            for k in range(1, width):
                every += words[k : len(words) - width + 1 + k] * _turn(k)
            every = mix(every)
        else:
            every = np.zeros(0, np.uint64)
        out = np.empty(int(offsets[-1]), np.uint64)
        full = counts >= width
        if full.all():
            keep = np.ones(len(every), bool)
            for k in range(1, width):
                cut = ends[1:-1] - k
                keep[cut[(cut >= 0) & (cut < len(every))]] = False
            out[:] = every[keep]
            return out, offsets
        place = np.arange(len(out)) - np.repeat(offsets[:-1], sizes) + np.repeat(ends[:-1], sizes)
        whole = np.repeat(full, sizes)
        out[whole] = every[place[whole]]
        for d in np.flatnonzero(~full & (counts > 0)):
            run = words[ends[d] : ends[d + 1]]
            total = np.uint64(_turn(width + len(run)))
            for k, w in enumerate(run):
                total = total + w * _turn(k)
            out[offsets[d]] = mix(np.array([total], np.uint64))[0]
        return out, offsets
