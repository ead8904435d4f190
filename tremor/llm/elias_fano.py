"""Elias-Fano sequences, and an n-gram trie of them.

A sequence of n non-decreasing integers below u keeps the low floor(log2(u /
n)) bits of each and the high bits in unary, about n * (2 + log2(u / n)) bits,
with one count of 32 bits for every 64 bits of the unary part to find a bit in
it.  All queries work on arrays of keys.
"""

from __future__ import annotations

import json
import mmap

CONTEXT_BITS = 32
ASKED = 1 << 16  # children that are looked up at a time


def _select_in(word, k):
    """Place of the one number ``k`` (from 0) in each 64-bit word."""
    import numpy as np

    at = np.zeros(len(word), np.uint64)
    k = k.astype(np.uint8)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> at) & np.uint64((1 << width) - 1))
        up = k >= low
        k = np.where(up, k - low, k)
        at += np.where(up, np.uint64(width), np.uint64(0))
    return at.astype(np.int64)


class EliasFano:
    def __init__(self, low, high, before, n: int, shift: int):
        self.low, self.high, self.before, self.n, self.shift = low, high, before, n, shift

    @staticmethod
    def build(values, universe: int) -> EliasFano:
        import numpy as np

        n = len(values)
        shift = max(0, (universe // max(1, n)).bit_length() - 1)
        high = np.zeros((((universe >> shift) + n + 1) >> 6) + 1, np.uint64)
        one = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, one >> 6, np.uint64(1) << (one & 63).astype(np.uint64))
        ones = np.bitwise_count(high).astype(np.uint32)
        low = np.zeros(((n * shift) >> 6) + 2, np.uint64)
        if shift:
            rest = values & np.uint64((1 << shift) - 1)
            bit = np.arange(n, dtype=np.int64) * shift
            off = (bit & 63).astype(np.uint64)
            np.bitwise_or.at(low, bit >> 6, rest << off)
            over = off + np.uint64(shift) > 64
            np.bitwise_or.at(low, (bit[over] >> 6) + 1, rest[over] >> (np.uint64(64) - off[over]))
        return EliasFano(low, high, np.cumsum(ones, dtype=np.uint32) - ones, n, shift)

    def values(self, at):
        """The values at the places ``at``."""
        import numpy as np

        if not len(at):
            return np.zeros(0, np.uint64)
        word = np.searchsorted(self.before, at.astype(np.uint32), "right") - 1
        one = (word << 6) + _select_in(self.high[word], at - self.before[word])
        return self._with_low((one - at).astype(np.uint64), at)

    def _with_low(self, high, at):
        import numpy as np

        if not self.shift:
            return high
        bit = at * self.shift
        off = (bit & 63).astype(np.uint64)
        low = self.low[bit >> 6] >> off
        low |= np.where(off > 0, self.low[(bit >> 6) + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (high << np.uint64(self.shift)) | (low & np.uint64((1 << self.shift) - 1))

    def part(self, a: int, b: int):
        """The values at the places from ``a`` to ``b``, read one after the other."""
        import numpy as np

        if a >= b:
            return np.zeros(0, np.uint64)
        word, last = (int(x) for x in np.searchsorted(self.before, np.array([a, b - 1], np.uint32), "right") - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[word : last + 1].view(np.uint8), bitorder="little"))
        skip = a - int(self.before[word])
        at = np.arange(a, b)
        high = (ones[skip : skip + b - a] + ((word << 6) - at)).astype(np.uint64)
        return self._with_low(high, at)

    def successor(self, keys, lo: int = 0, hi: int | None = None):
        """Place of the first value from ``lo`` on that is not less than the key; ``hi`` (the end) if none before it is."""
        import numpy as np

        return lo + np.searchsorted(self.part(lo, self.n if hi is None else hi), keys)

    def arrays(self) -> list:
        return [self.low, self.high, self.before]


class Trie:
    """n-grams level by level in one memory map that goes with the object.

    ``add`` appends a level: for each place of its parent level the children
    there, sorted, with an optional code each.  A level keeps the children,
    made monotone by the place of the parent, and monotone pointers from the
    parents to their first child; a child is searched for between the pointers
    of its parent only.
    """

    def __init__(self):
        self.levels: dict[str, tuple] = {}

    def add(self, name: str, parents: int, parent, child, codes=None) -> None:
        import numpy as np

        starts = np.searchsorted(parent, np.arange(parents + 1)).astype(np.uint64)
        key = (parent.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | child if parents > 1 else child
        universe = parents << CONTEXT_BITS if parents > 1 else 1 << 64
        self.levels[name] = EliasFano.build(key, universe), EliasFano.build(starts, len(child) + 1), codes, parents

    def _header(self) -> list:
        """Per level its name, number of parents, sizes and shifts of both sequences, and type and length of each array."""
        out = []
        for name, (keys, starts, codes, parents) in self.levels.items():
            arrays = [*keys.arrays(), *starts.arrays(), *([] if codes is None else [codes])]
            out.append([name, parents, keys.n, keys.shift, starts.n, starts.shift, [[x.dtype.str, len(x)] for x in arrays]])
        return out

    def _lay(self, header: list, whole) -> Trie:
        """Levels as views of one run of bytes."""
        import numpy as np

        at = 0
        for name, parents, n, shift, n_starts, shift_starts, kinds in header:
            views = []
            for kind, length in kinds:
                size = length * np.dtype(kind).itemsize
                views.append(whole[at : at + size].view(kind))
                at += size + -size % 8
            keys, starts = EliasFano(*views[:3], n, shift), EliasFano(*views[3:6], n_starts, shift_starts)
            self.levels[name] = keys, starts, views[6] if len(views) > 6 else None, parents
        self.whole = whole
        return self

    def map(self) -> Trie:
        """Move all levels into one memory map."""
        import numpy as np

        header = self._header()
        arrays = [x for keys, starts, codes, _ in self.levels.values() for x in (*keys.arrays(), *starts.arrays(), *([] if codes is None else [codes]))]
        self.bytes = sum(x.nbytes + -x.nbytes % 8 for x in arrays)
        whole = np.frombuffer(mmap.mmap(-1, max(1, self.bytes)), np.uint8)
        at = 0
        for x in arrays:
            whole[at : at + x.nbytes] = x.view(np.uint8)
            at += x.nbytes + -x.nbytes % 8
        return self._lay(header, whole)

    def dump(self) -> bytes:
        """A mapped trie as bytes: a line of JSON that describes the levels, then the map."""
        return json.dumps(self._header()).encode() + b"\n" + self.whole.tobytes()

    @staticmethod
    def load(data: bytes) -> Trie:
        """The trie that was dumped, in a memory map of its own."""
        import numpy as np

        at = data.index(b"\n") + 1
        trie = Trie()
        trie.bytes = len(data) - at
        whole = np.frombuffer(mmap.mmap(-1, max(1, trie.bytes)), np.uint8)
        whole[: trie.bytes] = np.frombuffer(data, np.uint8, offset=at)
        return trie._lay(json.loads(data[:at]), whole)

    def find(self, name: str, parent, child):
        """Place of each ``child`` below the place ``parent`` (-1: none), -1 if it isn't held.

        Questions are taken in order, so that those of neighbouring parents
        share one look at what lies between the pointers of the first and last.
        """
        import numpy as np

        keys, starts, _, parents = self.levels[name]
        out = np.full(len(child), -1, np.int64)
        ask = np.flatnonzero(parent >= 0) if keys.n else np.zeros(0, np.int64)
        above, key = parent[ask], child[ask]
        if parents > 1:
            key = (above.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | key
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key)
            ask, above, key = ask[order], above[order], key[order]
        for i in range(0, len(ask), ASKED):
            own, wanted = above[i : i + ASKED], key[i : i + ASKED]
            lo, hi = (int(x) for x in starts.values(np.array([own[0], own[-1] + 1])))
            values = keys.part(lo, hi)
            at = np.searchsorted(values, wanted)
            hit = np.flatnonzero(at < len(values))
            hit = hit[values[at[hit]] == wanted[hit]]
            out[ask[i : i + ASKED][hit]] = lo + at[hit]
        return out

    def codes(self, name: str):
        return self.levels[name][2]
