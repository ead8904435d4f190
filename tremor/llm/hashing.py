"""Vectorised 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from tremor.llm.common import WS

PIECE = 1 << 18  # bytes hashed at a time
_PRIME = 0x9E3779B97F4A7C15 | 3  # odd, so that its powers have inverses


@cache
def _tables(size: int):
    import numpy as np

    with np.errstate(over="ignore"):
        power = np.full(size, _PRIME, np.uint64)
        power[0] = 1
        inverse = np.full(size, pow(_PRIME, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    of_byte = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    blank = np.zeros(256, bool)
    blank[list(WS)] = True
    return power, inverse, of_byte, blank


def mix(x):
    """The splitmix64 finaliser."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(data: bytes):
    """Hashes of the words of ``data``, and where they start."""
    import numpy as np

    size = 1 << max(16, (len(data) + 1).bit_length())
    power, inverse, of_byte, blank = _tables(size)
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~blank[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_byte[raw] * power[: len(raw)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes) -> list[bytes]:
    """Cut a very long text at white space."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(bytes([x]), at + PIECE // 2, at + PIECE) for x in WS)
        if cut < 0:
            cut = min((k for x in WS if (k := text.find(bytes([x]), at + PIECE)) >= 0), default=len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def word_hashes(texts: list[bytes]) -> Iterator:
    """For each text the array of its words' hashes, in order."""
    import numpy as np

    group: list[bytes] = []
    size = 0

    def flush():
        hashes, start = _hashes(b" ".join(group))
        bounds = np.cumsum([0, *(len(x) + 1 for x in group)])
        at = np.searchsorted(start, bounds)
        yield from (hashes[a:b] for a, b in zip(at, at[1:], strict=False))

    for text in texts:
        if len(text) > PIECE:
            yield from flush() if group else ()
            group, size = [], 0
            yield np.concatenate([_hashes(x)[0] for x in _pieces(text)])
            continue
        group.append(text)
        size += len(text)
        if size > PIECE:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def shingles(words, size: int):
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    import numpy as np

    n = min(size, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(_PRIME) + words[k : len(words) - n + 1 + k])
    return np.unique(out)
