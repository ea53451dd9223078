"""Words and their hashes over whole Arrow string buffers, without a Python object for any word.

A word is a run of bytes that are ASCII letters or digits or not ASCII at all;
texts are expected in lower case. Hashes are of spans of one prefix sum, so any
span (a word, its first bytes) costs a few array operations.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 18)
        for k, factor in enumerate((_BASE, _INVERSE)):
            run = np.full(n, factor, dtype=np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary Arrow column, and where each value begins (one more than there are values); a null is empty."""
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def runs(flags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags; none crosses from one value to the next."""
    before = np.concatenate([[False], flags[:-1]]) if len(flags) else flags
    first = ends[:-1][ends[:-1] < len(flags)]
    begin = flags & ~before
    begin[first] = flags[first]
    starts = np.flatnonzero(begin)
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    last = ends[1:][ends[1:] > 0] - 1
    stop = flags & ~after
    stop[last] = flags[last]
    return starts, np.flatnonzero(stop) + 1


class Spans:
    """Hashes of byte spans of ``data``."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and how many words come before each value (one more than there are values)."""
    starts, stops = runs(IS_WORD[data], ends)
    return starts, stops, np.searchsorted(starts, ends)


def sequences(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` consecutive words in each value, and where each value's begin. A value of fewer words has one, of all its words; of none, none."""
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))
    total = len(hashes)
    whole = np.zeros(max(0, total - n + 1), dtype=np.uint64)
    for k in range(n):
        whole += mix(hashes[k : total - n + 1 + k] ^ salt[k]) if total >= n else 0
    sizes = np.diff(counts)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    per = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    long = sizes >= n
    take = np.repeat(counts[:-1][long] - bounds[:-1][long], per[long]) + np.flatnonzero(np.repeat(long, per))
    out[np.repeat(long, per)] = whole[take]
    for i in short:
        part = hashes[counts[i] : counts[i + 1]]
        out[bounds[i]] = np.add.reduce(mix(part ^ salt[: len(part)])) + np.uint64(len(part))
    return mix(out), bounds
