"""Content-chosen anchors: splits the starts of all width-byte strings into runs by key.

Each start gets as key the least hash of the GRAM-byte strings inside its width-byte string.
Equal strings have equal keys wherever they stand, so strings need comparing only with those
of the same key, and neighbouring starts mostly share a key, so that runs of them are few.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _UNBASE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    n = len(data)
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.multiply(data + np.uint64(1), up[:n], out=total[1:])
    np.add.accumulate(total, out=total)
    h = total[gram:] - total[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(h)
    blocks = -(-n // w)
    x = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    x = x.reshape(blocks, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(texts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (key, start, starts in the run, hash of the run's bytes, whether the run
    may repeat itself); a text of under width bytes has none. Equal strings hold their first
    least gram at the same offset, so a run repeats itself only if that gram's place changes
    within the run."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))
    out = [none] * len(texts)
    todo: list[int] = []
    size = 0
    for i, t in enumerate([*texts, b""]):
        if size > 1 << 20 or (i == len(texts) and todo):
            _runs([texts[j] for j in todo], todo, width, out)
            todo, size = [], 0
        if i < len(texts) and len(t) >= width:
            todo.append(i)
            size += len(t)
    return out


def _runs(texts: list[bytes], ids: list[int], width: int, out: list) -> None:
    joined = b"".join(texts)
    h = gram_hashes(np.frombuffer(joined, np.uint8).astype(np.uint64))
    m = sliding_min(h, width - GRAM + 1)
    leaves = h[: len(m)] == m
    leaves[:-1] &= m[1:] == m[:-1]
    view, at, digest = memoryview(joined), 0, xxhash.xxh3_64_intdigest
    for i, t in zip(ids, texts):
        own = m[at : at + len(t) - width + 1]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        count = np.diff(np.r_[start, len(own)])
        lo, hi = (start + at).tolist(), (start + count + (at + width - 1)).tolist()
        whole = np.fromiter((digest(view[a:b]) for a, b in zip(lo, hi)), np.uint64, len(lo))
        left = leaves[at : at + len(own)].copy()
        left[np.r_[start[1:], len(own)] - 1] = False
        out[i] = own[start], start, count, whole, np.logical_or.reduceat(left, start)
        at += len(t)
