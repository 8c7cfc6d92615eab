"""Sets of word shingles of whole texts, as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_AT_ONCE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_ODD, _AT_ONCE + 1), _powers(pow(_ODD, -1, 2**64), _AT_ONCE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of at most _AT_ONCE bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_SPACE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _BACK[starts] + (ends - starts).astype(np.uint64))


#: ASCII marks to spaces.
_MARKS = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c for c in range(256))


def words(texts: list[str | None], marks: bool = True) -> list[np.ndarray]:
    """Hashes of the words of each text: runs of bytes other than space and 9 to 13, A-Z in lower case.

    Without ``marks``, ASCII marks end words too and are no part of any.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        nonlocal size
        if group:
            starts, h = _hashes(b" ".join(group))
            cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group]))
            out.extend(np.split(h, cuts[:-1]))
            group.clear()
            size = 0

    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        raw = raw if marks else raw.translate(_MARKS)
        if size + len(raw) + 1 > _AT_ONCE:
            flush()
        if len(raw) >= _AT_ONCE:
            out.append(_long(raw))
        else:
            group.append(raw)
            size += len(raw) + 1
    flush()
    return out


def _long(raw: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + _AT_ONCE)
        if to < len(raw):
            cut = max(raw.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:  # one word longer than a part
                end = min((x for x in (raw.find(c, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=len(raw))
                word = raw[at:end].strip()
                parts.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64) if word else np.zeros(0, np.uint64))
                at = end
                continue
            to = cut
        parts.append(_hashes(raw[at:to])[1])
        at = to
    return np.concatenate(parts)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all shingles of ``k`` words, in order; of the whole sequence where there are fewer words; none without words."""
    if not len(h):
        return h
    width = min(k, len(h))
    n, total = len(h) - width + 1, np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        total += h[j : j + n] * _PLACE[j]
    return mix(total + np.uint64(width if width < k else 0))


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(shingles(h, k)) for h in words(texts)]


def set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two numbers."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
