"""Vectorised hashes over the bytes of many texts."""

from __future__ import annotations

import hashlib

import numpy as np

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit number over all its bits (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()  # the tables are made anew where they are needed

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = Powers()


def prefixes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of the bytes (one longer than ``raw``) and the inverse powers.

    The hash of raw[a:b] is (sums[b] - sums[a]) * down[a]: equal bytes, equal hash.
    """
    up, down = _powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(GEAR[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end], each mixed with its length."""
    sums, down = prefixes(raw)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """128-bit digests of raw[start:end], with a number each, as byte strings: for what equality alone decides."""
    view, blake = memoryview(raw), hashlib.blake2b
    if salt is None:
        made = [blake(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    else:
        made = [blake(view[a:b], digest_size=16, salt=x.to_bytes(8, "little")).digest() for a, b, x in zip(start.tolist(), end.tolist(), salt.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), "S16")


def halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of 128-bit digests; they sort and compare faster."""
    both = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


#: Words from this many bytes on are hashed by a digest: long words can be made to collide under a polynomial.
LONG_WORD = 64


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of
    fewer words has one shingle, its whole sequence; one without words has none.
    """
    parts = [t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    word = np.concatenate([[False], raw != 32, [False]])
    change = np.flatnonzero(word[1:] != word[:-1])
    start, end = change[::2], change[1::2]
    bounds = np.cumsum([1] + [len(p) + 1 for p in parts])
    first = np.searchsorted(start, bounds)
    words = spans(raw, start, end)
    if len(long_ := np.flatnonzero(end - start >= LONG_WORD)):
        words[long_] = halves(digests(raw.tobytes(), start[long_], end[long_]))[0]
    out = []
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled = (rolled + words[k : len(words) - size + 1 + k]) * np.uint64(_BASE)
        rolled = mix(rolled)
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = (h + w) * np.uint64(_INVERSE)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(hashes: np.ndarray) -> int:
    """64-bit identity of a set of hashes, as a signed number."""
    total = int(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(hashes) * _BASE
    return int(np.uint64(total & _M64).astype(np.int64))


def in_chunks(sizes: list[int], most: int):
    """Slices of consecutive items whose sizes sum to about ``most``."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))
