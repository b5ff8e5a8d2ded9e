"""Character n-gram hashing, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


class _Letters(dict):
    """For str.translate: every character to itself if it is a letter or digit, else to nothing; filled on demand."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if chr(code).isalnum() else None
        return self[code]


_LETTERS = _Letters()


def bare(text: str | None) -> str:
    """Lower-cased letters and digits only."""
    if not text:
        return ""
    t = text.lower()
    return t.encode().translate(None, _ASCII_MARKS).decode() if t.isascii() else t.translate(_LETTERS)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _B
    h = h ^ (h >> np.uint64(29))
    h = h * _A
    return h ^ (h >> np.uint64(32))


def grams(texts: list[str], n: int = 4) -> list[np.ndarray]:
    """The hashes of all runs of n characters of each text, in order (empty for a text shorter than n)."""
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return [np.empty(0, np.uint64) for _ in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        h = h * _A + codes[i : len(codes) - n + 1 + i]
    h = mix(h)
    ends = np.cumsum(sizes)
    return [h[e - s : max(e - n + 1, e - s)] for s, e in zip(sizes.tolist(), ends.tolist())]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(hashes)
    return s[np.append(s[1:] != s[:-1], True)] if len(s) else s


def jaccard(a: str, b: str, n: int = 4) -> float:
    """Shared runs of n characters over all distinct runs of both bare texts; 0 if there are none."""
    x, y = {a[i : i + n] for i in range(len(a) - n + 1)}, {b[i : i + n] for i in range(len(b) - n + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0
