"""Vectorised text features over batches of whole texts (numpy, no per-word Python).

A batch of texts is one UTF-8 byte buffer.  Words are maximal runs of bytes
outside ``\\x20 \\x09-\\x0D`` (all separators are ASCII, so byte runs and code-point
runs agree).  A span's hash is its polynomial hash modulo 2**64, read off a
prefix sum, then mixed; equal spans have equal hashes wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that can't be part of a lower-cased letter run (all of UTF-8 beyond ASCII can).
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False

_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept, as they never change)."""
    if len(_powers["p"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("p", _BASE), ("q", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    if n > 4 * CHUNK_BYTES:  # one very long text must not enlarge the worker for good
        p, q = _powers["p"][:n], _powers["q"][:n]
        _powers.update(p=p[: CHUNK_BYTES + 4096].copy(), q=q[: CHUNK_BYTES + 4096].copy())
        return p, q
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Batch:
    """Some texts as one byte buffer with their words.

    ``doc`` has the text of each word, ``starts``/``ends`` its bytes; ``n`` texts.
    A null text is an empty one.  ``sep`` marks the separating bytes.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, sep: np.ndarray = SPACE):
        raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.n = len(raw)
        sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, self.n)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        space = sep[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.buf) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.at, self.starts, side="right") - 1

    def prefix(self) -> np.ndarray:
        p, _ = _power(len(self.buf) + 1)
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans."""
        s = self.prefix() if prefix is None else prefix
        _, q = _power(len(self.buf) + 1)
        return mix((s[ends] - s[starts]) * q[starts] + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k consecutive words of one text, in order."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(_BASE) + h[i : n + i]
    same = doc[:n] == doc[k - 1 :]
    return mix(acc[same]), doc[:n][same]


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive runs of texts of about ``limit`` characters, each with its first position."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def gram_codes(symbols: np.ndarray, space: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, valid) of the n symbols from each position on; n * bits <= 64, so codes are exact.

    A gram may begin or end with a space, which marks a word's edge, but has none inside.
    """
    m = len(symbols) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    code = symbols[:m].astype(np.uint64)
    valid = np.ones(m, bool)
    for j in range(1, n):
        code = code | (symbols[j : m + j].astype(np.uint64) << np.uint64(bits * j))
        if j < n - 1:
            valid &= ~space[j : m + j]
    return code, valid


def bucket(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Multiply-shift hash of codes to ``bits`` bits; n salts the gram length."""
    return ((code + np.uint64(n)) * np.uint64(_BASE) ^ np.uint64(n * 0x2545F4914F6CDD1D & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)
