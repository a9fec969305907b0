"""Words, hashes and n-grams of many texts at once, as numpy arrays.

A batch of texts becomes one byte array; a word's hash is a difference of
prefix sums of a polynomial, so no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}
_odd = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)

#: Bytes up to which texts are handled together; one longer text is a batch of its own.
BATCH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~_SPACE
LETTER_DIGIT = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    LETTER_DIGIT[_a:_b] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n-1 modulo 2 ** 64."""
    if len(have := _tables.get(base, ())) < n:
        full = np.full(max(n, BATCH_BYTES * 2), base, U)
        full[0] = 1
        have = _tables[base] = np.cumprod(full, dtype=U)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x + U(salt * _BASE & (1 << 64) - 1)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def as_bytes(text: str | None, lower: str = "") -> bytes:
    """UTF-8 (null: empty); lower: "" none, "ascii" A-Z, "all" every letter."""
    if not text:
        return b""
    if lower == "all":
        text = text.lower()
    data = text.encode("utf-8", "surrogatepass")
    return data.translate(_LOWER) if lower == "ascii" else data


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal byte strings, wherever they stand in the batch."""
    inverse = powers(len(sums), _INVERSE)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * _odd[63])


class Words:
    """The words of a batch of texts: byte spans, hashes, and the text that each belongs to."""

    def __init__(self, texts: list[bytes], member: np.ndarray = NOT_SPACE):
        self.n = len(texts)
        joined = b"\n".join(texts)
        self.data = data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        inside = np.zeros(len(data) + 2, bool)
        if len(data):
            inside[1:-1] = member[data]
        self.start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        first = np.searchsorted(self.start, self.begin)
        self.counts = np.diff(np.append(first, len(self.start)))
        self.first = first
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self.hash = span_hashes(prefix_sums(data), self.start, self.end)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words within one text."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        total = np.zeros(len(at), U)
        for k in range(size):
            total += self.hash[at + k] * _odd[k]
        return at, mix(total)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each distinct shingle; a text of fewer words has its whole sequence as one."""
        at, gram = self.grams(size)
        doc = self.doc[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            total = np.zeros(len(short), U)
            for k in range(size - 1):
                has = self.counts[short] > k
                total[has] += self.hash[self.first[short[has]] + k] * _odd[k]
            doc, gram = np.append(doc, short), np.append(gram, mix(total + self.counts[short].astype(U)))
        _, one = np.unique(mix(gram ^ mix(doc.astype(U), 7)), return_index=True)
        one = one[np.argsort(doc[one], kind="stable")]
        return doc[one], gram[one]


def batches(values: Iterable, size) -> Iterator[list]:
    """Lists of values whose sizes together stay within BATCH_BYTES, if one alone does."""
    out, total = [], 0
    for x in values:
        n = size(x)
        if out and total + n > BATCH_BYTES:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out
