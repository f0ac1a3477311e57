"""Words of notes: counting in SQL, and splitting and hashing in numpy for whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed: a word is a longest run without space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def is_space(raw: np.ndarray) -> np.ndarray:
    return _IS_SPACE[raw]


_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number: it has an inverse modulo 2**64
_WORD_BASE = np.uint64(0xD1342543DE82EF95)


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_share(key: str | Column) -> Column:
    """A number from 0 to 1 that depends on the key alone, even over all keys: a seeded draw without sorting."""
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 32)) / F.lit(float(1 << 32))


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column is called so, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_id(columns: list[str]) -> Column:
    """128 hash bits of all columns of a row as text, NULL told from empty; equal rows have equal ones."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    flags = [t.isNull() for t in text]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *flags, *text)), 16, "0") for seed in (1, 2)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse, grown on demand, one pair per process."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(
                np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row boundaries; NULL is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def split_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every row the index of its first word (one more at the end)."""
    inside = ~_IS_SPACE[raw]
    # a word also ends where its row ends
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _byte_powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def hash_runs(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of `length` consecutive word hashes."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _word_powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix64((sums[length:] - sums[:n - length + 1]) * down[:n - length + 1])


def slices(texts: pa.Array, keys: pa.Array, size: int = 4 << 20):
    """Cuts columns into row ranges of about `size` bytes, so that numpy work stays small.

    A single text above the size is a range of its own.
    """
    lengths = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield texts.slice(at, to - at), keys.slice(at, to - at)
        at = to
