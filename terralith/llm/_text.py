"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on whole Arrow batches: texts stay in their UTF-8 buffer and words,
n-grams and windows are found with numpy over bounded slices, so memory does not follow the
size of a batch. Hashes are 64-bit polynomial fingerprints with a mixing finish; two different
strings share one with a chance of about 2^-64.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at a time; arrays of eight bytes a position then stay in the cache.
SLICE = 1 << 17
_rng = np.random.default_rng(20240229)
#: A random odd value for each byte.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_fold = np.arange(256)
_fold[65:91] += 32
#: The same with A-Z taken as a-z.
FOLDED_VALUE = BYTE_VALUE[_fold]
FOLD = _fold.astype(np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Separators of plain words: all of ASCII but letters and digits.
MARKS = np.array([not chr(i).isalnum() for i in range(128)] + [False] * 128)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.empty(size, np.uint64)
        have[0], k, f = 1, 1, base
        while k < size:
            step = min(k, size - k)
            have[k : k + step] = have[:step] * U(f)
            f = f * f % 2**64
            k += step
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; span_hash() reads the fingerprint of any stretch from them."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(BASE_INVERSE, len(h))[start])


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all stretches of k values."""
    n = len(h) - k
    return mix((h[k:] - h[:n]) * powers(BASE_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i+w] for every i."""
    k = 1
    while k * 2 <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: -(w - k)], x[w - k :]) if w > k else x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin and end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of rows whose texts hold about that many bytes, or one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts lying end to end, and each text's first word.

    Words are runs of bytes that the table between doesn't name, [^\\x20\\x09-\\x0D]+ by default. offsets are relative
    to data; the third result has an entry more than there are texts.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, folded: bool, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and end of each word, and each text's first word."""
    starts, ends, first = word_spans(data, offsets, between)
    h = prefix_hash((FOLDED_VALUE if folded else BYTE_VALUE)[data])
    return span_hash(h, starts, ends), starts, ends, first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word or byte, from where the rows begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, beside the next ones of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function of batches that gives memory back when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run):
    """The same for a function of groups."""

    def wrapped(table):
        out = run(table)
        give_back()
        return out

    return wrapped


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table_of(batches, schema: pa.Schema) -> pa.Table:
    """All rows of an iterator of batches under the schema's names."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else schema.empty_table()


def column(table: pa.Table, name: str) -> np.ndarray:
    c = table.column(name)
    return c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)


def crc_part(name: str, modulus: int):
    """crc32 of a column's text modulo a number, in DataFrame terms; a null counts as 0."""
    from pyspark.sql import functions as F

    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")
