"""Bounded pieces of Arrow text, hashes of byte slices, and per-document sums, shared by the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# kernels travel with the tasks that call them: executors need numpy and pyarrow but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
PRIME = (1 << 61) - 1
_LOW = np.uint64((1 << 31) - 1)
_ROLL = 0x9E3779B97F4A7C15
#: slices beyond this many bytes are summed in parts, so that no sum passes 64 bits
_LONGEST = 1 << 23
#: bytes that are hashed at once
_STRETCH = 1 << 15


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for tables that are costly to build."""
    module = sys.modules.setdefault("_voltlane_llm_store", types.ModuleType("_voltlane_llm_store"))
    return module.__dict__.setdefault(name, {})


def pieces(batches: Iterator[pa.RecordBatch], size: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in column ``size`` each; one longer row makes its own slice."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(size))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        ends, begin = np.cumsum(lengths), 0
        while begin < len(lengths):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other (null: none), and the ``n + 1`` offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of ``flat`` for binary columns."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime 2**61 - 1, by halves of 31 bits, as 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a1 * b0 + a0 * b1
    whole = ((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    return _reduced(whole)


def _base(which: int) -> int:
    from hashlib import sha256

    return int.from_bytes(sha256(f"slices {which}".encode()).digest()[:8], "big") % (PRIME - 2) + 2


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo the prime."""
    store = worker_store("powers")
    have = store.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(n, 1 << 16), []
        for base in (_base(which), pow(_base(which), -1, PRIME)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, times(table, np.full(1, pow(base, len(table), PRIME), np.uint64))])
            out.append(table)
        store[which] = have = tuple(out)
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums of a polynomial in the bytes, in two halves of its coefficients, for ``slice_hash``."""
    total = np.zeros((2, len(data) + 1), np.uint64)
    powers, digits = _powers(len(data) + 1, which)[0][: len(data)], data.astype(np.uint64)
    digits += np.uint64(1)
    np.cumsum(digits * (powers & _LOW), out=total[0, 1:])
    np.cumsum(digits * (powers >> np.uint64(31)), out=total[1, 1:])
    return total


def token_prefix(tokens: np.ndarray) -> np.ndarray:
    """The same over 64-bit tokens instead of bytes."""
    total = np.zeros((2, len(tokens) + 1), np.uint64)
    terms = times(_reduced(tokens), _powers(len(tokens) + 1, 0)[0][: len(tokens)])
    np.cumsum(terms & _LOW, out=total[0, 1:])
    np.cumsum(terms >> np.uint64(31), out=total[1, 1:])
    return total


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the slices ``[start, end)``: a polynomial modulo 2**61 - 1, equal for equal bytes wherever they stand.

    Two different slices of n bytes agree for n of 2**61 bases.
    """
    starts, ends = np.asarray(starts), np.asarray(ends)
    value, begin = np.zeros(len(starts), np.uint64), starts
    for _ in range(max(1, -(-int((ends - starts).max(initial=0)) // _LONGEST))):
        stop = np.minimum(ends, begin + _LONGEST)
        low, high = (_reduced(part[stop] - part[begin]) for part in prefix)
        value = _reduced(value + _reduced(low + times(high, np.full(1, 1 << 31, np.uint64))))
        begin = stop
    return mix(times(value, _powers(prefix.shape[1], which)[1][starts]))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether slices of ``data`` have the bytes of slices of ``other``, compared in parts of about 1 MB."""
    lengths = ends - starts
    same = lengths == other_ends - other_starts
    todo = np.flatnonzero(same & ((starts != other_starts) | (data is not other)) & (lengths > 0))
    for i in todo[lengths[todo] > PIECE_BYTES]:
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    todo = todo[lengths[todo] <= PIECE_BYTES]
    upto = np.concatenate([[0], np.cumsum(lengths[todo])])
    for at in range(0, int(upto[-1]), PIECE_BYTES):
        part = todo[np.searchsorted(upto[:-1], at) : np.searchsorted(upto[:-1], at + PIECE_BYTES)]
        size = lengths[part]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        differ = data[np.repeat(starts[part], size) + place] != other[np.repeat(other_starts[part], size) + place]
        if differ.any():
            same[part[np.repeat(np.arange(len(part)), size)[differ]]] = False
    return same


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One slice of each content, its 64-bit key in ascending order, and which of them every slice equals.

    Slices with one key are compared byte by byte; should two of them differ, another base is taken.
    """
    which = 0
    while True:
        keys, first, inverse = np.unique(slice_hash(prefix_hash(data, which), starts, ends, which), return_index=True, return_inverse=True)
        if same_bytes(data, starts, ends, data, starts[first[inverse]], ends[first[inverse]]).all():
            return first, keys, inverse
        which += 1


def rolling_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of every window of ``size`` bytes, to choose among windows by; it doesn't stand for their content.

    A polynomial in the bytes modulo 2**64, put together from windows of half the size, in stretches that stay in the processor's cache.
    """
    n = max(len(data) - size + 1, 0)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _STRETCH):
        part, width = data[a : a + _STRETCH + size - 1].astype(np.uint64), 1
        part += np.uint64(1)
        done, whole = 0, None
        while True:
            if size & width:  # the window's next ``width`` bytes
                ahead = part[done : done + min(n - a, _STRETCH)] * np.uint64(pow(_ROLL, done, 1 << 64))
                whole, done = ahead if whole is None else whole + ahead, done + width
            if done == size:
                break
            part = part[: len(part) - width] + part[width:] * np.uint64(pow(_ROLL, width, 1 << 64))
            width *= 2
        out[a : a + _STRETCH] = mix(whole)
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without space and control separators); none crosses a document."""
    gap = np.zeros(256, bool)
    gap[[0x20, *range(9, 14)]] = True
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def count_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_sha256(payloads: list[bytes]) -> list[str]:
    from hashlib import sha256

    return [sha256(p).hexdigest() for p in payloads]


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def size_hint(df: DataFrame, column: str = "text") -> int:
    """Bytes of the plan's input as the planner knows them from its files; where it doesn't, those of ``column``, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 52:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts_for(df: DataFrame, target: int, least: int = 1) -> int:
    """Number of partitions that hold about ``target`` bytes each; follows the input size without a bound."""
    return max(least, -(-size_hint(df) // target))
