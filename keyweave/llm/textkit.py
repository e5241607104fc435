"""Vectorised text primitives over Arrow buffers, shared by the operators of this subpackage.

All of them work on whole texts.  A batch is handled in slices of about ``SLICE_BYTES`` of text, so
that the memory of a worker follows the longest single text and not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import ship

SLICE_BYTES = 1 << 17
#: Where Python objects or frames are many, a slice pays its cost later.
WIDE_SLICE = 1 << 20
#: Rows that Spark hands to a worker at once.
BATCH_ROWS = 512

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, and of words of letters, digits and all that is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers and batches of bounded rows."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, with a number behind each that a column already has: no column of a caller is lost to one of ours."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        free = name
        for n in count(1):
            if free.lower() not in have:
                break
            free = f"{name}_{n}"
        have.add(free.lower())
        out.append(free)
    return out


#: A filter of values has about 16 bits for each, between these powers of two (2 KB to 16 MB); beyond that more pass it than need to.
FILTER_BITS = (14, 27)


class Filter:
    """Which 64-bit values may be among those of a table: a bitmap sized by their number and made by tasks; a value in it always passes."""

    def __init__(self, values: DataFrame, column: str):
        rows = values.select(F.col(column).alias("v"))
        n = rows.count()
        bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n).bit_length()))
        slot = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
        words = rows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
        self.shared = values.sparkSession.sparkContext.broadcast(table.tobytes())

    def passes(self, values: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.shared.value, np.uint64)
        slot = values & (64 * len(table) - 1)
        return table[slot >> 6] >> (slot & 63).astype(np.uint64) & _U(1) > 0


def texts_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null reads as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    size = len(column)
    if not size:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + size + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, rows)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible structure (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([_U(1)], np.full(size, _MULTIPLIER))), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate(([_U(1)], np.full(size, _INVERSE))), dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = the sum of values[j] * M**j for j < i, modulo 2**64."""
    powers, _ = _grown(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, stop) that depend on their content and length alone; for spans of a few hundred values (see ``keyed_hash``)."""
    _, inverses = _grown(len(sums))
    return mix((sums[stop] - sums[start]) * inverses[start] + (stop - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def gram_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of one length, one for each start; comparable among themselves alone."""
    _, inverses = _grown(len(sums))
    out = sums[length:] - sums[:-length]
    out *= inverses[: len(out)]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out ^= out >> _U(shift)
        out *= _U(factor)
    out ^= out >> _U(31)
    return out


_keys = np.ones(1, np.uint64)


def keyed_hash(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the disjoint spans [start, stop), in order: each value times a key of its place in the span.

    The keys are unrelated numbers.  Powers of one number would give strings whose hashes are equal
    whatever that number is (a Thue-Morse string of 1,024 letters and its complement).
    """
    global _keys
    size = stop - start
    longest = int(size.max()) if len(size) else 0
    with np.errstate(over="ignore"):
        if len(_keys) < longest:
            _keys = mix(np.arange(1, max(longest, 1 << 12) + 1, dtype=np.uint64) * _MULTIPLIER) | _U(1)
        total = np.cumsum(size)
        place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
        products = values[np.repeat(start, size) + place] * _keys[place]
        sums = np.zeros(len(products) + 1, np.uint64)
        np.cumsum(products, out=sums[1:])
        return mix(sums[total] - sums[total - size] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of consecutive texts: ``start`` and ``stop`` in bytes, ``of`` (first word of each text, then the end), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, hashed: bool = True):
        lower = LOWER[data]
        inside = kept[lower]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:n]))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
        self.stop = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.lower = lower
        if hashed:
            self.hash = keyed_hash(_BYTE_VALUES[lower], self.start, self.stop)

    def text(self, i: int, j: int) -> str:
        """Words i to j, one blank between."""
        return " ".join(bytes(self.lower[a:b]).decode("utf-8", "replace") for a, b in zip(self.start[i:j].tolist(), self.stop[i:j].tolist(), strict=True))


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``length`` words that stays within a text."""
    total = len(words.start)
    at = np.arange(max(0, total - length + 1))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    end_of = np.repeat(words.of[1:], np.diff(words.of))
    at = at[at + length <= end_of[at]]
    return at, spans_hash(prefix_sums(words.hash), at, at + length)


def shingle_sets(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct runs of ``length`` words of each text; a text of fewer words has its whole sequence as one."""
    at, hashes = windows(words, length)
    rows = np.searchsorted(words.of, at, side="right") - 1
    counts = np.diff(words.of)
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        whole = keyed_hash(words.hash, words.of[short], words.of[short + 1])
        rows, hashes = np.concatenate((rows, short)), np.concatenate((hashes, whole))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return np.searchsorted(rows, np.arange(len(counts) + 1)), hashes


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
