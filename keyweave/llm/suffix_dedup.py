"""Suffix-array dedup: every byte that a repeated string of 200 bytes covers goes.

Only places that can matter reach the suffix sort.  The least of the 32-byte hashes in a 200-byte
window is its anchor; equal windows have equal anchors at equal distances, so a window can only be
repeated if its anchor is.  The windows of one anchor are one stretch of text, its span.  Spans of
equal content, by hash, are added up before they are shuffled by it.

What is repeated is decided by the sorted suffixes alone: neighbours with 200 bytes in common are
repeated windows.  Of a content that stands more than once two places are sorted, those that follow
each other in both texts as one stretch; where all windows of a content turn out repeated there, its
other places, which share 128 bits of hash with it, are as well, and a join carries that to them.
(Should the two places differ, all places of that hash are sorted.)  The contents of an anchor that has more than one go to the shard of that
anchor, one place of each.  No place is in a shard twice.

A task is given a range of anchors and sorts them shard by shard.  An anchor whose contents are more
than SPLIT_BYTES is cut first: each of its spans by a second anchor, the least by another hash, and so
on for LEVELS; what is then still too large is sorted as it is, on disk.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut, dealt
from keyweave.llm.induced import Suffixes, chunks, joined
from keyweave.llm.textkit import _BYTE_VALUES, Filter, batch_of, gram_hashes, map_batches, mix, prefix_sums, slices, spans_hash, texts_of

LENGTH = 200
ANCHOR = 32
#: Bytes of a shard, of all shards of a task, and of an anchor that is not cut further.
SHARD_BYTES, TASK_BYTES, SPLIT_BYTES = 8 << 20, 256 << 20, 32 << 20
LEVELS = 4
#: Tuples that the queues and sorts of a shard hold in memory; shards have more, and the rest is on disk.
MEMORY = 1 << 19
_PIECE = 8 << 20
_PLACE = 24


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash, content hash) of the spans of texts; places within each text."""
    n = len(data)
    width = length - ANCHOR + 1
    windows = n - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(_BYTE_VALUES[data])
    hashes = gram_hashes(sums, ANCHOR)
    if level:
        hashes = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * level % (1 << 64)))
    low = np.uint64((1 << _PLACE) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    # the least of each run of ``width``: the least to the end of one block and from the start of the next
    padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    padded[: len(key)] = key
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, 1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows])
    # windows that end in their text, and where the anchor or the text changes among them
    sizes = np.diff(offsets)
    outside = np.zeros(n + 1, np.int8)
    np.add.at(outside, np.maximum(offsets[1:] - length + 1, offsets[:-1])[sizes > 0], 1)
    np.add.at(outside, offsets[1:][sizes > 0], -1)
    inside = np.cumsum(outside[:windows], dtype=np.int8) == 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    starts = offsets[:-1][(sizes >= length) & (offsets[:-1] < windows)]
    new[starts] = True
    heads = np.flatnonzero(new)
    if not len(heads):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rows = np.searchsorted(offsets, heads, side="right") - 1
    first = heads
    # a span ends before the next one, or with the last window of its text
    last = np.minimum(np.append(heads[1:], windows) - 1, offsets[rows + 1] - length)
    anchor = (least[heads] & low).astype(np.int64)
    content = mix(spans_hash(sums, first, last + length) ^ spans_hash(sums, first, anchor))
    return rows, first - offsets[rows], last - offsets[rows], hashes[anchor], content


def _pieces(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Ranges of rows, or of one long text in pieces that overlap by all but one byte of a window: (first row, row end, shift, bytes)."""
    for a, b in slices(offsets):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= _PIECE or b - a > 1:
            yield a, b, 0, offsets[a : b + 1] - low, data[low:high]
            continue
        # cut within runs of one anchor, a text would show two spans for one; both hold true windows
        for start in range(low, max(low + 1, high - length + 1), _PIECE):
            stop = min(high, start + _PIECE + length - 1)
            yield a, b, start - low, np.array([0, stop - start]), data[start:stop]


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows that share id and text are told apart by nothing and have the same result."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 62))).alias("id"), F.xxhash64(body).alias("print"), body.alias("text"))


_SPANS = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("place", pa.int64()), ("times", pa.int64())])
_SPANS_DDL = "id long, print long, anchor long, content long, place long, times long"


def spans_of(keyed: DataFrame, length: int) -> DataFrame:
    """(id, print, anchor, content, place, times): the spans of each text; place holds first window * 2**24 + windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch)
            ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, _, shift, base, raw in _pieces(offsets, data, length):
                rows, first, last, anchor, content = _anchors(raw, base, length)
                place = (first + shift) << _PLACE | (last - first + 1)
                yield batch_of(_SPANS, id=ids[a + rows], print=prints[a + rows], anchor=anchor.view(np.int64), content=content.view(np.int64), place=place, times=np.ones(len(rows), np.int64))

    return map_batches(keyed, find, _SPANS_DDL)


def _finer(bodies: DataFrame, length: int, level: int) -> DataFrame:
    """The spans of ``bodies`` (anchor, id, print, first, times, body) cut by one anchor more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, ids, prints, starts, times = (np.asarray(batch.column(i)) for i in range(5))
            offsets, data = texts_of(batch.select(["body"]), "body")
            for a, b in slices(offsets):
                rows, first, last, anchor, content = _anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, level)
                own = a + rows
                yield batch_of(_SPANS, id=ids[own], print=prints[own], anchor=mix(anchors[own].view(np.uint64) ^ anchor).view(np.int64), content=content.view(np.int64), place=(starts[own] + first) << _PLACE | (last - first + 1), times=times[own])

    return map_batches(bodies, find, _SPANS_DDL)


def _contents(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, id, print, first, times, body, twin): the bytes of ``wanted`` spans (id, print, anchor, place, times, twin).

    Spans that are twins of others by one anchor, and follow one another, are one body.
    """
    perdoc = wanted.groupBy("id", "print").agg(F.collect_list(F.struct("twin", "anchor", "place", "times")).alias("spans"))
    held = Filter(wanted, "print")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.passes(np.asarray(batch.column(1)))))

    texts = map_batches(keyed, keep, "id long, print long, text string").dropDuplicates(["id", "print"])
    rows = texts.join(perdoc, ["id", "print"]).select("id", "print", "text", "spans")
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("first", pa.int64()), ("times", pa.int64()), ("body", pa.binary()), ("twin", pa.bool_())])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw, found = text.encode(), []
                for s in sorted(spans, key=lambda s: (s["twin"], s["anchor"], s["place"])):
                    first, windows = s["place"] >> _PLACE, s["place"] & ((1 << _PLACE) - 1)
                    if s["twin"] and found and found[-1][0] and found[-1][1] == s["anchor"] and found[-1][3] == first:
                        found[-1][3] = first + windows
                    else:
                        found.append([s["twin"], s["anchor"], first, first + windows, s["times"]])
                yield batch_of(schema, anchor=[x[1] for x in found], id=[i] * len(found), print=[p] * len(found), first=[x[2] for x in found], times=[x[4] for x in found], body=[raw[x[2] : x[3] + length - 1] for x in found], twin=[x[0] for x in found])

    return map_batches(rows, cut_out, "anchor long, id long, print long, first long, times long, body binary, twin boolean")


_RANGES = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_RANGES_DDL = "id long, print long, start long, stop long"


class _Shard:
    """Pieces of text that are sorted together; their bytes go to a file as they come."""

    def __init__(self, length: int):
        self.length, self.bytes = length, 0
        self.ids, self.prints, self.firsts, self.sizes = (array("q") for _ in range(4))

    def add(self, i: int, p: int, first: int, body: bytes) -> np.ndarray:
        for column, value in ((self.ids, i), (self.prints, p), (self.firsts, first), (self.sizes, len(body))):
            column.append(value)
        self.bytes += len(body)
        return np.frombuffer(body, np.uint8)

    def ranges(self, text: np.ndarray, starts: np.ndarray, memory: int) -> Iterator[pa.RecordBatch]:
        """What repeated windows cover; a run may come in parts, which overlap."""
        repeated = Suffixes(text, self.length, memory).repeated()
        ids, prints, firsts, sizes = (np.array(x) for x in (self.ids, self.prints, self.firsts, self.sizes))
        for low, high in chunks(len(repeated)):
            at = np.flatnonzero(repeated[low:high]) + low
            piece = np.searchsorted(starts, at, side="right") - 1
            kept = starts[piece] + sizes[piece] - at >= self.length
            at, piece = at[kept], piece[kept]
            if not len(at):
                continue
            # runs of repeated windows of one piece
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
            heads = np.flatnonzero(new)
            first, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
            who = piece[heads]
            shift = firsts[who] - starts[who]
            yield batch_of(_RANGES, id=ids[who], print=prints[who], start=first + shift, stop=last + shift + self.length)


def _sorted_shards(bodies: DataFrame, tasks: int, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """(id, print, start, stop): what repeated windows cover, from the suffixes of each shard; an anchor is in one shard, twins in shards of their own."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((row[5], row[0]), *row[1:5]) for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)), strict=True))
        row = next(rows, None)
        while row is not None:
            shard = _Shard(length)

            def pieces(shard: _Shard = shard) -> Iterator[np.ndarray]:
                nonlocal row
                while row is not None:
                    anchor = row[0]
                    yield shard.add(*row[1:])
                    row = next(rows, None)
                    if row is not None and row[0] != anchor and (shard.bytes >= shard_bytes or row[0][0] != anchor[0]):
                        return

            yield from shard.ranges(*joined(pieces()), memory)

    return map_batches(bodies.repartition(tasks, "anchor").sortWithinPartitions("twin", "anchor"), sort, _RANGES_DDL)


def repeated_ranges(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, split_bytes: int = SPLIT_BYTES, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """(id, print, ranges): byte ranges that strings of ``length`` bytes cover which also start elsewhere."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    keyed = _keyed(docs, id_column, text)
    start, windows = F.shiftright("place", _PLACE), F.col("place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    spans = spans_of(keyed, length)
    again = dealt(spans.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1"), "anchor", "times").select("anchor")
    spans = cut(spans.join(again, "anchor").select(*_SPANS.names))
    counted, sorted_, size = [], [], 0
    for level in range(1, LEVELS + 1):
        place = F.struct("id", "print", "place")
        contents = cut(spans.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.min(place).alias("one"), F.max(place).alias("two")))
        # a row that stands twice is both places of its contents; at further levels that was seen before
        twice = contents.where("times > 1" if level == 1 else "times > 1 and one <> two")
        counted.append((spans, twice))
        # one key for all contents that stand at the same distance in the same two texts
        pair = F.xxhash64("one.id", "one.print", "two.id", "two.print", F.shiftright("two.place", _PLACE) - F.shiftright("one.place", _PLACE))
        twins = twice.select(pair.alias("anchor"), F.explode(F.array("one", "two")).alias("p")).select("anchor", "p.*", F.lit(2).cast("long").alias("times"), F.lit(True).alias("twin"))
        sorted_.append(twins)
        place_windows = F.col("one.place").bitwiseAND(F.lit((1 << _PLACE) - 1))
        size += twice.agg(F.coalesce(F.sum(place_windows) * 2, F.lit(0)).alias("n")).first().n
        # nothing new comes from an anchor of one content, or where all contents stand twice
        anchors = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.sum(place_windows + length).alias("bytes")).where("kinds > 1 and least = 1")
        anchors = cut(anchors.select("anchor", "bytes", ((F.col("bytes") > split_bytes) & F.lit(level < LEVELS)).alias("hot")))
        wanted = cut(contents.join(anchors, "anchor").select("anchor", "one.*", "times", F.lit(False).alias("twin"), "hot"))
        totals = {r.hot: r.bytes for r in anchors.groupBy("hot").agg(F.sum("bytes").alias("bytes")).collect()}
        if False in totals:
            size += totals[False]
            sorted_.append(wanted.where("not hot").drop("hot"))
        if True not in totals:
            break
        spans = cut(_finer(_contents(keyed, wanted.where("hot").drop("hot"), length), length, level))
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sort(rows: DataFrame, size: int) -> DataFrame:
        return cut(_sorted_shards(_contents(keyed, rows, length), max(partitions, -(-size // TASK_BYTES)), length, shard_bytes, memory))

    names = ["anchor", "id", "print", "place", "times", "twin"]
    ranges = [sort(reduce(DataFrame.unionByName, [x.select(*names) for x in sorted_]), size)]
    for spans, twice in counted:
        told = cut(_told(twice, ranges[0], length))
        whole = spans.join(told.where("repeated").select("anchor", "content"), ["anchor", "content"], "left_semi")
        ranges.append(whole.select("id", "print", start.alias("start"), (start + windows + length - 1).alias("stop")))
        unlike = spans.join(told.where("not repeated").select("anchor", "content"), ["anchor", "content"], "left_semi")
        if not told.where("not repeated").isEmpty():
            ranges.append(sort(unlike.select("anchor", "id", "print", "place", "times", F.lit(False).alias("twin")), 0))
    return reduce(DataFrame.unionByName, ranges).groupBy("id", "print").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _told(twice: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(anchor, content, repeated): whether all windows of a content's first place are among the repeated ones."""
    mine = twice.groupBy("one.id", "one.print").agg(F.collect_list(F.struct("anchor", "content", "one.place")).alias("spans"))
    held = ranges.groupBy("id", "print").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("repeated", pa.bool_())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for r in sorted(found or [], key=lambda r: r["start"]):
                    first, last = r["start"], r["stop"] - length
                    if runs and first <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], last)
                    else:
                        runs.append([first, last])
                begins = np.array([r[0] for r in runs], np.int64)
                ends = np.array([r[1] for r in runs], np.int64)
                place = np.array([s["place"] for s in spans], np.int64)
                first = place >> _PLACE
                last = first + (place & ((1 << _PLACE) - 1)) - 1
                at = np.searchsorted(begins, first, side="right") - 1
                repeated = (at >= 0) & (last <= ends[at]) if len(runs) else np.zeros(len(spans), bool)
                yield batch_of(schema, anchor=[s["anchor"] for s in spans], content=[s["content"] for s in spans], repeated=repeated)

    return map_batches(mine.join(held, ["id", "print"], "left").select("spans", "ranges"), tell, "anchor long, content long, repeated boolean")


def _kept(raw: bytes, ranges: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    out, at = [], 0
    for a, b in merged:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), merged


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, with_spans: bool = False, **limits: int) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``spans`` and ``kept`` if asked.

    ``limits`` are those of ``repeated_ranges``; they change nothing in the result.

    Strings are judged on the input as it is, every place of a repeated one goes, and matches never
    cross documents.  Null and empty texts have no bytes; repeated rows remove each other where they
    have ``length`` bytes; rows without an id take part.  What is kept may end inside a character, so
    it is binary.
    """
    keyed = _keyed(docs, id_column, text)
    ranges = cut(repeated_ranges(docs, id_column, text, length, **limits))
    held = Filter(ranges, "print")
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_spans:
        fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]
        ddl += ", spans array<struct<start: long, stop: long>>, kept binary"
    schema = pa.schema(fields)

    def digest(ids, texts, ranges) -> pa.RecordBatch:
        raw = [x.encode() for x in texts]
        done = [_kept(x, r or []) for x, r in zip(raw, ranges, strict=True)]
        more = {"spans": [[{"start": a, "stop": b} for a, b in m] for _, m in done], "kept": [k for k, _ in done]} if with_spans else {}
        return batch_of(schema, id=ids, n_bytes=[len(x) for x in raw], n_removed=[len(x) - len(k) for x, (k, _) in zip(raw, done, strict=True)], n_spans=[len(m) for _, m in done], kept_sha256=[hashlib.sha256(k).hexdigest() for k, _ in done], **more)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~held.passes(np.asarray(batch.column(1)))))
            yield digest(rest.column(0), rest.column(2).to_pylist(), [None] * rest.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.passes(np.asarray(batch.column(1)))))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield digest(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    touched = map_batches(keyed, maybe, "id long, print long, text string").join(ranges, ["id", "print"], "left").select("id", "text", "ranges")
    rows = map_batches(keyed, untouched, ddl).unionByName(map_batches(touched, reduced, ddl))
    return rows.select(F.when(F.col("id") != -(1 << 62), F.col("id")).alias("doc_id"), *[c for c in rows.columns if c != "id"])
