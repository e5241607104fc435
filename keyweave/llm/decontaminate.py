"""Benchmark decontamination: test n-grams as a hash set on every worker, document windows against it.

A window is ``length`` consecutive words of a benchmark item; an item of fewer words is one window.
The hash set is broadcast only while it has at most ``BROADCAST_WINDOWS`` windows; beyond that the
windows of the documents meet those of the benchmark in a join.  Hits are verified by their words, and
both ways give the same rows and can remove documents or spans alike.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut
from keyweave.llm.textkit import ALNUM, Filter, Words, batch_of, fresh, map_batches, prefix_sums, slices, spans_hash, texts_of

WINDOW_WORDS = 13
#: About 200 bytes each on the driver and on each worker.
BROADCAST_WINDOWS = 500_000

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _length_windows(words: Words, length: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(max(0, len(words.start) - length + 1))
    if len(at):
        at = at[at + length <= np.repeat(words.of[1:], np.diff(words.of))[at]]
    return at, spans_hash(sums, at, at + length)


def benchmark_windows(benchmark: DataFrame, length: int = WINDOW_WORDS, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, words, hash, item): distinct windows of the items, their words joined by blanks; item is null where it has no id."""
    schema = pa.schema([("window", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("item", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch)
            items = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                sums = prefix_sums(words.hash)
                at, hashes = _length_windows(words, length, sums)
                rows = np.searchsorted(words.of, at, side="right") - 1
                counts = np.diff(words.of)
                short = np.flatnonzero((counts > 0) & (counts < length))
                sizes = np.concatenate((np.full(len(at), length), counts[short]))
                hashes = np.concatenate((hashes, spans_hash(sums, words.of[short], words.of[short + 1])))
                at, rows = np.concatenate((at, words.of[short])), np.concatenate((rows, short))
                yield batch_of(schema, window=[words.text(i, i + n) for i, n in zip(at.tolist(), sizes.tolist(), strict=True)], words=sizes.astype(np.int32), hash=hashes.view(np.int64), item=[items[a + r] for r in rows.tolist()])

    return map_batches(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")), cut, "window string, words int, hash long, item string").distinct()


class WindowSet:
    """Windows by hash, with a bit table in front that answers most questions."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, int, str | None]]):
        self.items: dict[str, list[str | None]] = {}
        hashes = set()
        for window, words, h, item in rows:
            self.items.setdefault(window, []).append(item)
            hashes.add((words, h))
        self.lengths = sorted({n for n, _ in hashes})
        self.hashes = {n: np.array(sorted(h & (1 << 64) - 1 for m, h in hashes if m == n), np.uint64) for n in self.lengths}
        self.front = {n: np.zeros(1 << self.BITS, bool) for n in self.lengths}
        for n in self.lengths:
            self.front[n][(self.hashes[n] & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of each window that occurs."""
        sums = prefix_sums(words.hash)
        for n in self.lengths:
            at, h = _length_windows(words, n, sums)
            maybe = np.flatnonzero(self.front[n][(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            known = self.hashes[n]
            maybe = maybe[known[np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)] == h[maybe]]
            for i in at[maybe].tolist():
                if found := self.items.get(words.text(i, i + n)):
                    yield i, n, found


def _judge(windows: WindowSet, words: Words) -> tuple[np.ndarray, np.ndarray, list[set[str | None]], np.ndarray]:
    """(words, hit words, items) of each text and the hit words themselves."""
    counts = np.diff(words.of)
    edge = np.zeros(len(words.start) + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in counts]
    for i, n, found in windows.find(words):
        edge[i] += 1
        edge[i + n] -= 1
        items[int(np.searchsorted(words.of, i, side="right")) - 1].update(found)
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    return counts, total[words.of[1:]] - total[words.of[:-1]], items, hit


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()


def contaminated(n_words, n_hit):
    """Fixed rule: any word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


_built: dict[str, WindowSet] = {}


class _Shared:
    """The broadcast windows; a worker builds their set once, whatever the number of its tasks."""

    def __init__(self, spark, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.key, self.packed = uuid.uuid4().hex, spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def windows(self) -> WindowSet:
        if self.key not in _built:
            _built.clear()
            columns = pa.ipc.open_stream(self.packed.value).read_all().to_pydict()
            _built[self.key] = WindowSet(list(zip(*(columns[c] for c in ("window", "words", "hash", "item")), strict=True)))
        return _built[self.key]


def _set_of(windows: DataFrame, limit: int) -> _Shared | None:
    """The broadcast set, or None if it has too many windows for that."""
    table = windows.limit(limit + 1).toArrow()
    return _Shared(windows.sparkSession, table) if table.num_rows <= limit else None


def _parts(batch: pa.RecordBatch, text: str, limit: int = 1 << 17) -> Iterator[tuple[int, int, Words]]:
    offsets, data = texts_of(batch, text)
    for a, b in slices(offsets, limit):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)


def scan(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS, broadcast_windows: int = BROADCAST_WINDOWS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: words, hit words, items that occur, and the verdict.

    Null and empty texts have no words and are clean; so are all documents where the benchmark is
    empty or its texts are null.  Equal items count each; repeated rows are judged one by one.  Items
    without an id hit like all others; together they count as one item, which the digest leaves out.
    Other columns aren't read, so their names can't clash.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    windows = benchmark_windows(benchmark, length)
    if (shared := _set_of(windows, broadcast_windows)) is None:
        return _scan_by_join(narrow, windows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.windows()
        for batch in batches:
            for a, b, words in _parts(batch, "text"):
                n_words, n_hit, items, _ = _judge(known, words)
                yield batch_of(_RESULT, doc_id=batch.column(0).slice(a, b - a), n_words=n_words, n_hit=n_hit, n_items=[len(x) for x in items], items_sha256=[_digest(x) for x in items], contaminated=contaminated(n_words, n_hit))

    return map_batches(narrow, judge, _DDL)


def _mark(text: str) -> tuple:
    """128 bits of a text: its windows are known by them, so that a task that runs again finds the same."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits_by_join(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """(k, l, n_words, n_hit, n_items, items, spans) of each different text that holds a window, for a benchmark of any size.

    Only windows that the filter lets pass are shuffled; they meet the benchmark's by hash and words.
    """
    windows = cut(windows)
    lengths = [r.words for r in windows.select("words").distinct().collect()]  # ``length`` at most
    near = Filter(windows, "hash")
    k, l = _mark(text)  # noqa: E741
    schema = pa.schema([("k", pa.int64()), ("l", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("words", pa.int32()), ("hash", pa.int64()), ("window", pa.string())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _parts(batch, "text", 1 << 16):
                sums, counts = prefix_sums(words.hash), np.diff(words.of)
                ks, ls = (np.asarray(batch.column(i))[a:b] for i in (0, 1))
                for n in lengths:
                    at, h = _length_windows(words, n, sums)
                    kept = near.passes(h.view(np.int64))
                    at, h = at[kept], h[kept]
                    of = np.searchsorted(words.of, at, side="right") - 1
                    if len(at):
                        yield batch_of(schema, k=ks[of], l=ls[of], n_words=counts[of], at=at - words.of[of], words=np.full(len(at), n, np.int32), hash=h.view(np.int64), window=[words.text(i, i + n) for i in at.tolist()])

    rows = map_batches(docs.select(k.alias("k"), l.alias("l"), F.col(text).cast("string").alias("text")), explode, "k long, l long, n_words long, at long, words int, hash long, window string")
    hits = rows.join(windows, ["words", "hash", "window"]).select("k", "l", "n_words", "at", "words", "item")
    places = hits.groupBy("k", "l").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("at", "words")).alias("spans"))
    merged_schema = pa.schema([("k", pa.int64()), ("l", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged((s["at"], s["at"] + s["words"]) for s in x) for x in batch.column(3).to_pylist()]
            yield batch_of(merged_schema, k=batch.column(0), l=batch.column(1), n_words=batch.column(2), n_hit=[sum(b - a for a, b in x) for x in spans], spans=[[{"start": a, "stop": b} for a, b in x] for x in spans])

    merged = map_batches(places, merge, "k long, l long, n_words long, n_hit long, spans array<struct<start: long, stop: long>>")
    items = hits.select("k", "l", "item").distinct().groupBy("k", "l").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
    return cut(merged.join(items, ["k", "l"]).select("k", "l", "n_words", "n_hit", "n_items", "items", "spans"))


def _scan_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("l", pa.int64()), ("n_words", pa.int64())])
    hits = _hits_by_join(docs, windows, "text").drop("n_words", "spans")
    k, l = _mark("text")  # noqa: E741

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _parts(batch, "text"):
                yield batch_of(schema, n_words=np.diff(words.of), **{c: batch.column(i).slice(a, b - a) for i, c in enumerate(("doc_id", "k", "l"))})

    rows = map_batches(docs.select("doc_id", k.alias("k"), l.alias("l"), "text"), count, "doc_id long, k long, l long, n_words long").join(hits, ["k", "l"], "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_items"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), n_hit).alias("contaminated"))


def _without(text: str, words: Words, spans) -> str:
    """``text``, which is all that ``words`` holds, without the words in ``spans``; what stands between words stays."""
    raw = text.encode()
    keep = np.ones(len(raw), bool)
    for start, stop in spans:
        for a, b in zip(words.start[start:stop].tolist(), words.stop[start:stop].tolist(), strict=True):
            keep[a:b] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "replace")


def _words_of(text: str) -> Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM, hashed=False)


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", length: int = WINDOW_WORDS, broadcast_windows: int = BROADCAST_WINDOWS, text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``what="spans"``) with the hit words of those cut out of their texts.

    Documents under the rule's bound keep their texts as they are, null and empty ones too.  Repeated
    rows share their fate.  All columns stay, whatever their names.
    """
    if what not in ("documents", "spans"):
        raise ValueError(f"what is {what!r}, not documents or spans")
    windows = benchmark_windows(benchmark, length)
    if (shared := _set_of(windows, broadcast_windows)) is None:
        return _remove_by_join(docs, windows, what, text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.windows()
        for batch in batches:
            for a, b, words in _parts(batch, text):
                n_words, n_hit, _, hit = _judge(known, words)
                bad = contaminated(n_words, n_hit)
                part = batch.slice(a, b - a)
                if what == "documents" or not bad.any():
                    yield part.filter(pa.array(~bad))
                    continue
                at = part.schema.get_field_index(text)
                texts = part.column(at).to_pylist()
                for r in np.flatnonzero(bad).tolist():
                    mine = np.flatnonzero(np.diff(np.concatenate(([False], hit[words.of[r] : words.of[r + 1]], [False])).astype(np.int8)))
                    texts[r] = _without(texts[r], _words_of(texts[r]), zip(mine[::2].tolist(), mine[1::2].tolist(), strict=True))
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return map_batches(docs, clean, docs.schema)


def _remove_by_join(docs: DataFrame, windows: DataFrame, what: str, text: str) -> DataFrame:
    names = docs.columns
    key, other, spans = fresh(names, "__k", "__l", "__spans")
    k, l = _mark(text)  # noqa: E741
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], k.alias(key), l.alias(other))
    bad = _hits_by_join(docs, windows, text).where(contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("k").alias(key), F.col("l").alias(other), F.col("spans").alias(spans))
    if what == "documents":
        return keyed.join(bad, [key, other], "left_anti").select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i, ranges in enumerate(found):
                if ranges:
                    texts[i] = _without(texts[i], _words_of(texts[i]), [(r["start"], r["stop"]) for r in ranges])
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(keyed.join(bad, [key, other], "left").select(*[F.col(f"`{c}`") for c in names], spans), clean, docs.schema)
