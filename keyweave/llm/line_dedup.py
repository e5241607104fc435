"""Line dedup by overlapping windows of three lines.

Windows are three consecutive lines that aren't blank; blank lines between them belong to the window
but not to what is compared.  Of equal windows anywhere in the corpus the first, by document and
position, stays; the lines that any later one covers go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keyweave.cluster import cut, dealt
from keyweave.llm.textkit import Filter, fresh, map_batches

WINDOW_LINES = 3


def _marks(id_column: str, text: str) -> tuple:
    """(id, print) of a row: rows that share id and text are one document; a null id is one of its own."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 62))), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def line_windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lines: int = WINDOW_LINES) -> DataFrame:
    """(__id, __print, first, last, a, b): each window with its first and last line and 128 bits of hash."""
    row_id, mark = _marks(id_column, text)
    rows = docs.select(row_id.alias("__id"), mark.alias("__print"), F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1).alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: x.line.rlike(r"[^ \t\r\f\x0B]"))
    rows = rows.select("__id", "__print", full.alias("full")).where(F.size("full") >= lines)

    def window(i):
        parts = [F.get(F.col("full"), i + k) for k in range(lines)]
        return F.struct(parts[0].at.alias("first"), parts[-1].at.alias("last"), F.xxhash64(*[p.line for p in parts]).alias("a"), F.xxhash64(F.lit("b"), *[p.line for p in reversed(parts)]).alias("b"))

    spans = F.transform(F.sequence(F.lit(0), F.size("full") - lines), window)
    return rows.select("__id", "__print", F.explode(spans).alias("w")).select("__id", "__print", "w.*")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lines: int = WINDOW_LINES) -> DataFrame:
    """(__id, __print, __spans): the line ranges of each document that later windows cover."""
    windows = line_windows(docs, id_column, text, lines)
    place = F.struct("__id", "__print", "first")
    firsts = dealt(windows.groupBy("a", "b").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1"), "a", "b", "n").select("a", "b", "kept")
    later = windows.join(firsts, ["a", "b"]).where(place != F.col("kept"))
    return later.groupBy("__id", "__print").agg(F.collect_set(F.struct("first", "last")).alias("__spans"))


def _without(body: str, spans: list[dict]) -> tuple[str, int]:
    parts = body.split("\n")
    edge = [0] * (len(parts) + 1)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["last"] + 1] -= 1
    kept, depth = [], 0
    for line, e in zip(parts, edge, strict=False):
        depth += e
        if not depth:
            kept.append(line)
    return "\n".join(kept), len(parts) - len(kept)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lines: int = WINDOW_LINES) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated lines, and at the end ``n_lines`` and ``n_removed``.

    Where ``docs`` has columns of these names they stay, and the new ones are called ``n_lines_1`` and
    ``n_removed_1`` (or the next number).  Null and empty texts and those of fewer than three lines stay
    as they are.  Rows that share id and text are one document and keep the same lines.  An empty table
    gives an empty result.  Only the texts of documents that lose lines are shuffled, as far as the
    filter tells them apart.
    """
    spans = cut(repeated_spans(docs, id_column, text, lines))
    touched = Filter(spans, "__print")
    names = docs.columns
    key, mark, ranges = fresh(names, "__id", "__print", "__spans")
    n_lines, n_removed = fresh(names, "n_lines", "n_removed")
    row_id, row_mark = _marks(id_column, text)
    marked = docs.select(*[F.col(f"`{c}`") for c in names], row_id.alias(key), row_mark.alias(mark))
    schema = StructType([*docs.schema.fields, StructField(n_lines, LongType()), StructField(n_removed, LongType())])
    at, width = names.index(text), len(names)

    def done(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        bodies = batch.column(at).to_pylist()
        counts, removed = [(x or "").count("\n") + 1 for x in bodies], [0] * len(bodies)
        columns = [batch.column(i) for i in range(width)]
        for i, s in enumerate(spans):
            if s:
                bodies[i], removed[i] = _without(bodies[i] or "", s)
        if any(removed):
            columns[at] = pa.array(bodies, columns[at].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_lines, n_removed])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~touched.passes(np.asarray(batch.column(width + 1)))))
            yield done(rest, [])

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(touched.passes(np.asarray(batch.column(width + 1)))))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield done(batch, batch.column(width).to_pylist())

    found = spans.select(F.col("__id").alias(key), F.col("__print").alias(mark), F.col("__spans").alias(ranges))
    rows = map_batches(marked, maybe, marked.schema).join(found, [key, mark], "left").select(*[F.col(f"`{c}`") for c in names], ranges)
    return map_batches(marked, untouched, schema).unionByName(map_batches(rows, reduced, schema))
