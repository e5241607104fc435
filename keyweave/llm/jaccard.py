"""N-gram Jaccard join with a count-vector R-tree.

A text's set is its distinct runs of five words.  The members of a set are hashed into groups and the
number in each group is a coordinate; two sets can't share more than the sum of the smaller
coordinates.  An R-tree over these points bounds a whole node by its upper corner, so nodes that can't
hold a partner are passed over; pairs that survive are verified on the sets themselves.

Texts of equal sets are one class.  Classes meet in blocks: of the n members of a set, the
n - ceil(0.8 n) + 1 rarest ones (by a count over the whole corpus, then by hash) must hold one that a
partner also has among its own.  Blocks with the same classes are looked at once.  The class that
shares most is the middle of its block, and blocks with the same middle make one cluster.

The points of a cluster are sorted by size and place and packed into tiles of TILE, the lower nodes of
its R-tree; the sort is a range partitioning, so no task holds a cluster.  Tiles whose corners can't
share enough are never opened together, and only those that can be are copied to each other.  In a
pair of tiles the tree goes on to single points, and what it leaves is verified on the sets.

Where only the components are asked for, a pair of one component needn't be verified: tiles are first
held against themselves and the first tile of their cluster, then only pairs of tiles with more than
one component between them are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut, dealt
from keyweave.llm.graph import components
from keyweave.llm.textkit import NOT_SPACE, Filter, Words, batch_of, fresh, map_batches, mix, shingle_sets, slices, texts_of

SHINGLE_WORDS = 5
#: The threshold is PERCENT / 100 of the union.
PERCENT = 80
#: Cells of the corpus-wide count that orders shingles, as powers of two: about one for each document, 2 to 32 MB.
CELL_BITS = (18, 22)
GROUPS, MOST_GROUPS = 64, 4096
TILE = 256
LEAF, FANOUT = 16, 8
_FULL = 0xFFFF
_U = np.uint64


def _need(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which two sets of these sizes are linked."""
    return -(-percent * (nx + ny) // (100 + percent))


def _parts(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = texts_of(batch)
    for a, b in slices(offsets):
        yield a, b, *shingle_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_SPACE), words)


def _fingerprints(at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order."""
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members ^ _U(seed)), dtype=np.uint64)))
        out.append(mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def groups_of(n: int) -> int:
    """Coordinates of a set of n: about eight members each, a power of two."""
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, (n // 8).bit_length())))


def count_vector(members: np.ndarray) -> bytes:
    """Members in each group as 16-bit counts; a full count stands for any larger one."""
    size = groups_of(len(members))
    return np.minimum(np.bincount((mix(members) & _U(size - 1)).astype(np.int64), minlength=size), _FULL).astype("<u2").tobytes()


def folded(vector: np.ndarray, size: int) -> np.ndarray:
    """The same point with fewer coordinates."""
    return np.minimum(vector.reshape(-1, size).sum(0), _FULL)


def bound(x: np.ndarray, y: np.ndarray) -> int:
    """No two sets with these points share more."""
    size = min(len(x), len(y))
    low = np.minimum(folded(x, size), folded(y, size))
    return 1 << 60 if (low >= _FULL).any() else int(low.sum())


class RTree:
    """A packed R-tree over count vectors: upper corners and size ranges of leaves, and of nodes above them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # neighbours in a leaf are alike in size, then in the groups that vary most
        spread = points.var(0).argsort()[-8:]
        self.order = np.lexsort((*(points[:, g] for g in spread), sizes * 8 // max(1, int(sizes.max(initial=1)))))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        upper, low, high = self.points, self.sizes, self.sizes
        for width in (LEAF, FANOUT):
            edges = np.arange(0, len(upper), width)
            upper, low, high = np.maximum.reduceat(upper, edges, 0), np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
            self.levels.append((upper, low, high, width))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose bound and size allow a link."""
        found = np.arange(len(self.levels[-1][0]))
        for level, (upper, low, high, width) in enumerate(reversed(self.levels)):
            able = self._able(point, size, upper[found], low[found], high[found], percent)
            below = self.levels[len(self.levels) - 2 - level][0] if level + 1 < len(self.levels) else self.points
            found = (found[able][:, None] * width + np.arange(width)).ravel()
            found = found[found < len(below)]
        able = self._able(point, size, self.points[found], self.sizes[found], self.sizes[found], percent)
        return self.order[found[able]]

    @staticmethod
    def _able(point, size, upper, low, high, percent):
        least = np.minimum(point, upper)
        best = np.where((least >= _FULL).any(1), 1 << 60, least.sum(1)) if len(upper) else np.zeros(0)
        return (best >= _need(low, size, percent)) & (percent * low <= 100 * size) & (percent * size <= 100 * high)


def _summaries(docs: DataFrame, words: int, size: int) -> DataFrame:
    """One row per document row (128 bits of the text, n, 128 bits of the set, point), and this task's counts of shingle cells as more rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("l", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("times", pa.int64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.int64)
        for batch in batches:
            for low, high, at, members in _parts(batch, words):
                np.add.at(cells, (members & _U(size - 1)).astype(np.int64), 1)
                a, b = _fingerprints(at, members)
                edges = at.tolist()
                yield batch_of(schema, doc_id=batch.column(0).slice(low, high - low), k=batch.column(2).slice(low, high - low), l=batch.column(3).slice(low, high - low), n=np.diff(at), a=a, b=b, vector=[count_vector(members[i:j]) for i, j in zip(edges, edges[1:], strict=False)], cell=pa.nulls(high - low, pa.int32()), times=pa.nulls(high - low, pa.int64()))
        seen = np.flatnonzero(cells)
        none = {c: pa.nulls(len(seen), t) for c, t in (("doc_id", pa.int64()), ("k", pa.int64()), ("l", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("vector", pa.binary()))}
        yield batch_of(schema, cell=seen.astype(np.int32), times=cells[seen], **none)

    return map_batches(docs, summarise, "doc_id long, k long, l long, n long, a long, b long, vector binary, cell int, times long")


def _prefixes(docs: DataFrame, cells, words: int, percent: int) -> DataFrame:
    """(a, tokens): the rarest members of each set, as many as a partner can't miss all of."""
    schema = pa.schema([("a", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.frombuffer(cells.value, np.int64)
        for batch in batches:
            for _, _, at, members in _parts(batch, words):
                n = np.diff(at)
                rows = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((members, times[(members & _U(len(times) - 1)).astype(np.int64)], rows))
                rank = np.arange(len(members)) - np.repeat(at[:-1], n)
                kept = rank < np.repeat(n + (-percent * n) // 100 + 1, n)
                a, _ = _fingerprints(at, members)
                edges = np.searchsorted(rows[kept], np.arange(len(n) + 1)).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(members[order][kept].view(np.int64), pa.int64()))
                yield batch_of(schema, a=a, tokens=tokens).filter(pa.array(n > 0))

    return map_batches(docs, emit, "a long, tokens array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members) of the ``wanted`` (node, a, b), from the texts again; members as bytes."""
    filtered = Filter(wanted, "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            for _, _, at, members in _parts(batch, words):
                a, b = _fingerprints(at, members)
                maybe = np.flatnonzero((np.diff(at) > 0) & filtered.passes(a))
                rows = []
                for r in maybe.tolist():  # copies within a task go out once
                    if (key := (int(a[r]), int(b[r]))) not in sent:
                        sent.add(key)
                        rows.append(r)
                if len(sent) > 200_000:
                    sent.clear()
                if rows:
                    yield batch_of(schema, a=a[rows], b=b[rows], members=[members[at[r] : at[r + 1]].tobytes() for r in rows])

    rows = map_batches(docs, emit, "a long, b long, members binary")
    return rows.join(wanted, ["a", "b"]).dropDuplicates(["a", "b"]).select("node", "members")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    _, slot, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kept = times[slot] > 1
    rows, columns = rows[kept], (np.cumsum(times > 1) - 1)[slot[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        a, b = np.searchsorted(columns, (low, low + 4096))
        held = np.zeros((len(sets), int(columns[b - 1]) - low + 1), np.float32)
        held[rows[a:b], columns[a:b] - low] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _tiles(clusters: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, corners): the classes of each cluster with their tile, and the upper corner and sizes of each tile.

    Neighbours in the order are alike in size, then in four coarse coordinates.
    """
    held = clusters.join(clusters.groupBy("middle").count().where("count > 1").select("middle"), "middle").join(points.select("node", "n", "vector"), "node")
    # the hottest cluster is dealt out like any other rows
    rows = held.withColumn("step", F.floor(F.log("n") * 9).cast("int")).repartitionByRange(int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions")), "middle", "step", F.substring("vector", 1, 8), "node")
    rows = rows.withColumn("place", F.spark_partition_id()).select("middle", "node", "n", "vector", "place", "step")
    schema = pa.schema([("middle", pa.int64()), ("tile", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("high", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, count = 0, None, 0
        corner, low, high = np.zeros(GROUPS, np.int64), 0, 0

        def done() -> pa.RecordBatch:
            return batch_of(schema, middle=[now[0]], tile=[now[1]], node=[None], n=[low], vector=[np.minimum(corner, _FULL).astype("<u2").tobytes()], high=[high])

        for batch in batches:
            middle, n, place = (np.asarray(batch.column(i)) for i in (0, 2, 4))
            tile = np.zeros(len(middle), np.int64)
            for i, (m, size, p, v) in enumerate(zip(middle.tolist(), n.tolist(), place.tolist(), batch.column(3).to_pylist(), strict=True)):
                if now is None or m != now[0] or count == TILE:
                    if now is not None:
                        yield done()
                    now, number, count = (m, p << 32 | number), number + 1, 0
                    corner, low, high = np.zeros(GROUPS, np.int64), size, size
                count += 1
                corner = np.maximum(corner, folded(np.frombuffer(v, "<u2").astype(np.int64), GROUPS))
                low, high = min(low, size), max(high, size)
                tile[i] = now[1]
            yield batch_of(schema, middle=batch.column(0), tile=tile, node=batch.column(1), n=batch.column(2), vector=batch.column(3), high=pa.nulls(len(tile), pa.int64()))
        if now is not None:
            yield done()

    packed = cut(map_batches(rows.sortWithinPartitions("middle", "step", F.substring("vector", 1, 8), "node"), pack, "middle long, tile long, node long, n long, vector binary, high long"))
    return packed.where("node is not null").drop("high"), packed.where("node is null").select("middle", "tile", F.col("n").alias("low"), "high", F.col("vector").alias("corner"))


def _tile_pairs(corners: DataFrame, percent: int) -> DataFrame:
    """(middle, i, j, near): pairs of tiles, also of one with itself, whose corners and sizes allow a link; near: with itself or the first of the cluster."""
    first = corners.groupBy("middle").agg(F.min("tile").alias("first"))
    left, right = (corners.select("middle", F.col("tile").alias(t), F.col("low").alias(f"low_{t}"), F.col("high").alias(f"high_{t}"), F.col("corner").alias(f"corner_{t}")) for t in ("i", "j"))
    sized = left.join(right, "middle").where((F.col("i") <= F.col("j")) & (100 * F.col("high_i") >= percent * F.col("low_j")) & (100 * F.col("high_j") >= percent * F.col("low_i"))).join(first, "middle")
    schema = pa.schema([("middle", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("near", pa.bool_())])

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, GROUPS).astype(np.int64) for c in ("corner_i", "corner_j"))
            least = np.minimum(x, y)
            low = _need(np.asarray(batch.column("low_i")), np.asarray(batch.column("low_j")), percent)
            i, j, first = (np.asarray(batch.column(c)) for c in ("i", "j", "first"))
            yield batch_of(schema, middle=batch.column("middle"), i=i, j=j, near=(i == j) | (i == first)).filter(pa.array((least >= _FULL).any(1) | (least.sum(1) >= low)))

    return cut(map_batches(sized, able, "middle long, i long, j long, near boolean"))


def _opened(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``placed`` (middle, tile, node, ..) in each of the tile pairs (middle, i, j) that their tile is in."""
    both = pairs.select("middle", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    # of the first tile, which meets all others, Spark splits the pairs
    return placed.join(both, ["middle", "tile"])


def _by_tile(tiles: DataFrame, schema: pa.Schema, ddl: str, work) -> DataFrame:
    """Rows that ``work`` makes of the columns of each tile, whose rows stand together whatever the batches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([np.asarray(whole.column(c)) for c in ("middle", "i", "j")], 1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1))
            rest = whole.slice(int(starts[-1]))
            yield from found(whole.slice(0, int(starts[-1])), starts)
        if rest is not None and rest.num_rows:
            yield from found(rest, np.array([0, rest.num_rows]))

    def found(whole: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {f.name: np.asarray(whole.column(f.name)) if pa.types.is_integer(f.type) else whole.column(f.name).to_pylist() for f in whole.schema}
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                out += work({c: x[a:b] for c, x in columns.items()})
        if out:
            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    return map_batches(tiles.repartition("middle", "i", "j").sortWithinPartitions("middle", "i", "j"), search, ddl)


def _near(tile: dict, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile whose points an R-tree can't tell apart, each pair once."""
    n, i, j = tile["n"], tile["i"][0], tile["j"][0]
    left, right = (np.flatnonzero(tile["tile"] == c) for c in (i, j))
    if not len(left) or not len(right):
        return
    points = np.stack([folded(np.frombuffer(v, "<u2").astype(np.int64), GROUPS) for v in tile["vector"]])
    tree = RTree(points[right], n[right])
    for q in left.tolist():
        near = right[tree.search(points[q], int(n[q]), percent)]
        yield q, near[near > q] if i == j else near


def _able(placed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(middle, tile, node) of the classes that the R-trees leave a partner in their cluster.

    Tiles are looked at by themselves first; others are opened only for classes that have none there.
    """
    schema = pa.schema([("middle", pa.int64()), ("tile", pa.int64()), ("node", pa.int64())])

    def work(tile: dict) -> list[tuple[int, int, int]]:
        n, able = tile["n"], np.zeros(len(tile["n"]), bool)
        full = [np.frombuffer(v, "<u2").astype(np.int64) for v in tile["vector"]]
        for q, near in _near(tile, percent):
            for r in (near[~able[near]] if able[q] else near).tolist():
                if not (able[q] and able[r]) and bound(full[q], full[r]) >= _need(n[q], n[r], percent):
                    able[q] = able[r] = True
        return [(int(tile["middle"][0]), t, x) for t, x in zip(tile["tile"][able].tolist(), tile["node"][able].tolist(), strict=True)]

    ddl = "middle long, tile long, node long"
    alone = cut(_by_tile(_opened(placed, pairs.where("i = j")), schema, ddl, work))
    # a tile with a class that has no partner yet is opened with all that its corner allows
    rest = placed.join(alone, ["middle", "tile", "node"], "left_anti").select("middle", "tile").distinct()
    others = pairs.where("i <> j").join(rest.withColumnRenamed("tile", "i"), ["middle", "i"], "left_semi").unionByName(pairs.where("i <> j").join(rest.withColumnRenamed("tile", "j"), ["middle", "j"], "left_semi")).distinct()
    return cut(alone.unionByName(_by_tile(_opened(placed, others), schema, ddl, work)).distinct())


def _linked(tiles: DataFrame, percent: int) -> DataFrame:
    """(u, v) that join the components of each tile pair: what the R-trees leave is verified unless it is of one component already."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(tile: dict) -> list[tuple[int, int]]:
        node, n = tile["node"].tolist(), tile["n"]
        sets: list = [None] * len(node)
        root = tile["label"].copy()
        out = []
        for q, near in _near(tile, percent):
            while len(near := near[root[near] != root[q]]):
                r, near = int(near[0]), near[1:]
                x, y = (sets[k] if sets[k] is not None else sets.__setitem__(k, np.frombuffer(tile["members"][k], np.int64)) or sets[k] for k in (q, r))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (int(n[q]) + int(n[r]) - shared):
                    out.append((node[q], node[r]))
                    root[root == root[r]] = root[q]
        return out

    return _by_tile(tiles, schema, "u long, v long", work)


def _counted(tiles: DataFrame, percent: int) -> DataFrame:
    """(u, null, links) of each class and tile, links by the rows that they lead to; and (u, v, null), what joins the tile's components.

    All that the R-trees leave is verified on the sets.  A pair that meets in more than one cluster
    counts in that of the smallest middle.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def work(tile: dict) -> list[tuple]:
        node, n = tile["node"], tile["n"]
        link = np.zeros((len(n), len(n)), bool)
        for q, near in _near(tile, percent):
            link[q, near] = True
        at = np.flatnonzero(link.any(0) | link.any(1))
        if not len(at):
            return []
        node, n, link = node[at], n[at], link[np.ix_(at, at)]
        shared = _common([np.frombuffer(tile["members"][k], np.int64) for k in at.tolist()])
        link &= 100 * shared >= percent * (n[:, None] + n - shared)
        link |= link.T
        earlier = [np.array([m for m in tile["middles"][k] if m < tile["middle"][0]], np.int64) for k in at.tolist()]
        links = (link & (_common(earlier) == 0)) @ tile["copies"][at]
        out = [(int(node[k]), None, int(links[k])) for k in np.flatnonzero(links).tolist()]
        reached = np.zeros(len(n), bool)
        for k in np.flatnonzero(link.any(0)).tolist():
            front = np.array([] if reached[k] else [k], np.int64)
            while len(front):
                reached[front] = True
                out += [(x, int(node[k]), None) for x in node[front].tolist() if x != node[k]]
                front = np.flatnonzero(link[front].any(0) & ~reached)
        return out

    return _by_tile(tiles, schema, "u long, v long, links long", work)


def _met(narrow: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, points, clusters): the document rows, their classes, and by middle which of these can be linked."""
    spark = narrow.sparkSession
    size = 1 << min(CELL_BITS[1], max(CELL_BITS[0], narrow.count().bit_length()))
    summaries = cut(_summaries(narrow, words, size))
    counted = summaries.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(size, np.int64)
    times[np.asarray(counted.column("cell"))] = np.asarray(counted.column("times"))
    cells = spark.sparkContext.broadcast(times.tobytes())
    rows = summaries.where("cell is null").select("doc_id", "k", "l", "n", "a", "b", "vector")
    points = cut(rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()))
    tokens = cut(_prefixes(narrow.select("doc_id", "text"), cells, words, percent)).select("a", F.explode("tokens").alias("token"))
    repeated = dealt(tokens.groupBy("token").count().where("count > 1"), "token", "count").select("token")
    members = cut(tokens.join(repeated, "token").join(points.select("a", "node"), "a").select("token", "node").distinct())
    blocks = members.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    kept = blocks.groupBy("c", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "c", "times")
    held = cut(members.join(kept, "token"))
    # the class that shares most with others, for its size, stands in the middle of its block
    weight = held.groupBy("node").agg(F.sum(F.col("c") * F.col("times")).alias("shared")).join(points.select("node", "n"), "node").select("node", (F.col("shared") / F.col("n")).alias("weight"))
    weighted = held.join(weight, "node")
    middle = dealt(weighted.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("m")).select("token", F.col("m.node").alias("v")), "token", "v")
    # all that meets in blocks with one middle is one cluster, in which each pair stands once
    return rows, points, cut(held.join(middle, "token").select(F.col("v").alias("middle"), "node").distinct())


def _searchable(narrow: DataFrame, points: DataFrame, clusters: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(able, pairs, whole): the placed classes that may be linked, the tile pairs, and those classes with their sets."""
    placed, corners = _tiles(clusters, points)
    pairs = _tile_pairs(corners, percent)
    able = _able(placed, pairs, percent)
    places = able.groupBy("node").agg(F.collect_list("middle").alias("middles"))
    sets = _sets(narrow.select("doc_id", "text"), cut(points.join(places, "node", "left_semi").select("node", "a", "b")), words)
    return able, pairs, cut(points.select("node", "n", "vector", "copies").join(places, "node").join(sets, "node"))


def _labels(narrow: DataFrame, points: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, label) of the linked classes; links within a component that is known aren't looked for."""
    able, pairs, whole = _searchable(narrow, points, clusters, words, percent)
    rows = able.join(whole.select("node", "n", "vector", "members"), "node")
    links = cut(_linked(_opened(rows.withColumn("label", F.col("node")), pairs.where("near")), percent))
    labels = cut(components(links))
    labelled = cut(able.join(labels, "node", "left").select("middle", "tile", "node", F.coalesce("label", "node").alias("label")))
    spans = labelled.groupBy("middle", "tile").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    side = lambda t: spans.select("middle", F.col("tile").alias(t), F.col("low").alias(f"low_{t}"), F.col("high").alias(f"high_{t}"))
    open_pairs = pairs.where("not near").join(side("i"), ["middle", "i"]).join(side("j"), ["middle", "j"]).where(F.least("low_i", "low_j") != F.greatest("high_i", "high_j")).select("middle", "i", "j")
    more = cut(_linked(_opened(labelled.join(whole.select("node", "n", "vector", "members"), "node"), open_pairs), percent))
    return labels if more.isEmpty() else cut(components(links.unionByName(more)))


def _links(narrow: DataFrame, points: DataFrame, clusters: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the linked classes, and (node, links): the rows of other classes that each is linked to."""
    able, pairs, whole = _searchable(narrow, points, clusters, words, percent)
    found = cut(_counted(_opened(able.join(whole, "node"), pairs), percent))
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    return cut(components(found.where("v is not null").select("u", "v"))), links


def _narrow(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, text, k, l) with 128 bits of the text."""
    body = F.col(text).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("k"), F.xxhash64(F.lit(1), body).alias("l"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_links.

    ``n_links`` is the number of other rows that the row is linked to, copies included.  Null and empty
    texts have no shingles and no links and are their own component; a text of fewer words than a
    shingle has one; repeated rows and equal texts are linked; rows without an id take part and get
    the smallest id of their component, or null.
    """
    narrow = _narrow(docs, id_column, text)
    rows, points, clusters = _met(narrow, words, percent)
    labels, links = _links(narrow, points, clusters, words, percent)
    named = points.select("a", "b", "node", "first_id", "copies").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "label").select("a", "b", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "n", "a", "b").join(classes, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, rows without an id last.

    Among rows of one id it is the first by the marks of its set and its text, then by a hash of the
    row.  Texts without words stay, each as it is.  All columns stay.
    """
    narrow = _narrow(docs, id_column, text)
    rows, points, clusters = _met(narrow, words, percent)
    labels = points.select("a", "b", "node").join(_labels(narrow, points, clusters, words, percent), "node", "left").select("a", "b", F.coalesce("label", "node").alias("label"))
    names = docs.columns
    id_name, k_name, l_name, row_name = fresh(names, "__id", "__k", "__l", "__row")
    labelled = cut(rows.where("n > 0").join(labels, ["a", "b"]).select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b", "k", "l").alias("place")))
    groups = cut(labelled.groupBy("label").agg(F.min("place").alias("m"), F.count("*").alias("times")))
    # texts of one row in all are kept where they are; only those that others are linked to are shuffled
    doubtful = Filter(labelled.join(groups.where("times > 1").select("label"), "label").select(F.col("place.k").alias("k")), "k")
    first = groups.select(F.col("m.doc_id").alias(id_name), F.col("m.k").alias(k_name), F.col("m.l").alias(l_name))
    body = F.col(text).cast("string")
    own = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(*own, F.col(id_column).cast("long").alias(id_name), F.xxhash64(body).alias(k_name), F.xxhash64(F.lit(1), body).alias(l_name))
    worded = F.coalesce(body, F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    width = len(names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~doubtful.passes(np.asarray(batch.column(width + 1))))).select(names)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(doubtful.passes(np.asarray(batch.column(width + 1)))))

    some = map_batches(keyed.where(worded), linked, keyed.schema)
    same = some[id_name].eqNullSafe(first[id_name]) & (some[k_name] == first[k_name]) & (some[l_name] == first[l_name])
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    kept = some.join(first, same, "left_semi").groupBy(id_name, k_name, l_name).agg(F.min_by(F.struct(*own), F.xxhash64(*plain)).alias(row_name)).select(f"`{row_name}`.*")
    return kept.unionByName(map_batches(keyed.where(worded), alone, docs.schema)).unionByName(docs.where(~worded))
