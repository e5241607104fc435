"""Alignment of two tokenizers' ids on the bytes of a text.

Every byte has a label: no token ends there, a token of A, of B, or of both.  A regular expression
takes spans up to each both-label; a span is a group, and its labels say how many tokens of A and of
B it has.

Both tokenizers end a token where white space follows other text and where a mark follows a letter, so
a text is a row of pieces that are encoded, labelled and scanned once for each worker and then looked
up.  Where this holds for the second vocabulary is read from its pieces: white space that stands behind
other text in any of them, and a mark behind a letter, does not cut.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut
from keyweave.llm.bpe import WORD_PATTERN, Vocabulary
from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

#: White space of the first tokenizer's pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits behind which the first tokenizer always ends a word if a mark follows.
LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
MARKS = re.escape(string.punctuation)
#: Labels by (A ends here) + 2 * (B ends here).
LABELS = np.frombuffer(b"nabc", np.uint8)
SPAN = re.compile(b"[^c]*c")
#: Pieces and their letters that a worker remembers at most.
HELD_PIECES, HELD_LETTERS = 500_000, 1 << 25
#: Groups of more links go by distinct ids and not by occurrences.
WIDE_GROUP = 1 << 12
#: Pairs that a task adds up before it hands them on.
HELD_PAIRS = 1 << 21
#: Most frequent pairs that are broadcast with their counts (17 bytes each); rarer ones meet theirs in a join.
SHARED_PAIRS = 1 << 20


class Pair:
    """The two tokenizers; ids and bytes of both for pieces of text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        vocabulary = Vocabulary(path_a)
        if (np.diff(vocabulary.merged[np.argsort(vocabulary.ranks)]) < 0).any():
            raise ValueError("the first tokenizer must number its tokens in the order of its merges")
        special = {int.from_bytes(x, "little") for x in vocabulary.special.values()}
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks={x: i for i, x in enumerate(vocabulary.tokens) if x and i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths_a = np.array([len(x) for x in vocabulary.tokens], np.int64)
        self.lengths_b = np.array([len(x) for x in self.b_bytes], np.int64)
        self.size_b = size
        plain = [x.replace("▁", " ") for i, x in enumerate(names) if not self.b.is_byte(i)]
        # a line end keeps what follows apart from the blank that the model puts in front
        lead = [names[i] for i in self.b.encode("\n")]
        if lead != ["▁", "<0x0A>"] or any("\n" in x for x in plain):
            raise ValueError("the second tokenizer must put a blank in front and have line ends as bytes")
        glued = "".join(sorted({m.group(1) for x in plain for m in re.finditer(f"(?<=[^{WHITE}])([{WHITE}])", x)}))
        held = {m.group(1) for x in plain for m in re.finditer(f"(?<=[{LETTERS}])([{MARKS}])", x)}
        free = re.escape("".join(x for x in string.punctuation if x not in held))
        body = f"[^{WHITE}{LETTERS}]*(?:[{LETTERS}]+(?:[^{WHITE}{LETTERS}{free}][^{WHITE}{LETTERS}]*)?)*"
        more = f"(?:[{re.escape(glued)}][{WHITE}]*{body})*" if glued else ""
        self.pieces = re.compile(f"(?!\\Z)[{WHITE}]*{body}{more}").findall
        self.written = [f"{i}{sep}" for i in range(max(size, len(self.lengths_a))) for sep in ",|;"]

    def encode_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        ids = list(map(self.a.encode_ordinary, pieces))
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        ids = self.b.encode(["\n" + x for x in pieces], num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        found = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        lead = np.cumsum(counts) - counts
        return np.delete(found, np.concatenate((lead, lead + 1))), counts - 2


def spans(labels: bytes) -> np.ndarray:
    """The ends of all spans up to a both-label."""
    return np.array([m.end() for m in SPAN.finditer(labels)], np.int64)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them), one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


class Aligned:
    """What is known of each piece seen so far: counts, its groups in writing, and its id pairs with their links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.written: list[str] = []
        #: n_a, n_b, n_groups, n_links and whether B's bytes are the piece's own
        self.facts = np.zeros((0, 5), np.int64)
        self.at = np.zeros(1, np.int64)
        self.keys = self.times = np.zeros(0, np.int64)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; unseen ones are aligned together."""
        if len(self.index) > HELD_PIECES or self.letters > HELD_LETTERS:
            self.forget()
        numbers = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        unseen = np.flatnonzero(numbers < 0)
        if len(unseen):
            names = [pieces[i] for i in unseen.tolist()]
            self._add(list(dict.fromkeys(names)))
            numbers[unseen] = list(map(self.index.__getitem__, names))
        return numbers

    def _add(self, missing: list[str]) -> None:
        p, first = self.pair, len(self.written)
        b, n_b = p.encode_b(missing)
        raw = [x.encode() for x in missing]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end_b = np.cumsum(n_b)
        whole = np.diff(np.concatenate(([0], np.cumsum(p.lengths_b[b])))[end_b], prepend=0) == size
        if not whole.all() or b"".join(map(p.b_bytes.__getitem__, b.tolist())) != b"".join(raw):
            whole = np.array([b"".join([p.b_bytes[i] for i in b[e - n : e].tolist()]) == x for e, n, x in zip(end_b.tolist(), n_b.tolist(), raw, strict=True)], bool)
        good = np.flatnonzero(whole).tolist()
        facts = np.zeros((len(missing), 5), np.int64)
        facts[:, 4] = whole
        written = [""] * len(missing)
        sizes = np.zeros(len(missing), np.int64)
        keys = times = np.zeros(0, np.int64)
        if good:
            a, n_a = p.encode_a([missing[i] for i in good])
            b, n_b = b[np.repeat(whole, n_b)], n_b[whole]
            ends_a, ends_b = np.cumsum(p.lengths_a[a]), np.cumsum(p.lengths_b[b])
            labels = np.zeros(int(ends_a[-1]), np.uint8)
            labels[ends_a - 1] += 1
            labels[ends_b - 1] += 2
            stop = spans(LABELS[labels].tobytes())
            # tokens of A and of B in front of each span's end: of each label so many
            a1, b1 = np.cumsum(labels & 1, dtype=np.int64)[stop - 1], np.cumsum(labels >> 1, dtype=np.int64)[stop - 1]
            a0, b0 = np.concatenate(([0], a1[:-1])), np.concatenate(([0], b1[:-1]))
            last = np.cumsum(size[whole])
            groups = np.searchsorted(stop, last, side="right")
            of = np.repeat(np.arange(len(good)), np.diff(groups, prepend=0))
            links = (a1 - a0) * (b1 - b0)
            facts[good, 0], facts[good, 1], facts[good, 2] = n_a, n_b, np.diff(groups, prepend=0)
            facts[good, 3] = np.diff(np.concatenate(([0], np.cumsum(links)))[groups], prepend=0)
            for i, text in zip(good, self._write(a, b, a0, a1, b0, b1, np.cumsum(n_a + n_b)), strict=True):
                written[i] = text
            piece, key, time = self._pairs(a, b, a0, a1, b0, b1, of, links)
            order = np.lexsort((key, piece))
            piece, key, time = piece[order], key[order], time[order]
            new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (key[1:] != key[:-1]))))
            keys, times = key[new], np.add.reduceat(time, new)
            sizes[good] = np.bincount(piece[new], minlength=len(good))
        self.index.update(zip(missing, range(first, first + len(missing)), strict=True))
        self.letters += sum(map(len, missing))
        self.written += written
        self.facts = np.concatenate((self.facts, facts))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        self.keys, self.times = np.concatenate((self.keys, keys)), np.concatenate((self.times, times))

    def _write(self, a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """``a1,a2|b1;`` for each group, joined by piece."""
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = a * 3
        out[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = b * 3
        out[a1 + b0 - 1] += 1
        out[a1 + b1 - 1] += 2
        tokens = [self.pair.written[i] for i in out.tolist()]
        start = 0
        for end in ends.tolist():
            yield "".join(tokens[start:end])
            start = end

    def _pairs(self, a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, of: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, key, links) of all groups; a group of many tokens gives each pair of distinct ids once."""
        size = self.pair.size_b
        small = np.flatnonzero(links <= WIDE_GROUP)
        wide_b = (b1 - b0)[small]
        at_a = _ragged(a0[small], (a1 - a0)[small])
        times_b = np.repeat(wide_b, (a1 - a0)[small])
        key = np.repeat(a[at_a] * size, times_b) + b[_ragged(np.repeat(b0[small], (a1 - a0)[small]), times_b)]
        found = [(np.repeat(of[small], links[small]), key, np.ones(len(key), np.int64))]
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():
            ids_a, n_a = np.unique(a[a0[g] : a1[g]], return_counts=True)
            ids_b, n_b = np.unique(b[b0[g] : b1[g]], return_counts=True)
            key = (ids_a[:, None] * size + ids_b).ravel()
            found.append((np.full(len(key), of[g]), key, (n_a[:, None] * n_b).ravel()))
        piece, key, time = (np.concatenate(x) for x in zip(*found, strict=True))
        return piece, key, time

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(facts of each text, its groups in writing, where its pairs begin, keys, links)."""
        pieces = [self.pair.pieces(" " + x) if x else [] for x in texts]
        many = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.look_up(list(chain.from_iterable(pieces)))
        sums = np.zeros((len(flat) + 1, 5), np.int64)
        np.cumsum(self.facts[flat], axis=0, out=sums[1:])
        stop = np.cumsum(many)
        facts = sums[stop] - sums[stop - many]
        none = facts[:, 4] < many
        facts[none] = 0
        all_written = list(map(self.written.__getitem__, flat.tolist()))
        written = ["" if x else "".join(all_written[e - n : e])[:-1] for x, e, n in zip(none.tolist(), stop.tolist(), many.tolist(), strict=True)]
        row = np.repeat(np.arange(len(texts)), many)
        keep = ~none[row]
        held, times = np.unique(row[keep] << 32 | flat[keep], return_counts=True)
        row, flat = held >> 32, held & 0xFFFFFFFF
        size = np.diff(self.at)[flat]
        at = _ragged(self.at[flat], size)
        bits = int(len(self.pair.lengths_a) * self.pair.size_b).bit_length()
        if bits + len(texts).bit_length() > 63:
            raise ValueError("too many texts at once for vocabularies of this size")
        key, links = _summed(np.repeat(row << bits, size) | self.keys[at], self.times[at] * np.repeat(times, size))
        row = key >> bits
        return facts, written, np.searchsorted(row, np.arange(len(texts) + 1)), key - (row << bits), links


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs.clear()
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def _packed(keys: np.ndarray, links: np.ndarray, out: zstandard.ZstdCompressor) -> bytes:
    return out.compress(np.diff(keys, prepend=0).tobytes() + links.tobytes())


def _unpacked(blob: bytes, into: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(into.decompress(blob), np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text", shared_pairs: int = SHARED_PAIRS, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with ``groups`` in writing if asked.

    Texts that are null, empty or not what B's tokens say have zeros and the empty string.  Repeated
    rows count as documents of their own and an id may be null; other columns aren't read; an empty
    table gives an empty result.  ``path_a`` and ``path_b`` must be readable on every worker.
    """
    spark = docs.sparkSession
    size_b = _pair(path_a, path_b).size_b
    names = ["doc_id", *_FACTS, "groups_sha256", "pairs", "pair", "held", *(["groups"] if with_groups else [])]
    kinds = {"groups_sha256": pa.string(), "groups": pa.string(), "pairs": pa.binary(), "pair": pa.list_(pa.int64()), "held": pa.list_(pa.int64())}
    schema = pa.schema([(x, kinds.get(x, pa.int64())) for x in names])
    ddl = ", ".join(f"{x} " + {"groups_sha256": "string", "groups": "string", "pairs": "binary", "pair": "array<long>", "held": "array<long>"}.get(x, "long") for x in names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = Aligned(_pair(path_a, path_b)), zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 2
            for i in range(0, len(keys), 1 << 16):
                yield batch_of(schema, **{x: [None] for x in names} | {"pair": [keys[i : i + (1 << 16)]], "held": [n[i : i + (1 << 16)]]})
            held.clear()

        for batch in batches:
            offsets, _ = texts_of(batch)
            for i, j in slices(offsets, WIDE_SLICE):
                part = batch.slice(i, j - i)
                facts, written, at, keys, links = known.texts(part.column(1).to_pylist())
                held.append(_summed(keys, np.ones(len(keys), np.int64)))
                cuts = at.tolist()
                more = {"groups": written} if with_groups else {}
                yield batch_of(schema, doc_id=part.column(0), **{x: facts[:, k] for k, x in enumerate(_FACTS)}, groups_sha256=[hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written], pairs=[_packed(keys[s:e], links[s:e], press) for s, e in zip(cuts, cuts[1:], strict=False)], pair=[None] * len(part), held=[None] * len(part), **more)
                if sum(len(x) for x, _ in held) > HELD_PAIRS:
                    held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield from told()
        yield from told()

    made = cut(map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), align, ddl))
    counts = cut(_counted(made, size_b))
    keys, n, best, rest = _shared(counts, shared_pairs)
    table = spark.sparkContext.broadcast((keys, n, best))
    kept = [x for x in names if x not in ("pair", "held", "pairs")]
    fields = [*((x, kinds.get(x, pa.int64())) for x in kept), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
    scored = pa.schema(fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        into, none = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for batch in batches:
            sums, tops, left = [], [], []
            for blob in batch.column("pairs").to_pylist():
                key, links = _unpacked(blob, into)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                sums.append(int((n[at[hit]] * links[hit]).sum()))
                tops.append(int(links[hit][best[at[hit]]].sum()))
                left.append((none, none) if hit.all() else (key[~hit], links[~hit]))
            yield batch_of(scored, **{x: batch.column(x) for x in kept}, n_best=tops, count_sum=sums, pair=[x for x, _ in left], held=[x for _, x in left])

    ddl = ", ".join(f"{x} " + {"groups_sha256": "string", "groups": "string"}.get(x, "long") for x in kept) + ", n_best long, count_sum long, pair array<long>, held array<long>"
    rows = map_batches(made.where("pairs is not null").select(*kept, "pairs"), score, ddl)
    if rest is not None:
        rows = _with_rare(cut(rows), rest)
    return rows.select("doc_id", *_FACTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))


def _counted(made: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) of all id pairs: in how many documents it is linked, and whether no pair of its A id is in more."""
    zipped = made.where("pair is not null").select(F.explode(F.arrays_zip("pair", "held")).alias("x"))
    counts = cut(zipped.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.held").alias("n")))
    a = F.expr(f"pair div {size_b}").cast("int").alias("a")
    # one row for each id of A: bounded by its vocabulary
    tops = counts.groupBy(a).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _shared(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame | None]:
    """The most frequent pairs, ``limit`` at most, sorted by key, and the table of all others (None: there are none)."""
    steps = counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    room, least, over = limit, None, False
    for r in steps.groupBy("step").agg(F.count("*").alias("pairs")).orderBy(F.desc("step")).collect():
        if r.pairs > room:
            over = True
            break
        room, least = room - r.pairs, r.step
    if least is None:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool), counts if over else None
    found = steps.where(F.col("step") >= least).select("pair", "n", "best").toArrow()
    keys, n, best = (found.column(x).to_numpy() for x in ("pair", "n", "best"))
    order = np.argsort(keys)
    return keys[order], n[order], best[order].astype(bool), steps.where(F.col("step") < least).drop("step") if over else None


def _with_rare(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """Adds what the pairs that weren't shared give: each is rare, so no key of the join is hot."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode(F.arrays_zip("pair", "held")).alias("x")).select("row", "x.pair", "x.held")
    more = links.join(rest, "pair").groupBy("row").agg(F.sum(F.col("held") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("held")).otherwise(0)).alias("more_best"))
    added = rows.join(more, "row", "left")
    return added.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
