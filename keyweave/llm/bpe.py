"""Byte-level BPE by a lexicon of frequent words, and the way back from ids to text.

The frequent words of the corpus are compiled, with their ids, into a minimal acyclic transducer: an
automaton whose equal suffixes are shared.  Its arrays go to the workers as one block of bounded size
and are memory-mapped there.  A word that the automaton doesn't know is merged by the ranks of the
vocabulary, exactly, many words at a time.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut
from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

#: The pattern that splits text into words before merges.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon at most: it bounds what is broadcast (about 3 MB).
LEXICON_WORDS = 1 << 16
#: Letters of a word of the lexicon at most.
LEXICON_LETTERS = 48
#: Words that the counts and the memory of a worker hold at most before they are emptied.
HELD_WORDS = 400_000
#: Letters of the texts whose words are counted together: what words of any length hold.
HELD_LETTERS = 1 << 26
#: Longer words are merged one by one.
MATRIX_WIDTH = 40


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[x] for x in token) if token not in special else token.encode()
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])], np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), pairs[order, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (very large: none) and where it stands."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers, by the ranks alone."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        edges = [0, 4, 8, 12, 20, MATRIX_WIDTH]
        for low, high in zip(edges, edges[1:], strict=False):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(which, len(which) // 20_000 + 1):
                if len(part):
                    self._merge_matrix(words, part, lengths[part], high, out)
        for i in np.flatnonzero(lengths > MATRIX_WIDTH).tolist():
            out[i] = self._merge_long(words[i])
        return out

    def _merge_matrix(self, words: list[bytes], which: np.ndarray, length: np.ndarray, width: int, out: list[bytes]) -> None:
        rows = len(which)
        ids = np.full((rows, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < length[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8)]
        ranks = np.full((rows, width), _NONE, np.int64)
        pair = inside[:, 1:]
        ranks[pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])[0]
        count, active = length.copy(), np.arange(rows)
        column = np.arange(width)
        while len(active):
            r = ranks[active]
            best = r.argmin(1)
            going = r[np.arange(len(active)), best] < _NONE
            active, best, r = active[going], best[going], r[going]
            if not len(active):
                break
            x = ids[active]
            me = np.arange(len(active))
            _, at = self.rank(x[me, best], x[me, best + 1])
            # all that stands behind the merged pair moves up by one
            moved = np.concatenate((x[:, 1:], np.full((len(active), 1), -1)), 1)
            x = np.where(np.arange(width + 1) > best[:, None], moved, x)
            x[me, best] = self.merged[at]
            r = np.where(column > best[:, None], np.concatenate((r[:, 1:], np.full((len(active), 1), _NONE)), 1), r)
            count[active] -= 1
            r[me, best] = np.where(x[me, best + 1] >= 0, self.rank(x[me, best], x[me, best + 1])[0], _NONE)
            left = best > 0
            r[me[left], best[left] - 1] = self.rank(x[me[left], best[left] - 1], x[me[left], best[left]])[0]
            ids[active], ranks[active] = x, r
        flat = ids[np.arange(width + 1) < count[:, None]].astype("<u4").tobytes()
        ends = np.cumsum(count * 4).tolist()
        start = 0
        for i, end in zip(which.tolist(), ends, strict=True):
            out[i] = flat[start:end]
            start = end

    def _merge_long(self, word: bytes) -> bytes:
        """A heap of pairs over a linked list: n log n for a word of any length."""
        import heapq

        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        table = self._table()
        heap = [(table[p][0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in table]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = table[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in table:
                    heapq.heappush(heap, (table[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in table:
                heapq.heappush(heap, (table[p][0], h, *p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = {(k // self.size, k % self.size): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        return self._pairs


_NONE = 1 << 40


class Lexicon:
    """A minimal acyclic automaton whose n-th word, in byte order, has the n-th output.

    A transition carries how many words come before those that pass it, so the sum along a path is
    the number of its word: outputs need no state of their own and suffixes stay shared.
    """

    def __init__(self, key: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, output_at: np.ndarray, outputs: np.ndarray):
        #: key: state * 256 + byte, in order; target and before: of each transition; final: of each state.
        self.key, self.target, self.before, self.final, self.output_at, self.outputs = key, target, before, final, output_at, outputs

    @classmethod
    def compile(cls, entries: dict[bytes, bytes]) -> Lexicon:
        words = sorted(entries)
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple, int] = {}
        # the path of the last word: [final, its finished transitions, the byte that leads on]
        path: list[list] = [[False, [], -1]]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, moves, _ = path.pop()
                signature = (final, tuple(moves))
                if (state := known.get(signature)) is None:
                    state = known[signature] = len(states)
                    states.append(signature)
                path[-1][1].append((path[-1][2], state))

        last = b""
        for word in words:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            close(shared)
            for b in word[shared:]:
                path[-1][2] = b
                path.append([False, [], -1])
            path[-1][0] = True
            last = word
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        below = np.zeros(len(states), np.int64)
        rows: list[tuple[int, int, int]] = []
        for s, (final, moves) in enumerate(states):  # a state comes after all that it leads to
            n = int(final)
            for b, t in moves:
                rows.append((s * 256 + b, t, n))
                n += int(below[t])
            below[s] = n
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        outputs = [entries[w] for w in words]
        return cls(table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), np.array([f for f, _ in states], bool), np.concatenate(([0], np.cumsum([len(x) for x in outputs]))).astype(np.int64), np.frombuffer(b"".join(outputs), np.uint8))

    def pack(self) -> bytes:
        parts = (self.key, self.output_at, self.target, self.before, self.final, self.outputs)
        head = np.array([len(x) for x in parts], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def mapped(cls, packed: bytes) -> Lexicon:
        """Memory-mapped from an unnamed file of this worker, so its pages can be dropped and read again."""
        with tempfile.TemporaryFile() as file:
            file.write(packed)
            file.flush()
            raw = np.memmap(file, np.uint8, "r")
        sizes, at, parts = raw[:48].view(np.int64), 48, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int64, np.int32, np.int32, bool, np.uint8), strict=True):
            width = np.dtype(kind).itemsize
            parts.append(raw[at : at + n * width].view(kind))
            at += n * width
        key, output_at, target, before, final, outputs = parts
        return cls(key, target, before, final, output_at, outputs)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The output of each word, None where the automaton doesn't end on it; all words walk together."""
        if not len(self.key) or not words:
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), len(self.final) - 1, np.int64)
        number = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        for step in range(int(lengths.max())):
            walk = alive[lengths[alive] > step]
            if not len(walk):
                break
            want = state[walk] * 256 + data[starts[walk] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            dead, walk, at = walk[~hit], walk[hit], at[hit]
            state[dead] = -1
            state[walk] = self.target[at]
            number[walk] += self.before[at]
            alive = alive[state[alive] >= 0]
        found = state >= 0
        found[found] = self.final[state[found]]
        low = self.output_at[np.where(found, number, 0)].tolist()
        high = self.output_at[np.where(found, number + 1, 0)].tolist()
        raw = self.outputs.tobytes() if len(words) > 5000 else self.outputs
        return [bytes(raw[a:b]) if f else None for f, a, b in zip(found.tolist(), low, high, strict=True)]


class Splitter:
    """Words of a text, with the vocabulary's special strings as words of their own."""

    def __init__(self, special: Iterable[str]):
        self.words = regex.compile(WORD_PATTERN).findall
        self.special = frozenset(special)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.words(text)
        return list(chain.from_iterable([part] if part in self.special else self.words(part) for part in self.cut(text)))


class Codec:
    """Texts to ids and back, with a bounded memory of words already seen."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = Splitter(vocabulary.special)
        self.seen: dict[str, bytes] = dict(vocabulary.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        pieces = [self.split(x) for x in texts]
        if len(self.seen) > HELD_WORDS:
            self.seen = dict(self.vocabulary.special)
        missing = list(set(chain.from_iterable(pieces)) - self.seen.keys())
        if missing:
            raw = [x.encode() for x in missing]
            found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
            rest = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(rest, self.vocabulary.merge([raw[i] for i in rest]), strict=True):
                found[i] = x
            self.seen.update(zip(missing, found, strict=True))
        look = self.seen.__getitem__
        return [b"".join(map(look, x)) for x in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def count_words(docs: DataFrame, special: Iterable[str], text: str = "text") -> DataFrame:
    """(word, n) over every whole text, of words that the lexicon can have: each task adds up before rows are shuffled."""
    special = tuple(special)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def told(counts: Counter) -> pa.RecordBatch:
        short = [(w, n) for w, n in counts.items() if len(w) <= LEXICON_LETTERS]
        return batch_of(schema, word=[w for w, _ in short], n=[n for _, n in short])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts, read = Splitter(special), Counter(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    counts.update(split(x))
                    read += len(x)
                    if len(counts) > HELD_WORDS or read > HELD_LETTERS:
                        yield told(counts)
                        counts, read = Counter(), 0
        yield told(counts)

    return map_batches(docs.select(F.col(text).cast("string").alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, limit: int = LEXICON_WORDS, text: str = "text") -> list[str]:
    """The most frequent words, ``limit`` at most: all from the least frequency on that keeps to it.

    The frequency comes from a histogram of eight steps for each power of two, so what all tasks
    together send to the driver is bounded by ``limit`` words of LEXICON_LETTERS letters; longer ones are
    merged as they come.
    """
    counts = cut(count_words(docs, vocabulary.special, text).where("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    room, least = limit, None
    for r in counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if r.words > room:
            break
        room, least = room - r.words, r.step
    return sorted(r.word for r in counts.where(F.col("step") >= least).select("word").collect()) if least is not None else []


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, limit: int = LEXICON_WORDS, text: str = "text") -> Lexicon:
    words = [w.encode() for w in frequent_words(docs, vocabulary, limit, text) if w not in vocabulary.special]
    return Lexicon.compile(dict(zip(words, vocabulary.merge(words), strict=True)))


_codecs: dict[tuple[str, bytes], Codec] = {}


def _codec(path: str, packed: bytes) -> Codec:
    key = (path, hashlib.sha256(packed).digest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(path), Lexicon.mapped(packed))
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``ids`` and ``decoded`` too if asked.

    ``path`` must be readable on every worker.  A null or empty text has no ids and decodes to the
    empty text; repeated rows are encoded one by one; the other columns aren't read, so their names
    can't clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(build_lexicon(docs, Vocabulary(path), lexicon_words, text).pack())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int64())), ("decoded", pa.string())], ddl + ", ids array<long>, decoded string"
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, packed.value)
        for batch in batches:
            offsets, _ = texts_of(batch)
            for a, b in slices(offsets, WIDE_SLICE):
                part = batch.slice(a, b - a)
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                decoded = [codec.decode(x) for x in ids]
                more = {"ids": [np.frombuffer(x, "<u4").tolist() for x in ids], "decoded": decoded} if with_ids else {}
                yield batch_of(schema, doc_id=part.column(0), n_tokens=[len(x) // 4 for x in ids], ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids], decoded_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in decoded], **more)

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), encode, ddl)
