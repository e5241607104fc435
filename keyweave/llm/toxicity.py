"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that stand in toxic documents far more often than
in others.  Features are its densities, how near its words stand to words of the second person,
capitals, punctuation and obfuscated words.  The labelled sample is bounded by ``SAMPLE_ROWS``: of
repeated ids one row stays, the first by a hash of its text.  The lexicon, the trees and the calibration each have a part of it to themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut
from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

#: Labelled rows that are learned from at most, the first by a hash of the id.
SAMPLE_ROWS = 12_000
#: Words and beginnings that the lexicon holds at most, the most telling ones.
LEXICON_KEYS = 2_000
PREFIXES = (4, 5, 6)
NEAR_WORDS = 4
HELD_WORDS = 300_000
#: Words of the second person in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus vuestro".split())
#: Signs that stand for letters.
_STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("density", "weight", "hits", "strongest", "near_density", "near_hits", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "digits", "log_words")


def held_out(id_column, modulus: int = 5, remainder: int = 0):
    """Fixed rule: rows whose labels aren't learned from."""
    return F.crc32(F.col(id_column).cast("string")) % modulus == remainder


def bare(word: str) -> str:
    """Lower case without signs at its ends; signs and digits inside read as the letters they stand for."""
    word = word.strip("\"'.,;:!?()[]{}<>*#&%$|-_/\\~`").lower()
    if word.isalpha():
        return word
    if any(c.isalpha() for c in word):
        return "".join(c for c in word.translate(_STANDS_FOR) if c.isalpha())
    return ""


def keys_of(word: str) -> list[str]:
    """The word, and its beginnings where it goes on."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)] if word else []


def labelled_sample(labels: DataFrame, id_column: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(sample_id, toxic, part): parts 0-4 for the lexicon, 5-8 for the trees, 9 and 10 for the calibration."""
    usable = labels.where(F.coalesce(~held_out(id_column), F.lit(False)) & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("sample_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("sample_id").cast("string"))
    return usable.withColumn("h", order).orderBy("h", "sample_id").limit(rows).select("sample_id", "toxic", F.pmod(F.shiftright("h", 20), F.lit(11)).alias("part"))


def _key_counts(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return batch_of(schema, key=names, pos=[seen[1][x] for x in names], neg=[seen[0][x] for x in names])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {bare(w) for w in set((text or "").split())}
                seen[toxic].update({k for w in words for k in keys_of(w)})
                if len(seen[0]) + len(seen[1]) > HELD_WORDS:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    return map_batches(rows, count, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(rows: DataFrame, limit: int = LEXICON_KEYS) -> dict[str, float]:
    """Weights of the ``limit`` keys that tell toxic texts most; (text, toxic) in, cautious log odds out."""
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    # a standard error below: a key that only a few texts speak for counts less
    sure = odds - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = _key_counts(rows).withColumn("odds", sure).where((F.col("pos") >= 4) & (F.col("odds") >= 1)).orderBy((F.col("odds") * F.sqrt("pos")).desc(), "key").limit(limit).collect()
    return {r.key: round(float(r.odds), 6) for r in best}


class Features:
    """Dense features of whole texts; what a word says is kept for the words that come again."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 5))

    def _learn(self, words: list[str]) -> None:
        n = len(self.known)
        if n + len(words) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((n + 2 * len(words), 5))))
        for i, word in enumerate(words, n):
            plain = bare(word)
            weight = max((self.lexicon.get(k, 0.0) for k in keys_of(plain)), default=0.0)
            inner = word.strip("\"'.,;:!?()[]{}-")
            odd = bool(plain) and not inner.replace("-", "").replace("'", "").isalpha() and not inner.replace(".", "").isdigit()
            self.table[i] = weight, plain in SECOND_PERSON, len(plain) > 2 and inner.isupper(), odd, any(c.isdigit() for c in word)
            self.known[word] = i

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces = [x.split() for x in texts]
        if len(self.known) > HELD_WORDS:
            self._clear()
        self._learn(list(set().union(*pieces) - self.known.keys()))
        out = np.zeros((len(texts), len(FEATURES)))
        look = self.known.__getitem__
        for i, (text, words) in enumerate(zip(texts, pieces, strict=True)):
            n = len(words)
            if not n:
                continue
            weight, second, shouted, odd, digit = self.table[np.fromiter(map(look, words), np.int64, n)].T
            hit = weight > 0
            hits = np.flatnonzero(hit)
            near = 0
            if len(hits) and second.any():
                people = np.flatnonzero(second)
                slot = np.searchsorted(people, hits)
                gap = np.minimum(np.abs(people[np.minimum(slot, len(people) - 1)] - hits), np.abs(people[np.maximum(slot - 1, 0)] - hits))
                near = int((gap <= NEAR_WORDS).sum())
            raw = np.frombuffer(text.encode(), np.uint8)
            upper = int(((raw > 64) & (raw < 91)).sum())
            marks = int((((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))).sum())
            out[i] = len(hits) / n, weight.sum() / n, math.log1p(len(hits)), weight.max(), near / n, math.log1p(near), upper / len(raw), shouted.sum() / n, marks / len(raw), text.count("!") / n, odd.sum() / n, digit.sum() / n, math.log1p(n)
        return out


class Boosted:
    """Trees of depth 3 on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 60, rate: float = 0.15, bins: int = 48, depth: int = 3, smooth: float = 1.0):
        self.rounds, self.rate, self.bins, self.depth, self.smooth = rounds, rate, bins, depth, smooth
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = math.log(share / (1 - share))
        if len(y) < 2 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = y - p, p * (1 - p)
            feature = np.full((1 << self.depth) - 1, -1)
            cut = np.zeros((1 << self.depth) - 1)
            leaf = np.zeros(1 << self.depth)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(1 << level):
                    here = node == k
                    g, h = gradient[here], curve[here]
                    if len(g) < 16:
                        continue
                    base = g.sum() ** 2 / (h.sum() + self.smooth)
                    best = (1e-6, -1, 0)
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[here, f], g, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[here, f], h, len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.smooth) - base
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (float(gain[b]), f, b)
                    if best[1] >= 0:
                        at = (1 << level) - 1 + k
                        feature[at], cut[at] = best[1], cuts[best[1]][best[2]]
                right = np.zeros(len(y), np.int64)
                for k in range(1 << level):
                    at = (1 << level) - 1 + k
                    if feature[at] >= 0:
                        here = node == k
                        right[here] = x[here, feature[at]] > cut[at]
                node = 2 * node + right
            for k in range(1 << self.depth):
                here = node == k
                if here.any():
                    leaf[k] = self.rate * gradient[here].sum() / (curve[here].sum() + self.smooth)
            score += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                f = feature[at]
                node = 2 * node + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
            score += leaf[node]
        return score


class Isotonic:
    """Pooled adjacent violators; between its steps the value is interpolated."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, count, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([float(b), 1.0, a])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        # a little towards the middle, so that no score is certain
        self.y = np.array([(p[0] + 0.01) / (p[1] + 0.02) for p in pools])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1) if len(self.x) else 1 / (1 + np.exp(-x))


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def scorer(self):
        features = Features(self.lexicon)
        return lambda texts: self.calibration(self.trees.raw(features(texts)))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents; its sample alone is broadcast, with ids and labels only."""
    sample = labelled_sample(labels, id_column, label, rows)
    rows_of = docs.select(F.col(id_column).alias("sample_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "sample_id")
    # one row of each id, so that the sample is bounded whatever the ids
    chosen = cut(rows_of.groupBy("sample_id", "toxic", "part").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    lexicon = learn_lexicon(chosen.where("part < 5").select("text", "toxic"))
    schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32()), ("part", pa.int64())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            x = features([t or "" for t in batch.column(0).to_pylist()])
            yield batch_of(schema, x=list(x), toxic=batch.column(1), part=batch.column(2))

    found = map_batches(chosen.where("part >= 5").select("text", "toxic", "part"), describe, "x array<double>, toxic int, part long").orderBy("x", "toxic", "part").collect()
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in found], float)
    fit = np.array([r.part < 9 for r in found], bool)
    trees = Boosted().fit(x[fit], y[fit])
    return Model(lexicon, trees, Isotonic(trees.raw(x[~fit]), y[~fit]))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts have features of 0 and get the score of those; a null id isn't held out.
    Without labels the score is that of an even guess.
    """
    model = train(docs, labels, id_column, text, label, rows)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            offsets, _ = texts_of(batch)
            for a, b in slices(offsets, WIDE_SLICE):
                part = batch.slice(a, b - a)
                s = scorer([x or "" for x in part.column(2).to_pylist()])
                yield batch_of(schema, doc_id=part.column(0), held_out=part.column(1), score=s, predicted=(s >= 0.5).astype(np.int32))

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_batches(narrow, score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without rows whose score reaches ``threshold``; columns and other rows stay as they are.

    Null and empty texts are scored as texts of no words and so stay or go alike; each of repeated rows
    has the same fate; other columns aren't read, whatever their names; an empty table stays empty.
    """
    model = train(docs, labels, id_column, text, label, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            offsets, _ = texts_of(batch, text)
            for a, b in slices(offsets, WIDE_SLICE):
                part = batch.slice(a, b - a)
                s = scorer([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])
                yield part.filter(pa.array(s < threshold))

    return map_batches(docs, keep, docs.schema)
