import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute import components, contamination, line_dedup, substring_dedup, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyweave.llm import bpe, decontaminate, flac, induced, jaccard, language, licenses, toxicity
from keyweave.llm import line_dedup as lines
from keyweave.llm import suffix_dedup as suffixes
from keyweave.llm.induced import Suffixes, joined
from keyweave.llm.textkit import ALNUM, NOT_SPACE, Words, shingle_sets

SCHEMA = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def passage(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, ties, repeats, other scripts, one very long text."""
    rng = random.Random(4)
    base = passage(rng, 120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "two words"), (6, base), (7, base), (8, base.replace("w1 ", "W1 ", 1)), (9, base + " tail"), (10, "Zürich ☃ 日本 🙂 " * 30), (11, "a" * 900), (12, "x\0y " * 120), (13, passage(rng, 4000)), (14, "\n".join(["same line here"] * 12)), (15, base[:300] + passage(rng, 30) + base[300:600])]
    return rows


# --- words and sets ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_and_sets(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = Words(data, offsets, ALNUM)
    for i, r in enumerate(raw):
        mine = [bytes(found.lower[a:b]) for a, b in zip(found.start[found.of[i] : found.of[i + 1]], found.stop[found.of[i] : found.of[i + 1]], strict=True)]
        assert mine == words(r.decode())
    from brute import shingles

    at, _ = shingle_sets(Words(data, offsets, NOT_SPACE), 5)
    assert np.diff(at).tolist() == [len(shingles(r.decode())) for r in raw]


def test_words_have_different_hashes():
    pairs = [("".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))) for n in (2, 64, 1024, 4096, 1 << 15)]
    texts = [x.encode() for pair in pairs for x in pair] + [b"a", b"aa", b"b" * 70_000]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    found = Words(data, np.array([0, len(data)]), ALNUM)
    again = Words(np.frombuffer(b"x " + texts[4], np.uint8), np.array([0, 2, 2 + len(texts[4])]), ALNUM)
    assert len(set(found.hash.tolist())) == len(texts) and again.hash[1] == found.hash[4]


# --- 1: BPE ---


def test_bpe_like_the_library(spark, odd):
    rows = [*odd, (20, "a<|endoftext|>b <|endoftext|>"), (21, "don't  stop\r\n\r\n  '"), (22, "x" * 300 + " y" * 50), (None, "no id")]
    library = Tokenizer.from_file(PATH)
    out = bpe.encode_documents(table(spark, rows).withColumn("n_tokens", F.lit("clash")), PATH, with_ids=True, lexicon_words=40).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=9), max_size=60), st.lists(st.binary(max_size=9), max_size=20))
def test_lexicon(known, asked):
    entries = {w: hashlib.md5(w).digest()[: 4 * (len(w) % 3 + 1)] for w in known}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(entries).pack())
    questions = [*known, *asked]
    assert lexicon.find(questions) == [entries.get(w) for w in questions]


def test_lexicon_shares_suffixes():
    lexicon = bpe.Lexicon.compile({w: b"1234" for w in (b"walking", b"talking", b"walked", b"talked")})
    assert len(lexicon.final) == 9


# --- 2: lines ---


def test_line_dedup(spark, odd):
    rng = random.Random(1)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = odd + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(60)]
    clashing = ("n_lines", "N_REMOVED", "__id", "__print", "__spans", "__body", "first", "a")
    docs = table(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashing})
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", *clashing, "n_lines_1", "n_removed_1"]
    expected = line_dedup(rows)
    for r in out.collect():
        assert (r.text or "") == expected[r.doc_id] and all(r[c] == f"{c}{r.doc_id}" for c in clashing)
        assert r.n_removed_1 == (0 if r.text == dict(rows)[r.doc_id] else r.n_lines_1 - len(r.text.split("\n")) if r.text else r.n_removed_1)
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert lines.dedup_lines(docs.select("doc_id", "text")).columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_line_dedup_without_ids(spark):
    text = "a\nb\nc"
    kept = {(r.doc_id, r.text) for r in lines.dedup_lines(table(spark, [(None, text), (1, text)])).collect()}
    assert kept == {(None, text), (1, "")}


# --- 3: Jaccard ---


def test_jaccard_components(spark, odd):
    rng = random.Random(2)
    rows = list(odd)
    for g in range(6):
        base = passage(rng, rng.choice([5, 8, 40, 150])).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
            rows.append((1000 + len(rows), " ".join(copy)))
    rows += [(r, passage(rng, 30)) for r in range(2000, 2030)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert found == dict(zip((d for d, _ in rows), components(rows), strict=True))


def test_jaccard_edges(spark):
    same = "a b c d e f"
    docs = spark.createDataFrame([(7, same, 1), (7, same, 2), (3, same, 3), (None, same, 4), (5, None, 5), (None, "", 6)], "doc_id long, text string, component_id int")
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect() if r.doc_id is not None)
    assert found == [(3, 2, 3), (5, 0, 5), (7, 2, 3), (7, 2, 3)]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.component_id for r in kept.collect()) == [3, 5, 6]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_tree_bounds_keep_every_partner():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 60, rng.integers(5, 900), dtype=np.uint64)
        for _ in range(3):
            keep = base[rng.random(len(base)) > 0.1]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 60, len(base) // 12, dtype=np.uint64)))))
    vectors = [np.frombuffer(jaccard.count_vector(s), "<u2").astype(np.int64) for s in sets]
    points, sizes = np.stack([jaccard.folded(v, jaccard.GROUPS) for v in vectors]), np.array([len(s) for s in sets])
    tree = jaccard.RTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], sizes[i], 80).tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert jaccard.bound(vectors[i], vectors[j]) >= both
            if 100 * both >= 80 * (len(s) + len(t) - both):
                assert j in near


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    rng = random.Random(8)
    base = passage(rng, 60).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert found == dict(zip(range(40), components(rows), strict=True))


def test_tiles_that_cannot_link_are_not_opened(spark, monkeypatch):
    """Of 40 tiles, 20 of one size and apart in their coordinates and 20 of growing sizes, only a few pairs are left, all with partners among them."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    rows = []
    for family in range(40):
        for k in range(4):
            vector = np.zeros(jaccard.GROUPS, np.int64)
            if family < 20:
                vector[3 * family : 3 * family + 3] = 16
            else:
                vector[:] = 2 * int(1.3 ** (family - 20)) + 10
            rows.append((family * 4 + k, int(vector.sum()), vector.astype("<u2").tobytes()))
    points = spark.createDataFrame(rows, "node long, n long, vector binary")
    placed, corners = jaccard._tiles(points.select(F.lit(7).cast("long").alias("middle"), "node"), points)
    assert corners.count() >= 40 and placed.count() == 160
    where = {r.node: r.tile for r in placed.collect()}
    pairs = {(r.i, r.j) for r in jaccard._tile_pairs(corners, 80).collect()}
    assert len(pairs) < 150 < 40 * 41 // 2
    for family in range(40):
        tiles = {where[family * 4 + k] for k in range(4)}
        assert all((min(a, b), max(a, b)) in pairs for a in tiles for b in tiles)


# --- 4: substrings ---


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_induced_sorting(data):
    """With all in memory, and with queues, sorts, texts and orders on disk and every level of the recursion."""
    letters = data.draw(st.sampled_from([b"a", b"ab", b"abcd \n"]))
    pieces = data.draw(st.lists(st.lists(st.sampled_from(list(letters)), max_size=60).map(bytes), min_size=1, max_size=5))
    depth = data.draw(st.integers(1, 20))
    text, starts = joined(np.frombuffer(p, np.uint8) for p in pieces)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(induced, "BASE", data.draw(st.sampled_from([0, 4, 1 << 13])))
        found = Suffixes(text, depth, memory=data.draw(st.sampled_from([8, 100, 1 << 20]))).repeated()
    from collections import Counter

    seen = Counter(p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1))
    for p, s in zip(pieces, starts.tolist(), strict=True):
        assert [bool(found[s + i]) for i in range(len(p) - depth + 1)] == [seen[p[i : i + depth]] > 1 for i in range(len(p) - depth + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.sampled_from([4, 64, 1 << 20]), st.sampled_from([0, 3, 1 << 13]))
def test_recursion_sorts_all_suffixes(values, memory, base):
    import bisect

    ordered = sorted(values)
    names = np.array([bisect.bisect_left(ordered, x) for x in values])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(induced, "BASE", base)
        assert induced.sorted_names(names, False, 10**6, memory).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_long_runs_and_periods():
    pieces = [b"a" * 3000, b"ab" * 2000 + b"c", b"xyz" * 900, b"b" + b"a" * 700 + b"c", b"q" * 200, b"ab" * 60]
    text, starts = joined(np.frombuffer(p, np.uint8) for p in pieces)
    for memory in (64, 1 << 20):
        found = Suffixes(text, 200, memory).repeated()
        seen = {}
        for p in pieces:
            for i in range(len(p) - 199):
                seen[p[i : i + 200]] = seen.get(p[i : i + 200], 0) + 1
        for p, s in zip(pieces, starts.tolist(), strict=True):
            assert [bool(found[s + i]) for i in range(len(p) - 199)] == [seen[p[i : i + 200]] > 1 for i in range(len(p) - 199)]


def test_common_lengths_are_fetched_sixteen_bytes_at_once():
    """And no further than ``depth``; each exact."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, 900, dtype=np.uint8)
    other = base.copy()
    other[[300, 417, 640]] ^= 3
    text, starts = joined(iter([base, other]))
    sorter, fetched = Suffixes(text, 200), []

    class Counted:
        def __init__(self, array):
            self.array = array

        def __getitem__(self, places):
            fetched.append(len(places))
            return self.array[places]

    sorter.words, sorter.pairs = Counted(sorter.words), Counted(sorter.pairs)
    at = np.arange(900)
    found = sorter._common(at + starts[0], at + starts[1])
    expected = [next((k for k in range(200) if i + k >= 900 or base[i + k] != other[i + k]), 200) for i in range(900)]
    assert np.minimum(found, [900 - i for i in range(900)]).tolist() == expected and len(fetched) <= 2 * 13


def test_a_shard_larger_than_memory_stays_on_disk():
    """Text, queues, runs, names, orders and marks are in files: in memory are under two bytes for each of the text, where one array of places alone has eight."""
    import tracemalloc

    rng = np.random.default_rng(19)
    base = rng.integers(97, 123, 3_000_000, dtype=np.uint8)
    text, starts = joined(iter([base, rng.integers(97, 123, 1_500_000, dtype=np.uint8), base[100_000:600_000]]))
    del base
    tracemalloc.start()
    found = Suffixes(text, 200, memory=1 << 14).repeated()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(found, np.memmap) and int(found.sum()) == 2 * (500_000 - 199) and peak < 2 * len(text)


LIMITS = [{}, {"split_bytes": 500}, {"split_bytes": 0, "shard_bytes": 1, "memory": 64}, {"shard_bytes": 3000, "memory": 500}]


@pytest.mark.parametrize("limits", LIMITS)
def test_suffix_dedup(spark, odd, monkeypatch, limits):
    """Also where every anchor is cut further, and where next to nothing may stay in memory."""
    monkeypatch.setattr(induced, "BASE", 16)
    rng = random.Random(5)
    shared = passage(rng, 90)
    rows = odd + [(100 + i, passage(rng, 20) + shared[rng.randrange(200) : rng.randrange(250, 500)] + passage(rng, 20)) for i in range(25)] + [(200, "ab" * 400), (201, "é" * 300), (202, shared[:199]), (203, shared[:200])]
    out = suffixes.dedup_substrings(table(spark, rows).withColumn("n_bytes", F.lit("clash")), with_spans=True, **limits).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert found == dict(zip((d for d, _ in rows), substring_dedup([t for _, t in rows]), strict=True))
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in out)


def test_suffix_dedup_repeated_rows_and_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    rng = random.Random(6)
    text = passage(rng, 500)
    rows = [(1, text), (2, passage(rng, 400) + text[500:1500]), (None, text[100:400])]
    found = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_substrings(table(spark, rows)).collect())
    assert found == sorted(substring_dedup([t for _, t in rows]))
    twice = suffixes.dedup_substrings(table(spark, [(1, text), (1, text)])).collect()
    assert [(r.n_removed, r.n_spans) for r in twice] == [(len(text), 1)] * 2
    assert suffixes.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sorted_neighbours_decide_what_is_repeated(spark, monkeypatch):
    """Without the sort nothing is removed, and where two places of one hash differ all of them are sorted."""
    rng = random.Random(77)
    base = passage(rng, 300)
    rows = [(1, base), (2, base), (3, base + " tail " + passage(rng, 200)), (4, passage(rng, 200) + base[:900]), (5, base), (5, base), (6, "x" * 500), (7, None)]
    kept = [(r.doc_id, r.n_removed) for r in suffixes.dedup_substrings(table(spark, rows)).collect()]
    assert all(n > 0 for i, n in kept if i < 7)
    calls = []

    def none(bodies, *more):
        calls.append(bodies.count())
        return bodies.select("id", "print", F.col("first").alias("start"), F.col("first").alias("stop")).where("false")

    monkeypatch.setattr(suffixes, "_sorted_shards", none)
    assert {r.n_removed for r in suffixes.dedup_substrings(table(spark, rows)).collect()} == {0}
    assert len(calls) == 2 and all(calls)


# --- 5: licenses ---


def test_license_base_and_labels(spark):
    texts = ["Licensed under CC-BY 4.0; cc by, CC/by", "GNU General Public\nLicense. All Rights Reserved!", None, "", "general public", "x " * 50 + "Licensed under the Apache License, Version 2.0. y", "Released under the MIT License.", "released the license mit under", "cc 日 by", "by cc by"]
    out = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        w, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.encode().split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert out[1].labels == "gpl,reserved" and out[2].labels == "" and out[5].labels == "apache-2.0" and out[6].labels == out[7].labels == "mit"


# --- 6: decontamination ---


@pytest.mark.parametrize("room", [500_000, 3])
def test_decontamination(spark, odd, room):
    rng = random.Random(9)
    items = [(1, passage(rng, 20)), (2, passage(rng, 13)), (10, "One, two THREE"), (11, "one two three"), (12, None), (13, "!!"), (None, "four five")]
    texts = [t for _, t in odd] + [passage(rng, 50) + " " + items[0][1] + " " + passage(rng, 60), items[1][1].upper(), "zero one two, three four", passage(rng, 400) + " one two three", " ".join(items[0][1].split()[:12]), items[0][1] + " " + items[0][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(table(spark, list(enumerate(texts))), benchmark, broadcast_windows=room).collect()}
    expected = contamination(texts, [x for x in items if x[0] is not None])
    assert out == dict(enumerate(expected))
    docs = table(spark, list(enumerate(texts))).withColumn("contaminated", F.lit("clash"))
    kept = decontaminate.remove(docs, benchmark, broadcast_windows=room)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in enumerate(expected) if not x[4]}


@pytest.mark.parametrize("room", [500_000, 0])
def test_decontamination_spans(spark, odd, room):
    rng = random.Random(10)
    items = [(1, "b c"), (1, "b c"), (2, passage(rng, 30)), (None, "tail end")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*odd, (50, "A, b C. d"), (50, "A, b C. d"), (51, "b"), (52, passage(rng, 200) + " b c"), (53, "é " + items[2][1] + " tail, END b"), (None, items[2][1] * 2)]
    clashing = ("__k", "__l", "__spans", "k", "n_words", "__text_key")
    docs = table(spark, rows).withColumns({c: F.lit(c) for c in clashing})
    out = decontaminate.remove(docs, benchmark, what="spans", broadcast_windows=room)
    assert out.columns == docs.columns
    windows = {tuple(w[i : i + 13]) for _, t in items for w in [words(t)] for i in range(max(len(w) - 13, 0) + 1)}
    expected = []
    for i, text in rows:
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
        if hit and 20 * len(hit) >= len(w):
            from brute import ALNUM as WORD
            from brute import LOWER

            raw, kept, last = text.encode(), b"", 0
            for number, m in enumerate(WORD.finditer(raw.translate(LOWER))):
                if number in hit:
                    kept, last = kept + raw[last : m.start()], m.end()
            text = (kept + raw[last:]).decode("utf-8", "replace")
        expected.append((str(i), str(text)))
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted(expected)
    assert ("50", "A,  . d") in expected and all(r[c] == c for r in out.limit(3).collect() for c in clashing)


def test_decontamination_empty(spark):
    benchmark = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    docs = table(spark, [(1, "A, b C. d")])
    assert decontaminate.scan(docs, benchmark.limit(0)).first().contaminated is False
    assert decontaminate.scan(docs.limit(0), benchmark).count() == 0


# --- 7: FLAC ---


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.randoms(use_true_random=False), st.sampled_from([1, 2, 20, 256])), min_size=1, max_size=5))
def test_flac_round_trip(streams):
    payloads = [bytes(rng.randrange(spread) * (255 // max(spread - 1, 1)) for _ in range(192 * n)) for n, rng, spread in streams]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads
    assert [b"".join(p for _, p in flac.blocks(m, 500)) for m in media] == payloads


def test_flac_of_ours_by_plain_reader():
    import brute

    rng = random.Random(15)
    payloads = [bytes(rng.randrange(spread) for _ in range(192 * n)) for n, spread in ((1, 256), (4, 3), (7, 60), (3, 1))] + [("plain words " * 64).encode()]
    for payload, media in zip(payloads, flac.encode(payloads), strict=True):
        samples, bits = brute.read_flac(media)
        assert bits == 8 and bytes(v + 128 for v in samples[0]) == payload


WAYS = {
    "fixed 2, 8 partitions": (2, 0, 3, False, 0, ()), "fixed 4, wide": (4, 0, 2, True, 0, ()), "raw partitions": (1, 0, 2, False, 0, (1, 3)), "raw, wide": (0, 0, 1, True, 0, (0,)), "wasted": (1, 0, 1, False, 2, ()),
    "linear 3": ([9000, -3000, 200], 13, 3, False, 0, ()), "linear 12": ([700 * (-1) ** i for i in range(12)], 14, 0, True, 1, ()), "fixed 0": (0, 0, 4, False, 0, ()), "verbatim": ("verbatim",), "constant": ("constant",), "order fills a partition": (3, 0, 6, False, 0, ()),
}


def wave(rng, n, width, wasted=0, constant=False):
    top = 1 << (width - 1)
    x, v = [], rng.randrange(-top // 2, top // 2)
    for _ in range(n):
        v = v if constant else max(-top, min(top - 1, v + rng.randrange(-top // 50 - 2, top // 50 + 2))) if rng.random() > 0.02 else rng.randrange(-top, top)
        x.append(v >> wasted << wasted)
    return x


@pytest.mark.parametrize(("width", "seek"), [(8, ()), (16, (0, 3)), (24, ())])
def test_flac_of_others(width, seek):
    """Streams by the plain writer, without a seek table or with a sparse one, are read as by the plain reader."""
    import brute

    rng = random.Random(width)
    streams = []
    for channels, variable in ((1, True), (2, False), (3, False)):
        frames = []
        for i, (name, how) in enumerate(WAYS.items()):
            n = 192 if not variable else rng.choice([192, 576, 384, 320])
            wasted = how[4] if len(how) > 4 else 0
            samples = [wave(rng, n, width, wasted, name == "constant") for _ in range(channels)]
            code = rng.choice([1, 8, 9, 10]) if channels == 2 and name != "wasted" and "12" not in name else channels - 1
            side = code >= 8 and name == "constant"
            frames.append((samples, channels - 1 if side else code, [how] * channels))
        streams.append(brute.write_flac(frames, width, channels, variable=variable, seek=seek, md5=channels < 3))
    for stream, pcm in zip(streams, flac.decode(streams), strict=True):
        samples, bits = brute.read_flac(stream)
        plain = b"".join((v + 128).to_bytes(1, "big") if bits == 8 else v.to_bytes(bits + 7 >> 3, "little", signed=True) for row in zip(*samples, strict=True) for v in row)
        assert pcm == plain and flac.decode([stream]) == [plain]
        step = len(samples) * (bits + 7 >> 3)
        for start, stop in ((0, 50), (700, 1300), (577, 578), (1700, None)):
            parts = list(flac.blocks(stream, 100, start, stop))
            whole = plain[start * step :] if stop is None else plain[start * step : stop * step]
            assert b"".join(p for _, p in parts) == whole and [a for a, _ in parts] == list(range(start, start + len(whole) // step, 100))


def test_blocks_touch_only_their_frames():
    import brute

    rng = random.Random(17)
    payload = bytes(rng.randrange(90) for _ in range(192 * 60))
    for media in (flac.encode([payload])[0], brute.write_flac([([[b - 128 for b in payload[i : i + 192]]], 0, [WAYS["fixed 2, 8 partitions"]]) for i in range(0, len(payload), 192)], 8, 1, seek=tuple(range(0, 60, 6)))):
        info = flac.info_of(media)
        low = max(p for p in info.points if p[0] <= 3000)[1]
        high = min(p for p in info.points if p[0] >= 3600)[1]
        broken = bytearray(media)
        for at in [*range(info.audio, info.audio + low), *range(info.audio + high, len(media))]:
            broken[at] ^= 0x55
        assert b"".join(p for _, p in flac.blocks(bytes(broken), 250, 3000, 3600)) == payload[3000:3600]
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_headers_inside_frames():
    """A frame that holds a whole frame of the next number as samples is read as one frame."""
    import brute

    rng = random.Random(18)
    inner = brute.write_flac([([wave(rng, 16, 8)], 0, [("verbatim",)])] * 2, 8, 1)
    hidden = next(inner[i:] for i in range(50, len(inner)) if inner[i : i + 2] == b"\xff\xf8" and inner[i + 4] == 1)
    samples = [b - 256 if b > 127 else b for b in hidden] + wave(rng, 192 - len(hidden), 8)
    outer = brute.write_flac([([samples], 0, [("verbatim",)]), ([wave(rng, 192, 8)], 0, [("verbatim",)])], 8, 1)
    found = brute.read_flac(outer)[0][0]
    assert flac.decode([outer]) == [bytes(v + 128 for v in found)] and found[:192] == samples


def test_flac_checks_sums():
    (media,) = flac.encode([bytes(range(192)) * 4])
    for at in (len(media) - 1, len(media) - 40, 60, 30):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_frame_numbers():
    assert [flac._frame_number(n).hex() for n in (0, 127, 128, 2047, 2048, 65536)] == ["00", "7f", "c280", "dfbf", "e0a080", "f0908080"]


def test_media_columns(spark, odd):
    import binascii

    made = flac.media_columns(table(spark, odd).withColumn("feature", F.lit("clash")), with_media=True)
    texts = dict(odd)
    seen = {}
    for r in made.collect():
        payload = flac.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(payload)) and len(payload) % 192 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == binascii.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media) and flac.decode([bytes(r.media)]) == [payload]
        assert seen.setdefault(texts[r.doc_id] or "", tuple(r)[1:]) == tuple(r)[1:]
    blocks = flac.pcm_blocks(made, block=1000)
    assert blocks.groupBy("doc_id").agg(F.sum(F.length("pcm")).alias("n")).join(made, "doc_id").where("n <> payload_bytes").count() == 0


# --- 8 and 9: classifiers ---


def corpus(rng, per=60):
    """Texts of three made-up languages that share letters: each has words of its own, some far more frequent than others."""
    stems = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "fr": "es le de en re nt on er ent ou la qu ai eu ment ion aux que eau oi".split(), "de": "en er ch ei ie in te de ge un ich sch ung heit keit lich au st be ver".split()}
    rows = []
    for lang, parts in stems.items():
        vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
        weights = [1 / (k + 1) for k in range(300)]
        for _ in range(per):
            rows.append((len(rows), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(30, 150))), lang))
    return rows


def test_language(spark, monkeypatch):
    rows = corpus(random.Random(11))
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "12 ?!", "en"), (None, "the then", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    assert out[9001].lang_pred == out[9002].lang_pred == "und" and out[9001].score == 0.0 and out[None].held_out is False
    tested = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert len(tested) > 20 and sum(a == b for a, b in tested) / len(tested) > 0.95
    import binascii

    assert all(out[i].held_out == (binascii.crc32(str(i).encode()) % 4 == 2) and 0 <= out[i].score <= 1 for i, _, _ in rows)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="over 2 languages"):
        language.identify(docs)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_language_like_plain_sizes(spark):
    """Ties, repeats, very long and one-word texts, null ids and clashing columns, against sizes taken one by one."""
    import brute

    rng = random.Random(13)
    rows = corpus(rng)
    twin = [(7000 + i, rows[i][1], f"copy-{rows[i][2]}") for i in range(len(rows))]
    texts = [rows[0][1], rows[0][1], rows[70][1] * 400, "a", "th er", "x " * 20_000, "日本 語", "1 2", "", None, rows[5][1][:60]]
    docs = spark.createDataFrame([*rows, *twin, *((9000 + i, t, None) for i, t in enumerate(texts)), (None, rows[3][1], "en")], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("lang_pred", "held_out", "id", "h", "t", "n")})
    content = language.training_sample(docs)
    assert content == language.training_sample(docs.repartition(5)) and len(content) == 6
    out = sorted(((r.doc_id, r.lang_pred, r.score, r.rejected) for r in language.identify(docs).collect() if r.doc_id is not None and r.doc_id >= 9000))
    assert out == [(9000 + i, *x) for i, x in enumerate(brute.languages(content, texts, language.SHORT_BYTES, language.PIECE_BYTES))]
    assert len([r for r in language.identify(docs).collect() if r.doc_id is None]) == 1


def test_toxicity_like_plain_walk(spark):
    """Scores of odd rows against features, trees and calibration taken one text and one node at a time."""
    rng = random.Random(14)
    rows = [(i, passage(rng, 40, 300) + (" you dimwit BLOCKHEAD!" if i % 4 == 0 else " you are fine.")) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, "DIMWIT " * 30_000), (1003, rows[0][1]), (1003, rows[0][1]), (None, "d1mw1t you"), (1004, "¡tú! " * 3)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = table(spark, [*rows, *odd]).withColumns({c: F.lit("clash") for c in ("score", "toxic", "sample_id", "part", "held_out")})
    model = toxicity.train(docs, labels)
    features = toxicity.Features(model.lexicon)

    def plain(text):
        x = features([text or ""])[0]
        raw = model.trees.start
        for feature, cuts, leaf in model.trees.trees:
            node = 0
            for level in range(model.trees.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + int(feature[at] >= 0 and x[feature[at]] > cuts[at])
            raw += leaf[node]
        knots = list(zip(model.calibration.x.tolist(), model.calibration.y.tolist(), strict=True))
        if raw <= knots[0][0]:
            return knots[0][1]
        for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
            if raw <= x1:
                return y0 + (raw - x0) / (x1 - x0) * (y1 - y0)
        return knots[-1][1]

    def counted(text):
        """Three features said plainly: density of learned words, share of capitals, exclamation marks a word."""
        parts = (text or "").split()
        hits = sum(any(k in model.lexicon for k in toxicity.keys_of(toxicity.bare(w))) for w in parts)
        return [hits / max(len(parts), 1), sum("A" <= c <= "Z" for c in text or "") / max(len((text or "").encode()), 1), (text or "").count("!") / max(len(parts), 1)]

    texts = [t for _, t in odd]
    names = [toxicity.FEATURES.index(x) for x in ("density", "capitals", "exclamations")]
    assert np.allclose(features([t or "" for t in texts])[:, names], [counted(t) for t in texts])
    out = toxicity.score_documents(docs, labels).collect()
    found = sorted(((str(r.doc_id), round(r.score, 9), r.predicted) for r in out if r.doc_id is None or r.doc_id >= 1000))
    assert found == sorted((str(i), round(plain(t), 9), int(plain(t) >= 0.5)) for i, t in odd)
    assert model.lexicon and len(out) == len(rows) + len(odd) and toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    rng = random.Random(12)
    insults = ["jerkface", "dimwit", "blockhead", "numbskull"]
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = passage(rng, rng.randrange(30, 90), 900).split()
        for _ in range(rng.randrange(2, 6) if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(insults) + rng.choice(["", "!", "s"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    docs = table(spark, [*rows, (5000, None), (5001, ""), (None, "x")])
    labels = spark.createDataFrame([*marks, (7777, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs.withColumn("score", F.lit("clash")), labels).collect()}
    tested = [(out[i].predicted, bad) for i, bad in marks if out[i].held_out]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert out[5000].score == out[5001].score < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted} and kept.columns == docs.columns
    blind = toxicity.score_documents(docs, labels.limit(0))
    assert blind.count() == len(out) and toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    fitted = toxicity.Isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float))
    y = fitted(np.linspace(-4, 4, 200))
    assert (np.diff(y) >= -1e-12).all() and y[0] < 0.2 < 0.8 < y[-1]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    assert (((toxicity.Boosted().fit(x, y).raw(x) > 0) == y).mean()) > 0.98
