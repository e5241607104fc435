"""Each test fails where an operator does less than the whole job."""

import binascii
import hashlib
import random

import pytest
from brute import shingles, words
from keyweave.llm import decontaminate, jaccard, language, licenses, toxicity

SCHEMA = "doc_id long, text string"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def passage(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 3: Jaccard ---


def links(texts):
    sets = [shingles(t) for t in texts]
    return [sum(1 for j, t in enumerate(sets) if j != i and s & t and 100 * len(s & t) >= 80 * len(s | t)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("tile", [256, 4])
def test_all_links_are_counted(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(21)
    texts = [None, "", "one", "one", passage(rng, 900)]
    for n in (8, 60, 60, 200):
        base = passage(rng, n).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(n)] = f"e{rng.randrange(9)}"
            texts.append(" ".join(copy))
    texts += [texts[-1], texts[-1]] + [passage(rng, 30) for _ in range(10)]
    expected = links(texts)
    assert max(expected) > 9
    found = {r.doc_id: r.n_links for r in jaccard.jaccard_components(table(spark, list(enumerate(texts)))).collect()}
    assert found == dict(enumerate(expected))


@pytest.mark.parametrize("size", [1024, 4096])
def test_strings_that_fool_powers_of_two(spark, size):
    one = "".join("ab"[i.bit_count() & 1] for i in range(size))
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " and four more words"
    rows = [(1, one), (2, other), (3, one + tail), (4, other + tail), (5, one)]
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_components(table(spark, rows)).collect()} == {1: (1, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (1, 1)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(table(spark, rows)).collect()) == [1, 2, 3, 4]


def test_unlinked_rows_without_or_with_one_id_stay(spark):
    rng = random.Random(22)
    a, b, c, d, e, f = (passage(rng, 40) for _ in range(6))
    rows = [(None, a), (None, b), (None, b + " tail"), (5, c), (5, d), (5, d), (1, e), (2, e + " tail"), (1, f), (0, f + " tail")]
    kept = [r.text for r in jaccard.one_of_each(table(spark, rows)).collect()]
    assert len(kept) == 6 and {a, c, d, e, f + " tail"} < set(kept) and len({b, b + " tail"} & set(kept)) == 1


# --- 6: decontamination ---


@pytest.mark.parametrize("room", [500_000, 0])
def test_items_without_id_hit(spark, room):
    benchmark = spark.createDataFrame([(None, "four five"), (None, "six seven"), (3, "eight nine")], "item_id long, text string")
    docs = table(spark, [(1, "a four five"), (2, "six seven, four five; eight nine"), (3, "five four")])
    out = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(docs, benchmark, broadcast_windows=room).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert out == {1: (3, 2, 1, digest(""), True), 2: (6, 6, 2, digest("3"), True), 3: (2, 0, 0, digest(""), False)}
    assert [r.doc_id for r in decontaminate.remove(docs, benchmark, broadcast_windows=room).collect()] == [3]


# --- 5: licenses ---


def expected_licenses(text, templates, threshold=0.8):
    """Labels and the largest share over all runs, by sets."""
    w, labels, score = [x.decode() for x in words(text)], set(), 0.0
    sets = {k: set(t.split()) for k, t in templates.items()}
    for name, tokens in sets.items():
        label = name.split("#")[0]
        telling = tokens - set().union(*(x for k, x in sets.items() if k.split("#")[0] != label))
        run = -(-3 * len(templates[name].split()) // 2)
        for b in range(len(w)):
            held = set(w[b : b + run])
            share = len(tokens & held) / len(tokens)
            if share >= threshold and len(telling & held) >= threshold * len(telling):
                labels.add(label)
                score = max(score, share)
    return labels, score


def test_licenses_in_all_runs(spark):
    rng = random.Random(23)
    small = {"one": "a b c d e", "two": "a b c d f g", "three": "x y", "four": "a b c d", "long": " ".join(f"v{i}" for i in range(40)) + " a b c"}
    pool = sorted({w for t in small.values() for w in t.split()})
    texts = [None, "", "a", "a b c d e", "x X y", *("pad " * k + "a n1 b n2 c d n3 e f" for k in range(9)), small["long"], small["long"] + " " + small["one"], "a b c d " * 30]
    texts += [" ".join(rng.choice(pool) if rng.random() < rng.choice([0.5, 0.9]) else f"n{rng.randrange(99)}" for _ in range(rng.randrange(90))) for _ in range(150)]
    body = small["long"].split()
    for _ in range(40):
        copy = [x for x in body if rng.random() < 0.85]
        for _ in range(rng.randrange(30)):
            copy.insert(rng.randrange(len(copy)), f"n{rng.randrange(99)}")
        texts.append("lead " * rng.randrange(40) + " ".join(copy) + " trail" * rng.randrange(40))
    docs = table(spark, list(enumerate(texts))).withColumns({c: licenses.F.lit("clash") for c in ("labels", "score", "n_words")})
    for threshold in (0.8, 0.6, 1.0):
        out = {r.doc_id: r for r in licenses.scan_licenses(docs, small, threshold).collect()}
        for i, text in enumerate(texts):
            assert (set(out[i].labels.split(",")) - {""}, out[i].score) == expected_licenses(text, small, threshold)
    repeated = licenses.scan_licenses(table(spark, [(1, "X, y")] * 3 + [(None, "x y")]), small).collect()
    assert [(r.labels, r.score) for r in repeated] == [("three", 1.0)] * 4
    assert licenses.scan_licenses(docs.limit(0), small).count() == 0


def test_published_licenses(spark):
    rng = random.Random(29)
    texts = []
    whole = {k: v for k, v in licenses.TEMPLATES.items() if "#" not in k}
    for body in whole.values():
        copy = body.split()
        for _ in range(len(copy) // 10):  # names and bullets between its words, and words that are lost
            copy.insert(rng.randrange(len(copy)), "Name")
            copy.pop(rng.randrange(len(copy)))
        texts.append("pad " * rng.randrange(900) + " ".join(copy).upper() + " end" * rng.randrange(900))
    plain = ["released under the apache license", "This text is released under the GPL license, the end", "Licensed under CC-BY 4.0", "Released under the ISC License.", "the software is provided as is without warranty of any kind " * 20, passage(rng, 3000)]
    out = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(enumerate(texts + plain)))).collect()}
    for i, label in enumerate(whole):
        assert set(out[i].labels.split(",")) - set(licenses.PHRASES.values()) == {label}
        assert expected_licenses(texts[i], licenses.TEMPLATES)[0] == {label}
    for i in range(len(texts), len(texts + plain)):
        assert out[i].labels == out[i].base_labels


def test_sentences_and_spdx_lines_name_a_license(spark):
    named = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "released under the MIT license": "mit", "This work is licensed under the GNU General Public License, version 3": "gpl-notice",
        "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "# SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: GPL-3.0-only": "gpl-notice",
        "released under the apache license": "", "released under the license": "", "licensed under CC BY": "", "SPDX-License-Identifier: XYZ": "", "mit der Lizenz unter dem the license": "",
    }
    texts = [f"{'pad ' * 40}{x} {'end ' * 40}" for x in named]
    out = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    assert {x: ",".join(sorted(set(out[i].labels.split(",")) - set(licenses.PHRASES.values()))) for i, x in enumerate(named)} == named
    plain = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(enumerate(texts))), telling=False).collect()}
    i = list(named).index("released under the apache license")
    assert out[i].met_labels == plain[i].met_labels == plain[i].labels == "mit" and all(set(out[i].labels.split(",")) - set(licenses.PHRASES.values()) <= set(out[i].met_labels.split(",")) | {""} for i in out)


def test_sql_of_licenses(spark, tmp_path):
    import duckdb

    from keyweave.llm import queries

    rng = random.Random(31)
    body = licenses.TEMPLATES["mpl-2.0"]
    texts = [None, "", body, "x " * 70 + body + " cc by", body.replace("mozilla", "other").replace("mpl", "lpm"), licenses.TEMPLATES["cc-by-nc-4.0"], "General Public License " * 2, body[:60]]
    texts += [" ".join(w for w in body.split() if rng.random() < 0.85) for _ in range(12)]
    table(spark, [*enumerate(texts), (1, body)]).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op5_license_scan"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    said = con.execute(queries.ORACLE_SQL["op5_license_scan"]).df()
    rows = lambda frame: sorted(map(str, frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    assert rows(found.astype({"first_word": float, "last_word": float})) == rows(said.astype({"first_word": float, "last_word": float})) and found.labels.str.contains("mpl").sum() > 3


# --- 8: language ---


def test_no_language_is_dropped_or_cut_by_a_rare_one(spark):
    rng = random.Random(24)
    learned = [i for i in range(900) if binascii.crc32(str(i).encode()) % 4 != 2]
    long = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(700)) for _ in range(6)]
    rows = [(learned[i], x, "en") for i, x in enumerate(long)] + [(learned[10], "stray", "xx")]
    content = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {len(x) for x in content.values()} == {len(content["en"])} and len(content["en"]) > 20_000
    many = [(learned[100 + i], f"some text {i}", f"l{i}") for i in range(80)] + [(learned[100], f"copy {k}", "l0") for k in range(300)]
    assert len(language.training_sample(spark.createDataFrame(many, "doc_id long, text string, lang string"), texts=1)) == 80


# --- 9: toxicity ---


def test_copies_of_a_labelled_row_teach_nothing_more(spark):
    rng = random.Random(25)
    rows = [(i, passage(rng, 40, 900) + (" dimwit blockhead" if i % 4 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    copies = [rows[i] for i in range(300) if i % 4] * 8
    one, other = (toxicity.train(table(spark, x), labels, rows=400) for x in (rows, rows + copies))
    assert one.lexicon == other.lexicon and one.trees.start == other.trees.start and len(one.trees.trees) == len(other.trees.trees) > 0
    assert one.calibration.y.tolist() == other.calibration.y.tolist()
