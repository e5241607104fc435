"""Alignment of two tokenizers, filter audit, main text of pages."""

import random

import public_tokenizers
import pytest
from brute import alignment, article, audit
from keyweave.llm import alignment as aligner
from keyweave.llm import pages
from keyweave.llm.alignment import align_documents, spans
from keyweave.llm.audit import audit_filters, audit_orders
from keyweave.llm.pages import extract_pages, main_text

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


# --- 11: alignment ---


def texts():
    rng = random.Random(11)
    letters = [*"ab ,.'s>)}-_09\n\r\t\x1c\x85\xa0 　▁é́日\U0001f642ǅ", "<|endoftext|>", "</s>", "<0x41>", "foo", "the ", ");\r\n", "  ", "ſ,", "ƀ,"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(400)]
    out += [None, "", " ", "\n", "same text, twice", "same text, twice", "a" * 3000, "é" * 900, "x;" * 700, "word " * 2000]
    return out + [" ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ",", ".", "%%%"]) for _ in range(rng.randrange(300))) for _ in range(30)]


@pytest.mark.parametrize(("shared", "held"), [(1 << 20, 1 << 21), (40, 1 << 21), (0, 100)])
def test_alignment(spark, monkeypatch, shared, held):
    monkeypatch.setattr(aligner, "HELD_PAIRS", held)
    rows = texts() if shared == 1 << 20 else texts()[-60:]
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in align_documents(df, A, B, shared_pairs=shared).collect()}
    assert found == dict(enumerate(alignment(rows, A, B)))


def test_alignment_edges(spark, monkeypatch):
    monkeypatch.setattr(aligner, "HELD_PIECES", 5)
    monkeypatch.setattr(aligner, "WIDE_GROUP", 0)
    rows = [(1, "some words, some more"), (1, "some words, some more"), (None, "more words"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as pair", "2 as n_a", "3 as held")
    found = align_documents(df, A, B, with_groups=True)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    expected = dict(zip(rows, alignment([t for _, t in rows], A, B), strict=True))
    got = found.collect()
    assert sorted(tuple(r)[1:8] for r in got) == sorted(alignment([t for _, t in rows], A, B)) and len(expected) == 4
    assert {r.groups.count(";") + 1 if r.groups else 0 for r in got} == {r.n_groups for r in got}
    assert align_documents(df.where("false"), A, B).count() == 0


def test_spans_end_at_labels_of_both():
    assert spans(b"nacbcc").tolist() == [3, 5, 6] and spans(b"").tolist() == []


# --- 12: audit ---


def test_audit(spark):
    rng = random.Random(12)
    bodies = [None, "", "A", "x # y", " ".join(f"w{i}" for i in range(220)), "word " * 250, "Up Up Up " + " ".join(f"v{i}" for i in range(300)), "\x0b tab\tand\nline   ", "\x1cnot\x1cspace"]
    rows = [(i if i != 7 else None, rng.choice(bodies), rng.choice(["a", "b", None, ""])) for i in range(90)] + [(None, bodies[4], "a"), (3, bodies[4], "b"), (3, bodies[4], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "2 as step", "3 as good", "4 as first").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit_filters(docs, marks)
    assert sorted(map(tuple, found.collect())) == audit(rows, labels)
    assert audit_filters(docs.where("false"), marks).count() == 0 and audit_filters(docs, marks.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def test_orders_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit_orders(cells, "XY").collect()}
    assert found == {("XY", 1): (5, 2, 0, 0, 1, 1, 2), ("XY", 2): (5, 0, 2, 0, 0, 0, 2), ("YX", 1): (5, 2, 0, 0, 1, 1, 2), ("YX", 2): (5, 0, 2, 0, 0, 0, 2)}
    with pytest.raises(ValueError, match="seven"):
        audit_orders(cells, "AA")


# --- 13: pages ---


def test_pages_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in table.collect())
    assert sorted(tuple(r)[:4] for r in extract_pages(table).collect()) == expected


@pytest.mark.parametrize("container", ["div", "section", "td"])
def test_rules_without_article_elements(spark, container):
    """Labels rest on the rules alone: nearly all text of the articles is found, and nothing else."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    right = lost = extra = 0
    for r in table.collect():
        plain = r.html
        for name in ("article", "nav", "footer"):
            plain = plain.replace(f"<{name}>", f"<{container}>").replace(f"</{name}>", f"</{container}>")
        want, got = article(r.html).split("\n\n"), main_text(plain)[0].split("\n\n")
        right += len(set(want) & set(got))
        lost += len(set(want) - set(got))
        extra += len(set(got) - set(want))
    assert lost <= right // 20 and extra == 0


LONG = "The committee met on Tuesday to discuss the plan for the new bridge, which will be built over the river in the spring of next year if the weather is good and the funds are there. It was the third meeting on this."
MORE = "Most of the people who spoke were in favour of it, but some had doubts about the cost and the time that it would take to build, and asked for a second opinion from an engineer who had not been part of the work so far."


def test_a_page_of_everything():
    page = f"""<!doctype html><html><head><title>T</title><style>x</style></head><body class="has-sidebar ads">
<div id="cookie-banner"><p>{MORE}</p><button>OK</button></div><header><h1><a href=/>Site</a></h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="sidebar"><h3>Related</h3><p>{MORE}</p></div><div id="content"><h2>The bridge</h2><p>{LONG}<p>He agreed.</p><blockquote>{MORE}</blockquote><ul><li>one</li><li>two</li></ul>
<div class="advert">{LONG}</div><form action=/s><label>Search</label><textarea>abc</textarea><p>Sign up for news.</p></form><p>AT&amp;T&nbsp;said &lt;b&gt; &amp;amp; x<br>y<br><br>z<!-- no <p> --></p></div>
<div id="comments"><h3>2 comments</h3><article class="comment"><p>{LONG}</p></article></div><p hidden>{LONG}</p><footer><p>{MORE}</p>&copy; 2024</footer><script>if (a < b) w("<p>no</p>")</script></body></html>"""
    assert main_text(page)[0].split("\n\n") == ["The bridge", LONG, "He agreed.", MORE, "one", "two", "AT&T said <b> &amp; x y", "z"]


def test_short_blocks_take_their_neighbours_labels():
    assert main_text(f"<p>{LONG}</p><p>Yes.</p><p>{MORE}</p>")[0] == f"{LONG}\n\nYes.\n\n{MORE}"
    assert main_text(f"<p>{LONG}</p><p>Yes.</p><div>© Foo</div>")[0] == f"{LONG}\n\nYes."
    menu = "<div>" + "".join(f"<a href=/{i}>Item {i}</a> " for i in range(9)) + "</div>"
    assert main_text(f"{menu}<div>Yes.</div>{menu}<p>{LONG}</p>")[0] == LONG
    assert main_text(f"{menu}<h2>Title</h2><p>{LONG}</p><h2>Links</h2>{menu}")[0] == f"Title\n\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("hello", "hello"), ("<p>a<b>b</b>c", "abc"), ("<nav>x", ""), ("a < b and c > d", "a < b and c > d"), ("<p>x<!-- c", "x"), ("<p>x<a hr", "x"), ("<p title='>'>x</p>", "x"), ("<div>&am", "&am"), ("<script>x", ""),
     ("<article><header><h1>Title</h1></header><p>x</p><aside>no</aside></article>", "Title\n\nx"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("</p></div>x", "x"), ("<p>\x00x\n\t y</p>", "\x00x y")],
)
def test_odd_pages(page, text):
    assert main_text(page)[0] == text


def test_pages_that_nest_or_repeat_without_end():
    import time

    began = time.perf_counter()
    for part in ("<", "<div>", "<a b='", "<!--", "&amp", "<p><b>", "<br>", '<a title="x', "</p>"):
        main_text(part * 20_000)
    assert time.perf_counter() - began < 20


def test_page_rows(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, "v", "<article>" + f"<p>{LONG}</p>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(df).collect()))
    assert [x[0] for x in found] == [0, 1, 1, 2] and found[0][1] == "" and found[3][1] == "\n\n".join([LONG] * 5000) and all(len(t) == n for _, t, n in found)
    assert extract_pages(df.where("false")).count() == 0 and pages.STOP_WORDS
