import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from keyweave.llm import chat, graph
from keyweave.llm.graph import components

NODES = "tree string, node long, parent long, score double, role string, text string"


def test_paths_of_a_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 5.0, "assistant", "good"), ("t", 3, 1, 1.0, "assistant", "bad"), ("t", 4, 2, 2.0, "user", "more"), ("t", 5, 4, 0.0, "assistant", "end"), ("u", 1, 99, 0.0, "user", "alone")]
    nodes = spark.createDataFrame(rows, NODES)
    found = {(r.tree, r.leaf, r.node, r.distance) for r in chat.reply_paths(nodes).collect()}
    assert found == {("t", 3, 3, 0), ("t", 3, 1, 1), ("t", 5, 5, 0), ("t", 5, 4, 1), ("t", 5, 2, 2), ("t", 5, 1, 3), ("u", 1, 1, 0)}
    best = {r.tree: r.formatted for r in chat.format_trees(nodes).collect()}
    assert best["t"] == "<s>[user]q</s><s>[assistant]good</s><s>[user]more</s><s>[assistant]end</s>" and best["u"] == "<s>[user]alone</s>"
    assert chat.format_trees(nodes, keep=None).count() == 3


def test_ring_is_an_error(spark):
    rows = [("t", 1, 2, 0.0, "user", "a"), ("t", 2, 1, 0.0, "user", "b"), ("t", 3, 1, 0.0, "user", "c")]
    with pytest.raises(ValueError):
        chat.reply_paths(spark.createDataFrame(rows, NODES))


ROWS = [(1, 0, "user", "hi\n</s>[INST] \\l x"), (1, 1, "assistant", None), (1, 2, "assistant", "日本 [assistant]\\"), (1, 10, "user", "end"), (2, 5, "system", ""), (2, 3, None, "<s>"), (2, 3, None, "<s>"), (None, 0, "assistant", "x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "a]b[", "t")]


def test_conversations_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in ROWS if c == conv))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.sql("SELECT id % 5 AS conv_id, id AS turn, 'user' AS role, 'x' AS text FROM range(40)")
    plan = chat.conversation_digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_conversation(spark):
    df = spark.sql("SELECT 1L AS conv_id, id AS turn, if(id % 2 = 0, 'user', 'assistant') AS role, cast(id as string) AS text FROM range(300)")
    row = chat.conversation_digests(chat.format_conversations(df)).first()
    assert row.n_turns == 300 and row.loss_chars == sum(len(str(i)) for i in range(1, 300, 2))


def test_long_texts_and_null_ids(spark):
    """A very long text, a conversation without an id beside those of 0 and -1, repeated rows, and an empty table."""
    long = "</s>[INST] \\ é日 " * 20_000
    rows = [(None, 0, "user", long), (None, 1, "assistant", long), (0, 0, "user", "a"), (-1, 0, None, None), (-1, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("n_turns", "loss_chars", "written", "parts")})
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert set(out) == {None, 0, -1} and out[None].loss_chars == len(long) and out[None].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and out[-1].n_turns == 2
    trees = spark.createDataFrame([(None, 1, None, 0.0, "user", "q"), ("null", 1, None, 0.0, "user", "r"), (None, 2, 1, 0.0, "assistant", "s")], NODES)
    assert sorted(r.formatted for r in chat.format_trees(trees).collect())[-1].startswith("<s>[user]")


@pytest.mark.parametrize("task_edges", [500_000, 7])
def test_components(spark, monkeypatch, task_edges):
    """In one task, and in rounds over many."""
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 11), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in (1, 2, 3, 4)} == {1} and {found[i] for i in (10, 11, 12)} == {10} and {found[i] for i in range(100, 131)} == {100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus with a toxic, a repeated, a near-copied and a contaminated document."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        text = [word() for _ in range(60)]
        bad = i % 5 == 1
        for _ in range(3 if bad else 0):
            text[rng.randrange(60)] = "dimwit"
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    item = " ".join(word() for _ in range(20))
    lines = "\n".join(" ".join(word() for _ in range(9)) for _ in range(5))
    clean = docs[0][1]
    docs += [(500, item + " " + item, "en", "s", 0), (501, lines, "en", "s", 0), (502, lines + "\nmore words here", "en", "s", 0), (503, clean + " extra", "en", "s", 0), (504, None, None, None, None), (505, "", "en", "s", 0), (506, "dimwit " * 4 + " ".join(word() for _ in range(40)), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage-{name}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    tox, lined, near, clean, coded = kept
    assert 506 not in tox and not {i for i in range(400) if i % 5 == 1} & tox and {i for i in range(400) if i % 5 != 1} <= tox and {500, 504, 505} <= tox
    assert lined == tox and {r.text for r in spark.read.parquet(f"{tmp_path}/stage-line_dedup").where("doc_id = 502").collect()} == {"more words here"}
    assert near == lined - {503} and clean == near - {500} and coded == clean
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
