"""Chat formatting of reply trees, in DataFrame and SQL functions alone.

Root-to-leaf paths are enumerated by self-joins that double their reach: after k joins each leaf
knows its 2**k nearest ancestors, so a tree of depth d takes log d joins, and the rows made are those
of the paths and no more.  Paths are ranked by score and each chosen one becomes one conversation.

A turn is written ``<s>[role]text</s>``.  Inside roles and texts ``\\``, ``<``, ``[`` and ``]`` are
written ``\\-``, ``\\l``, ``\\b`` and ``\\r``, so no control string can stand there, and each reads
back as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.cluster import cut

#: In this order when written, in reverse when read.
_ESCAPES = (("\\", "\\-"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
_OPEN, _MIDDLE, _CLOSE = "<s>[", "]", "</s>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, distance): each leaf with all nodes from it up to its root.

    ``nodes`` has tree, node and parent, without nulls in tree and node.  A parent that isn't in the
    tree reads as none.  A ring of parents is an error.
    """
    links = nodes.select("tree", "node", "parent").where("parent is not null").join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    up = cut(links.select("tree", "node", F.col("parent").alias("up")))
    leaves = nodes.select("tree", "node").join(up.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    reach = [cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")))]
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while True:
        so_far = reduce(DataFrame.unionByName, reach)
        further = cut(so_far.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("distance") + step).alias("distance")))
        if further.isEmpty():
            return so_far
        if step > largest:
            raise ValueError("a node is its own ancestor")
        reach.append(further)
        step *= 2
        again = up.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        up = cut(up.join(again, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))


def best_paths(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, node, position) of the ``keep`` paths of the highest mean score in each tree (None: all), ties to the smaller leaf."""
    paths = reply_paths(nodes)
    rows = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    ranked = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("distance").alias("depth"))
    chosen = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")))
    if keep is not None:
        chosen = chosen.where(F.col("rank") <= keep)
    return paths.join(chosen.select("tree", "leaf", "depth", "rank"), ["tree", "leaf"]).select("tree", "leaf", "rank", "node", (F.col("depth") - F.col("distance")).alias("position"))


def format_trees(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, rank, formatted, loss_spans): one row for each chosen path.

    ``nodes`` has tree, node, parent, score, role and text; null roles and texts read as empty.
    ``loss_spans`` holds start (from 1) and length, in code points of ``formatted``, of the escaped
    assistant texts.
    """
    said = nodes.select("tree", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    rows = best_paths(nodes, keep).join(said, ["tree", "node"])
    piece = F.concat(F.lit(_OPEN), "role", F.lit(_MIDDLE), "text", F.lit(_CLOSE))
    along = Window.partitionBy("tree", "leaf", "rank").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("piece", piece).withColumn("end", F.sum(F.length("piece").cast("long")).over(along))
    learned = F.col("role") == escape(F.lit(LEARNED_ROLE))
    span = F.struct((F.col("end") - len(_CLOSE) - F.length("text") + 1).cast("int").alias("start"), F.length("text").alias("length"))
    made = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("pieces"), F.array_sort(F.collect_list(F.when(learned, span))).alias("loss_spans"))
    return made.select("tree", "rank", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    bodies = F.filter(F.split(formatted, _CLOSE, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        split = F.instr(x, _MIDDLE)
        role = F.substring(x, F.lit(len(_OPEN) + 1), split - len(_OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, split + 1, F.length(x))).alias("text"))

    return F.transform(bodies, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start, s.length))), "")


def conversation_nodes(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations as trees without branches: a row's parent is the row before it by turn, then role and text.

    Rows without a conversation id are one conversation.
    """
    tree = F.coalesce(F.col(conv).cast("string"), F.lit("null"))
    narrow = rows.select(tree.alias("tree"), F.col(turn).alias("turn"), "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("long")
    return narrow.select("tree", number.alias("node"), (number - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): every conversation formatted whole; an empty table gives none.

    Repeated rows are turns of their own; other columns aren't read.
    """
    nodes = cut(conversation_nodes(rows))
    made = format_trees(nodes, keep=1)
    return made.select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), "formatted", "loss_spans")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says when it is read back."""
    turns = read_turns(F.col("formatted"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
