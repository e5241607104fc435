"""Which documents each of five filters takes, in every order of the filters.

A document's failures are five bits.  Documents are added up by part and bits first, so the audit
works on 32 cells a part whatever their number.  Each cell is unpivoted against the steps of all
orders; a running bit-or over the earlier steps says what has failed before, conditional sums give
each step's counts, and a window over all orders gives each filter's total.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.cluster import cut
from keyweave.llm.textkit import fresh

#: The five filters, in this order from the lowest bit on.
FILTERS = "ABCDE"
_SPACE = " \t\n\x0b\f\r"


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: too short, too repetitive, capitals, control marks."""
    words = F.split(F.trim(text, F.lit(_SPACE)), r"[ \t-\r]+")
    n = F.size(words) - (F.trim(text, F.lit(_SPACE)) == "").cast("int")
    distinct = F.size(F.array_distinct(words)) - (F.trim(text, F.lit(_SPACE)) == "").cast("int")
    capitals = F.length(text).cast("long") - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = (n < 200, 100 * distinct.cast("long") < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0)).cast("int")


def document_cells(docs: DataFrame, labels: DataFrame, part: str = "source", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure bits, with those of quality 1 and of toxic 1.

    E is decided over the whole table: of equal texts only the one of the smallest id passes.  A row
    without an id has no smaller one and is smaller than none, so it never fails E.  A null text is
    empty, a null part the empty string.  Rows that repeat an id stay rows; an id that is labelled
    more than once is good, or toxic, if any of its labels says so.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(body).alias("mask"), F.sha2(body, 256).alias("content"))
    rows = cut(rows.groupBy("id", "part", "mask", "content").agg(F.count("*").alias("n")))
    first = rows.where("id is not null").groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marked = marked.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.where("id is not null").join(first, ["id", "content"], "left").join(marked, "id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"), "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    unknown = rows.where("id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    all_rows = known.unionByName(unknown)
    return all_rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of ``filters``.

    A part's cells stand in one task, at most 2**len(filters) of them; each part has a row for every
    order and step, zeros included.  An empty table gives no rows.
    """
    if not filters or len(set(filters)) != len(filters) or len(filters) > 7:
        raise ValueError("between one and seven filters, each named once")
    bits = {x: 1 << i for i, x in enumerate(filters)}
    names = fresh(cells.columns, "filter_order", "step", "bit", "earlier")
    order, step, bit, earlier = names
    steps = F.array(*[F.struct(F.lit("".join(p)).alias("o"), F.array(*[F.lit(bits[x]) for x in p]).alias("b")) for p in permutations(filters)])
    # parts are dealt once; the windows and sums below need no other shuffle
    dealt = cells.repartition("part").withColumn("way", F.explode(steps))
    long = dealt.select("part", "mask", "n", "good", "toxic", F.col("way.o").alias(order), F.posexplode("way.b").alias(step, bit)).withColumn(step, F.col(step) + 1)
    before = Window.partitionBy("part", "mask", order).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn(earlier, F.coalesce(F.bit_or(F.col(bit).bitwiseAND(F.col("mask"))).over(before), F.lit(0)))
    fails, untouched = F.col("mask").bitwiseAND(F.col(bit)) != 0, F.col(earlier) == 0

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")

    counted = long.groupBy("part", order, step, bit).agg(
        total("n", untouched & ~fails).alias("kept"), total("n", untouched & fails).alias("removed"), total("n", ~untouched & fails).alias("redundant"),
        total("n", F.col("mask") == F.col(bit)).alias("unique_fails"), total("good", untouched & fails).alias("good_lost"), total("toxic", untouched & fails).alias("toxic_lost"),
    )
    counted = counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", bit)))
    return counted.select("part", F.col(order).alias("filter_order"), F.col(step).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over whole documents."""
    return audit_orders(cut(document_cells(docs, labels, part)))
