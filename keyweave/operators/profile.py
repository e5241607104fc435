"""Profiles of tables, columns and keys, type inference and header detection.

Columns are profiled in long form (column, value), so a wide table costs one shuffle of its distinct
values, summed before they move, and not one distinct aggregate per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.functions.normalize import FALSE_WORDS, TRUE_WORDS, as_text, parse_timestamp, strip, to_float
from keyweave.operators.reconcile import with_row_id

#: Shares of values from which a type is taken.
NUMBER_SHARE, UNIT_SHARE, DATE_SHARE = 0.95, 0.8, 0.8
HEAD = 20


def _values(df: DataFrame, order: bool = False) -> DataFrame:
    """(column, position, value) of every cell; the row's id too for the first rows' sake."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), as_text(F.col(c), df.schema[c].dataType).alias("value")) for i, c in enumerate(df.columns)])
    keep = ["__row_id"] if order else []
    rows = with_row_id(df) if order else df
    return rows.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


def profile_table(df: DataFrame) -> DataFrame:
    """(row_count, column_count, empty_rows, empty_columns, duplicate_rows): every row of a group of equal rows is a duplicate."""
    names = df.columns
    cells = [F.to_json(F.col(f"`{c}`")) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    present = [c.isNotNull() for c in cells]
    # rows are told apart by 128 bits, nulls by their places: whole rows aren't shuffled
    marks = [F.xxhash64(F.lit(seed), *cells, *present).alias(name) for seed, name in ((1, "__a"), (2, "__b"))]
    groups = df.select(*marks, *[x.alias(f"__has{i}") for i, x in enumerate(present)]).groupBy("__a", "__b").agg(F.count("*").alias("__n"), *[F.bool_or(f"__has{i}").alias(f"__has{i}") for i in range(len(names))])
    nothing = ~F.greatest(*[F.col(f"__has{i}").cast("int") for i in range(len(names))], F.lit(0), F.lit(0)).cast("boolean")
    counted = groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(nothing, F.col("__n"))), F.lit(0)).alias("empty_rows"), F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("duplicate_rows"),
        *[F.coalesce(F.bool_or(f"__has{i}"), F.lit(False)).alias(f"__has{i}") for i in range(len(names))],
    )
    empty = sum((F.when(F.col(f"__has{i}"), 0).otherwise(1) for i in range(len(names))), F.lit(0))
    return counted.select(F.col("row_count").cast("long").alias("row_count"), F.lit(len(names)).cast("long").alias("column_count"), F.col("empty_rows").cast("long").alias("empty_rows"), empty.cast("long").alias("empty_columns"), F.col("duplicate_rows").cast("long").alias("duplicate_rows"))


def _looks(value: Column) -> dict[str, Column]:
    text = strip(value)
    bare = F.replace(text, F.lit(","), F.lit(""))
    units = F.regexp_replace(text, r"[^0-9+\-.]", "")
    return {
        "word": F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS), "number": to_float(bare).isNotNull(), "units": to_float(units).isNotNull(),
        "plain": text.rlike(r"^[-+]?\d+(\.\d+)?$"), "date": parse_timestamp(text).isNotNull(), "timed": text.contains(" ") | text.contains("T"),
    }


def _inferred(count: Column, n: dict[str, Column], timed: Column) -> Column:
    share = lambda x: F.try_divide(x.cast("double"), count)
    return (
        F.when(F.coalesce(count, F.lit(0)) == 0, "mixed").when(n["word"] == count, "boolean").when(share(n["number"]) >= NUMBER_SHARE, "number")
        .when((share(n["units"]) >= UNIT_SHARE) & (n["plain"] < count), "unit_number").when(share(n["date"]) >= DATE_SHARE, F.when(timed, "datetime").otherwise("date")).otherwise("text")
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """(position, column, missing_count, missing_rate, unique_count, inferred_type); missing means null and no token.

    A date column is a datetime if one of its first 20 values shows a time, by the rows' order in a Parquet
    table (or the ``__row_no`` of a grid).  Only the cells of date columns are looked at for that; where
    there are none, nothing is read again.
    """
    distinct = _values(df).groupBy("position", "column", "value").agg(F.count("*").alias("n"))
    looks = _looks(F.col("value"))
    full = F.col("value").isNotNull()
    sums = distinct.groupBy("position", "column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("full"), F.count_if(full).alias("unique_count"),
        *[F.coalesce(F.sum(F.when(full & looks[k], F.col("n"))), F.lit(0)).alias(k) for k in ("word", "number", "units", "plain", "date")],
    )
    counts = {k: F.col(k) for k in ("word", "number", "units", "plain", "date")}
    # a row for each column
    dates = sums.where(_inferred(F.col("full"), counts, F.lit(False)) == "date").select("position")
    first = F.row_number().over(Window.partitionBy("position").orderBy("__row_id"))
    head = _values(df, order=True).where(full).join(F.broadcast(dates), "position").withColumn("at", first).where(F.col("at") <= HEAD)
    joined = sums.join(head.groupBy("position").agg(F.bool_or(looks["timed"]).alias("timed")), "position", "left")
    kind = _inferred(F.col("full"), counts, F.coalesce("timed", F.lit(False)))
    missing = F.col("rows") - F.col("full")
    return joined.select("position", "column", missing.cast("long").alias("missing_count"), (missing / F.col("rows")).cast("double").alias("missing_rate"), F.col("unique_count").cast("long").alias("unique_count"), kind.alias("inferred_type"))


def infer_types(df: DataFrame) -> dict[str, str]:
    """The type of each column, for rule defaults."""
    found = {r.position: r.inferred_type for r in profile_columns(df).select("position", "inferred_type").collect()}
    return {c: found.get(i, "mixed") for i, c in enumerate(df.columns)}


def duplicate_keys(df: DataFrame, keys: list[Column], values: list[str] | None = None) -> DataFrame:
    """(k0.., count, variation): keys that aren't blank, how often they stand and how many different value rows they have."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, *[F.col(v).alias(f"v{i}") for i, v in enumerate(values or [])])
    names = [f"k{i}" for i in range(len(keys))]
    for n in names:
        rows = rows.where(F.col(n).isNotNull() & (strip(F.col(n).cast("string")) != ""))
    cells = [f"v{i}" for i in range(len(values or []))]
    return rows.groupBy(*names, *cells).agg(F.count("*").alias("n")).groupBy(*names).agg(F.sum("n").cast("long").alias("count"), (F.count("*") if cells else F.lit(0)).cast("long").alias("variation"))


def profile_duplicates(df: DataFrame, keys: list[Column], values: list[str] | None = None) -> DataFrame:
    """(unique_key_count, duplicate_key_count, max_count, empty_key_count)."""
    per_key = duplicate_keys(df, keys, values)
    counted = per_key.agg(F.count("*").alias("unique_key_count"), F.count_if(F.col("count") > 1).alias("duplicate_key_count"), F.coalesce(F.max("count"), F.lit(0)).alias("max_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("full"))
    total = df.agg(F.count("*").alias("total"))
    return counted.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one").select("unique_key_count", "duplicate_key_count", "max_count", (F.col("total") - F.col("full")).cast("long").alias("empty_key_count"))


def key_diagnostics(a: DataFrame, keys_a: list[Column], b: DataFrame, keys_b: list[Column]) -> DataFrame:
    """(metric, a, b): the key profiles side by side."""
    metrics = ("rows", "unique_key_count", "duplicate_key_count", "max_count", "empty_key_count")

    def long(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
        wide = profile_duplicates(df, keys).withColumn("__one", F.lit(1)).join(df.agg(F.count("*").alias("rows")).withColumn("__one", F.lit(1)), "__one")
        return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(m).cast("long").alias(name)) for i, m in enumerate(metrics)])).alias("x")).select("x.*")

    return long(a, keys_a, "a").join(long(b, keys_b, "b"), ["position", "metric"]).orderBy("position").drop("position")


def header_candidates(grid: DataFrame, row_no: str = "__row_no", limit: int = 5, head: int = HEAD) -> DataFrame:
    """(row_number, score, non_empty): likely header rows of a raw grid's first rows; full rows of different cells score best."""
    cells = [c for c in grid.columns if c != row_no]
    tidy = F.filter(F.array(*[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells]), lambda x: x != "")
    rows = grid.where(F.col(row_no) <= head).select(F.col(row_no).alias("row_number"), tidy.alias("cells"))
    full = F.size("cells")
    score = full + F.size(F.array_distinct("cells")) / F.greatest(full, F.lit(1))
    return rows.select("row_number", score.cast("double").alias("score"), full.alias("non_empty")).orderBy(F.desc("score"), "row_number").limit(limit)
