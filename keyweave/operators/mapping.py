"""Key unification: aliases to canonical values, as relations.

A mapping is built from (row_number, canonical, aliases) rows.  Canonical values register themselves;
a value that leads to two canonical values, or a canonical value that is another's alias, is an error
and makes the mapping unusable: chains are never followed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.config import ConfigError, KeyOptions
from keyweave.functions.normalize import as_text, normalize_keys, strip

GROUP_SCHEMA = "row_number long, canonical string, aliases array<string>"
STATS = ("canonical_count", "alias_count", "mapping_item_count", "duplicate_alias_count", "empty_alias_cell_count", "collision_alias_count", "empty_canonical_count", "duplicate_row_count", "aliasless_group_count")
_ISSUE = ("severity", "code", "alias", "canonicals", "row_numbers")


def _empty(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def groups_from_dict(spark: SparkSession, groups: dict[str, list]) -> DataFrame:
    rows = [(i, None if k is None else str(k), [None if v is None else str(v) for v in values]) for i, (k, values) in enumerate(groups.items(), start=2)]
    return spark.createDataFrame(rows, GROUP_SCHEMA)


def groups_from_wide(df: DataFrame, canonical: str, aliases: list[str] | None = None, all_other_columns: bool = False, row_number: str | None = None) -> DataFrame:
    """Groups of a wide table: one canonical column and any number of alias columns."""
    if canonical not in df.columns:
        raise ConfigError("a canonical column must be chosen")
    chosen = [c for c in df.columns if c != canonical and c != row_number] if all_other_columns else [c for c in aliases or [] if c != canonical]
    if missing := [c for c in chosen if c not in df.columns]:
        raise ConfigError(f"no alias column {', '.join(missing)}")
    if not chosen:
        raise ConfigError("an alias column must be chosen")
    text = lambda c: as_text(F.col(c), df.schema[c].dataType)
    number = F.col(row_number).cast("long") if row_number else F.monotonically_increasing_id() + 2
    return df.select(number.alias("row_number"), text(canonical).alias("canonical"), F.array(*[text(c) for c in chosen]).alias("aliases"))


def groups_from_json(spark: SparkSession, payload: str | bytes) -> DataFrame:
    """An object of arrays; anything else is an error."""
    try:
        value = json.loads(payload)
    except (ValueError, UnicodeDecodeError) as error:
        raise ConfigError("the key mapping isn't JSON") from error
    if not isinstance(value, dict) or not all(isinstance(v, list) for v in value.values()):
        raise ConfigError("the key mapping must be an object of arrays")
    return groups_from_dict(spark, value)


def groups_from_text(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """Aliases entered by hand, between commas."""
    return groups_from_dict(spark, {k: [x.strip() for x in v.split(",") if x.strip()] for k, v in entries.items()})


@dataclass
class Mapping:
    """Relations of a mapping: ``registrations`` (one row per canonical or alias), ``pairs``, ``issues``, ``preview`` and ``stats``."""

    groups: DataFrame
    registrations: DataFrame

    @cached_property
    def _targets(self) -> DataFrame:
        r = self.registrations
        raw = r.groupBy("raw").agg(F.count_distinct("raw_canonical").alias("n"))
        # the code depends on whether the alias as normalised was already ambiguous as it was written
        return r.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"), F.array_sort(F.collect_set("row_number")).alias("row_numbers")).join(raw.select(F.col("raw").alias("alias"), (F.col("n") > 1).alias("raw_conflict")), "alias", "left")

    @cached_property
    def _chained(self) -> DataFrame:
        """Canonical values that lead to another one too."""
        known = self.registrations.where("is_canonical").select(F.col("canonical").alias("alias")).distinct()
        return self._targets.join(known, "alias", "left_semi").where(F.exists("canonicals", lambda c: c != F.col("alias")))

    @cached_property
    def pairs(self) -> DataFrame:
        """(alias, canonical) of all that is unambiguous."""
        single = self._targets.where(F.size("canonicals") == 1).select("alias", F.col("canonicals")[0].alias("canonical"))
        return single.join(self._chained.select("alias"), "alias", "left_anti")

    @cached_property
    def issues(self) -> DataFrame:
        g, r = self.groups, self.registrations
        none, no_names = F.lit(None).cast("string"), F.array().cast("array<string>")

        def issue(df: DataFrame, severity: str, code, alias, canonicals, rows) -> DataFrame:
            code = F.lit(code) if isinstance(code, str) else code
            return df.select(F.lit(severity).alias("severity"), code.alias("code"), alias.alias("alias"), canonicals.alias("canonicals"), rows.cast("array<long>").alias("row_numbers"))

        row = F.array("row_number")
        usable = g.where("standard is not null")
        found = [
            issue(g.where("standard is null"), "warning", "EMPTY_CANONICAL", none, no_names, row),
            issue(usable.where(F.size("named") == 0), "warning", "ALIASLESS_GROUP", none, F.array("canonical"), row),
            issue(usable.groupBy("canonical", "signature").agg(F.array_sort(F.collect_list("row_number")).alias("rows")).where(F.size("rows") > 1), "warning", "DUPLICATE_ROW", none, no_names, F.col("rows")),
            issue(r.groupBy("alias", "canonical").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("row_number")).alias("rows")).where("n > 1"), "warning", "DUPLICATE_ALIAS", F.col("alias"), F.array("canonical"), F.col("rows")),
            issue(self._targets.where(F.size("canonicals") > 1), "error", F.when(F.coalesce("raw_conflict", F.lit(False)), "ALIAS_CONFLICT").otherwise("NORMALIZED_ALIAS_CONFLICT"), F.col("alias"), F.col("canonicals"), F.col("row_numbers")),
            issue(self._chained, "error", "CANONICAL_ALIAS_CONFLICT", F.col("alias"), F.array_sort(F.array_union("canonicals", F.array("alias"))), F.col("row_numbers")),
        ]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def applicable(self) -> bool:
        return self.issues.where("severity = 'error'").isEmpty()

    @cached_property
    def preview(self) -> DataFrame:
        """(alias, canonical) once each, as first registered."""
        first = F.min_by(F.struct("raw", "raw_canonical", "is_canonical", "row_number"), F.struct("row_number", "position"))
        return self.registrations.groupBy("alias", "canonical").agg(first.alias("f")).select("alias", "canonical", "f.*")

    @cached_property
    def stats(self) -> DataFrame:
        """One row of counters."""
        g, r = self.groups, self.registrations
        usable = F.col("standard").isNotNull()
        unnamed = F.size("aliases") - F.size("named")
        one = g.agg(F.count_distinct("standard").alias("canonical_count"), F.count_if(~usable).alias("empty_canonical_count"), F.count_if(usable & (F.size("named") == 0)).alias("aliasless_group_count"), F.coalesce(F.sum(F.when(usable, unnamed)), F.lit(0)).alias("unnamed"), F.coalesce(F.sum(F.when(usable, F.size("named"))), F.lit(0)).alias("all_named"))
        two = r.agg(F.count_if(~F.col("is_canonical")).alias("alias_count"))
        more = lambda df, name: df.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias(name))
        three = more(r.groupBy("alias", "canonical").agg(F.count("*").alias("n")), "duplicate_alias_count")
        four = more(g.where(usable).groupBy("canonical", "signature").agg(F.count("*").alias("n")), "duplicate_row_count")
        five = self.pairs.agg(F.count("*").alias("mapping_item_count"))
        bad = self._targets.where(F.size("canonicals") > 1).select("alias").unionByName(self._chained.select("alias")).distinct()
        six = bad.agg(F.count("*").alias("collision_alias_count"))
        # aliases that only normalisation leaves empty count as empty cells too
        parts = [one, two, three, four, five, six]
        wide = parts[0].withColumn("__one", F.lit(1))
        for p in parts[1:]:
            wide = wide.join(p.withColumn("__one", F.lit(1)), "__one")
        return wide.withColumn("empty_alias_cell_count", F.col("unnamed") + F.col("all_named") - F.col("alias_count")).select(*[F.col(c).cast("long").alias(c) for c in STATS])


def build(groups: DataFrame, options: KeyOptions, assume_ascii: bool = False) -> Mapping:
    """A mapping of (row_number, canonical, aliases) rows; ``assume_ascii`` says that no text is beyond ASCII.

    The texts of a group are normalised together, so that a task has one Python worker beside it where a
    Python step is needed, whatever is asked of the mapping.
    """
    used = SimpleNamespace(**vars(options), assume_ascii=assume_ascii)
    tidy = groups.withColumn("named", F.filter("aliases", lambda a: ~_empty(a))).withColumn("signature", F.transform("aliases", lambda a: F.when(_empty(a), "").otherwise(a)))
    tidy = tidy.withColumn("told", F.concat(F.array("canonical"), "named"))
    tidy = tidy.withColumn("normal", normalize_keys(F.coalesce("told", F.array("canonical")), used)).withColumn("standard", F.get("normal", F.lit(0)))
    tidy = tidy.withColumn("standard", F.when(~_empty(F.col("canonical")) & ~_empty(F.col("standard")), F.col("standard")))
    usable = tidy.where("standard is not null").select("row_number", F.col("canonical").alias("raw_canonical"), F.col("standard").alias("canonical"), F.arrays_zip(F.col("told").alias("raw"), F.col("normal").alias("alias")).alias("texts"))
    rows = usable.select("row_number", "raw_canonical", "canonical", F.posexplode("texts").alias("position", "r"))
    registered = rows.select("row_number", "raw_canonical", "canonical", "position", F.col("r.raw").alias("raw"), (F.col("position") == 0).alias("is_canonical"), F.col("r.alias").alias("alias")).where(~_empty(F.col("alias")))
    return Mapping(tidy.drop("told", "normal"), registered)


def build_mapping(spark: SparkSession, groups: dict[str, list] | DataFrame, options: KeyOptions) -> Mapping:
    """A mapping of a table of groups, or of a dictionary; where all of that is ASCII, no Python step is in the plan."""
    if isinstance(groups, DataFrame):
        return build(groups, options)
    plain = all(str(x).isascii() for k, values in groups.items() for x in (k, *values))
    return build(groups_from_dict(spark, groups), options, assume_ascii=plain)


def applied(df: DataFrame, key: str, mapping: Mapping, standard: str, canonical: str) -> DataFrame:
    """``df`` with the canonical value of ``key`` (null where there is none) and the standard key.

    A left join whose right side has one row per alias; Spark broadcasts it while it is small.
    """
    pairs = mapping.pairs.select(F.col("alias").alias("__alias"), F.col("canonical").alias(canonical))
    return df.join(pairs, F.col(key) == F.col("__alias"), "left").drop("__alias").withColumn(standard, F.coalesce(canonical, key))


def application_stats(df: DataFrame, key: str, canonical: str) -> DataFrame:
    """(unique_key_count, mapped_key_count, unmapped_key_count, mapping_rate) over distinct keys that aren't empty."""
    unique = df.where(~_empty(F.col(key))).groupBy(key).agg(F.bool_or(F.col(canonical).isNotNull()).alias("m"))
    counted = unique.agg(F.count("*").alias("unique_key_count"), F.count_if("m").alias("mapped_key_count"))
    return counted.select("*", (F.col("unique_key_count") - F.col("mapped_key_count")).alias("unmapped_key_count"), F.coalesce(F.try_divide(F.col("mapped_key_count") * 100.0, F.col("unique_key_count")), F.lit(0.0)).alias("mapping_rate"))


def to_json(groups: DataFrame) -> str:
    """Groups as an object of arrays, merged by canonical value; the mapping file, so small by nature."""
    merged: dict[str, list] = {}
    for r in groups.where(~_empty(F.col("canonical"))).orderBy("row_number").select("canonical", F.filter("aliases", lambda a: ~_empty(a)).alias("aliases")).toLocalIterator():
        merged.setdefault(r.canonical, []).extend(r.aliases)
    return json.dumps(merged, ensure_ascii=False, indent=2)


