import pytest
from pyspark.sql import functions as F

from keyweave.config import ConfigError, KeyOptions
from keyweave.operators import mapping, profile

FOLD = KeyOptions(case_insensitive=True)


def codes(built):
    return sorted((r.code, r.alias) for r in built.issues.select("code", "alias").collect())


def test_wide_table(spark):
    df = spark.createDataFrame([("A", "a1", None, " "), ("B", "b1", "b2", "b3")], "canon string, x string, y string, z string")
    built = mapping.build(mapping.groups_from_wide(df, "canon", all_other_columns=True), FOLD)
    assert {(r.alias, r.canonical) for r in built.pairs.collect()} == {("a", "a"), ("a1", "a"), ("b", "b"), ("b1", "b"), ("b2", "b"), ("b3", "b")}
    assert built.stats.first().empty_alias_cell_count == 2
    assert mapping.build(mapping.groups_from_wide(df, "canon", ["x"]), FOLD).pairs.count() == 4
    for bad in ({"canonical": "nope"}, {"canonical": "canon"}, {"canonical": "canon", "aliases": ["nope"]}):
        with pytest.raises(ConfigError):
            mapping.groups_from_wide(df, **bad)


@pytest.mark.parametrize(
    ("groups", "expected"),
    [({"A": ["x"], "B": ["x"]}, [("ALIAS_CONFLICT", "x")]), ({"A": ["x"], "B": ["X"]}, [("NORMALIZED_ALIAS_CONFLICT", "x")]), ({"A": ["B"], "B": ["y"]}, [("CANONICAL_ALIAS_CONFLICT", "b"), ("NORMALIZED_ALIAS_CONFLICT", "b")])],
)
def test_conflicts(spark, groups, expected):
    built = mapping.build_mapping(spark, groups, FOLD)
    assert codes(built) == expected and not built.applicable()


def test_warnings_and_stats(spark):
    rows = [(2, "A", ["a1", " A1 ", ""]), (3, "A", ["a1", " A1 ", ""]), (4, None, ["z"]), (5, "C", [None])]
    built = mapping.build(spark.createDataFrame(rows, mapping.GROUP_SCHEMA), FOLD)
    assert {c for c, _ in codes(built)} == {"DUPLICATE_ROW", "DUPLICATE_ALIAS", "EMPTY_CANONICAL", "ALIASLESS_GROUP"} and built.applicable()
    assert built.stats.first().asDict() == {"canonical_count": 2, "alias_count": 4, "mapping_item_count": 3, "duplicate_alias_count": 4, "empty_alias_cell_count": 3, "collision_alias_count": 0, "empty_canonical_count": 1, "duplicate_row_count": 1, "aliasless_group_count": 1}
    assert built.preview.count() == 3


def test_json_and_text(spark):
    groups = mapping.groups_from_json(spark, '{"A": ["x", null], "B": []}')
    assert mapping.to_json(groups) == '{\n  "A": [\n    "x"\n  ],\n  "B": []\n}'
    for bad in ("[]", "{", '{"A": "x"}'):
        with pytest.raises(ConfigError):
            mapping.groups_from_json(spark, bad)
    assert mapping.groups_from_text(spark, {"A": "x, y,,"}).first().aliases == ["x", "y"]


def test_application(spark):
    built = mapping.build_mapping(spark, {"A": ["x"]}, FOLD)
    df = mapping.applied(spark.createDataFrame([("x",), ("y",), (None,), ("a",)], "k string"), "k", built, "s", "c")
    assert {(r.k, r.s, r.c) for r in df.collect()} == {("x", "a", "a"), ("y", "y", None), (None, None, None), ("a", "a", "a")}
    assert mapping.application_stats(df, "k", "c").first().asDict() == {"unique_key_count": 3, "mapped_key_count": 2, "unmapped_key_count": 1, "mapping_rate": 2 * 100.0 / 3}


def test_profile_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (2, None)], "a int, b string")
    assert profile.profile_table(df).first().asDict() == {"row_count": 4, "column_count": 2, "empty_rows": 1, "empty_columns": 1, "duplicate_rows": 2}
    assert profile.profile_table(df.limit(0)).first().row_count == 0


@pytest.mark.parametrize(
    ("values", "kind"),
    [([None, None], "mixed"), (["Y", "no"], "boolean"), (["1", "0"], "boolean"), (["1,000", "2.5"], "number"), (["12 kg", "3 kg"], "unit_number"), (["2026-01-02", "2026-01-03"], "date"), (["2026/01/02"], "unit_number"), (["2026-01-02 10:00", "2026-01-03 11:00"], "datetime"), (["abc", "d"], "text")],
)
def test_types(spark, values, kind):
    # slashes go with the units, so such dates read as unit numbers; those with dashes are dates
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert profile.infer_types(df) == {"x": kind}


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (" ", 1), (None, 1)], "k string, v int")
    assert profile.profile_duplicates(df, [F.col("k")]).first().asDict() == {"unique_key_count": 2, "duplicate_key_count": 1, "max_count": 3, "empty_key_count": 2}
    assert {(r.k0, r["count"], r.variation) for r in profile.duplicate_keys(df, [F.col("k")], ["v"]).collect()} == {("a", 3, 2), ("b", 1, 1)}
    assert [r.metric for r in profile.key_diagnostics(df, [F.col("k")], df, [F.col("k")]).collect()][0] == "rows"


def test_header_candidates(spark):
    grid = spark.createDataFrame([(1, "title", None), (2, "id", "name"), (3, "1", "1")], "__row_no long, a string, b string")
    found = profile.header_candidates(grid).collect()
    assert [(r.row_number, r.score) for r in found] == [(2, 3.0), (3, 2.5), (1, 2.0)]


def test_a_group_goes_through_python_once(spark, tmp_path):
    rows = [(2, "Ａ", ["ｘ１", "STRASSE", None]), (3, "b", ["Straße", " "]), (4, "-", ["y"])]
    spark.createDataFrame(rows, mapping.GROUP_SCHEMA).write.parquet(str(tmp_path / "groups"))
    built = mapping.build(spark.read.parquet(str(tmp_path / "groups")), KeyOptions(case_insensitive=True, unicode_normalize=False))
    for found in (built.registrations, built.groups):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert built.registrations._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    wide = mapping.build(spark.read.parquet(str(tmp_path / "groups")), FOLD)
    assert {(r.alias, r.canonical) for r in wide.registrations.collect()} == {("a", "a"), ("x1", "a"), ("strasse", "a"), ("b", "b"), ("strasse", "b")}
    assert codes(wide) == [("EMPTY_CANONICAL", None), ("NORMALIZED_ALIAS_CONFLICT", "strasse")]


def test_ascii_groups_need_no_python(spark):
    plain, wide = (mapping.build_mapping(spark, g, FOLD) for g in ({"A": ["X ", None], 1: [2]}, {"A": ["Ｘ"], "B": ["Straße"]}))
    assert "EvalPython" not in plain.pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.alias, r.canonical) for r in plain.pairs.collect()} == {("a", "a"), ("x", "a"), ("1", "1"), ("2", "1")}
    assert {(r.alias, r.canonical) for r in wide.pairs.collect()} == {("a", "a"), ("x", "a"), ("b", "b"), ("strasse", "b")}
