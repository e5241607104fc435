import pytest
from pyspark.sql import functions as F

from keyweave.config import ConfigError, KeyMapping
from keyweave.operators.dialect import Options, boolean, compare_typed, day, dialect_view, number, shown_values, text
from keyweave.operators.reconcile import FLAGS

SCHEMA = "id string, value string"


def run(spark, a, b, rules=(), schema=SCHEMA, **more):
    return compare_typed(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), Options(["id"], rules=list(rules), **more))


def statuses(result):
    return sorted((r.key or "", r.status) for r in result.collect())


def key(value, kind="string"):
    return f'[{{"type":"{kind}","value":"{value}"}}]'


def test_keys_alone_and_statuses(spark):
    assert statuses(run(spark, [("1", "a"), ("2", "b")], [("1", "z"), ("3", "c")])) == [(key(1), "matched"), (key(2), "removed"), (key(3), "added")]


def test_types_are_part_of_a_key(spark):
    a = spark.createDataFrame([(1, "a")], "id long, value string")
    found = compare_typed(a, spark.createDataFrame([("1", "a")], SCHEMA), Options(["id"], rules=[text("value")]))
    assert statuses(found) == [(key(1, "int"), "removed"), (key(1), "added")]


def test_blank_keys_are_rows_of_their_own(spark):
    found = run(spark, [(None, "a"), (" ", "b"), ("-", "c")], [(None, "a")], [text("value")])
    assert statuses(found) == [("", "invalid-key")] * 3 + [(key("-"), "removed")]
    assert {(r.a_count, r.b_count) for r in found.where("status = 'invalid-key'").collect()} == {(1, 0), (0, 1)}


@pytest.mark.parametrize(("policy", "status"), [(None, "duplicate"), ("report", "duplicate"), ("first", "matched"), ("last", "changed"), ("representative", "changed"), ("set", "changed"), ("multiset", "changed"), ("aggregate", "changed")])
def test_one_policy_for_all(spark, policy, status):
    assert [s for _, s in statuses(run(spark, [("x", "1")], [("x", "1"), ("x", "2")], [number("value")], duplicate_policy=policy))] == [status]


@pytest.mark.parametrize(("policy", "status"), [(None, "nm-pending"), ("first", "matched"), ("last", "changed"), ("set", "matched"), ("multiset", "matched")])
def test_many_to_many(spark, policy, status):
    found = run(spark, [("x", "1"), ("x", "2"), ("x", None)], [("x", "1"), ("x", "2")][:: -1 if policy in ("set", "multiset") else 1] + [("x", None if policy in ("set", "multiset") else "3")], [number("value")], nm_policy=policy)
    (row,) = found.collect()
    assert row.status == status and (policy or row.flags == FLAGS["NM_PENDING"] | FLAGS["DUPLICATE"] | FLAGS["STRUCTURAL_BLOCK"])


@pytest.mark.parametrize(
    ("used", "a", "b", "status"),
    [(number("value"), "1,000 ", "1000", "matched"), (number("value"), "$5", "5", "conversion-failed"), (number("value", empty_equals_zero=True), None, "0", "matched"), (text("value"), " a ", "a", "matched"), (text("value"), "-", None, "changed"), (text("value", case_insensitive=True), "A", "a", "matched"), (day("value"), "2026-01-02", "2026-01-02T03:00:00Z", "matched"), (boolean("value"), "Yes", "1", "matched"), (boolean("value"), "사용", "1", "conversion-failed")],
)
def test_values(spark, used, a, b, status):
    assert [s for _, s in statuses(run(spark, [("x", a)], [("x", b)], [used]))] == [status]


def test_rates_and_mapping_and_view(spark):
    (row,) = run(spark, [("x", "10")], [("x", "8")], [number("value")]).collect()
    assert (row.rates[0].a, row.rates[0].b) == (0.2, 0.25)
    found = run(spark, [("Acme Inc", "1")], [("acme", "1")], [number("value")], mappings={"id": KeyMapping(enabled=True, groups={"acme": ["acme inc"]})}, case_insensitive_keys=True)
    assert statuses(found) == [("acme", "matched")]
    assert dialect_view(found, "matched", "CM").count() == 1 and dialect_view(found, "changed").count() == 0
    with pytest.raises(ConfigError):
        run(spark, [("x", "1")], [("x", "1")], duplicate_policy="nonsense")


def test_exports(spark):
    from keyweave.operators.dialect import CSV_COLUMNS, export_rows, export_sheets
    from keyweave.sources import sinks

    found = run(spark, [("1", "a"), ("2", "b"), (None, "c")], [("1", "x"), ("3", "c")], [text("value")])
    assert tuple(export_rows(found).columns) == CSV_COLUMNS
    sheets = export_sheets(found)
    assert {k: v.count() for k, v in sheets.items()} == {"Lane 비교 결과": 3, "불일치": 1, "첫 시트에만 존재": 1, "두번째 시트에만 존재": 1, "빈 키 행": 1, "요약": 1}
    assert tuple(sheets["요약"].first()) == (3, 0, 1, 1, 1, 1, 0.0)
    assert sinks.csv_text(export_rows(found), quote_all=True).count('"changed"') == 2


def test_template_on_new_headers():
    from keyweave.operators.dialect import fit_template

    template = {"version": 2, "keyColumns": ["id"], "compareColumns": ["value"], "rules": [{"columnA": "value", "columnB": 1}], "representativeColumn": "value", "caseSensitive": True, "duplicatePolicy": "report", "expectations": [{"id": "id", "raw": "ID ", "normalizedName": "id", "occurrence": 0}, {"id": "value", "raw": "value", "normalizedName": "value", "occurrence": 1}]}
    fitted, problems = fit_template(["Id", "Value", "VALUE"], template)
    assert not problems and fitted["keyColumns"] == ["Id"] and fitted["rules"] == [{"columnA": "VALUE", "columnB": 1}] and fitted["representativeColumn"] == "VALUE"
    for headers, change, code in ((["Id"], {}, "STALE_TEMPLATE_COLUMN"), (["Id", "Value", "VALUE"], {"keyColumns": ["id", "id"]}, "DUPLICATE_KEY_COLUMN"), (["Id", "Value", "VALUE"], {"compareColumns": [9]}, "STALE_TEMPLATE_COLUMN"), (["Id"], {"version": 1}, "UNSUPPORTED_TEMPLATE_VERSION")):
        fitted, problems = fit_template(headers, template | change)
        assert fitted is None and problems[0][0] == code


def test_shown_values_and_search_in_mapping_text(spark):
    a, b = [("x", "1"), ("x", "1"), ("x", "2"), ("y", "5")], [("x", "1"), ("x", "2")]
    show = lambda policy, method="sum": {r.key: (r.shown_a, r.shown_b) for r in shown_values(run(spark, a, b, [number("value")], duplicate_policy=policy), policy, method).collect()}
    assert show("multiset")[key("x")] == ("1.0 × 2, 2.0 × 1", "1.0 × 1, 2.0 × 1") and show("set")[key("x")] == ("1.0, 2.0", "1.0, 2.0")
    assert show("aggregate")[key("x")] == ("4.0", "3.0") and show("report")[key("y")] == ("-", "-")
    options = Options(["id"], rules=[text("value")], mappings={"id": KeyMapping(enabled=True, groups={"Main": ["Alias One"]})})
    found = compare_typed(spark.createDataFrame([("Alias One", "v"), ("other", "v")], SCHEMA), spark.createDataFrame([("Main", "v")], SCHEMA), options, with_trace=True)
    assert dialect_view(found, key="alias one").count() == 1 and dialect_view(found, key="MAIN").count() == 1 and dialect_view(found, key="oth").count() == 1


def test_typed_keys_have_no_text_steps(spark):
    from keyweave.operators.dialect import typed_key

    rows = spark.createDataFrame([(1, True, 'a" b', 1.5), (None, True, "x", 2.0), (2, None, " ", 3.0)], "i long, t boolean, s string, v double")
    plain = compare_typed(rows, rows, Options(["i", "t"], rules=[number("v")]))
    plan = plain.select("key", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?U)" not in plan and "to_json" not in plan
    assert {(r.key, r.status) for r in plain.collect()} == {('[{"type":"int","value":"1"},{"type":"bool","value":"True"}]', "matched"), (None, "invalid-key")}
    text = compare_typed(rows, rows, Options(["s"], rules=[number("v")]))
    assert {r.key for r in text.collect()} == {'[{"type":"string","value":"a\\" b"}]', '[{"type":"string","value":"x"}]', None}
    assert [r.k for r in rows.select(typed_key(rows, ["i", "s"]).alias("k")).collect()] == ['[{"type":"int","value":"1"},{"type":"string","value":"a\\" b"}]', None, None]


def test_statuses_of_policies_need_no_shown_values(spark):
    rows = spark.range(40).selectExpr("id % 30 AS k", "cast(id % 10 AS double) AS v")
    for policy in ("set", "multiset", "aggregate"):
        found = compare_typed(rows, rows.where("v < 9"), Options(["k"], rules=[number("v")], duplicate_policy=policy))
        plan = found.select("key", "status", "a_count")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan
        assert {(r.status, r.n) for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()} == {("matched", 27), ("removed", 3)}
    one_to_many = compare_typed(rows, rows.dropDuplicates(["k"]), Options(["k"], rules=[number("v")], duplicate_policy="set"))
    assert {r.status for r in one_to_many.collect()} == {"matched"}
