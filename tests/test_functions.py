from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions import normalize, scalar


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "options", "out"),
    [("  a\r\n b ", {}, "a  b"), ("a b　c", {"collapse_spaces": True}, "a b c"), ("ＡＢ", {}, "AB"), ("　x\x1c", {"unicode_normalize": False}, "x"), ("N/A", {}, None), ("a-b", {"replacements": {"-": "+"}}, "a+b"), ("á?", {"unicode_normalize": False, "remove_special_characters": True}, "a"), ("ß", {"case_insensitive": True}, "ss")],
)
def test_text(spark, text, options, out):
    assert value(spark, text, lambda c: normalize.normalize_text(c, options)) == out


@pytest.mark.parametrize(
    ("text", "options", "out"),
    [("₩1,234원", {}, 1234.0), ("(12.5)", {}, -12.5), ("50%", {"percent_string": True}, 0.5), ("50%", {}, None), ("about 12 kg", {"extract_number": True}, 12.0), ("1d", {}, None), ("1_000", {}, None), ("1e3", {}, 1000.0), (".5", {}, 0.5), ("", {}, None), (None, {}, None), ("nan", {}, None), ("inf", {}, float("inf"))],
)
def test_number(spark, text, options, out):
    assert value(spark, text, lambda c: normalize.parse_number(c, options)) == out


@pytest.mark.parametrize(
    ("text", "mode", "out"),
    [("2026-8-16", "date", date(2026, 8, 16)), ("2026/08/16", "date", date(2026, 8, 16)), ("2026.08.16", "date", date(2026, 8, 16)), ("20260816", "date", date(2026, 8, 16)), ("8/16/2026", "date", date(2026, 8, 16)), ("16/8/2026", "date", date(2026, 8, 16)), ("Aug 16 2026", "date", date(2026, 8, 16)), ("2026년 8월 16일", "date", date(2026, 8, 16)), ("2026-08-16T10:20:30Z", "date", date(2026, 8, 16)), ("2026-08-16 10:20", "year", 2026), ("2026", "year", 2026), ("2026-08", "year_month", date(2026, 8, 1)), ("12:30", "date", None), ("1250", "date", None), ("2026-13-01", "date", None), ("", "date", None)],
)
def test_date(spark, text, mode, out):
    assert value(spark, text, lambda c: normalize.parse_date(c, mode)) == out


def test_dayfirst(spark):
    assert value(spark, "1/2/2026", lambda c: normalize.parse_date(c, "date", dayfirst=True)) == date(2026, 2, 1)


@pytest.mark.parametrize(("x", "text"), [(12.0, "12.0"), (10000000.0, "10000000.0"), (0.0001, "0.0001"), (1234.5678, "1234.5678"), (-0.5, "-0.5")])
def test_double_text(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(normalize.double_text(F.col("x"))).first()[0] == text


def test_typed_text(spark):
    row = spark.sql("SELECT true AS b, date'2026-01-02' AS d, timestamp'2026-01-02 03:04:05' AS t, CAST('nan' AS DOUBLE) AS n, 7L AS i")
    assert [row.select(normalize.as_text(F.col(c), row.schema[c].dataType)).first()[0] for c in "bdtni"] == ["True", "2026-01-02", "2026-01-02 03:04:05", None, "7"]


def test_empty_tokens_mean_the_usual_ones(spark):
    assert value(spark, " NULL ", lambda c: normalize.is_missing(c, [])) is True
    assert value(spark, "?", lambda c: normalize.is_missing(c, ["?"])) is True


@pytest.mark.parametrize(("i", "letter"), [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_letters(i, letter):
    assert normalize.excel_letter(i) == letter


@pytest.mark.parametrize(
    ("sql", "kind", "text"),
    [("'a'", "string", "a"), ("true", "bool", "true"), ("7L", "int", "7"), ("1152921504606846976L", "decimal", "1152921504606846976"), ("1.5D", "float", "1.5"), ("CAST('nan' AS DOUBLE)", "nonfinite", "nan"), ("CAST('-inf' AS DOUBLE)", "nonfinite", "-inf"), ("date'2026-01-02'", "date", "2026-01-02"), ("1.50BD", "decimal", "1.50"), ("CAST(NULL AS STRING)", "null", None), ("array(1,2)", "json", "[1,2]")],
)
def test_scalars_round_trip(spark, sql, kind, text):
    row = spark.sql(f"SELECT {sql} AS x")
    coded = row.select(scalar.encode(F.col("x"), row.schema["x"].dataType).alias("s"), "x")
    found = coded.select("s", scalar.valid(F.col("s")).alias("ok")).first()
    assert (found.s.type, found.s.value, found.ok) == (kind, text, True)


@pytest.mark.parametrize(("version", "kind", "text"), [(2, "string", "a"), (1, "int", "1.5"), (1, "int", str(2**60)), (1, "decimal", "01"), (1, "date", "2026-02-30"), (1, "datetime", "2026-01-01T00:00:00"), (1, "nonfinite", "x"), (1, "other", "x"), (1, "bool", "1"), (1, "null", "x"), (1, "json", "{")])
def test_bad_scalars(spark, version, kind, text):
    row = spark.createDataFrame([((version, kind, text),)], "s struct<version:int,type:string,value:string>")
    assert row.select(scalar.valid(F.col("s"))).first()[0] is False


def test_scalar_needs_a_zone():
    with pytest.raises(ValueError):
        scalar.encode(F.lit(1), T.TimestampNTZType())


def test_canonical_json():
    assert scalar.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        scalar.canonical_json(float("nan"))


def test_steps_that_use_their_input_often_stay_a_chain(spark):
    """Each step is in the plan once, whatever the steps behind it."""
    from keyweave.config import KeyOptions

    rows = spark.createDataFrame([(" (1,234.50) ",), ("007.0",), ("$ 5",), ("x",), (None,), ("2024-03-01",)], "v string")
    options = KeyOptions(coerce_numeric_string=True)
    keys = rows.select("v", normalize.normalize_key(F.col("v"), type("Options", (), vars(options) | {"assume_ascii": True})()).alias("k"))
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("RLIKE") < 20 and len(plan) < 20_000
    assert {r.v: r.k for r in keys.collect()} == {" (1,234.50) ": "-1234.5", "007.0": "7", "$ 5": "5", "x": "x", None: None, "2024-03-01": "2024-03-01"}
    dated = rows.select(normalize.normalize_key(F.col("v"), type("Options", (), vars(KeyOptions(date_format="year", coerce_numeric_string=True)) | {"assume_ascii": True})()).alias("k"))
    assert "2024" in {r.k for r in dated.collect()} and len(dated._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    percent = normalize.parse_number(F.col("v"), {"percent_string": True})
    assert [r[0] for r in spark.createDataFrame([("(50%)",), ("50%",), ("5",)], "v string").select(percent).collect()] == [-0.5, 0.5, 5.0]
