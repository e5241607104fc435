import json
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from keyweave.config import ConfigError, DuplicatePolicy, KeyMapping, Rule, compare, to_dict
from keyweave.operators.reconcile import reconcile, summary
from keyweave.plans import template
from keyweave.sources import grid, sinks


def rule():
    return Rule("r", "R", "value", "value")


def test_csv_with_title_and_bom(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿title\nid,name,name\n1,\"a\nb\",c\n\n2,,d\n".encode())
    table = grid.load(spark, str(path), header_row=2, data_start_row=3)
    assert [(c.name, c.letter, c.column_id, c.occurrence) for c in table.columns] == [("id", "A", "a_col_0", 0), ("name", "B", "a_col_1", 0), ("name", "C", "a_col_2", 1)]
    assert [tuple(r)[1:] for r in table.df.orderBy("__row_no").collect()] == [("1", "a\nb", "c"), ("2", "", "d")]
    assert table.df.schema["a_col_1"].metadata["name"] == "name" and table.column("name", 1) == "a_col_2"


@pytest.mark.parametrize(("encoding", "name"), [("utf-8", "utf-8-sig"), ("cp949", "cp949"), ("latin-1", "latin-1")])
def test_encodings(spark, tmp_path, encoding, name):
    text = "키;값\n하나;둘\n" if encoding != "latin-1" else "k;v\n\xe9\xff\x81;1\n"
    payload = text.encode(encoding)
    assert grid.detect_encoding(payload) == name
    (tmp_path / "x.csv").write_bytes(payload)
    table = grid.load(spark, str(tmp_path / "x.csv"))
    assert len(table.columns) == 2 and table.df.count() == 1


def test_header_bounds_and_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(grid.SourceError):
        grid.load(spark, str(tmp_path / "x.csv"), header_row=2, data_start_row=2)
    with pytest.raises(grid.SourceError):
        grid.load(spark, str(tmp_path / "x.csv"), header_row=9, data_start_row=10)
    with pytest.raises(grid.SourceError):
        grid.validate_upload("x.pdf", 1)
    with pytest.raises(grid.SourceError):
        grid.validate_upload("x.csv", 300 << 20)


@pytest.mark.parametrize(
    ("text", "rows"),
    [('a,"b,c"\n1,2\n', [["a", "b,c"], ["1", "2"]]), ('"a""b" ,c\r\n', [['a"b', "c"]]), ("a,\n", [["a", ""]]), ("a\rb", [["a"], ["b"]]), ('"x\ny",z', [["x\ny", "z"]])],
)
def test_strict_csv(text, rows):
    assert grid.strict_csv_rows(text.encode()) == rows


@pytest.mark.parametrize(("payload", "code"), [(b'"a', "MALFORMED_CSV"), (b'"a"b', "MALFORMED_CSV"), (b"\xff", "INVALID_UTF8"), (b" \n", "EMPTY_INPUT")])
def test_strict_csv_errors(payload, code):
    with pytest.raises(grid.SourceError) as error:
        grid.strict_csv_rows(payload)
    assert error.value.code == code


def test_limits():
    with pytest.raises(grid.SourceError) as error:
        grid.strict_csv_rows(b"a\n1\n2\n", limits=grid.Limits(max_rows=1))
    assert error.value.code == "RESOURCE_LIMIT"
    with pytest.raises(grid.SourceError):
        grid.strict_csv_rows(b"a;b", delimiter="#")


def test_unique_headers():
    assert grid.unique_headers(["a", "", "a", " a "]) == ["a", "column_2", "a_2", "a_3"]


def test_workbook_round_trip(spark, tmp_path):
    payload = sinks.workbook({"one": (["id", "id", "n"], [["x", None, 1.5], ["<&>", True, 2]]), "two": ([], [])})
    book = grid.Workbook(payload)
    assert list(book.sheets) == ["one", "two"]
    assert book.rows("one") == [["id", "id", "n"], ["x", None, "1.5"], ["<&>", "True", "2"]]
    (tmp_path / "b.xlsx").write_bytes(payload)
    table = grid.load(spark, str(tmp_path / "b.xlsx"), sheet="one", side="b")
    assert [c.column_id for c in table.columns] == ["b_col_0", "b_col_1", "b_col_2"] and table.df.count() == 2
    assert grid.sheet_names(spark, str(tmp_path / "b.xlsx")) == ["one", "two"]


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_workbook_errors():
    rels = '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/s.xml"/></Relationships>'
    book = '<w:workbook xmlns:w="m" xmlns:q="o"><w:sheets><w:sheet q:id="r1" name="S"/></w:sheets></w:workbook>'
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/s.xml": '<worksheet><sheetData><row r="2"><c r="B2"><f>1+1</f><v>2.0</v></c></row></sheetData></worksheet>'}

    def made(**change):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in (parts | change).items():
                z.writestr(k, v)
        return out.getvalue()

    assert grid.Workbook(made()).rows() == [[], [None, "2"]]
    for payload, code in ((b"abc", "INVALID_ZIP"), (made(**{"../x": "1"}), "UNSAFE_PATH"), (made(**{"xl/workbook.xml": "<workbook/>"}), "NO_SHEETS"), (made(**{"xl/workbook.xml": "<workbook"}), "MALFORMED_XLSX"), (made(**{"xl/workbook.xml": '<!DOCTYPE a [<!ENTITY x "y">]><workbook/>'}), "MALFORMED_XLSX")):
        with pytest.raises(grid.SourceError) as error:
            grid.Workbook(payload)
        assert error.value.code == code
    with pytest.raises(grid.SourceError) as error:
        grid.Workbook(made(), reject_formulas=True).rows()
    assert error.value.code == "FORMULA"
    with pytest.raises(grid.SourceError) as error:
        grid.Workbook(made(), grid.Limits(max_entries=1))
    assert error.value.code == "RESOURCE_LIMIT"


@pytest.fixture
def compared(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("4", "z"), ("4", "z")], "key string, value string")
    b = spark.createDataFrame([("1", "x"), ("2", "Y"), ("3", "z"), ("4", "z")], "key string, value string")
    config = compare("key", [rule()])
    return reconcile(a, b, config), config


def test_exports(spark, compared, tmp_path):
    result, config = compared
    book = grid.Workbook(sinks.result_workbook(result, config, summary=summary(result)))
    assert len(book.sheets) == 10 and len(book.rows("02_불일치")) == 2 and len(book.rows("05_중복키")) == 2
    assert book.rows("10_요약")[0][0] == "전체 결과"
    text = sinks.csv_text(result.select("key_display", "status"), quote_all=True)
    assert text.startswith('﻿"key_display","status"') and text.count("\r\n") == 5
    assert '"status": "A_ONLY"' not in sinks.json_text(result) and '"status": "DUPLICATE_BLOCKED"' in sinks.json_text(result)
    sinks.write_csv(result, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').count() == 4


def test_templates():
    config = compare(["k"], [rule()], duplicate_policy_a=DuplicatePolicy("A", "first", "k"))
    config.dataset_a.key_mappings = {"k": KeyMapping(enabled=True, groups={"A": ["x"]})}
    old = template.dump(config, [{"id": "k", "side": "A", "normalized_name": "key"}, {"id": "value", "side": "A", "normalized_name": "value"}])
    assert to_dict(template.load(old)) == to_dict(config) | {"created_at": template.load(old).created_at}
    now = [{"id": "k2", "side": "A", "normalized_name": "key"}, {"id": "value", "side": "A", "normalized_name": "value"}]
    fitted, problems = template.refit(config, template.expectations(old), now)
    assert not problems and fitted.dataset_a.key_columns == ["k2"] and fitted.duplicate_policy_a.representative_sort_column == "k2" and "k2" in fitted.dataset_a.key_mappings
    same, problems = template.refit(config, template.expectations(old), now[:1] * 2)
    assert same is config and problems == [("UNDECIDED", "k"), ("GONE", "value")]
    with pytest.raises(ConfigError):
        template.remap(config, {}, problems)
    saved = {"a": {"name": "Price", "occurrence": 0}, "b": {"name": "Price", "occurrence": 1}}
    now = [{"id": "x", "name": " price", "occurrence": 1}, {"id": "y", "name": "PRICE", "occurrence": 0}]
    assert template.match_columns(saved, now) == ({"a": "y", "b": "x"}, [])
    now = [{"id": "x", "fingerprint": "f", "name": "p"}]
    assert template.match_columns([{"name": "p"}, {"id": "a", "fingerprint": "f"}, {"id": "b", "name": "p"}], now) == ({"a": "x"}, [("NO_ID", ""), ("TAKEN", "b")])
    for bad in ("[]", "{", '{"template_version": 3}', '{"dataset_a": {"nope": 1}}'):
        with pytest.raises(ConfigError):
            template.load(bad)


def test_large_csv_is_split_and_numbered(spark, tmp_path):
    lines = ["key,value,key"] + [f'{i},"v, ""{i}""",' for i in range(2, 5000)]
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.csv").write_text("key,value,key\nx,,y\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        table = grid.read_large_csv(spark, str(tmp_path / "*.csv"))
        rows = table.df.collect()
        assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = [r for r in rows if r["__file"].endswith("one.csv")]
    assert sorted(r["__row_no"] for r in one) == list(range(2, 5000)) and all(r.a_col_0 == str(r["__row_no"]) and r.a_col_1 == f'v, "{r.a_col_0}"' and r.a_col_2 == "" for r in one)
    assert [(r["__row_no"], r.a_col_0, r.a_col_1, r.a_col_2) for r in rows if r["__file"].endswith("two.csv")] == [(2, "x", "", "y")]
    assert table.column("key", 1) == "a_col_2" and table.df.schema["a_col_1"].metadata["name"] == "value"


def test_limits_and_bounds(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4\n")
    path = str(tmp_path / "x.csv")
    with pytest.raises(Exception, match="RESOURCE_LIMIT"):
        grid.load(spark, path, limits=grid.Limits(max_rows=2))
    for strict, rows, cells in ((False, 2, 5), (True, 1, 3)):  # the stricter dialect counts rows without the header
        for limits in (grid.Limits(max_rows=rows), grid.Limits(max_columns=1), grid.Limits(max_cells=cells), grid.Limits(max_bytes=3)):
            with pytest.raises(grid.SourceError, match="RESOURCE_LIMIT"):
                grid.file_rows("x.csv", (tmp_path / "x.csv").read_bytes(), limits=limits, strict=strict)
    assert grid.load(spark, path, limits=grid.Limits(max_rows=3, max_cells=6)).df.count() == 2
    rows = spark.range(5)
    assert sinks.csv_text(rows, most=5).count("\n") == 6 and json.loads(sinks.json_text(rows, most=5))[4] == {"id": 4}
    for export in (sinks.csv_text, sinks.json_text):
        with pytest.raises(ValueError, match="write_csv"):
            export(rows, most=4)


def test_projection(spark):
    df = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert template.rename_columns(df, {"a": "x"}).columns == ["x"]
    for bad in ({"z": "x"}, {"a": "x", "b": "x"}):
        with pytest.raises(ConfigError):
            template.rename_columns(df, bad)
    with pytest.raises(ConfigError):
        template.pair_columns(["a"], [])


def test_stream(spark, tmp_path):
    from keyweave.streaming.microbatch import reconcile_stream

    other = spark.createDataFrame([("1", "x")], "key string, value string")
    other.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(other.schema).parquet(str(tmp_path / "in"))
    reconcile_stream(stream, other, compare("key", [rule()]), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["IDENTICAL"]
