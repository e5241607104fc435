"""Flat views of a result, filters, and the sheets of an export."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyweave.cluster import delete, shared_folder
from keyweave.config import Comparison, Rule, to_dict
from keyweave.functions.compare import DIFFERENT
from keyweave.operators.reconcile import STATUS_LABELS, lookup

#: Headings of exports.
BASE_HEADINGS = {"key_display": "키", "status": "상태", "reason": "사유", "a_count": "A 키 발생 건수", "b_count": "B 키 발생 건수", "a_unique": "A 고유값 개수", "b_unique": "B 고유값 개수", "duplicate_type": "중복 유형", "row_id_a": "A 행 식별자", "row_id_b": "B 행 식별자"}
TRACE_HEADINGS = {"original": "원본 키", "normalized": "정규화 키", "standard": "표준 키", "applied": "매핑 적용 여부", "canonical": "적용 대표값"}
RULE_HEADINGS = {"original_a": "A 원본값", "original_b": "B 원본값", "normalized_a": "A 정규화값", "normalized_b": "B 정규화값", "status": "결과", "reason": "불일치 사유", "difference": "숫자 차이", "absolute_difference": "절대 차이", "difference_rate": "차이율", "ok_a": "변환 성공 A", "ok_b": "변환 성공 B", "method": "비교 방식", "policy": "중복 처리 방식"}
RULE_LABELS = {"EQUAL": "동일", "DIFFERENT": "불일치", "UNAVAILABLE": "비교 불가", "CONVERSION_FAILED": "형식 변환 실패"}
SHEETS = ("01_전체결과", "02_불일치", "03_A에만존재", "04_B에만존재", "05_중복키", "06_N대M처리필요", "07_변환실패", "08_데이터품질", "09_비교설정", "10_요약")
SUMMARY_HEADINGS = {"total": "전체 결과", "comparable": "비교 가능", "identical": "모두 동일", "mismatch": "불일치", "a_only": "A에만 존재", "b_only": "B에만 존재", "duplicate": "중복", "conversion_failed": "변환 실패", "nm_pending": "N:M 처리 필요", "match_rate": "일치율", "by_status": "상태별 건수"}

MISMATCHED = ("PARTIAL_MISMATCH", "FULL_MISMATCH", "DUP_DIFF", "CONVERSION_FAILED")
DUPLICATED = ("DUPLICATE_BLOCKED", "DUP_EQUAL", "DUP_DIFF", "ONE_TO_MANY", "MANY_TO_ONE")


def _field(name: str):
    return lambda x: x[name]


def _of_rule(rule_id: str):
    return lambda x: x.rule_id == rule_id


def flat(result: DataFrame, rules: list[Rule], headings: bool = False) -> DataFrame:
    """One column for each base field and 13 for each rule; ``headings`` names and labels them as exports do.

    A rule that was compared row by row shows its last row.
    """
    name = lambda plain, heading: heading if headings else plain
    label = lambda names, c: lookup(names, c) if headings else c
    columns = [(label(STATUS_LABELS, F.col(c)) if c == "status" else F.col(c)).alias(name(c, h)) for c, h in BASE_HEADINGS.items()]
    for side in ("a", "b"):
        if f"key_trace_{side}" in result.columns:
            parts = F.flatten(F.transform(f"key_trace_{side}", lambda t: t["__key_trace"]))
            columns += [F.to_json(F.transform(parts, _field(f))).alias(name(f"{side}_key_{f}", f"{side.upper()} {h}")) for f, h in TRACE_HEADINGS.items()]
    for rule in rules:
        mine = F.filter("rules", _of_rule(rule.rule_id))
        last = F.element_at(F.when(F.size(mine) > 0, mine), -1)
        columns += [(label(RULE_LABELS, last[f]) if f == "status" else last[f]).alias(name(f"{rule.rule_id}_{f}", f"{rule.display_name} · {h}")) for f, h in RULE_HEADINGS.items()]
    return result.select(*columns)


def with_status(result: DataFrame, *statuses: str) -> DataFrame:
    return result.where(F.col("status").isin(*statuses)) if statuses else result


def with_mismatch(result: DataFrame, rule_id: str) -> DataFrame:
    return result.where(F.exists("rules", lambda x: (x.rule_id == rule_id) & (x.status == DIFFERENT)))


def containing(df: DataFrame, text: str) -> DataFrame:
    """Rows of which any cell holds ``text``, in any case and as it stands."""
    wanted = text.lower()
    hit: Column = F.lit(False)
    for field in df.schema.fields:
        shown = F.to_json(F.struct(field.name)) if field.dataType.typeName() in ("array", "map", "struct") else F.col(field.name).cast("string")
        hit = hit | F.coalesce(F.lower(shown).contains(wanted), F.lit(False))
    return df.where(hit)


def sheets(result: DataFrame) -> dict[str, DataFrame]:
    """The result cut as the export's sheets are; N:M keys aren't among the duplicates."""
    return {
        "all": result, "mismatched": with_status(result, *MISMATCHED), "a_only": with_status(result, "A_ONLY"), "b_only": with_status(result, "B_ONLY"),
        "duplicated": with_status(result, *DUPLICATED), "nm_pending": with_status(result, "NM_PENDING"), "conversion_failed": with_status(result, "CONVERSION_FAILED"),
    }


class Stored:
    """A result that was written once: sheets and pages of keys are read from it without comparing again."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        #: ``schema`` is needed where a result without rows was stored
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def result(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)

    def sheet(self, name: str) -> DataFrame:
        """A sheet's rows: only the folders of its statuses are read."""
        return sheets(self.result)[name]

    def page(self, name: str, start: str, rows: int) -> DataFrame:
        """The first ``rows`` keys of a sheet from ``start`` on, in their order: files and row groups of smaller keys are left out by their statistics."""
        return self.sheet(name).where(F.col("key_display") >= start).orderBy("key_display").limit(rows)

    def delete(self) -> None:
        delete(self.spark, self.path)


def store(result: DataFrame, path: str | None = None) -> Stored:
    """Writes a result in one job, a folder for each status and ranges of keys in each, and returns what reads it.

    Without ``path`` it goes to the shared folder, where ``delete`` removes it.  A status of very many keys
    is written by as many tasks as it has ranges; no order of the whole result is needed for that.
    """
    spark = result.sparkSession
    path = path or f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    result.repartitionByRange("status", "key_display").sortWithinPartitions("status", "key_display").write.partitionBy("status").parquet(path)
    return Stored(spark, path, result.schema)


def settings_rows(config: Comparison) -> list[tuple[str, str]]:
    """(path, value) of every setting; lists stay one value."""
    out: list[tuple[str, str]] = []

    def walk(path: str, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{path}.{k}" if path else str(k), v)
        else:
            out.append((path, "" if value is None else str(value)))

    walk("", to_dict(config))
    return out


def settings(spark: SparkSession, config: Comparison) -> DataFrame:
    return spark.createDataFrame(settings_rows(config), "setting string, value string")
