"""The stricter dialect: typed keys, one duplicate policy, blank keys row by row.

A key is the JSON array of its components with their types, so 1 and "1" are different keys, unless
a mapping is on, which makes them text.  A row whose key has a null or blank component is a result of
its own.  One policy holds for 1:N, N:1 and N:M keys; without one such keys are only reported.
Nulls are no members of sets and multisets, and only null and the empty text are missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.config import COLLECTION_POLICIES, Comparison, ConfigError, Dataset, DuplicatePolicy, KeyMapping, KeyOptions, NullPolicy, Rule, Tolerance
from keyweave.functions.compare import FAILED
from keyweave.functions.normalize import as_text, strip
from keyweave.operators.reconcile import FLAGS, lookup, reconcile, with_row_id

POLICIES = ("report", "first", "last", "representative", "set", "multiset", "aggregate")
#: The only words for true and false here.
WORDS = {"true": True, "1": True, "y": True, "yes": True, "false": False, "0": False, "n": False, "no": False}
STATUSES = {"IDENTICAL": "matched", "PARTIAL_MISMATCH": "changed", "FULL_MISMATCH": "changed", "A_ONLY": "removed", "B_ONLY": "added", "DUPLICATE_BLOCKED": "duplicate", "DUP_EQUAL": "matched", "DUP_DIFF": "changed", "NM_PENDING": "nm-pending", "CONVERSION_FAILED": "conversion-failed"}
INVALID = "invalid-key"
KEY = "__typed_key"


@dataclass
class Options:
    keys_a: list[str]
    keys_b: list[str] | None = None
    rules: list[Rule] = field(default_factory=list)
    case_insensitive_keys: bool = False
    duplicate_policy: str | None = None
    nm_policy: str | None = None
    representative_a: str | None = None
    representative_b: str | None = None
    mappings: dict[str, KeyMapping] = field(default_factory=dict)

    @property
    def policy(self) -> str:
        return self.nm_policy or self.duplicate_policy or "report"


def number(a: str, b: str | None = None, rule_id: str = "r1", empty_equals_zero: bool = False, **policy) -> Rule:
    """Commas and blanks go, and the rest must be a number."""
    options = {"parentheses_negative": False, "remove_currency": False}
    return Rule(rule_id, rule_id, a, b or a, "number", "exact", options, _nulls(empty_equals_zero=empty_equals_zero, **policy))


def text(a: str, b: str | None = None, rule_id: str = "r1", case_insensitive: bool = False, **policy) -> Rule:
    options = {"unicode_normalize": False, "remove_special_spaces": False, "remove_line_breaks": False, "case_insensitive": case_insensitive, "missing_tokens": [""], "assume_ascii": not case_insensitive}
    return Rule(rule_id, rule_id, a, b or a, "text", "exact", options, _nulls(**policy))


def day(a: str, b: str | None = None, rule_id: str = "r1", **policy) -> Rule:
    """The calendar day in the session's zone, which should be UTC."""
    return Rule(rule_id, rule_id, a, b or a, "date", "exact", {}, _nulls(**policy), Tolerance())


def boolean(a: str, b: str | None = None, rule_id: str = "r1", empty_equals_false: bool = False, **policy) -> Rule:
    return Rule(rule_id, rule_id, a, b or a, "boolean", "exact", {"mapping": WORDS | ({"": False} if empty_equals_false else {})}, _nulls(**policy))


def _nulls(**policy) -> NullPolicy:
    return NullPolicy(**({"missing_tokens": [""]} | policy))


def _component(column: Column, kind: T.DataType, fold: bool) -> Column:
    """{"type", "value"} of one component; null if it is blank."""
    tag = "bool" if isinstance(kind, T.BooleanType) else "int" if isinstance(kind, T.IntegralType) else "decimal" if isinstance(kind, T.DecimalType) else "float" if isinstance(kind, T.FractionalType) else "date" if isinstance(kind, T.DateType) else "string"
    shown = as_text(column, kind)
    shown = F.lower(shown) if fold and tag == "string" else shown
    return F.when(shown.isNotNull() & (strip(shown) != "") if tag == "string" else shown.isNotNull(), F.struct(F.lit(tag).alias("type"), shown.alias("value")))


def typed_key(df: DataFrame, keys: list[str], fold: bool = False) -> Column:
    """The JSON of a row's key; null if any component is blank."""
    if missing := [k for k in keys if k not in df.columns]:
        raise ConfigError(f"no column {', '.join(missing)}")
    parts = [_component(F.col(k), df.schema[k].dataType, fold) for k in keys]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    if all(isinstance(df.schema[k].dataType, (T.IntegralType, T.DateType, T.BooleanType)) for k in keys):
        # digits, days and truth values have nothing to escape
        return F.concat(F.lit("["), *[x for i, p in enumerate(parts) for x in (F.lit("," if i else ""), F.concat(F.lit('{"type":"'), p["type"], F.lit('","value":"'), p["value"], F.lit('"}')))], F.lit("]"))
    return F.when(whole, F.to_json(F.array(*parts)))


def compare_typed(a: DataFrame, b: DataFrame, options: Options, order_a: str | None = None, order_b: str | None = None, with_trace: bool = False) -> DataFrame:
    """(key, status, flags, a_count, b_count, rules, rates, row_id): one row per key, then one for each row with a blank key.

    ``rates`` holds each rule's difference over its own side's value, for A and for B; ``with_trace``
    adds what each row's key came from.
    """
    if options.policy not in POLICIES:
        raise ConfigError(f"policy {options.policy!r} isn't one of {', '.join(POLICIES)}")
    keys_b = options.keys_b or options.keys_a
    if not options.keys_a or len(options.keys_a) != len(keys_b):
        raise ConfigError("both sides need as many key columns")
    mapped = any(m.enabled for m in options.mappings.values())
    sides, blanks, settings = [], [], []
    for df, keys, order, side, column in ((a, options.keys_a, order_a, "A", options.representative_a), (b, keys_b, order_b, "B", options.representative_b)):
        rows = with_row_id(df, order).withColumnRenamed("__row_id", "__row_no") if "__row_no" not in df.columns else df
        rows = rows.withColumn(KEY, typed_key(df, keys, options.case_insensitive_keys))
        blanks.append(rows.where(F.col(KEY).isNull()).select(F.lit(side).alias("side"), F.col("__row_no").alias("row_id")))
        sides.append(rows.where(F.col(KEY).isNotNull()))
        first = (options.rules[0].column_a_id if side == "A" else options.rules[0].column_b_id) if options.rules else None
        picks = column or first if options.policy == "representative" else None
        settings.append((Dataset(key_columns=keys if mapped else [KEY], key_normalization=KeyOptions(case_insensitive=options.case_insensitive_keys) if mapped else KeyOptions(unicode_normalize=False, strip_numeric_dot_zero=False), key_mappings=options.mappings if mapped else {}), DuplicatePolicy(side, "error" if options.policy == "report" else options.policy, picks, "desc")))
    config = Comparison(settings[0][0], settings[1][0], "outer", settings[0][1], settings[1][1], "error" if options.policy == "report" else options.policy, options.rules)
    result = reconcile(*sides, config, key_only=not options.rules, nm_picks=True, drop_nulls=True, with_trace=with_trace, json_keys=not mapped, with_equal=True)
    status = F.coalesce(lookup(STATUSES, F.col("status")), F.when(F.col("equal"), "matched").otherwise("changed"))
    repeated = (F.col("a_count") > 1) | (F.col("b_count") > 1)
    flags = F.col("flags").bitwiseOR(F.when(F.col("status") == "NM_PENDING", FLAGS["STRUCTURAL_BLOCK"]).when((F.col("status") == "CONVERSION_FAILED") & repeated, FLAGS["DUPLICATE"]).otherwise(0))
    rates = F.transform("rules", lambda x: F.struct(F.try_divide(x.absolute_difference, F.abs(x.normalized_a.try_cast("double"))).alias("a"), F.try_divide(x.absolute_difference, F.abs(x.normalized_b.try_cast("double"))).alias("b")))
    keyed = result.select(F.col("key_display").alias("key"), status.alias("status"), flags.alias("flags"), "a_count", "b_count", "rules", rates.alias("rates"), F.lit(None).cast("long").alias("row_id"), *(["key_trace_a", "key_trace_b"] if with_trace else []))
    invalid = blanks[0].unionByName(blanks[1]).select(F.lit(None).cast("string").alias("key"), F.lit(INVALID).alias("status"), F.lit(FLAGS["INVALID_KEY"] | FLAGS["STRUCTURAL_BLOCK"]).alias("flags"), (F.col("side") == "A").cast("long").alias("a_count"), (F.col("side") == "B").cast("long").alias("b_count"), "row_id")
    return keyed.unionByName(invalid, allowMissingColumns=True)


def dialect_view(result: DataFrame, status: str | None = None, key: str | None = None) -> DataFrame:
    """The result narrowed to a status and to keys that hold a text, in any case; where it has traces, to what keys came from too."""
    out = result.where(F.col("status") == status) if status else result
    if not key:
        return out
    traces = [_traced(side, name, out.columns) for side in ("a", "b") for name in ("original", "normalized", "standard", "canonical") if f"key_trace_{side}" in out.columns]
    return out.where(F.contains(F.lower(F.concat_ws("\n", "key", *traces)), F.lit(key.lower())))


def shown_values(result: DataFrame, policy: str = "report", method: str = "sum") -> DataFrame:
    """(key, status, shown_a, shown_b): the values of each side as they are read: ``v × n`` in multisets, counts with their unit, a stroke between rules."""
    unit = {"count": "건", "nunique": "개"}.get(method, "") if policy == "aggregate" else ""

    def side(name: str) -> Column:
        def one(x: Column) -> Column:
            values = F.from_json(x[f"original_{name}"], "array<struct<value:string,count:bigint>>")
            if policy == "multiset":
                return F.array_join(F.transform(values, lambda v: F.concat(F.coalesce(v.value, F.lit("-")), F.lit(" × "), F.format_number(v["count"], 0))), ", ")
            if policy == "set":
                return F.array_join(F.transform(values, lambda v: F.coalesce(v.value, F.lit("-"))), ", ")
            if policy == "aggregate":
                return F.when(x.status == FAILED, "계산할 수 없음").otherwise(F.concat(x[f"normalized_{name}"], F.lit(unit)))
            return x[f"original_{name}"]

        parts = F.filter(F.transform("rules", one), lambda t: t.isNotNull() & (t != ""))
        return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(parts) if policy not in COLLECTION_POLICIES else parts, " / ")).otherwise("-")

    return result.select("key", "status", side("a").alias("shown_a"), side("b").alias("shown_b"))


#: Columns and sheets of this dialect's exports.
CSV_COLUMNS = ("key", "status", "displayStatus", "aCount", "bCount", "aOriginalKey", "aNormalizedKey", "aStandardKey", "aMappingApplied", "bOriginalKey", "bNormalizedKey", "bStandardKey", "bMappingApplied", "firstSheetValue", "secondSheetValue")
SHEETS = {"Lane 비교 결과": None, "불일치": "changed", "첫 시트에만 존재": "removed", "두번째 시트에만 존재": "added"}
SUMMARY_HEADINGS = ("유효_Lane_결과", "일치", "불일치", "첫_시트에만", "두번째_시트에만", "빈_키_행", "일치율")


def _traced(side: str, name: str, columns: list[str]) -> Column:
    if f"key_trace_{side}" not in columns:
        return F.lit(None).cast("string")
    parts = F.flatten(F.transform(f"key_trace_{side}", lambda t: t["__key_trace"]))
    if name == "applied":
        return F.when(F.exists(parts, lambda p: p.applied), "Yes").otherwise("No")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p[name], F.lit(""))), " | ")


def export_rows(result: DataFrame) -> DataFrame:
    """The 15 columns of the CSV export; values of several rules stand between semicolons."""
    shown = lambda side: F.array_join(F.transform("rules", lambda x: F.coalesce(x[f"original_{side}"], F.lit(""))), "; ")
    columns = result.columns
    values = [F.col("key"), F.col("status"), F.col("status"), F.col("a_count"), F.col("b_count")]
    values += [_traced(side, name, columns) for side in ("a", "b") for name in ("original", "normalized", "standard", "applied")]
    return result.select(*[v.alias(n) for v, n in zip([*values, shown("a"), shown("b")], CSV_COLUMNS, strict=True)])


def export_sheets(result: DataFrame) -> dict[str, DataFrame]:
    """The six sheets of the XLSX export: all keys, three kinds of them, rows with blank keys, and counts."""
    valid = result.where(F.col("status") != INVALID)
    out = {name: export_rows(valid.where(F.col("status") == status) if status else valid) for name, status in SHEETS.items()}
    out["빈 키 행"] = result.where(F.col("status") == INVALID).select(F.when(F.col("a_count") > 0, "A").otherwise("B").alias("side"), "row_id")
    n = lambda s: F.count_if(F.col("status") == s)
    counted = result.agg(F.count_if(F.col("status") != INVALID), n("matched"), n("changed"), n("removed"), n("added"), n(INVALID), F.coalesce(F.try_divide(n("matched"), n("matched") + n("changed")), F.lit(0.0)))
    out["요약"] = counted.toDF(*SUMMARY_HEADINGS)
    return out


def fit_template(headers: list[str], template: dict) -> tuple[dict | None, list[tuple[str, str]]]:
    """This dialect's template on new headers: (its references resolved, problems); nothing is resolved while there are problems."""
    if template.get("version") != 2:
        return None, [("UNSUPPORTED_TEMPLATE_VERSION", "only version 2 is read")]
    plain = lambda h: h.strip().lower()
    found, problems = {}, []
    for e in template.get("expectations", []):
        if plain(e["raw"]) != e["normalizedName"]:
            problems.append(("STALE_TEMPLATE_COLUMN", f"the identity of {e['id']} is stale"))
        same = [h for h in headers if plain(h) == e["normalizedName"]]
        if e["id"] in headers:
            found[e["id"]] = e["id"]
        elif e.get("occurrence", 0) < len(same):
            found[e["id"]] = same[e.get("occurrence", 0)]
        else:
            problems.append(("STALE_TEMPLATE_COLUMN", f"{e['id']} is missing"))
    keys, mapping = template["keyColumns"], template.get("keyMapping") or {}
    lists = {"keyColumns": keys, "keyColumnsB": template.get("keyColumnsB") or keys, "compareColumns": template.get("compareColumns", [])}
    used = [*(c for v in lists.values() for c in v), *(r[k] for r in template.get("rules", []) for k in ("columnA", "columnB")), *mapping.get("applyA", []), *mapping.get("applyB", [])]
    if template.get("representativeColumn") is not None:
        used.append(template["representativeColumn"])
    if any(isinstance(c, int) and not 0 <= c < len(headers) for c in used):
        problems.append(("STALE_TEMPLATE_COLUMN", "a column number is out of range"))
    if missing := sorted({c for c in used if isinstance(c, str) and found.get(c, c) not in headers}):
        problems.append(("STALE_TEMPLATE_COLUMN", f"no column {', '.join(missing)}"))
    if len(set(keys)) < len(keys):
        problems.append(("DUPLICATE_KEY_COLUMN", "a key column stands twice"))
    if problems:
        return None, problems
    new = lambda c: found.get(c, c) if isinstance(c, str) else c
    out = {k: [new(c) for c in v] for k, v in lists.items()}
    out["rules"] = [r | {k: new(r[k]) for k in ("columnA", "columnB")} for r in template.get("rules", [])]
    out |= {k: template.get(k) for k in ("caseSensitive", "duplicatePolicy")} | {"representativeColumn": new(template.get("representativeColumn"))}
    out["keyMapping"] = mapping | {k: [new(c) for c in mapping.get(k, [])] for k in ("applyA", "applyB")} if mapping else None
    return out, []
