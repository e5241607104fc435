"""One rule as columns: what each side carries, and how two of them compare.

Each side is normalised before the sides meet, so a grouped row holds typed values.  A slot is
struct<original, missing, value, stripped, ok>; comparing two slots gives RESULT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.config import Rule
from keyweave.functions.normalize import as_text, double_text, is_missing, is_missing_typed, normalize_text, parse_boolean, parse_date, parse_number, strip, to_float

RESULT = "struct<rule_id:string,display_name:string,original_a:string,original_b:string,normalized_a:string,normalized_b:string,status:string,reason:string,difference:double,absolute_difference:double,difference_rate:double,ok_a:boolean,ok_b:boolean,method:string,policy:string>"
_FIELDS = [tuple(f.split(":")) for f in RESULT[7:-1].split(",")]
#: Parts of a RESULT that are given as what they are.
_PLAIN = {"rule_id", "display_name", "status", "reason", "ok_a", "ok_b", "method", "policy"}
EQUAL, DIFFERENT, UNAVAILABLE, FAILED = "EQUAL", "DIFFERENT", "UNAVAILABLE", "CONVERSION_FAILED"


def family(rule: Rule) -> str:
    if rule.data_type in ("number", "unit_number"):
        return "number"
    if rule.data_type in ("date", "datetime"):
        return "date"
    return "boolean" if rule.data_type == "boolean" else "text"


def date_mode(rule: Rule) -> str:
    method = rule.comparison_method
    return {"exact_datetime": "datetime", "datetime": "date", "month": "year_month", "year_month": "year_month", "year": "year"}.get(method, "date")


def _text_options(rule: Rule) -> dict:
    adds = {"trim": "trim", "strip": "trim", "case_insensitive": "case_insensitive", "ignore_case": "case_insensitive", "collapse_spaces": "collapse_spaces", "remove_spaces": "remove_all_spaces", "remove_special": "remove_special_characters"}
    out = dict(rule.normalization_options)
    if rule.comparison_method in adds:
        out[adds[rule.comparison_method]] = True
    return out


def _number_options(rule: Rule) -> dict:
    unit = rule.data_type == "unit_number"
    return {"extract_number": unit, "remove_units": unit} | rule.normalization_options


def typed_value(rule: Rule, column: Column, kind: T.DataType) -> Column:
    """The normalised value of one side; null where it can't be converted."""
    text = as_text(column, kind)
    match family(rule):
        case "number":
            numeric = isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)
            if numeric and not {"percent_string"} & rule.normalization_options.keys():
                x = column.cast("double")
                return F.when(~F.isnan(x), x)
            return parse_number(text, _number_options(rule))
        case "date":
            mode, dayfirst = date_mode(rule), bool(rule.normalization_options.get("dayfirst", False))
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                day = column.cast("date")
                return {"datetime": lambda: column.cast("timestamp"), "year": lambda: F.year(day), "year_month": lambda: F.trunc(day, "month"), "date": lambda: day}[mode]()
            return parse_date(text, mode, dayfirst)
        case "boolean":
            if isinstance(kind, T.BooleanType) and not rule.normalization_options.get("mapping"):
                return column
            return parse_boolean(text, rule.normalization_options.get("mapping"))
    return normalize_text(text, _text_options(rule))


def value_text(rule: Rule, value: Column) -> Column:
    match family(rule):
        case "number":
            return double_text(value)
        case "date":
            mode = date_mode(rule)
            if mode == "year":
                return value.cast("string")
            return F.date_format(value, {"datetime": "yyyy-MM-dd HH:mm:ss", "year_month": "yyyy-MM"}.get(mode, "yyyy-MM-dd"))
        case "boolean":
            return F.when(value, "True").when(~value, "False")
    return value


def rounded(rule: Rule, value: Column) -> Column:
    """What the round method compares: half to even, on the number's decimal form."""
    if family(rule) == "number" and rule.comparison_method in ("round", "rounding") and rule.tolerance_options.decimals is not None:
        return F.bround(value, rule.tolerance_options.decimals)
    return value


def tells_apart(rule: Rule, kind: T.DataType) -> bool:
    """Whether two values of a typed column are the same only where their originals are, and none of them fails to convert."""
    if is_missing_typed(F.lit(None), kind, rule.null_policy.missing_tokens) is None:
        return False
    match family(rule):
        case "number":
            exact = isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType))
            return exact and rule.comparison_method not in ("round", "rounding") and "percent_string" not in rule.normalization_options
        case "date":
            return isinstance(kind, T.DateType) and date_mode(rule) == "date"
        case "boolean":
            return isinstance(kind, T.BooleanType) and not rule.normalization_options.get("mapping")
    return False


def slot(rule: Rule, column: Column, kind: T.DataType) -> Column:
    text = as_text(column, kind)
    ascii_only = bool(rule.normalization_options.get("assume_ascii"))
    missing = is_missing_typed(column, kind, rule.null_policy.missing_tokens)
    if missing is None:
        missing = is_missing(text, rule.null_policy.missing_tokens, ascii_only)
    value = typed_value(rule, column, kind)
    fields = [text.alias("original"), missing.alias("missing"), F.when(~missing, value).alias("value")]
    if rule.null_policy.empty_equals_zero or rule.null_policy.empty_equals_text is not None:
        fields.append(strip(text, ascii_only).alias("stripped"))
    # text always converts; what is missing isn't converted at all
    fields.append((F.lit(True) if family(rule) == "text" else missing | value.isNotNull()).alias("ok"))
    return F.struct(*fields)


def constant(rule: Rule, status: Column | str, reason: Column | str, **more: Column) -> Column:
    """A RESULT of given parts."""
    status, reason = (F.lit(x) if isinstance(x, str) else x for x in (status, reason))
    yes = F.lit(True)
    given = {"rule_id": F.lit(rule.rule_id), "display_name": F.lit(rule.display_name), "status": status, "reason": reason, "ok_a": yes, "ok_b": yes, "method": F.lit(rule.comparison_method), "policy": F.lit("")} | more
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) if n not in _PLAIN or n not in given else given[n].alias(n) for n, t in _FIELDS])


def result_literal(told: dict[str, str]) -> str:
    """A RESULT of texts alone, both sides of which are in order, as an expression: nothing else is in it."""
    quoted = {k: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in told.items()}
    return f"named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, ' + (quoted[n] if n in quoted else 'true' if n in ('ok_a', 'ok_b') else f'CAST(NULL AS {t})') for n, t in _FIELDS)})"


def compare_slots(rule: Rule, a: Column, b: Column) -> Column:
    """RESULT of two slots: the null policy first, then the typed comparison."""
    policy, tolerance, kind = rule.null_policy, rule.tolerance_options, family(rule)
    both, one = a["missing"] & b["missing"], a["missing"] | b["missing"]
    ok_a, ok_b = F.coalesce(a["ok"], F.lit(False)), F.coalesce(b["ok"], F.lit(False))
    x, y = rounded(rule, a["value"]), rounded(rule, b["value"])
    difference = absolute = rate = F.lit(None).cast("double")
    converted = ok_a & ok_b
    if kind == "number":
        difference = a["value"] - b["value"]
        absolute = F.abs(difference)
        rate = F.when(b["value"] != 0, F.try_divide(absolute, F.abs(b["value"]))).when(absolute == 0, F.lit(0.0))
        method = rule.comparison_method
        if method in ("exact", "round", "rounding"):
            equal = x == y
        elif method in ("absolute_tolerance", "absolute"):
            equal = F.abs(x - y) <= F.lit(float(tolerance.absolute or 0.0))
        elif method in ("relative_tolerance", "relative", "percentage"):
            share = tolerance.relative if tolerance.relative is not None else tolerance.percentage or 0
            equal = F.abs(x - y) <= F.abs(b["value"]) * F.lit(float(share) / (100 if tolerance.percentage is not None else 1))
        else:
            equal = F.abs(x - y) <= F.lit(0.0)
    elif kind == "date":
        equal = x == y
        if date_mode(rule) in ("date", "datetime"):
            days = F.abs(F.datediff(x, y)).cast("double") if date_mode(rule) == "date" else F.abs(F.unix_micros(x) - F.unix_micros(y)) / 86_400e6
            difference = absolute = days
            equal = equal | (days <= F.lit(float(tolerance.absolute or 0)))
    elif kind == "boolean":
        equal = x == y
    else:
        # a token that the rule lets through may still normalise to nothing
        equal = x.eqNullSafe(y)
    equal = F.coalesce(equal, F.lit(False))
    outcome = F.when(both, F.lit(policy.both_empty_equal))
    reason = F.when(both, "BOTH_EMPTY")
    if one_rules := _one_missing(rule, a, b, one):
        for condition, name in one_rules:
            outcome, reason = outcome.when(condition, F.lit(True)), reason.when(condition, name)
    outcome = outcome.when(one, F.lit(not policy.one_empty_mismatch)).when(~converted, F.lit(False)).otherwise(equal)
    reason = reason.when(one, "ONE_EMPTY").when(~converted, "NOT_CONVERTED").when(equal, "SAME_VALUE").otherwise("OTHER_VALUE")
    compared = ~one & converted
    text_a, text_b = value_text(rule, x), value_text(rule, y)
    return constant(
        rule, F.when(outcome, EQUAL).otherwise(DIFFERENT), reason,
        original_a=a["original"], original_b=b["original"],
        normalized_a=F.when(both, None).when(one, F.when(~a["missing"], a["original"])).otherwise(text_a),
        normalized_b=F.when(both, None).when(one, F.when(~b["missing"], b["original"])).otherwise(text_b),
        difference=F.when(compared, difference), absolute_difference=F.when(compared, absolute), difference_rate=F.when(compared, rate),
        ok_a=one | ok_a, ok_b=one | ok_b,
    )


def _one_missing(rule: Rule, a: Column, b: Column, one: Column) -> list[tuple[Column, str]]:
    policy, out = rule.null_policy, []
    if policy.empty_equals_zero or policy.empty_equals_text is not None:
        other = F.when(a["missing"], b["stripped"]).otherwise(a["stripped"])
        if policy.empty_equals_zero:
            out.append((one & (to_float(other) == 0), "EMPTY_IS_ZERO"))
        if policy.empty_equals_text is not None:
            out.append((one & (other == policy.empty_equals_text), "EMPTY_IS_TEXT"))
    return out
