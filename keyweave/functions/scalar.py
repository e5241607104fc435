"""Tagged scalars: struct<version, type, value> of a column, and back."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
#: The largest whole number that every reader of the format holds exactly.
SAFE = 2**53 - 1
#: The names of types, and the form of decimals.
TYPES = ("null", "bool", "string", "int", "float", "decimal", "date", "datetime", "nonfinite", "json")
_PLAIN_DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def encode(column: Column, kind: T.DataType) -> Column:
    """struct<version: int, type: string, value: string> by the column's type; a timestamp without a zone is an error."""
    tag, text = F.lit("string"), column.cast("string")
    if isinstance(kind, T.BooleanType):
        tag = F.lit("bool")
    elif isinstance(kind, T.IntegralType):
        tag = F.when(F.abs(column.cast("decimal(38,0)")) > SAFE, "decimal").otherwise("int")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        odd = F.isnan(column) | (F.abs(column) == float("inf"))
        tag = F.when(odd, "nonfinite").otherwise("float")
        text = F.when(F.isnan(column), "nan").when(column == float("inf"), "inf").when(column == float("-inf"), "-inf").otherwise(text)
    elif isinstance(kind, T.DecimalType):
        tag = F.lit("decimal")
    elif isinstance(kind, T.DateType):
        tag = F.lit("date")
    elif isinstance(kind, T.TimestampType):
        tag, text = F.lit("datetime"), F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    elif isinstance(kind, T.TimestampNTZType):
        raise ValueError("a timestamp needs a time zone to be a scalar")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        tag, text = F.lit("json"), F.to_json(column)
    return F.struct(F.lit(VERSION).alias("version"), F.when(column.isNull(), "null").otherwise(tag).alias("type"), F.when(column.isNotNull(), text).alias("value"))


def valid(scalar: Column) -> Column:
    """Whether a tagged scalar reads as its type says."""
    kind, raw = scalar["type"], scalar["value"]
    checks = {
        "null": raw.isNull(), "string": raw.isNotNull(), "bool": raw.isin("true", "false"), "int": raw.rlike(r"^-?[0-9]+$") & (F.abs(raw.try_cast("decimal(38,0)")) <= SAFE),
        "float": raw.try_cast("double").isNotNull() & ~F.isnan(raw.try_cast("double")) & (F.abs(raw.try_cast("double")) < float("inf")), "decimal": raw.rlike(_PLAIN_DECIMAL),
        "date": raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & raw.try_cast("date").isNotNull(), "datetime": raw.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") & raw.try_cast("timestamp").isNotNull(),
        "nonfinite": raw.isin("nan", "inf", "-inf"), "json": F.try_parse_json(raw).isNotNull(),
    }
    out = F.lit(False)
    for name, check in checks.items():
        out = F.when(kind == name, check).otherwise(out)
    return F.coalesce((scalar["version"] == VERSION) & out, F.lit(False))


def decode(scalar: Column, kind: str) -> Column:
    """The value as a Spark type; null where the scalar isn't valid or is of another kind."""
    types = {"bool": "boolean", "string": "string", "int": "bigint", "float": "double", "decimal": "decimal(38,18)", "date": "date", "datetime": "timestamp", "nonfinite": "double", "json": "string"}
    raw = scalar["value"]
    if kind == "nonfinite":
        raw = F.replace(F.replace(raw, F.lit("inf"), F.lit("Infinity")), F.lit("nan"), F.lit("NaN"))
    return F.when(valid(scalar) & (scalar["type"] == kind), raw.try_cast(types[kind]))


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, nothing that isn't a number."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
