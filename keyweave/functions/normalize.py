"""Text, number, date and boolean normalisation as column expressions.

All of it stays in the JVM but for Unicode NFKC and case folding, which Spark has no function for;
both share one Arrow UDF that passes ASCII text through.  It isn't in the plan unless asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.config import MISSING_TOKENS

#: What strip() takes for white space: Java's Unicode class and four control characters more.
_SPACE = r"(?U)[\s\x1c-\x1f]"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Of these, what ends in ``.0``: whole numbers all.
_WHOLE = r"^[+-]?\d*\.0$"
#: All of it that is ASCII.
_ASCII_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
#: Fixed values.
_FIRST_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
CURRENCY = r"(?i)[₩$€£원]|krw|usd|eur"
TRUE_WORDS = ("y", "yes", "true", "1", "사용", "활성")
FALSE_WORDS = ("n", "no", "false", "0", "미사용", "비활성")
#: A spelled-out date.
_KOREAN_DATE = r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일$"
#: Date patterns in the order they are tried; with ``dayfirst`` the two slashed ones change places.
DATE_PATTERNS = ("yyyy-M-d", "yyyy-M-d H:m[:s[.SSSSSS][.SSS]]", "yyyy-M-d'T'H:m[:s[.SSSSSS][.SSS]][XXX]", "yyyy/M/d", "yyyy/M/d H:m[:s]", "yyyy.M.d", "yyyy.M.d H:m[:s]", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy H:m[:s]", "yyyyMMdd", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy-M", "yyyy")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is in the plan, and evaluated, once however often it is used.

    A chain of steps that use their input more than once is then as long as its steps; without this, each
    step repeats all before it.  ``use`` can't hold a Python step.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column, ascii_only: bool = False) -> Column:
    """``text`` without white space at its ends; a plain trim where no letter is beyond ASCII."""
    return F.btrim(text, F.lit(_ASCII_SPACE)) if ascii_only else F.regexp_replace(text, _EDGES, "")


def double_text(x: Column) -> Column:
    """A number without exponent: integers as ``12.0``, others with as many digits as they need."""
    whole = F.concat(x.try_cast("bigint").cast("string"), F.lit(".0"))
    exact = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?[1-9])0+$", "$1")
    text = x.cast("string")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), whole).when(text.contains("E") & (F.abs(x) < 1e15), exact).otherwise(text)


def as_text(column: Column, kind: T.DataType) -> Column:
    """The text of a typed value."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = column.cast("double")
        return F.when(~F.isnan(x), double_text(x))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def is_missing(text: Column, tokens: Sequence[str] | None = None, ascii_only: bool = False) -> Column:
    """Null, or one of the tokens after white space and case are gone; no tokens at all means the usual ones."""
    return text.isNull() | F.lower(strip(text, ascii_only)).isin(*(tokens or MISSING_TOKENS))


def is_missing_typed(column: Column, kind: T.DataType, tokens: Sequence[str] | None = None) -> Column | None:
    """The same for a number, date or truth value, whose text no token can be; None where one might."""
    typed = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
    if not typed or any(c.isdigit() for t in tokens or () for c in t) or {"true", "false", "infinity", "-infinity"} & {t.strip().lower() for t in tokens or ()}:
        return None
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column.isNull()


def _unicode(nfkc: bool, fold: bool, each: bool = False):
    """The Python step; with ``each`` for every text of an array, and no filter on its result repeats it."""

    def change(text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text.lower() if fold else text
        text = unicodedata.normalize("NFKC", text) if nfkc else text
        return text.casefold() if fold else text

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(change, na_action="ignore")

    @F.pandas_udf("array<string>")
    def apply_each(values: pd.Series) -> pd.Series:
        return values.map(lambda texts: [change(t) for t in texts], na_action="ignore")

    return apply_each.asNondeterministic() if each else apply


def normalize_text(text: Column, options: dict | None = None) -> Column:
    """The text steps in their fixed order; usual missing tokens become null.

    ``missing_tokens`` are others to take for that; ``assume_ascii`` says that no value has a letter beyond ASCII: the Python step is left out.
    """
    o = options or {}
    ascii_only = o.get("assume_ascii", False)
    out = _not_missing(text, o)
    if o.get("unicode_normalize", True) and not ascii_only:
        out = _unicode(True, False)(out)
    out = _between(out, o)
    if o.get("case_insensitive", False):
        out = F.lower(out) if ascii_only else _unicode(False, True)(out)
    return _letters(out, o)


def _not_missing(text: Column, o: dict) -> Column:
    return F.when(~is_missing(text, o.get("missing_tokens"), o.get("assume_ascii", False)), text)


def _between(out: Column, o: dict) -> Column:
    """The text steps between the Unicode form and the case."""
    ascii_only = o.get("assume_ascii", False)
    if o.get("remove_special_spaces", True) and not ascii_only:
        out = F.translate(out, "\u00a0\u3000", "  ")
    if o.get("remove_line_breaks", True):
        broken = out.contains("\n") | out.contains("\r")
        out = F.when(broken, F.regexp_replace(out, r"[\r\n]+", " ")).otherwise(out)
    for old, new in (o.get("replacements") or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new)) if old else out
    if o.get("collapse_spaces", False):
        out = F.regexp_replace(out, _SPACE + "+", " ")
    if o.get("remove_all_spaces", False):
        out = F.regexp_replace(out, _SPACE + "+", "")
    if o.get("trim", True):
        out = strip(out, ascii_only)
    return out


def _letters(out: Column, o: dict) -> Column:
    return F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s-]", "") if o.get("remove_special_characters", False) else out


def to_float(text: Column) -> Column:
    """What float() takes, by a guard that try_cast lacks; not-a-number reads as null."""
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(text.rlike(_FLOAT), text.try_cast("double")).when(F.lower(text).rlike(r"^[+-]?inf(inity)?$"), sign * F.lit(float("inf")))


def parse_number(text: Column, options: dict | None = None) -> Column:
    o = options or {}
    percent = o.get("percent_string", False)

    def signed(t: Column) -> Column:
        if not o.get("parentheses_negative", True):
            return t
        return F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), t.substr(F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)

    def number(t: Column) -> Column:
        out = F.regexp_replace(t, "%$", "") if percent else t
        if o.get("remove_commas", True):
            out = F.replace(out, F.lit(","), F.lit(""))
        if o.get("remove_currency", True):
            out = F.regexp_replace(out, CURRENCY, "")
        if o.get("remove_spaces", True):
            out = F.regexp_replace(out, _SPACE + "+", "")
        if o.get("extract_number", False) or o.get("remove_units", False):
            out = F.regexp_extract(out, _FIRST_NUMBER, 0)
        return let(out, to_float) / (F.when(t.endswith("%"), 100.0).otherwise(1.0) if percent else F.lit(1.0))

    signs = let(strip(text), signed)
    return let(signs, number) if percent else number(signs)


def parse_timestamp(text: Column, dayfirst: bool = False) -> Column:
    """A timestamp by the listed patterns alone: a bare time or other loose spelling is null."""
    patterns = list(DATE_PATTERNS)
    if dayfirst:
        i, j = patterns.index("M/d/yyyy"), patterns.index("d/M/yyyy")
        patterns[i], patterns[j] = patterns[j], patterns[i]
    # one test on the shape leaves most texts with one or two patterns
    shapes = {r"^\d{4}-\d{1,2}-": "yyyy-M-d", r"^\d{4}/": "yyyy/", r"^\d{4}\.": "yyyy.", r"^\d{1,2}/": ("M/d", "d/M"), r"^\d{8}$": "yyyyMMdd", r"^[A-Za-z]": "MMM", r"^\d{1,2} [A-Za-z]": "d MMM"}
    rest = [p for p in patterns if p in ("yyyy-M", "yyyy")]
    short = {r"^\d{4}-\d{1,2}$": [rest[0]], r"^(1[6-9]|2\d)\d{2}$": [rest[1]]}

    def parsed(stripped: Column) -> Column:
        out = F.lit(None).cast("timestamp")
        for shape, tried in [*((s, [p for p in patterns if p.startswith(f)]) for s, f in shapes.items()), *short.items()]:
            out = F.when(stripped.rlike(shape), F.coalesce(*[F.try_to_timestamp(stripped, F.lit(p)) for p in tried])).otherwise(out)
        return out

    return let(F.regexp_replace(strip(text), _KOREAN_DATE, "$1-$2-$3"), parsed)


def parse_date(text: Column, mode: str = "date", dayfirst: bool = False) -> Column:
    """``date``: a date; ``datetime``: a timestamp; ``year``: an integer; ``year_month``: the month's first day."""
    at = parse_timestamp(text, dayfirst)
    if mode == "datetime":
        return at
    if mode == "year":
        return F.year(at)
    if mode == "year_month":
        return F.trunc(at.cast("date"), "month")
    return at.cast("date")


def parse_boolean(text: Column, vocabulary: dict | None = None) -> Column:
    words = {str(k).casefold(): v for k, v in vocabulary.items()} if vocabulary else dict.fromkeys(TRUE_WORDS, True) | dict.fromkeys(FALSE_WORDS, False)
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in words.items())), F.lower(strip(text)))


def plain_key(kind: T.DataType, options) -> bool:
    """Whether the digits of a whole number are its key as they are: no step of ``options`` can change them."""
    return isinstance(kind, T.IntegralType) and not (options.replacements or options.date_format or options.coerce_numeric_string)


def normalize_key(text: Column, options) -> Column:
    """One key component; ``options`` as attributes (KeyOptions) and ``assume_ascii`` if it has that."""
    return _key_form(normalize_text(text, dict(vars(options))), options)


def normalize_keys(texts: Column, options) -> Column:
    """``normalize_key`` of every text of an array: however many they are, a Python step takes them at once."""
    o = dict(vars(options))
    nfkc, fold = (o.get(x, d) and not o.get("assume_ascii", False) for x, d in (("unicode_normalize", True), ("case_insensitive", False)))
    if not nfkc and not fold:
        return F.transform(texts, lambda t: normalize_key(t, options))
    out = F.transform(texts, lambda t: _not_missing(t, o))
    out = F.transform(_unicode(True, False, True)(out) if nfkc else out, lambda t: _between(t, o))
    out = _unicode(False, True, True)(out) if fold else out
    return F.transform(out, lambda t: _key_form(_letters(t, o), options))


def _key_form(value: Column, options) -> Column:
    """The steps of keys alone."""
    if not (options.strip_numeric_dot_zero or options.date_format or options.coerce_numeric_string):
        return value

    def key(v: Column) -> Column:
        out = v
        if options.strip_numeric_dot_zero:
            out = F.when(v.endswith(".0") & v.rlike(_WHOLE), v.substr(F.lit(1), F.length(v) - 2)).otherwise(v)
        if options.date_format:
            shape = {"datetime": "yyyy-MM-dd HH:mm:ss", "year_month": "yyyy-MM"}.get(options.date_format, "yyyy-MM-dd")
            parsed = parse_date(v, options.date_format)
            out = F.coalesce(parsed.cast("string") if options.date_format == "year" else F.date_format(parsed, shape), out)
        if options.coerce_numeric_string:
            out = F.coalesce(let(parse_number(v), number_text), out)
        return out

    def number_text(number: Column) -> Column:
        if not options.strip_numeric_dot_zero:
            return double_text(number)
        whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
        return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(double_text(number))

    return let(value, key)


def excel_letter(index: int) -> str:
    """The letters of a column number from 0."""
    out, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def fingerprint(name: str) -> str:
    """A column name as templates know it."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip().casefold()
