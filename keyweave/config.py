"""What to compare and how: the configuration is the query.

Field names and defaults are fixed values: saved templates carry them.  Some fields are kept for those
templates alone and change nothing: ``exclude_empty_rows``, ``compare_mode``, ``aggregation_method``
of a duplicate policy, and ``visible``.
"""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from datetime import datetime
from typing import Any, get_type_hints

#: What the fields of a saved template may hold.
JOIN_TYPES = ("outer", "left", "right", "inner")
DATA_TYPES = ("text", "number", "unit_number", "date", "datetime", "boolean", "mixed")
PICK_POLICIES = ("first", "last", "representative")
COLLECTION_POLICIES = ("set", "multiset", "aggregate")
AGGREGATES = ("sum", "mean", "min", "max", "count", "nunique", "first_date", "last_date", "concat_unique", "concat_sorted")
#: What stands for nothing, after white space and case are gone.
MISSING_TOKENS = ("", "null", "none", "nan", "n/a", "na", "-")


class ConfigError(ValueError):
    pass


@dataclass
class KeyOptions:
    trim: bool = True
    collapse_spaces: bool = False
    remove_all_spaces: bool = False
    case_insensitive: bool = False
    remove_line_breaks: bool = True
    remove_special_spaces: bool = True
    unicode_normalize: bool = True
    strip_numeric_dot_zero: bool = True
    coerce_numeric_string: bool = False
    date_format: str | None = None
    replacements: dict = field(default_factory=dict)


@dataclass
class KeyMapping:
    name: str = "key mapping"
    enabled: bool = False
    groups: dict = field(default_factory=dict)
    canonical_column: str | None = None
    alias_columns: list = field(default_factory=list)
    use_all_other_columns: bool = False


@dataclass
class Dataset:
    file_name: str = ""
    source_type: str = "table"
    sheet_name: str | None = None
    header_row: int = 1
    data_start_row: int = 2
    key_columns: list = field(default_factory=list)
    key_normalization: KeyOptions = field(default_factory=KeyOptions)
    key_mappings: dict = field(default_factory=dict)
    drop_empty_rows: bool = True
    drop_empty_columns: bool = True
    encoding: str | None = None
    delimiter: str | None = None


@dataclass
class NullPolicy:
    both_empty_equal: bool = True
    one_empty_mismatch: bool = True
    exclude_empty_rows: bool = False
    empty_equals_zero: bool = False
    empty_equals_text: str | None = None
    missing_tokens: list = field(default_factory=lambda: list(MISSING_TOKENS))


@dataclass
class Tolerance:
    decimals: int | None = None
    absolute: float | None = None
    relative: float | None = None
    percentage: float | None = None


@dataclass
class Rule:
    rule_id: str
    display_name: str
    column_a_id: str
    column_b_id: str
    data_type: str = "text"
    comparison_method: str = "exact"
    normalization_options: dict = field(default_factory=dict)
    null_policy: NullPolicy = field(default_factory=NullPolicy)
    tolerance_options: Tolerance = field(default_factory=Tolerance)
    visible: bool = True


@dataclass
class DuplicatePolicy:
    dataset_side: str = ""
    policy_type: str = "error"
    representative_sort_column: str | None = None
    representative_sort_direction: str = "desc"
    aggregation_method: str | None = None
    compare_mode: str = "row"
    allow_one_to_many: bool = False

    @property
    def row_wise(self) -> bool:
        return self.policy_type not in (*PICK_POLICIES, *COLLECTION_POLICIES) and (self.policy_type != "error" or self.allow_one_to_many)


@dataclass
class Comparison:
    dataset_a: Dataset = field(default_factory=Dataset)
    dataset_b: Dataset = field(default_factory=Dataset)
    join_type: str = "outer"
    duplicate_policy_a: DuplicatePolicy = field(default_factory=lambda: DuplicatePolicy("A"))
    duplicate_policy_b: DuplicatePolicy = field(default_factory=lambda: DuplicatePolicy("B"))
    nm_policy: str = "error"
    comparison_rules: list[Rule] = field(default_factory=list)
    created_at: str = ""

    def validate(self, rules_required: bool = True) -> Comparison:
        a, b = self.dataset_a.key_columns, self.dataset_b.key_columns
        problems = []
        if self.join_type not in JOIN_TYPES:
            problems.append(f"join type {self.join_type!r} isn't one of {', '.join(JOIN_TYPES)}")
        if not a or not b:
            problems.append("both sides need key columns")
        elif len(a) != len(b):
            problems.append("both sides need as many key columns")
        if rules_required and not self.comparison_rules:
            problems.append("a comparison rule is needed")
        for rule in self.comparison_rules:
            method = rule.normalization_options.get("aggregation_method", "sum")
            if method not in AGGREGATES:
                problems.append(f"rule {rule.rule_id}: {method!r} isn't an aggregate")
        if problems:
            raise ConfigError("; ".join(problems))
        return self


def compare(keys, rules: list[Rule], keys_b=None, **more) -> Comparison:
    """A configuration for tables: key columns by name, the same on both sides unless said."""
    a = [keys] if isinstance(keys, str) else list(keys)
    b = a if keys_b is None else [keys_b] if isinstance(keys_b, str) else list(keys_b)
    options = more.pop("key_options", KeyOptions())
    mappings = more.pop("mappings", {})
    side = lambda columns: Dataset(key_columns=columns, key_normalization=options, key_mappings={c: m for c, m in mappings.items() if c in columns})
    return Comparison(side(a), side(b), comparison_rules=rules, **more)


_NESTED = {(Dataset, "key_mappings"): KeyMapping}


def _read(kind: type, raw: Any):
    if not is_dataclass(kind) or not isinstance(raw, dict):
        return raw
    hints, out = get_type_hints(kind), {}
    known = {f.name: f for f in fields(kind)}
    if unknown := raw.keys() - known.keys():
        raise ConfigError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    for name, value in raw.items():
        if inner := _NESTED.get((kind, name)):
            out[name] = {k: _read(inner, v) for k, v in (value or {}).items()}
        elif hints[name] == list[Rule]:
            out[name] = [_read(Rule, v) for v in value or []]
        elif value is None and is_dataclass(hints[name]):
            out[name] = hints[name]()
        else:
            out[name] = _read(hints[name], value)
    missing = [f.name for f in known.values() if f.default is MISSING and f.default_factory is MISSING and f.name not in out]
    if missing:
        raise ConfigError(f"{kind.__name__} needs {', '.join(missing)}")
    return kind(**out)


def from_dict(payload: dict) -> Comparison:
    made = _read(Comparison, {k: v for k, v in payload.items() if k in {f.name for f in fields(Comparison)}})
    made.duplicate_policy_a.dataset_side, made.duplicate_policy_b.dataset_side = "A", "B"
    made.created_at = made.created_at or datetime.now().isoformat(timespec="seconds")
    return made


def to_dict(config: Comparison) -> dict:
    return asdict(config)


def to_json(config: Comparison) -> str:
    return json.dumps(to_dict(config), ensure_ascii=False, indent=2, default=str)
