"""Fit a drafted contract to what the profile shows, and say what was changed.

Works on profile rows (one per column), never on data.
"""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any

# Texts that stand for a missing value among observed values.
MISSING_TEXTS = ("None", "", "null", "NULL")

_NUMERIC_NAMES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")

Change = tuple[str, str, str, str]  # rule, column, action, reason


def _numeric(dtype: str) -> bool:
    return dtype.split("(")[0] in _NUMERIC_NAMES


def reconcile(
    contract: Mapping[str, Any], profile: Mapping[str, Mapping[str, Any]]
) -> tuple[dict[str, Any], list[Change]]:
    """``profile`` maps column to ``dtype, null_count, row_count, values``. Returns the adjusted
    contract and the changes; without a profile nothing can be judged and nothing changes."""
    fitted = copy.deepcopy(dict(contract))
    rules = fitted.get("rules")
    if not profile or not isinstance(rules, dict):
        return fitted, []
    changes: list[Change] = []
    for kind in ("not_null", "unique"):
        if isinstance(rules.get(kind), dict) and isinstance(rules[kind].get("columns"), list):
            rules[kind]["columns"] = _fit_columns(kind, rules[kind], profile, changes)
    for kind, fit in (("range", _fit_range), ("regex", _keep), ("allowed_values", _fit_allowed)):
        if isinstance(rules.get(kind), dict) and isinstance(rules[kind].get("checks"), dict):
            checks = {}
            for column, value in rules[kind]["checks"].items():
                if column not in profile:
                    changes.append((kind, column, "drop", "unknown column"))
                    continue
                kept, value = fit(kind, column, value, profile[column], changes)
                if kept:
                    checks[column] = value
            rules[kind]["checks"] = checks
    for kind, part in (
        ("not_null", "columns"), ("unique", "columns"),
        ("range", "checks"), ("regex", "checks"), ("allowed_values", "checks"),
    ):
        if isinstance(rules.get(kind), dict) and rules[kind].get(part) in ([], {}):
            del rules[kind]
            changes.append((kind, "", "remove", "no valid columns left"))
    return fitted, changes


def _fit_columns(kind, rule, profile, changes):
    kept = []
    allowed = float(rule.get("max_fail_rate") or 0.0)
    for column in rule["columns"]:
        stats = profile.get(column)
        if stats is None:
            changes.append((kind, column, "drop", "unknown column"))
        elif kind == "not_null" and stats["null_count"] > allowed * stats["row_count"]:
            changes.append((kind, column, "drop", "nullable in the source"))
        else:
            kept.append(column)
    return kept


def _keep(kind, column, value, stats, changes):
    return True, value


def _fit_range(kind, column, bounds, stats, changes):
    if _numeric(stats["dtype"]):
        return True, bounds
    changes.append((kind, column, "drop", "not numeric"))
    return False, None


def _fit_allowed(kind, column, allowed, stats, changes):
    observed = {v for v in stats.get("values") or () if v not in MISSING_TEXTS}
    listed = {str(v) for v in allowed} if isinstance(allowed, list) else None
    if listed is None or observed <= listed:
        return True, allowed
    changes.append((kind, column, "widen", ",".join(sorted(observed - listed))))
    return True, sorted(listed | observed)
