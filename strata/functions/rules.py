"""Rule registry: a rule name maps to a function building a pass condition.

A row fails a rule iff ``NOT(condition)`` is TRUE, so a NULL condition is not
a failure (three-valued logic, same as SQL). Conditions are plain Columns, so
every rule stays inside whole-stage codegen and all rules over one table can be
fused into a single aggregate.

Group rules (``unique``) are not row predicates; they are evaluated by the
quality engine as a separate aggregate over the column.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RowRule = Callable[[Column, dict, T.DataType | None], Column]


@dataclass(frozen=True)
class RuleSpec:
    name: str
    kind: str  # "row" or "group"
    build: RowRule | None


RULES: dict[str, RuleSpec] = {}


def rule(name: str, kind: str = "row"):
    """Register ``fn(col, params, data_type) -> Column`` under ``name``."""

    def decorator(fn):
        RULES[name] = RuleSpec(name, kind, fn)
        return fn

    return decorator


def register_group_rule(name: str) -> None:
    RULES[name] = RuleSpec(name, "group", None)


def get_rule(name: str) -> RuleSpec | None:
    return RULES.get(name)


@rule("not_null")
def _not_null(c: Column, params: dict, dt=None) -> Column:
    return c.isNotNull()


@rule("positive")
def _positive(c: Column, params: dict, dt=None) -> Column:
    return c > 0


@rule("non_negative")
def _non_negative(c: Column, params: dict, dt=None) -> Column:
    return c >= 0


@rule("in_range")
def _in_range(c: Column, params: dict, dt=None) -> Column:
    # An absent bound is unbounded on that side.
    cond = F.lit(True)
    if params.get("min") is not None:
        cond = cond & (c >= F.lit(params["min"]))
    if params.get("max") is not None:
        cond = cond & (c <= F.lit(params["max"]))
    return cond


@rule("in_set")
def _in_set(c: Column, params: dict, dt=None) -> Column:
    values = list(params.get("values", []))
    if not values:
        # Every non-NULL value fails an empty set; NULL stays unknown.
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return c.isin(values)


@rule("matches_regex")
def _matches_regex(c: Column, params: dict, dt=None) -> Column:
    # Partial match, like a regex search.
    return c.rlike(params.get("pattern", ".*"))


@rule("no_future_dates")
def _no_future_dates(c: Column, params: dict, dt=None) -> Column:
    as_of = params.get("as_of")
    if as_of is None:
        ref = F.current_date()
    elif isinstance(as_of, (_dt.date, _dt.datetime)):
        ref = F.lit(as_of).cast("date")
    else:
        ref = F.to_date(F.lit(str(as_of)))
    return F.to_date(c) <= ref


@rule("valid_date")
def _valid_date(c: Column, params: dict, dt=None) -> Column:
    # Typed dates/timestamps are valid by construction; strings must parse as
    # year-month-day (single-digit month/day accepted).
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(True)
    return c.isNull() | F.try_to_timestamp(c.cast("string"), F.lit("yyyy-M-d")).isNotNull()


register_group_rule("unique")
register_group_rule("unique_strict")
