"""Data-quality checks of a table.

All row-level checks of a suite become conditional aggregates of one pass over the data;
uniqueness of all columns is one grouping-sets aggregation. NULL is ignored by every value
check except the one for NULLs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.config import QualitySpec, parse_value
from sentinela.functions.dates import java_pattern
from sentinela.operators.reconcile import COMPARISONS, Counterpart, comparison_outcomes

DATASET = "Dataset"


class QualityFailure(Exception):
    """A suite that must stop the job found unexpected values."""


@dataclass(frozen=True)
class Check:
    """``bad`` marks an unexpected row; ``verdict`` replaces the count for whole-table checks."""

    subject: str
    label: str
    bad: Column | None = None
    verdict: Callable[[Column], Column] | None = None
    note: Column | None = None
    unique: bool = False


def _listed(value: Any) -> list:
    """Lists as they are; text is split at commas."""
    if isinstance(value, str):
        return [part.strip() for part in value.split(",")]
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _resolve(df: DataFrame, name: str) -> str:
    """Column name in the frame, matched without regard to case."""
    for column in df.columns:
        if column.lower() == name.lower():
            return column
    raise ValueError(f"quality check on unknown column {name!r}")


def _aligned(params: dict[str, Any], *names: str) -> list[tuple]:
    lists = [_listed(params[name]) for name in names]
    if len({len(values) for values in lists}) != 1:
        raise ValueError(f"quality parameters {names} differ in length")
    return list(zip(*lists))


def not_null(df: DataFrame, params: dict) -> list[Check]:
    return [Check(c, "not null values", F.col(_resolve(df, c)).isNull()) for c in _listed(params["column"])]


def unique_vals(df: DataFrame, params: dict) -> list[Check]:
    return [Check(c, "unique values", unique=True) for c in _listed(params["column"])]


def date_mask_equal(df: DataFrame, params: dict) -> list[Check]:
    checks = []
    for c, mask in _aligned(params, "column", "date_mask"):
        text = F.col(_resolve(df, c)).cast("string")
        bad = text.isNotNull() & F.try_to_timestamp(text, F.lit(java_pattern(mask))).isNull()
        checks.append(Check(c, f"date mask matches {mask}", bad))
    return checks


def value_length_between(df: DataFrame, params: dict) -> list[Check]:
    checks = []
    for c, low, high in _aligned(params, "column", "min", "max"):
        length = F.length(F.col(_resolve(df, c)).cast("string"))
        checks.append(Check(c, f"value length between {low} and {high}", ~length.between(int(low), int(high))))
    return checks


def df_count_between(df: DataFrame, params: dict) -> list[Check]:
    low, high = int(params["min"]), int(params["max"])
    return [Check(DATASET, f"DataFrame row count between {low} and {high}",
                  verdict=lambda rows: rows.between(low, high))]


def value_match_regex(df: DataFrame, params: dict) -> list[Check]:
    """Patterns given as a list may contain commas."""
    return [
        Check(c, f"values match regex {regex}", ~F.col(_resolve(df, c)).cast("string").rlike(regex))
        for c, regex in _aligned(params, "column", "regex")
    ]


def values_between(df: DataFrame, params: dict) -> list[Check]:
    """Also reports the mean of all unexpected values."""
    checks = []
    for c, low, high in _aligned(params, "column", "min", "max"):
        given = F.col(_resolve(df, c))
        number = given.try_cast("double")
        bad = given.isNotNull() & ~F.coalesce(number.between(float(low), float(high)), F.lit(False))
        checks.append(Check(c, f"values between {float(low)} and {float(high)}", bad,
                            note=F.avg(F.when(bad, number))))
    return checks


_CONVERT = {"int": int, "float": float, "str": str}


def _sets(params: dict) -> list[tuple]:
    out = []
    for c, kind, values in zip(_listed(params["column"]), _listed(params["type"]), params["set_values"], strict=True):
        out.append((c, [_CONVERT.get(kind, str)(v) for v in values]))
    return out


def values_not_be_in_set(df: DataFrame, params: dict) -> list[Check]:
    return [Check(c, f"column {c} must not contain values {vals}", F.col(_resolve(df, c)).isin(vals))
            for c, vals in _sets(params)]


def values_to_be_in_set(df: DataFrame, params: dict) -> list[Check]:
    return [Check(c, f"column {c} must only contain values {vals}", ~F.col(_resolve(df, c)).isin(vals))
            for c, vals in _sets(params)]


BUILDERS: dict[str, Callable[[DataFrame, dict], list[Check]]] = {
    f.__name__: f for f in (
        not_null, unique_vals, date_mask_equal, value_length_between, df_count_between,
        value_match_regex, values_between, values_not_be_in_set, values_to_be_in_set,
    )
}


def build_checks(df: DataFrame, checks: dict[str, Any]) -> list[Check]:
    """Checks in configured order; an unknown name is an error."""
    built: list[Check] = []
    for name, params in checks.items():
        if name not in BUILDERS:
            raise ValueError(f"unknown quality check {name!r}")
        built.extend(BUILDERS[name](df, parse_value(params)))
    return built


def _outcome(check: Check, count: Column, passed: Column, note: Column, position: int) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(check.subject).alias("column_tested"),
        F.lit(check.label).alias("test_applied"),
        count.cast("bigint").alias("unexpected_count"),
        note.cast("double").alias("mean_unexpected"),
        F.when(passed, "success").otherwise("failure").alias("status"),
    )


def _one_pass(df: DataFrame, numbered: list[tuple[int, Check]]) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, check in numbered:
        if check.bad is not None:
            aggregates.append(F.count_if(F.coalesce(check.bad, F.lit(False))).alias(f"_bad{i}"))
        if check.note is not None:
            aggregates.append(check.note.alias(f"_note{i}"))
    outcomes = []
    for i, check in numbered:
        note = F.col(f"_note{i}") if check.note is not None else F.lit(None)
        if check.verdict is not None:
            passed = check.verdict(F.col("_rows"))
            outcomes.append(_outcome(check, F.when(passed, 0).otherwise(1), passed, note, i))
        else:
            count = F.col(f"_bad{i}")
            outcomes.append(_outcome(check, count, count == 0, note, i))
    return df.agg(*aggregates).select(F.inline(F.array(*outcomes)))


def _uniqueness(df: DataFrame, numbered: list[tuple[int, Check]]) -> DataFrame:
    columns = list(dict.fromkeys(_resolve(df, check.subject) for _, check in numbered))
    per_value = df.select(*columns).groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(c).alias(f"_off_{c}") for c in columns])
    repeats = [
        F.coalesce(F.sum(F.when((F.col(f"_off_{c}") == 0) & F.col(c).isNotNull() & (F.col("_n") > 1), F.col("_n"))),
                   F.lit(0)).alias(f"_bad_{c}")
        for c in columns
    ]
    outcomes = []
    for i, check in numbered:
        count = F.col(f"_bad_{_resolve(df, check.subject)}")
        outcomes.append(_outcome(check, count, count == 0, F.lit(None), i))
    return per_value.agg(*repeats).select(F.inline(F.array(*outcomes)))


def run_checks(df: DataFrame, checks: dict[str, Any], table: str) -> DataFrame:
    """Result rows ``table, column_tested, test_applied, unexpected_count, mean_unexpected, status``."""
    numbered = list(enumerate(build_checks(df, checks)))
    row_level = [(i, c) for i, c in numbered if not c.unique]
    unique = [(i, c) for i, c in numbered if c.unique]
    parts = ([_one_pass(df, row_level)] if row_level else []) + ([_uniqueness(df, unique)] if unique else [])
    if not parts:
        raise ValueError("no quality checks given")
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return result.select(F.lit(table).alias("table_name"), "position", "column_tested", "test_applied",
                         "unexpected_count", "mean_unexpected", "status")


def run_suite(df: DataFrame, spec: QualitySpec, counterpart: Counterpart | None = None) -> list[dict[str, Any]]:
    """Run a suite and return its outcomes (one small row per check): the one-pass checks in
    configured order, then the comparisons with another system.

    Raises when something failed and the suite stops the job, whoever is or is not notified.
    """
    own = {name: params for name, params in spec.checks.items() if name not in COMPARISONS}
    outcomes: list[dict[str, Any]] = []
    if own:
        rows = run_checks(df, own, spec.target).collect()
        outcomes = sorted((row.asDict() for row in rows), key=lambda o: o["position"])
    for name, params in spec.checks.items():
        if name in COMPARISONS:
            if counterpart is None:
                raise ValueError(f"check {name!r} needs a counterpart to compare with")
            for outcome in comparison_outcomes(df, name, parse_value(params), counterpart):
                outcomes.append({"table_name": spec.target, "position": len(outcomes), **outcome})
    if spec.stop_job and any(o["status"] == "failure" for o in outcomes):
        failure = QualityFailure(f"quality checks failed for {spec.target}")
        failure.outcomes = outcomes
        raise failure
    return outcomes
