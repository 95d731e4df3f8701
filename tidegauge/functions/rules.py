"""Threshold rules for alerts.  A rule is data; the order of rules is priority."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    column: str
    above: float | None = None
    below: float | None = None

    def holds(self, value: Column | None = None) -> Column:
        value = F.col(self.column) if value is None else value
        return value > self.above if self.above is not None else value < self.below


# Alert labels and thresholds, strict, first match wins.
ALERT_RULES = (
    Rule("HIGH_TEMPERATURE", "temperature", above=35.0),
    Rule("HIGH_HUMIDITY", "humidity", above=80.0),
    Rule("LOW_BATTERY", "battery_level", below=20.0),
)
NORMAL = "NORMAL"

# The label set used for rows that are already averaged.
ROLLUP_LABELS = {"HIGH_TEMPERATURE": "HIGH_TEMP"}


def classify_alert(
    rules: Sequence[Rule] = ALERT_RULES,
    labels: dict[str, str] | None = None,
    otherwise: str = NORMAL,
) -> Column:
    """The label of the first rule that holds, else ``otherwise``."""
    labels = labels or {}
    choice = F.lit(otherwise)
    for rule in reversed(rules):
        choice = F.when(rule.holds(), labels.get(rule.label, rule.label)).otherwise(choice)
    return choice


def alert_labels(rules: Sequence[Rule] = ALERT_RULES, missing_is_zero: bool = True) -> Column:
    """Array of the labels of every rule that holds.

    With ``missing_is_zero`` an absent field counts as 0, so a message without
    a battery level raises LOW_BATTERY.
    """
    def tested(rule: Rule) -> Column:
        value = F.col(rule.column)
        value = F.coalesce(value, F.lit(0.0)) if missing_is_zero else value
        return F.when(rule.holds(value), rule.label)

    return F.array_compact(F.array(*[tested(rule) for rule in rules]))


def has_alert(rules: Sequence[Rule] = ALERT_RULES) -> Column:
    """1 where any rule holds, else 0 (also where fields are missing)."""
    anything = reduce(or_, [rule.holds() for rule in rules])
    return F.coalesce(anything, F.lit(False)).cast("short")
