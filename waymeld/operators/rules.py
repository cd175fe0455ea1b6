"""Versioned rules with receipts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_digest


@dataclass(frozen=True)
class Rule:
    """`fn` adds an `outcome` column to the rows it is given."""
    version: int
    fn: Callable[[DataFrame], DataFrame]


def apply_rule(rule: Rule, rows: DataFrame, receipts: DataFrame | None, keys: list[str], material: list[str]) -> DataFrame:
    """Outcomes with receipts (version, keys, input hash) for rows without a valid one.

    A row is looked at again only when its material fields or the version changed.
    """
    stamped = rows.withColumns({"rule_version": F.lit(rule.version), "input_sha": text_digest(*material)})
    if receipts is not None:
        stamped = stamped.join(receipts.select("rule_version", *keys, "input_sha"), ["rule_version", *keys, "input_sha"], "left_anti")
    return rule.fn(stamped).select("rule_version", *keys, "input_sha", "outcome")
