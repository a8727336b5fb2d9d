"""Recipes: a chain of named scalar expressions over the rows of one table.

A step adds columns computed from those before it. The same recipe runs on a
DataFrame, where Catalyst merges the steps into one projection inside
whole-stage code generation, and prints as nested SELECTs for another engine.
Expressions are SQL that both read alike; DIV stands for integer division.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _doubles(expr: str) -> str:
    """Decimal literals as doubles, which both engines then compute alike."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", expr)


@dataclass
class Recipe:
    steps: list[dict[str, str]] = field(default_factory=list)

    def add(self, **columns: str) -> Recipe:
        self.steps.append({k: _doubles(v) for k, v in columns.items()})
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns({k: F.expr(v.replace(" DIV ", " div ")) for k, v in step.items()})
        return df

    def sql(self, source: str) -> str:
        for step in self.steps:
            source = "SELECT *, " + ", ".join(f"{v.replace(' DIV ', ' // ')} AS {k}" for k, v in step.items()) + f" FROM ({source})"
        return source
