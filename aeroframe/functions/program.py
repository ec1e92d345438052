"""Formula programs: staged SQL expressions that Catalyst compiles.

A long formula is written as stages of named expressions. Each stage is one
projection, so no generated method grows past what the JVM compiles, and each
name is computed once. The same stages print as nested SELECTs for other engines.
Names that start with an underscore are scratch and are dropped at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def num(x: float) -> str:
    """A double literal (not a decimal one) in any SQL dialect."""
    text = repr(float(x))
    text = text if "e" in text else text + "e0"
    return f"({text})" if x < 0 else text


#: Programs of this many stages are fenced off from what follows them.
LONG = 8


def fence(df: DataFrame, computed: list[str]) -> DataFrame:
    """The same rows, with ``computed`` as plain columns to the optimizer.

    A generator over one-element arrays: later projections, filters and inferred
    constraints see columns here instead of the long expressions behind them, which
    they would otherwise copy at every use.
    """
    rest = [x for x in df.columns if x not in computed]
    made = df.select(*rest, F.explode(F.array(F.struct(*computed))).alias("_fenced"))
    return made.select(*(F.col(f"_fenced.{x}").alias(x) if x in computed else F.col(x) for x in df.columns))


class Program:
    def __init__(self, *stages: dict[str, str]) -> None:
        self.stages = list(stages)

    def __add__(self, other: Program) -> Program:
        return Program(*self.stages, *other.stages)

    @property
    def names(self) -> list[str]:
        return [k for s in self.stages for k in s]

    @property
    def scratch(self) -> list[str]:
        return [k for k in self.names if k.startswith("_")]

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
        df = df.drop(*self.scratch) if self.scratch else df
        return fence(df, [k for k in self.names if k not in self.scratch]) if len(self.stages) >= LONG else df

    def sql(self, source: str) -> str:
        """SELECT text over ``source`` (a SELECT)."""
        for stage in self.stages:
            source = "select *, " + ", ".join(f"{v} as {k}" for k, v in stage.items()) + f" from ({source})"
        if self.scratch:
            source = f"select * exclude ({', '.join(self.scratch)}) from ({source})"
        return source
