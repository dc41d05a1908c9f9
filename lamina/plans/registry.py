"""A table of named plans and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None):
    """Registers a plan under its function's name."""

    def put(f: Plan) -> Plan:
        PLANS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, **kinds: str) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; kinds casts columns."""
    from pyspark.sql import functions as F

    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in kinds:
            c = c.cast(kinds[f.name])
        elif f.dataType.typeName() == "double":
            c = F.round(c, digits)
        elif f.dataType.typeName() == "integer":
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
