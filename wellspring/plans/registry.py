"""Registered queries: each an operator over the driver's tables, with the same result in DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import functions as F

from ..sources import fixtures

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, fn: Callable, sql: str | None = None, views: str = "", doubles: str = "", digits: int = 6) -> None:
    """Register fn(spark, sf_dir) under name.

    doubles names result columns that both sides round, since sums of doubles
    depend on their order. sql is a select that may use the fixture views named.
    """
    names = doubles.split()

    def query(spark, sf_dir):
        df = fn(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names}) if names else df

    QUERIES[name] = query
    if sql is not None:
        head = ", ".join([*[fixtures.SQL[v] for v in views.split()], f"q as ({sql})"])
        replaced = ", ".join(f"round({c}::double, {digits}) + 0.0 as {c}" for c in names)
        ORACLE_SQL[name] = f"with {head} select * {f'replace ({replaced})' if names else ''} from q"


from . import benchmark, mixing, more, pipelines, pixels, screens, spatial, tables  # noqa: E402, F401
