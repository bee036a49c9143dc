"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Column name for expressions; match columns of negative ids need the quoting."""
    return f"`{name}`"


def named(name: str) -> Column:
    """Column by exact name."""
    return F.col(quoted(name))


def fail(*message: Column | str) -> Column:
    """Stops the job that evaluates it, with a message."""
    return F.raise_error(
        F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message])
    )


def graph_token(line: Column, position: int, kind: str) -> Column:
    """Token of a space separated line as an integer type; a bad line stops the job."""
    value = F.get(F.split(line, " "), F.lit(position)).try_cast(kind)
    return F.coalesce(value, fail("not a graph line: ", line).cast(kind))


def all_different(new: str, bound: Iterable[str]) -> str:
    """No data vertex twice: the new column differs from the given bound columns.

    Only same-tag columns need to be passed, a vertex has one tag. Empty if there are none.
    """
    return " AND ".join(f"{quoted(new)} <> {quoted(other)}" for other in bound)


def keep_injective(df: DataFrame, new: str, bound: Iterable[str]) -> DataFrame:
    condition = all_different(new, bound)
    return df.where(condition) if condition else df


def match_line(columns: Iterable[str]) -> Column:
    """One match as the comma separated line of the result file."""
    return F.concat_ws(",", *[named(c).cast("string") for c in columns])
