"""Small helpers the operators share: tables in the shared folder, size checks, safe text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401  the operators take it from here

#: Rows up to which a slim side (a few longs a row) may be broadcast; beyond it callers shuffle.
BROADCAST_ROWS = 500_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has at most limit rows, else leave the join to shuffle (and AQE to split skew).

    df should be a stored table: it is counted first.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words_expr(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed and carriage return; null counts as empty."""
    runs = F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+")
    return F.size(F.filter(runs, lambda x: x != "")).cast("long")


def id_text(col: Column) -> Column:
    """An id as text, null as the empty text, so that hashes of ids are never null."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many `_` behind it as make it differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
