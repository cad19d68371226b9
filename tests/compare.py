"""Rows as order-insensitive text, so that two engines' results can be compared by value."""

from __future__ import annotations


def _text(x) -> str:
    if x is None or x != x:
        return "NULL"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(x)
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
