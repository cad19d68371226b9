"""Predicates with three answers, carried as nullable booleans: true, false, and null for unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, NON_MATCH, UNKNOWN = "known_match", "known_non_match", "unknown"


def contains(text: Column, part: str) -> Column:
    """Case-insensitive substring; unknown where the text is."""
    return F.lower(text).contains(part.lower())


def at_least(value: Column, least) -> Column:
    return value >= least


def at_most(value: Column, most) -> Column:
    return value <= most


def equals(value: Column, wanted) -> Column:
    return value == wanted


def any_element(values: Column, test) -> Column:
    """Whether some element passes; unknown where the whole array is, false for none."""
    return F.when(values.isNotNull(), F.coalesce(F.exists(values, test), F.lit(False)))


def positive_only(found: Column) -> Column:
    """Evidence that can prove a match but whose absence proves nothing."""
    return F.when(F.coalesce(found, F.lit(False)), F.lit(True))


def every(predicates: list[Column]) -> Column:
    """Conjunction: any false is false, else any unknown is unknown; none at all is true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def state(answer: Column) -> Column:
    return F.when(answer.isNull(), UNKNOWN).when(answer, MATCH).otherwise(NON_MATCH)


def trace(label: str, answer: Column, actual: Column) -> Column:
    """One predicate's record: label, state, what was found, and why it is unknown."""
    reason = F.when(answer.isNull(), F.lit("no value known"))
    return F.struct(F.lit(label).alias("predicate"), state(answer).alias("state"), actual.cast("string").alias("actual"), reason.alias("reason"))


def page_order(key: Column, id_col: Column, descending: bool = False) -> list[Column]:
    """Unknown keys last and by ascending id in either direction; descending also turns the id order of known keys."""
    if not descending:
        return [key.isNull(), key, id_col]
    return [key.isNull(), key.desc_nulls_last(), F.when(key.isNotNull(), id_col).desc_nulls_last(), id_col]
