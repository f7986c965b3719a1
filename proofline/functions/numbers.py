"""Closeness of numbers and numbers in text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Whether two numbers agree within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def close_lists(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Whether two arrays have one length and agree element by element."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y, rel, abs_)), lambda ok: F.coalesce(ok, F.lit(False)))


def agree(a: Column, b: Column) -> Column:
    """The looser agreement that coverage uses."""
    return close(a, b, 1e-6, 1e-12)


def event_slack(t: Column) -> Column:
    """How far an event may lie from its nominal instant."""
    return 1e-6 * F.greatest(F.lit(1.0), F.abs(t))


def finite(text: Column) -> Column:
    """A text as a finite double, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_value(text: Column) -> Column:
    """Numbers of a written value as an array of doubles: thousands separators and the wide minus are read, what follows a
    tolerance sign is left out."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "−", "-"), r"(\d),(?=\d{3}(\D|$))", "$1"), r"(±|\+/-).*$", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), 0), lambda x: x.cast("double"))


def states_number(text: Column, number: Column) -> Column:
    """Whether a text states a number."""
    return F.exists(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])" + NUMBER), 0), lambda x: x.cast("double")), lambda x: x == number)
