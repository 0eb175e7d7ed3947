"""Exceptions as data: a raised class is kept as the names of its bases, most derived first."""

from __future__ import annotations

import builtins
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(256)
def chain(cls: type[BaseException]) -> str:
    return "|".join(c.__name__ for c in cls.__mro__ if issubclass(c, BaseException))


def literal(name: str) -> Column:
    return F.lit(chain(getattr(builtins, name)))


def matches(err: Column, cls: type[BaseException]) -> Column:
    """Whether the error is of the class or a subclass; never null."""
    return F.coalesce(F.concat(F.lit("|"), err, F.lit("|")).contains(f"|{cls.__name__}|"), F.lit(False))


def class_name(err: Column) -> Column:
    return F.substring_index(err, "|", 1)
