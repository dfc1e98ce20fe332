"""Scalar text functions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(c, part: str) -> Column:
    """Case-insensitive substring; wildcards mean nothing."""
    return F.contains(F.lower(col(c)), F.lit(part.lower()))


def any_has(c, part: str) -> Column:
    """Whether an element of an array holds the substring, in any case."""
    return F.exists(col(c), lambda x: F.contains(F.lower(x), F.lit(part.lower())))


def after_last(c, sep: str) -> Column:
    return F.substring_index(col(c), sep, -1)


def short_name(c) -> Column:
    """The last dotted part of what follows the kind in an id."""
    return after_last(F.regexp_replace(col(c), r"^[^:]*:", ""), ".")


def directory(c) -> Column:
    """The directory of a path, '.' if there is none."""
    c = col(c)
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def terms(query: str) -> list[str]:
    return query.lower().split()


def term_score(term: str) -> Column:
    """Tiers of a search term: name, id, description, package, then any import, literal, property."""
    return F.greatest(
        F.when(has("name", term), 100).otherwise(0), F.when(has("id", term), 90).otherwise(0), F.when(has("description", term), 70).otherwise(0), F.when(has("package", term), 60).otherwise(0),
        F.when(any_has("imports", term), 40).otherwise(0), F.when(any_has("literals", term), 30).otherwise(0), F.when(any_has("properties", term), 20).otherwise(0),
    )
