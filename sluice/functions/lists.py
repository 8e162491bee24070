"""Comma lists, AS paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column) -> Column:
    """Comma list to ARRAY<STRING>; empty text is an empty list."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def list_size(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, ",")))


def join_numbers(numbers: Column) -> Column:
    """Set of integers to a comma list in numeric order."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(numbers)), lambda x: x.cast("string")), ",")


def path_hops(path: Column) -> Column:
    return F.filter(F.split(path, " "), lambda h: h != "")


def path_origin(path: Column) -> Column:
    """The last hop as a number; null for AS sets and empty paths."""
    return F.try_element_at(path_hops(path), F.lit(-1)).try_cast("long")


def path_upstream(path: Column) -> Column:
    """The hop before the last, prepending kept: "... 12880 12880" gives 12880."""
    return F.try_element_at(path_hops(path), F.lit(-2)).try_cast("long")


def blank_to(text: Column, default: str) -> Column:
    """Null or blank text to a default."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def camel(text: Column) -> Column:
    """"some_label-x" to "SomeLabelX"."""
    return F.regexp_replace(F.initcap(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " ", "")
