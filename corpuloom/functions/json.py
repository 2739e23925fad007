"""Typed access to JSON text with defaults, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$['{key}']")


def has(json: Column, key: str) -> Column:
    """Whether an object has a key, be its value null."""
    return F.coalesce(F.array_contains(keys(json), key), F.lit(False))


def keys(json: Column) -> Column:
    """The keys of an object in order of its text; null for other values."""
    return F.json_object_keys(json)


def string(json: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(_at(json, key), F.lit(default))


def integer(json: Column, key: str, default: int | None = None) -> Column:
    """The value as a whole number, the default where it is none."""
    return F.coalesce(_at(json, key).try_cast("bigint"), F.lit(default).cast("bigint"))


def double(json: Column, key: str, default: float | None = None) -> Column:
    return F.coalesce(_at(json, key).try_cast("double"), F.lit(default).cast("double"))


def boolean(json: Column, key: str, default: bool | None = None) -> Column:
    return F.coalesce(_at(json, key).try_cast("boolean"), F.lit(default).cast("boolean"))


def array(json: Column, key: str | None = None) -> Column:
    """An array's members as text, whatever their kinds; null for other values."""
    return F.from_json(json if key is None else _at(json, key), "array<string>")


def join(members: Column, separator: str) -> Column:
    return F.array_join(members, separator, "null")


def objects(names: Column, members: Column) -> Column:
    """An object of the names and members of two arrays, the shorter one's length."""
    n = F.least(F.size(names), F.size(members))
    return F.to_json(F.map_from_arrays(F.slice(names, 1, n), F.slice(members, 1, n)))
