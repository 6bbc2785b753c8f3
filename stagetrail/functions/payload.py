"""Access to JSON kept as text; malformed text and JSON null both read as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The payload as VARIANT, in an array of its own; parsed once for all keys that a row is asked for.

    Spark's parser stops after the first value. What parses both inside an array and inside an object is one value: after
    it, the one could only go on with a value and the other only with a key.
    """
    alone = F.try_parse_json(F.concat(F.lit('{"":'), payload, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))))


def json_text(payload: Column, key: str) -> Column:
    """Value of one top-level key, as text. Dots, spaces, quotes and question marks belong to the key.

    Text that is more than one JSON value, or names a key twice, has no values.
    """
    for quote in "'\"":
        if quote not in key:
            return F.try_variant_get(parsed(payload), f"$[0][{quote}{key}{quote}]", "string")
    raise ValueError(f"JSON key cannot hold both kinds of quotes: {key!r}")


def json_upper(payload: Column, key: str) -> Column:
    return F.upper(json_text(payload, key))


def json_int(payload: Column, key: str) -> Column:
    """Value as INT, rounding decimals half away from zero; NULL where it is no number."""
    return F.round(json_text(payload, key).try_cast("decimal(38,18)"), 0).try_cast("int")
