"""JSON parsing with a fallback value for malformed input (no exceptions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_field(text: Column, path: str, type_name: str, fallback=None) -> Column:
    """Field at ``path`` of a JSON string as ``type_name``.

    Malformed JSON yields ``fallback``; well-formed JSON without the field (or
    with a value that does not convert) yields NULL. Parsing goes through the
    VARIANT type (``try_parse_json`` / ``try_variant_get``).
    """
    v = F.try_parse_json(text)
    got = F.try_variant_get(v, path, type_name)
    if fallback is None:
        return got
    return F.when(v.isNull() & text.isNotNull(), F.lit(fallback)).otherwise(got)
