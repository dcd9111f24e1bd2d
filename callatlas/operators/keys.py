"""The type of a call's key is that of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keyed(schema: str, df: DataFrame) -> str:
    """schema, which begins with call_id and a type, with the type that df's call_id has."""
    _, rest = schema.split(", ", 1)
    return f"call_id {df.schema['call_id'].dataType.simpleString()}, {rest}"
