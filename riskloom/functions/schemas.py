"""Schema helpers."""

from __future__ import annotations

from pyspark.sql.types import StructType


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the columns of ``ddl`` after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
