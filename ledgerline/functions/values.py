"""How cells, literals and numbers are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plain decimal number, without padding, suffix, NaN or infinity; anchored so that a final line feed doesn't pass.
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def literal(value: object) -> str:
    """A condition's value as the text that cells are compared with: 5.0 is 5, true is lower case."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return value if isinstance(value, str) else repr(value) if isinstance(value, float) else str(value)


def number(column: Column, dtype: str = "string", nulls: str = "zero") -> Column:
    """column as a double. Text that is no number, and null, counts as 0; with nulls="skip" it is null."""
    if dtype == "string":
        column = F.when(column.rlike(NUMBER), column.try_cast("double"))
    else:
        column = column.cast("double")
    return column if nulls == "skip" else F.coalesce(column, F.lit(0.0))


def is_empty(column: Column) -> Column:
    """Null, the empty text or the text NULL."""
    text = column.cast("string")
    return text.isNull() | (text == "") | (text == "NULL")
