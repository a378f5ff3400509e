"""Values as they are shown outside: numbers for JSON and settings without their secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How names of settings that are secrets end, in any case.
SECRETS = "(?i)(key|secret|password|token)$"


def clean_number(x: Column) -> Column:
    """Six decimals; NULL for what JSON has no number for."""
    # the rounded value that is nearest to an even digit on a tie, as Python rounds
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, 6))


def for_json(df: DataFrame) -> DataFrame:
    """``df`` with all its floating-point columns cleaned."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: clean_number(F.col(f"`{n}`").cast("double")) for n in floats})


def masked(key: Column, value: Column, secrets: str = SECRETS) -> Column:
    """``value``, of which for a secret only two characters at either end are shown, and none of six or fewer."""
    n = F.length(value)
    hidden = F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.lit("…"), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))
    return F.when(key.rlike(secrets), hidden).otherwise(value)
