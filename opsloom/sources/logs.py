"""Structured log lines: JSON to columns and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

FIXED_KEYS = ("ts", "level", "logger", "message", "request_id")
NO_REQUEST = "-"


def parse_lines(df: DataFrame, line: str) -> DataFrame:
    """Fixed keys as columns, everything else in the ``extras`` map."""
    fields = df.withColumn("_f", F.from_json(line, "map<string,string>"))
    extras = F.map_filter("_f", lambda k, _: ~k.isin(*FIXED_KEYS))
    picked = [F.col("_f")[k].alias(k) for k in FIXED_KEYS if k != "request_id"]
    request = F.coalesce(F.col("_f")["request_id"], F.lit(NO_REQUEST)).alias("request_id")
    kept = [c for c in df.columns if c != line and c not in FIXED_KEYS]
    return fields.select(*kept, *picked, request, extras.alias("extras"))


def format_lines(df: DataFrame, line: str) -> DataFrame:
    """The inverse: fixed keys first, then the extras, as one JSON object."""
    fixed = F.map_from_arrays(
        F.array(*[F.lit(k) for k in FIXED_KEYS]),
        F.array(*[F.coalesce(F.col(k), F.lit(NO_REQUEST)) if k == "request_id" else F.col(k) for k in FIXED_KEYS]),
    )
    return df.withColumn(line, F.to_json(F.map_concat(fixed, F.coalesce("extras", F.create_map().cast("map<string,string>")))))


def nonfinite_text(value: Column) -> Column:
    """inf, -inf or nan as text; null for a finite number."""
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
    )


def sanitize_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moves inf and NaN out of the columns, at any depth of structs, arrays and map values.

    A column keeps its shape with null in place of such a number; ``<column>_text`` has the
    same shape with the number's text there and null elsewhere.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nothing = F.lit(None).cast("string")
    for name in columns:
        text = rebuilt(F.col(name), kinds[name], nonfinite_text, lambda _: nothing)
        clean = rebuilt(F.col(name), kinds[name], lambda x: F.when(nonfinite_text(x).isNull(), x), lambda x: x)
        df = df.withColumns({f"{name}_text": text, name: clean})
    return df


def rebuilt(
    value: Column, kind: DataType, number: Callable[[Column], Column], other: Callable[[Column], Column]
) -> Column:
    """``value`` with every floating-point leaf passed through ``number`` and other leaves through ``other``."""
    if isinstance(kind, (FloatType, DoubleType)):
        return number(value)
    if isinstance(kind, StructType):
        fields = [rebuilt(value[f.name], f.dataType, number, other).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rebuilt(x, kind.elementType, number, other))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: rebuilt(x, kind.valueType, number, other))
    return other(value)
