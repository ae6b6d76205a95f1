"""Declarative field rules: every failing field of a row is reported, not just the first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers above this are milliseconds; the last second of the year 9999.
MOST_SECONDS = 2e10
LAST_SECOND = 253_402_300_799
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


@dataclass(frozen=True)
class FieldRule:
    """Bounds of one field. ``kind`` is text, float, int, bool, enum, time, map or list.

    The bounds of a list are those of its length.
    """

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    finite: bool = False
    values: tuple[str, ...] = ()
    required: bool = True


def typed(rule: FieldRule, text: Column) -> Column:
    """The text of a JSON field as the rule's type; null where it does not parse."""
    # The JSON parser hands an overflowing number over as "Infinity", quotes included.
    bare = F.btrim(text, F.lit('"'))
    if rule.kind == "float":
        return bare.try_cast("double")
    if rule.kind == "int":
        number = bare.try_cast("double")
        whole = number.between(-2147483648, 2147483647) & (number == F.floor(number))
        return F.when(whole, number.cast("int"))
    if rule.kind == "bool":
        return text.try_cast("boolean")
    if rule.kind == "time":
        return event_time(text)
    if rule.kind == "map":
        return F.from_json(text, "map<string,string>")
    if rule.kind == "list":
        return F.from_json(text, "array<string>")
    return text


def event_time(text: Column) -> Column:
    """ISO text, or seconds since 1970 (milliseconds where they are too many), as a timestamp."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > MOST_SECONDS, number / 1000).otherwise(number)
    micros = F.when(F.abs(seconds) <= LAST_SECOND, F.round(seconds * 1_000_000)).cast("bigint")
    return F.when(number.isNotNull(), F.timestamp_micros(micros)).when(
        text.rlike(ISO_TIME), F.try_to_timestamp(text)
    )


def violation(rule: FieldRule, text: Column, json_type: Column) -> Column:
    """The name of the first broken check of a field, or null.

    ``json_type`` names the type the field has in the payload: null where it is missing,
    VOID where it is a JSON null.
    """
    value = typed(rule, text)
    checks: list[tuple[Column, str]] = []
    if rule.required:
        checks.append((text.isNull(), "missing"))
    if rule.kind in ("float", "int", "bool"):
        checks.append((value.isNull() & text.isNotNull(), f"{rule.kind}_parsing"))
    if rule.kind == "text":
        checks.append((text.isNotNull() & (json_type != "STRING"), "string_type"))
    if rule.kind == "time":
        scalar = json_type.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)")
        checks.append((~scalar, "datetime_type"))
        checks.append((value.isNull() & text.isNotNull(), "datetime_parsing"))
    if rule.kind == "map":
        checks.append((~json_type.startswith("OBJECT"), "dict_type"))
    if rule.kind == "list":
        checks.append((~json_type.startswith("ARRAY"), "list_type"))
    if rule.kind == "enum":
        checks.append((text.isNotNull() & ~text.isin(*rule.values), "literal_error"))
    size = {"text": F.char_length(text), "list": F.size(value)}.get(rule.kind, value)
    if rule.finite:
        limit = float("inf")
        checks.append((F.isnan(value) | (F.abs(value) == F.lit(limit)), "finite_number"))
    if rule.low is not None:
        name = {"text": "string_too_short", "list": "too_short"}.get(rule.kind, "greater_than_equal")
        too_low = size < rule.low
        if rule.kind == "float":
            too_low = too_low | F.isnan(value)
        checks.append((too_low, name))
    if rule.high is not None:
        name = {"text": "string_too_long", "list": "too_long"}.get(rule.kind, "less_than_equal")
        checks.append((size > rule.high, name))
    return reduce(
        lambda rest, check: F.when(check[0], F.lit(check[1])).otherwise(rest),
        reversed(checks),
        F.lit(None).cast("string"),
    )


def violations(profile: tuple[FieldRule, ...], field, json_type) -> Column:
    """ARRAY<STRUCT<field, rule, value>> of all broken fields, in profile order.

    ``field(name)`` gives the text Column of a field, ``json_type(name)`` that of its type.
    """
    found = [
        F.when(
            violation(r, field(r.name), json_type(r.name)).isNotNull(),
            F.struct(
                F.lit(r.name).alias("field"),
                violation(r, field(r.name), json_type(r.name)).alias("rule"),
                field(r.name).alias("value"),
            ),
        )
        for r in profile
    ]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def reason_text(errors: Column) -> Column:
    """``N validation error(s): field rule; field rule``."""
    parts = F.transform(errors, lambda e: F.concat_ws(" ", e["field"], e["rule"]))
    return F.concat(
        F.size(errors).cast("string"), F.lit(" validation error(s): "), F.array_join(parts, "; ")
    )
