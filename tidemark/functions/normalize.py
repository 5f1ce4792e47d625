"""Values of neutral types from text, as Column expressions. Null stays null; what a type can't hold raises unless
the function says that it is lenient."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that count as true and false.
TRUE_TEXTS = ("t", "true", "1", "yes", "on")
FALSE_TEXTS = ("f", "false", "0", "no", "off")
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def boolean_of_number(number: Column) -> Column:
    return number != 0


def integer(text: Column) -> Column:
    """Exact: a fraction raises; up to 38 digits."""
    value = F.trim(text).cast("decimal(38,9)")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)")).when(value.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), text)).cast("decimal(38,0)"))


def decimal(text: Column, precision: int = 38, scale: int = 9) -> Column:
    return F.trim(text).cast(f"decimal({precision},{scale})")


def decimal_of_double(value: Column, precision: int = 38, scale: int = 9) -> Column:
    """By the shortest text of the double, not its binary expansion."""
    return value.cast("string").cast(f"decimal({precision},{scale})")


def binary(text: Column) -> Column:
    r"""Bytes of a \x text in hex, of any other text in ISO-8859-1."""
    return F.when(text.startswith("\\x"), F.unhex(F.substr(text, F.lit(3)))).otherwise(F.encode(text, "ISO-8859-1"))


def timestamp_text(text: Column) -> Column:
    """Lenient: an instant as ISO text in UTC with Z, a local time without; unreadable text stays as it is.

    Takes ISO texts with T or a space; with an offset they are instants.
    """
    iso = F.replace(F.trim(text), F.lit(" "), F.lit("T"))
    zoned = iso.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$")
    instant = F.try_to_timestamp(iso)
    local = F.expr("try_cast(NULL AS timestamp_ntz)")
    local = iso.try_cast("timestamp_ntz")
    whole = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.when(whole & zoned & instant.isNotNull(), F.concat(F.date_format(instant, micros), F.lit("Z"))).when(whole & ~zoned & local.isNotNull(), F.date_format(local, micros)).otherwise(text)


def time_text(text: Column) -> Column:
    """HH:mm:ss with its fraction; a date before it and an offset after it are dropped."""
    found = F.regexp_extract(text, r"(?:^|[T ])(\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(?:Z|[+-]\d{2}(?::?\d{2})?)?$", 1)
    return F.when(text.isNull(), F.lit(None)).when(found == "", F.raise_error(F.concat(F.lit("not a time: "), text)).cast("string")).otherwise(F.when(F.length(found) == 5, F.concat(found, F.lit(":00"))).otherwise(found))


def uuid(text: Column) -> Column:
    return F.when(text.rlike(UUID_PATTERN), F.lower(text)).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a uuid: "), text)).cast("string"))


def adaptive_family(declared: Column, text: Column) -> Column:
    """The family that a text decodes as: the declared one if it fits, else the first that does, at last STRING."""
    word = F.trim(text)
    is_integer, is_decimal = word.rlike(r"^[+-]?\d+$"), word.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    is_boolean = F.lower(word).isin(*TRUE_TEXTS, *FALSE_TEXTS)
    fits = (
        ((declared == "BOOLEAN") & is_boolean)
        | ((declared == "INTEGER") & is_integer)
        | (declared.isin("DECIMAL", "FLOAT") & is_decimal)
        | ((declared == "UUID") & word.rlike(UUID_PATTERN))
        | ((declared == "DATE") & word.try_cast("date").isNotNull() & word.rlike(r"^\d{4}-\d{2}-\d{2}$"))
        | declared.isin("STRING", "JSON", "XML", "ENUM_STRING", "TIMESTAMP")
    )
    inferred = (
        F.when(F.lower(word).isin("true", "false", "t", "f", "1", "0"), "BOOLEAN")
        .when(is_integer, "INTEGER")
        .when(is_decimal, "DECIMAL")
        .when(word.rlike(UUID_PATTERN), "UUID")
        .when(word.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "TIMESTAMP")
        .when(word.rlike(r"^\d{4}-\d{2}-\d{2}$"), "DATE")
        .otherwise("STRING")
    )
    return F.when(text.isNull() | fits, declared).otherwise(inferred)
