"""Key literals and their stored form as column expressions, for whole tables: nothing leaves the JVM.

A literal is lexed by one regular expression: runs of plain and escaped signs, and bare delimiters. A run never equals a
delimiter, as a delimiter in it has its backslash, so fields are what lies between bare commas, and a field's name ends
at its first bare equals sign. ``literals`` has the same for one text on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import STORED_PREFIX

TOKEN = r"(?s)(?:\\.|[^\\,={}]++)++|[,={}\\]"  # possessive: a loop in Java's matcher, not a recursion


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, ""), r"(?s)\\(.)", "$1")


def _fields(tokens: Column) -> Column:
    """(name, value) of each field; name is null without a bare equals sign, value then is the whole field."""
    commas = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.element_at(tokens, i) == ",")
    commas = F.when(F.size(tokens) > 0, commas).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(1)), F.transform(commas, lambda i: i + 1))
    ends = F.concat(commas, F.array(F.size(tokens) + 1))

    def field(start: Column, end: Column) -> Column:
        def named(own: Column) -> Column:
            at = F.array_position(own, F.lit("=")).cast("int")
            value = F.when(at > 0, _plain(F.slice(own, at + 1, F.size(own)))).otherwise(_plain(own))
            return F.struct(F.when(at > 0, _plain(F.slice(own, F.lit(1), at - 1))).alias("name"), value.alias("value"))

        return _let(F.slice(tokens, start, end - start), named)

    return F.zip_with(starts, ends, field)


def parse(text: Column, names: list[str]) -> Column:
    """Values in the order of the key's columns, and ``error``: null, or why the literal isn't one of such a key."""
    t = F.trim(text)
    none = F.lit(None).cast("array<string>")
    result = lambda values, error: F.struct(values.alias("values"), error.alias("error"))
    wrapped = lambda a, b: t.startswith(a) & t.endswith(b) & (F.length(t) >= 2)
    body = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))

    def read(tokens: Column) -> Column:
        bare = F.when(F.exists(tokens, lambda x: x == "\\"), "DANGLING_ESCAPE").when(F.exists(tokens, lambda x: x.isin("{", "}")), "BARE_BRACE")

        def check(fields: Column) -> Column:
            have = F.transform(fields, lambda f: f["name"])
            wanted = F.array(*map(F.lit, names))
            by_name = F.transform(wanted, lambda n: F.element_at(F.filter(fields, lambda f: f["name"] == n), 1)["value"])
            by_place = F.transform(fields, lambda f: F.when(f["name"].isNotNull(), F.concat(f["name"], F.lit("="), f["value"])).otherwise(f["value"]))
            wrong = (
                F.when(F.exists(have, lambda n: n.isNull()), "FIELD_WITHOUT_NAME")
                .when(F.size(F.array_distinct(have)) < F.size(have), "NAME_TWICE")
                .when(F.array_sort(have) != F.array_sort(wanted), "OTHER_COLUMNS")
            )
            named = F.coalesce(bare, wrong)
            placed = F.coalesce(bare, F.when(F.size(fields) != len(names), "OTHER_NUMBER_OF_VALUES"))
            return (
                F.when(wrapped("(", ")"), result(F.when(placed.isNull(), by_place).otherwise(none), placed))
                .when(wrapped("{", "}"), result(F.when(named.isNull(), by_name).otherwise(none), named))
                .otherwise(result(none, F.lit("NOT_COMPOSITE")))
            )

        return _let(_fields(tokens), check)

    composite = _let(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), read)
    if len(names) > 1:
        return composite
    return F.when(~wrapped("{", "}"), result(F.array(t), F.lit(None).cast("string"))).otherwise(composite)


def _sized(number: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), digits, "0"))


def store(parts: list[tuple[Column, Column, Column]]) -> Column:
    """Stored form of (name, type, literal) texts: a count, then each text behind its length, in URL-safe base64."""
    texts = [t for part in parts for t in part]
    raw = F.concat(_sized(F.lit(len(parts)), 8), *[x for t in texts for x in (_sized(F.octet_length(t), 4), F.encode(t, "UTF-8"))])
    return F.concat(F.lit(STORED_PREFIX), F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("=")))


def load(text: Column) -> Column:
    """Array of (name, type, literal) of a stored form; null where it isn't one, or where bytes are missing or left over."""
    coded = F.when(text.startswith(STORED_PREFIX), F.translate(F.substr(text, F.lit(len(STORED_PREFIX) + 1)), "-_", "+/"))
    raw = F.try_to_binary(F.rpad(coded, F.ceil(F.length(coded) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))
    number = lambda b, at, n: F.conv(F.hex(F.substr(b, at, F.lit(n))), 16, 10).cast("int")

    def read(b: Column) -> Column:
        count = F.coalesce(number(b, F.lit(1), 4), F.lit(0))
        steps = F.when((count > 0) & (count <= F.octet_length(b)), F.sequence(F.lit(1), 3 * count)).otherwise(F.array().cast("array<int>"))

        def step(state: Column, _: Column) -> Column:
            size = F.coalesce(number(b, state["at"], 2), F.lit(0))
            return F.struct((state["at"] + 2 + size).alias("at"), F.concat(state["texts"], F.array(F.decode(F.substr(b, state["at"] + 2, size), "UTF-8"))).alias("texts"))

        def finish(state: Column) -> Column:
            texts = state["texts"]
            part = lambda i: F.struct(*[F.element_at(texts, 3 * i - 2 + k).alias(n) for k, n in enumerate(("name", "type", "literal"))])
            whole = (state["at"] == F.octet_length(b) + 1) & (F.size(texts) == 3 * count) & (count > 0)
            return F.when(whole, F.transform(F.sequence(F.lit(1), count), part))

        start = F.struct(F.lit(5).alias("at"), F.array().cast("array<string>").alias("texts"))
        return F.aggregate(steps, start, step, finish)

    return _let(raw, read)
