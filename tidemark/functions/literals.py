"""Key literals: text of single keys, {name=value,...} of composite ones, parsing, and the stored form of a tuple."""

from __future__ import annotations

import base64
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPED = "\\,={}"
STORED_PREFIX = "pkt:v1:"


def single(value: Column, kind: str) -> Column:
    """Plain text of one key value. kind: the Spark type's name."""
    if kind.startswith("decimal"):
        text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(value == 0, "0").otherwise(text)
    if kind == "binary":
        return F.lower(F.hex(value))
    if kind.startswith("timestamp"):
        base_text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(base_text, F.lit("Z")) if kind == "timestamp" else base_text
    return value.cast("string")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\,={}])", r"\\$1")


def composite(parts: dict[str, Column]) -> Column:
    """{a=1,b=x} of text columns by name, reserved characters escaped."""
    fields = [F.concat(escape(F.lit(name)), F.lit("="), escape(text)) for name, text in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _split(text: str) -> list[list[str]]:
    """Fields of an escaped list, each as its parts around the first bare equals sign."""
    fields, parts, part, at = [], [], [], 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            if at + 1 == len(text):
                raise ValueError("dangling escape")
            part.append(text[at + 1])
            at += 2
            continue
        if c in "{}":
            raise ValueError(f"bare {c}")
        if c == ",":
            fields.append([*parts, "".join(part)])
            parts, part = [], []
        elif c == "=" and not parts:
            parts, part = ["".join(part)], []
        else:
            part.append(c)
        at += 1
    return [*fields, [*parts, "".join(part)]]


def parse(text: str, names: list[str]) -> dict[str, str]:
    """Values by key column of a literal: plain for one column, {a=1,b=2} or (1,2) for several."""
    text = text.strip()
    if len(names) == 1 and not (text.startswith("{") and text.endswith("}")):
        return {names[0]: text}
    if text.startswith("(") and text.endswith(")"):
        values = ["=".join(f) for f in _split(text[1:-1])]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for {len(names)} key columns")
        return dict(zip(names, values, strict=True))
    if not (text.startswith("{") and text.endswith("}")):
        raise ValueError("a composite key is {name=value,...} or (value,...)")
    found: dict[str, str] = {}
    for field in _split(text[1:-1]):
        if len(field) != 2:
            raise ValueError("a field without a name")
        if field[0] in found:
            raise ValueError(f"{field[0]} twice")
        found[field[0]] = field[1]
    if set(found) != set(names):
        raise ValueError(f"key columns {sorted(found)}, not {sorted(names)}")
    return {name: found[name] for name in names}


def store(parts: list[tuple[str, str, str]]) -> str:
    """Stored form of (name, type, literal) parts: a count, then texts with their lengths, in URL-safe base64."""
    raw = struct.pack(">i", len(parts))
    for text in (t for part in parts for t in part):
        data = text.encode()
        raw += struct.pack(">H", len(data)) + data
    return STORED_PREFIX + base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def load(text: str) -> list[tuple[str, str, str]]:
    if not text.startswith(STORED_PREFIX):
        raise ValueError("not a stored key")
    data = text[len(STORED_PREFIX) :]
    raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    (count,), at, texts = struct.unpack_from(">i", raw), 4, []
    for _ in range(3 * count):
        (size,) = struct.unpack_from(">H", raw, at)
        texts.append(raw[at + 2 : at + 2 + size].decode())
        at += 2 + size
    if at != len(raw):
        raise ValueError("bytes left over")
    return [tuple(texts[i : i + 3]) for i in range(0, len(texts), 3)]


def payload(value: Column, kind: str) -> Column:
    """Tagged text of a value: str:, hex:, or the type's name, with reserved characters escaped."""
    tags = {"bigint": "Long", "int": "Integer", "boolean": "Boolean", "date": "LocalDate"}
    if kind == "binary":
        text = F.concat(F.lit("hex:"), F.lower(F.hex(value)))
    elif kind == "string":
        text = F.concat(F.lit("str:"), escape(value))
    else:
        text = F.concat(F.lit(tags.get(kind, "BigDecimal") + ":"), escape(value.cast("string")))
    return F.coalesce(text, F.lit("null"))
