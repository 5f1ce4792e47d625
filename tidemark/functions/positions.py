"""Log positions as sortable structs: two-part hexadecimal ones, and file with offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn(text: Column) -> Column:
    """struct<high, low> of HEX/HEX."""
    halves = F.split(text, "/")
    return F.struct(F.conv(halves[0], 16, 10).cast("bigint").alias("high"), F.conv(halves[1], 16, 10).cast("bigint").alias("low"))


def lsn_text(high: Column, low: Column) -> Column:
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def binlog(text: Column) -> Column:
    """struct<prefix, file_no, offset, gtids> of file.000123:456[;gtid=set]."""
    part = lambda k: F.regexp_extract(text, r"^(.*?)\.?(\d+):(\d+)(?:;gtid=(.*))?$", k)
    return F.struct(part(1).alias("prefix"), part(2).cast("bigint").alias("file_no"), part(3).cast("bigint").alias("offset"), F.nullif(part(4), F.lit("")).alias("gtids"))
