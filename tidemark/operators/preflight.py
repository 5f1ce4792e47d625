"""What must hold of a source before a run begins, checked on frames of its catalog: one finding a row.

settings: source, kind (``mysql`` or ``postgres``), name, value. tables: source, kind, table_name, key_columns,
replica_identity, published. publications: source, publication, inserts, updates, deletes, truncates, by_root. slots:
source, slot, plugin, database, own_database, active, invalid. Rules are rows of this module; each frame is read once,
and a source that lacks a setting altogether is found by the list of those it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the public manuals of both databases ask of a log that holds whole rows.
NEEDED = {"mysql": {"log_bin": "ON", "binlog_format": "ROW", "binlog_row_image": "FULL"}, "postgres": {"wal_level": "logical"}}


def _found(frame: DataFrame, what: Column, rules: dict[str, Column]) -> DataFrame:
    """source, object, code for each rule that a row breaks; a rule that comes out null is broken."""
    codes = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda c: c.isNotNull())
    return frame.select("source", what.alias("object"), F.explode(codes).alias("code"))


def setting_findings(settings: DataFrame) -> DataFrame:
    """SETTING_MISSING and SETTING_WRONG: names and values are compared without regard to case."""
    sources = settings.select("source", "kind").distinct()
    needed = F.create_map(*[x for kind, wanted in NEEDED.items() for x in (F.lit(kind), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("wanted")) for n, v in wanted.items()]))])
    wanted = sources.select("source", F.explode(needed[F.col("kind")]).alias("n")).select("source", "n.name", "n.wanted")
    have = settings.groupBy("source", F.lower("name").alias("name")).agg(F.max("value").alias("value"))
    both = wanted.join(have, ["source", "name"], "left")
    code = F.when(F.col("value").isNull(), "SETTING_MISSING").when(F.lower("value") != F.lower("wanted"), "SETTING_WRONG")
    return both.select("source", F.col("name").alias("object"), code.alias("code")).filter("code IS NOT NULL")


def table_findings(tables: DataFrame) -> DataFrame:
    """A table needs a key, a name that the other side can quote, and in PostgreSQL whole old rows and a publication."""
    postgres = F.col("kind") == "postgres"
    return _found(
        tables,
        F.col("table_name"),
        {
            "NO_KEY": F.col("key_columns") > 0,
            "BAD_NAME": (F.trim("table_name") != "") & (F.octet_length("table_name") <= 63) & ~F.contains("table_name", F.lit(".")),
            "REPLICA_IDENTITY": ~postgres | (F.col("replica_identity") == "FULL"),
            "NOT_PUBLISHED": ~postgres | F.col("published"),
        },
    )


def publication_findings(publications: DataFrame) -> DataFrame:
    """A publication gives all changes of rows, and those of partitions under their root's name."""
    return _found(publications, F.col("publication"), {"NO_INSERTS": F.col("inserts"), "NO_UPDATES": F.col("updates"), "NO_DELETES": F.col("deletes"), "NO_TRUNCATES": F.col("truncates"), "NOT_BY_ROOT": F.col("by_root")})


def slot_findings(slots: DataFrame) -> DataFrame:
    """A slot is of the right plugin and database, free, and still has its log."""
    return _found(slots, F.col("slot"), {"WRONG_PLUGIN": F.col("plugin") == "pgoutput", "WRONG_DATABASE": F.col("database") == F.col("own_database"), "SLOT_IN_USE": ~F.col("active"), "SLOT_INVALID": ~F.col("invalid")})


def findings(settings: DataFrame, tables: DataFrame, publications: DataFrame, slots: DataFrame) -> DataFrame:
    """source, object, code of all of them; a source without a row may start."""
    return setting_findings(settings).unionByName(table_findings(tables)).unionByName(publication_findings(publications)).unionByName(slot_findings(slots))
