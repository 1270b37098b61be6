"""Foreign keys and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fk_columns(constraints: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """a row for each column pair of each foreign key: (key, name, conrelid, confrelid, matchtype, pos, from_*, to_*).

    ``conkey`` and ``confkey`` are zipped by position; a number that no attribute has gives nulls.
    """
    pairs = constraints.select(*key, "name", "conrelid", "confrelid", "matchtype", F.posexplode(F.arrays_zip("conkey", "confkey")).alias("pos", "pair"))
    rows = pairs.select(*key, "name", "conrelid", "confrelid", "matchtype", "pos", F.col("pair.conkey").alias("from_num"), F.col("pair.confkey").alias("to_num"))
    for side, rel in (("from", "conrelid"), ("to", "confrelid")):
        facts = [F.col(c).alias(f"{side}_{c}") for c in ("attname", "type", "typmod", "notnull")]
        rows = rows.join(attributes.select(*key, F.col("attrelid").alias(rel), F.col("attnum").alias(f"{side}_num"), *facts), [*key, rel, f"{side}_num"], "left")
    return rows


def _per_key(pairs: DataFrame, key: list[str]) -> DataFrame:
    names = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("from_attname", F.lit("?")).alias("name")))), lambda x: x["name"])
    return pairs.groupBy(*key, "name", "conrelid", "confrelid").agg(F.array_join(names, ",").alias("columns"))


def fk_nullable(pairs: DataFrame, key: list[str]) -> DataFrame:
    """foreign keys with nullable columns, those columns in key order; MATCH FULL keys are safe and left out."""
    return _per_key(pairs.where((F.col("matchtype") != "f") & ~F.col("from_notnull")), key)


def fk_similar(pairs: DataFrame, key: list[str], mode: str = "equal") -> DataFrame:
    """Pairs (name, name2) of foreign keys between the same relations, with equal column lists or a common column.

    Overlaps are found by an equi-join on the shared column, not by comparing all keys of two relations.
    """
    rels = [*key, "conrelid", "confrelid"]
    if mode == "equal":
        sides, on = _per_key(pairs, key), [*rels, "columns"]
    else:
        sides, on = pairs.where("from_attname is not null").select(*rels, "name", "from_attname"), [*rels, "from_attname"]
    found = sides.join(sides.withColumnRenamed("name", "name2"), on).where("name < name2").select(*rels, "name", "name2")
    return found if mode == "equal" else found.distinct()


def fk_type_mismatch(pairs: DataFrame, key: list[str]) -> DataFrame:
    """foreign keys with a column whose type or type modifier differs from the referenced column's."""
    return _per_key(pairs.where((F.col("from_type") != F.col("to_type")) | (F.col("from_typmod") != F.col("to_typmod"))), key)


def invalid_constraints(constraints: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """constraints that were never validated, with their relation's name."""
    names = classes.select(*key, F.col("relid").alias("conrelid"), "schema", "relname")
    return constraints.where(~F.col("validated")).join(names, [*key, "conrelid"]).select(*key, "schema", "relname", "name")
