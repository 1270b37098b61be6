"""Schema checks and their report (L1-L24). A finding is (key, code, level, schema, object, within, used_pct, unique_nullable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT4_MAX = 2147483647
LEVELS = ["error", "warning", "notice"]
# Code, default level, whether partitions roll up into their root.
CHECKS = [
    ("sequence_exhaustion", "error", False), ("no_primary_key", "error", True), ("no_unique_key", "error", True), ("public_create_privilege", "error", False),
    ("unlogged_relation", "warning", True), ("unlogged_sequence", "warning", False), ("uuid_in_non_uuid_type", "notice", True), ("relation_without_fk", "notice", True),
    ("relation_without_columns", "notice", True), ("reserved_word_in_name", "warning", True), ("unsafe_chars_in_name", "notice", True), ("invalid_constraint", "warning", True),
    ("fk_type_mismatch", "warning", True), ("fk_nullable", "notice", True), ("fk_similar", "notice", True), ("index_similar", "notice", True), ("btree_on_array", "notice", True),
]
LEVEL = {c: lv for c, lv, _ in CHECKS}
# Words that names can't be without quotes.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column concurrently constraint create cross "
    "current_catalog current_date current_role current_schema current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch "
    "for foreign freeze from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural "
    "not notnull null offset on only or order outer overlaps placing primary references returning right select session_user similar some symmetric system_user table "
    "tablesample then to trailing true union unique user using variadic verbose when where window with"
).split()
EXTRA = {"used_pct": "double", "unique_nullable": "boolean"}


def _finding(df: DataFrame, key: list[str], code: str | Column, level: str | Column, within: Column | None = None, **extra: Column) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    more = [(extra[n] if n in extra else F.lit(None)).cast(t).alias(n) for n, t in EXTRA.items()]
    return df.select(*key, text(code).alias("code"), text(level).alias("level"), "schema", "object", (F.lit("") if within is None else within).cast("string").alias("within"), *more)


def headroom(sequences: DataFrame) -> DataFrame:
    """L1: ``free_pct`` of each sequence that doesn't cycle, against the narrower of its own limit and its owner's; decimals, so full ranges don't overflow."""
    last = F.coalesce("last_value", "start").cast("decimal(20,0)")
    high, low = F.col("max_value").cast("decimal(20,0)"), F.col("min_value").cast("decimal(20,0)")
    narrow = F.coalesce(F.col("owned_column_type") == "integer", F.lit(False)) & (high > INT4_MAX) & (low < INT4_MAX)
    top = F.when(narrow, F.lit(INT4_MAX).cast("decimal(20,0)")).otherwise(high)
    left = F.when(F.col("increment") > 0, top - last).otherwise(last - low)
    span = (top - low).cast("double")
    free = 100.0 * left.cast("double") / F.when(span != 0, span)
    return sequences.where(~F.col("cycle")).withColumn("free_pct", F.when(narrow, F.greatest(free, F.lit(0.0))).otherwise(free))


def sequence_exhaustion(sequences: DataFrame, key: list[str], bounds: tuple[float, float, float] = (5, 10, 20)) -> DataFrame:
    """L1: sequences with little headroom; one level worse where a 4-byte column owns it. Hidden values are skips, not findings."""
    rank = F.when(F.col("free_pct") < bounds[0], 0).when(F.col("free_pct") < bounds[1], 1).when(F.col("free_pct") < bounds[2], 2)
    rank = F.when(rank.isNotNull() & (F.col("owned_column_type") == "integer"), F.greatest(rank - 1, F.lit(0))).otherwise(rank)
    rows = headroom(sequences).where("last_value_known").withColumn("_rank", rank).where("_rank is not null")
    return _finding(rows, key, "sequence_exhaustion", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_rank") + 1), used_pct=100 - F.col("free_pct"))


def sequence_skips(sequences: DataFrame, key: list[str]) -> DataFrame:
    """How many sequences hide their value; these weren't checked."""
    return sequences.where("not last_value_known").groupBy(*key).agg(F.count("*").alias("skipped")).withColumn("code", F.lit("sequence_exhaustion"))


def not_run(expected: DataFrame, ran: DataFrame, key: list[str]) -> DataFrame:
    """Checks (key, code) that should have run and didn't."""
    return expected.join(ran.select(*key, "code").distinct(), [*key, "code"], "left_anti")


def worst_sequence(sequences: DataFrame, key: list[str]) -> DataFrame:
    """The largest used share (0 to 1) of the readable sequences of each key."""
    return headroom(sequences).where("last_value_known").groupBy(*key).agg(F.greatest(F.max((100 - F.col("free_pct")) / 100), F.lit(0.0)).alias("worst_used"))


def relation_keys(classes: DataFrame, indexes: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """L2, L3: tables without primary key, told apart by whether a usable unique index exists.

    Partial and expression indexes aren't keys; included columns don't count. ``unique_nullable``: no unique index has
    all its columns not null.
    """
    cols = indexes.where("`unique` and valid and predicate is null").select(*key, "indrelid", "indexrelid", "primary", F.explode(F.slice("indkey", 1, F.col("nkeyatts"))).alias("attnum"))
    facts = attributes.select(*key, F.col("attrelid").alias("indrelid"), "attnum", "notnull")
    one = cols.join(facts, [*key, "indrelid", "attnum"], "left").groupBy(*key, "indrelid", "indexrelid", "primary").agg(F.every(F.col("attnum") != 0).alias("plain"), F.every(F.coalesce("notnull", F.lit(False))).alias("strict"))
    per = one.where("plain").groupBy(*key, F.col("indrelid").alias("relid")).agg(F.bool_or("strict").alias("strict"), F.bool_or("primary").alias("primary"))
    rows = classes.where("relkind in ('r', 'p')").join(per, [*key, "relid"], "left").where("primary is null or not primary")
    has = F.col("strict").isNotNull()
    return _finding(rows, key, F.when(has, "no_primary_key").otherwise("no_unique_key"), "error", unique_nullable=F.when(has, ~F.col("strict")))


def public_create(grants: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    """L4: schemas where everyone may create objects (key, schema, grantee, privilege); before version 15 that was the default, so only a warning."""
    rows = grants.where("grantee = 'public' and privilege = 'CREATE'").select(*key, "schema", F.col("schema").alias("object")).distinct().join(versions, key)
    return _finding(rows, key, "public_create_privilege", F.when(F.col("version_num") < 150000, "warning").otherwise("error"))


def unlogged(classes: DataFrame, key: list[str]) -> DataFrame:
    """Tables and sequences that a crash empties."""
    rows = classes.where("relpersistence = 'u' and relkind in ('r', 'p', 'm', 'S')")
    return _finding(rows, key, F.when(F.col("relkind") == "S", "unlogged_sequence").otherwise("unlogged_relation"), "warning")


def uuid_like(classes: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """Identifiers kept in strings of 32 or 36 characters (declared length plus 4)."""
    name = F.lower("attname")
    cols = attributes.where(F.col("type").isin("varchar", "bpchar") & (F.col("typmod") - 4).isin(32, 36) & (name.contains("uid") | name.endswith("_id") | (name == "id")))
    tables = classes.where("relkind in ('r', 'p') and relpersistence <> 't'").withColumnRenamed("relid", "attrelid")
    return _finding(tables.join(cols.select(*key, "attrelid", "attname"), [*key, "attrelid"]), key, "uuid_in_non_uuid_type", "notice", F.col("attname"))


def without_fk(classes: DataFrame, constraints: DataFrame, key: list[str]) -> DataFrame:
    """Tables that neither refer nor are referred to; one anti join for each side."""
    tables = classes.where("relkind in ('r', 'p')")
    for side in ("conrelid", "confrelid"):
        tables = tables.join(constraints.select(*key, F.col(side).alias("relid")).distinct(), [*key, "relid"], "left_anti")
    return _finding(tables, key, "relation_without_fk", "notice")


def without_columns(classes: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """Tables without columns."""
    some = attributes.where("attnum > 0").select(*key, F.col("attrelid").alias("relid")).distinct()
    return _finding(classes.where("relkind in ('r', 'p')").join(some, [*key, "relid"], "left_anti"), key, "relation_without_columns", "notice")


def unsafe_names(classes: DataFrame, key: list[str]) -> DataFrame:
    """Names that are reserved words, or that hold more than letters, digits and underscores; reserved goes first."""
    reserved = F.lower("object").isin(RESERVED)
    rows = classes.where("relkind in ('r', 'p', 'm', 'v', 'S', 'i', 'I') and relpersistence <> 't'").where(reserved | F.col("object").rlike("[^A-Za-z0-9_]"))
    return _finding(rows, key, F.when(reserved, "reserved_word_in_name").otherwise("unsafe_chars_in_name"), F.when(reserved, "warning").otherwise("notice"))


def from_rows(rows: DataFrame, key: list[str], code: str, within: str) -> DataFrame:
    """Findings from the rows (key, schema, object, ...) of the report named; ``within`` is the constraint, index or column."""
    return _finding(rows, key, code, LEVEL[code], F.col(within))


def collapse_partitions(findings: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """Findings of partitions under their root (roots: key, child, root; named as schema.object), with the worst child's numbers.

    Findings about different columns or constraints stay apart; checks that don't roll up keep their object.
    """
    rolls = F.col("code").isin([c for c, _, roll in CHECKS if roll])
    name = F.concat_ws(".", "schema", "object")
    rows = findings.withColumns({"child": name, "_rolls": rolls}).join(roots.select(*key, "child", "root"), [*key, "child"], "left")
    to = F.when(F.col("_rolls"), F.col("root"))
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    worst = F.struct(rank.alias("rank"), (-F.coalesce("used_pct", F.lit(0.0))).alias("used"))
    return rows.groupBy(*key, "code", F.coalesce(to, "child").alias("object"), "within").agg(
        F.min_by("level", worst).alias("level"), F.min_by("used_pct", worst).alias("used_pct"), F.count_if(to.isNotNull()).alias("partitions"), F.bool_or(F.coalesce("unique_nullable", F.lit(False))).alias("unique_nullable"))


def suppress(findings: DataFrame, masks: list[str], off: list[str] | None = None) -> DataFrame:
    """Without findings in schemas like a mask ('*' stands for anything; whole names) or of checks that are off."""
    out = findings.where(~F.col("code").isin(off)) if off else findings
    schema = F.element_at(F.split("object", r"\."), 1) if "schema" not in findings.columns else F.col("schema")
    for m in masks:
        out = out.where(~schema.like(m.replace("\\", "\\\\").replace("_", r"\_").replace("%", r"\%").replace("*", "%")))
    return out


def order_findings(findings: DataFrame) -> DataFrame:
    """A total order: level, check, object, what within it."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return findings.orderBy(rank, "code", "object", "within", F.desc_nulls_last("used_pct"), *(["schema"] if "schema" in findings.columns else []))


def lint_summary(findings: DataFrame, key: list[str]) -> DataFrame:
    """Findings by level for each key, zeros included."""
    return findings.groupBy(*key).pivot("level", LEVELS).agg(F.count(F.lit(1))).fillna(0, LEVELS)
