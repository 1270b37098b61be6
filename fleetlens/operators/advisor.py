"""Index advice from column usages.

A usage is (key, fingerprint, schema, table, column, role, desc, seq); the catalog holds relations (key, relid, schema,
table, rows, ...), columns (key, relid, column, null_frac, n_distinct, indexable) and indexes (key, relid, name, columns,
unique, valid, method, predicate). Every step is a join or a grouping; lists are arrays of column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.graph import ancestry, root_of
from fleetlens.functions.store import settled
from fleetlens.functions.windows import top_n

SYSTEM = ["pg_catalog", "information_schema"]


def _none() -> Column:
    return F.array().cast("array<string>")


def advisor_catalog(relations: DataFrame, edges: DataFrame, counters: DataFrame, key: list[str]) -> DataFrame:
    """V1: relations with the rows and writes of their whole partition tree; structure from one host, counters summed over all."""
    roots = root_of(edges, key).select(*key, F.col("child").alias("relid"), "root")
    counts = counters.groupBy(*key, "relid").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))
    leaf = relations.select(*key, "relid", "rows").join(counts, [*key, "relid"], "left").join(roots, [*key, "relid"], "left")
    total = leaf.groupBy(*key, F.coalesce("root", "relid").alias("relid")).agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("writes"), F.lit(0)).alias("writes"))
    return relations.drop("rows").join(total, [*key, "relid"])


def resolve_tables(usages: DataFrame, relations: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """V2: usages with the relation that they name (partitions give their root) or a reason.

    A bare name must be unique among the schemas; system schemas are left out.
    """
    full = relations.select(*key, F.col("schema"), "table", F.col("relid").alias("_full"))
    bare = relations.groupBy(*key, "table").agg(F.count("*").alias("_n"), F.min("relid").alias("_bare"))
    roots = root_of(edges, key).select(*key, F.col("child").alias("relid"), "root")
    rows = usages.join(full, [*key, "schema", "table"], "left").join(bare, [*key, "table"], "left")
    found = F.when(F.col("schema").isNotNull(), F.col("_full")).when(F.col("_n") == 1, F.col("_bare"))
    reason = F.when(F.col("schema").isin(SYSTEM), "system_relation").when(found.isNotNull(), F.lit(None)).when(F.col("schema").isNull() & (F.col("_n") > 1), "ambiguous_table").otherwise("unknown_relation")
    rows = rows.withColumns({"reason": reason, "relid": found}).join(roots, [*key, "relid"], "left")
    return rows.withColumn("relid", F.coalesce("root", "relid")).drop("root", "_full", "_bare", "_n")


def bind_usages(columns_used: DataFrame, candidates: DataFrame, columns: DataFrame, key: list[str]) -> DataFrame:
    """V3: unqualified columns (key, fingerprint, column, ...) bound to the one of the statement's tables (key, fingerprint, relid) that has them.

    Only a table's list of columns travels to the statements, a row for each of their tables (candidates and columns are
    unique); a statement's own tables are then one row, so that its usages stay where they are.
    """
    has = columns.groupBy(*key, "relid").agg(F.collect_list("column").alias("has"))
    tables = candidates.join(has, [*key, "relid"]).groupBy(*key, "fingerprint").agg(F.collect_list(F.struct("relid", "has")).alias("_tables"))
    owners = F.transform(F.filter("_tables", lambda t: F.array_contains(t["has"], F.col("column"))), lambda t: t["relid"])
    rows = columns_used.join(tables, [*key, "fingerprint"], "left").withColumn("_owners", F.coalesce(owners, F.array().cast(T.ArrayType(candidates.schema["relid"].dataType))))
    reason = F.when(F.size("_owners") > 1, "ambiguous_column").when(F.size("_owners") == 0, "unknown_column")
    return rows.withColumns({"reason": reason, "relid": F.when(F.size("_owners") == 1, F.col("_owners")[0])}).drop("_owners", "_tables")


def split_roles(usages: DataFrame, key: list[str]) -> DataFrame:
    """V4: (key, fingerprint, relid, equality, ranges, nulls, ordering), each list in the order written.

    Joins count as equality; grouping orders only without an explicit order; an order of mixed directions is no use.
    """
    def names(*roles: str) -> Column:
        return F.array_distinct(F.transform(F.filter("_hits", lambda x: x["role"].isin(*roles)), lambda x: x["column"]))

    def mixed(role: str) -> Column:
        desc = F.when(F.col("role") == role, F.coalesce("desc", F.lit(False)))
        return F.coalesce(F.min(desc) != F.max(desc), F.lit(False))

    # one list, and no distinct count beside it: that would triple the rows before they are grouped
    rows = usages.groupBy(*key, "fingerprint", "relid").agg(
        F.sort_array(F.collect_list(F.struct("seq", "column", "role"))).alias("_hits"), mixed("order").alias("_mixed_order"), mixed("group").alias("_mixed_group"))
    rows = rows.select(*key, "fingerprint", "relid", names("equality", "join").alias("equality"), names("range").alias("ranges"), names("is_null").alias("nulls"),
        names("order").alias("_order"), names("group").alias("_group"), "_mixed_order", "_mixed_group")
    by_order = F.when(F.col("_mixed_order"), _none()).otherwise(F.col("_order"))
    by_group = F.when(F.col("_mixed_group"), _none()).otherwise(F.col("_group"))
    return rows.withColumn("ordering", F.when(F.size("_order") > 0, by_order).otherwise(by_group)).drop("_order", "_group", "_mixed_order", "_mixed_group")


def with_column_facts(roles: DataFrame, relations: DataFrame, columns: DataFrame, key: list[str]) -> DataFrame:
    """Each statement's roles with a map of its relation's columns to their statistics (a row's own columns only)."""
    facts = columns.groupBy(*key, "relid").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("null_frac", "n_distinct", "indexable")))).alias("facts"))
    return roles.join(relations.select(*key, "relid", "rows"), [*key, "relid"], "left").join(facts, [*key, "relid"], "left")


def _fact(c: Column) -> Column:
    return F.try_element_at(F.col("facts"), c)


def order_equality() -> tuple[Column, Column]:
    """V5: equality columns, most distinct first (a negative count is a share of the rows), and whether statistics are missing.

    Without statistics of every column they stay as written.
    """
    missing = F.exists("equality", lambda c: _fact(c)["n_distinct"].isNull())
    distinct = lambda c: F.when(_fact(c)["n_distinct"] < 0, -_fact(c)["n_distinct"] * F.col("rows")).otherwise(_fact(c)["n_distinct"])
    ranked = F.array_sort(F.transform("equality", lambda c, i: F.struct((-distinct(c)).alias("d"), i.alias("i"), c.alias("c"))))
    return F.when(missing, F.col("equality")).otherwise(F.transform(ranked, lambda x: x["c"])), missing


def null_predicate() -> Column:
    """V6: null-tested columns that aren't scanned by anyway and where some, but at most half, of the rows are null; sorted."""
    scanned = F.concat("equality", "ranges", "ordering")
    share = lambda c: _fact(c)["null_frac"]
    return F.sort_array(F.filter(F.array_except("nulls", scanned), lambda c: (share(c) > 0) & (share(c) <= 0.5)))


def draft_keys(facts: DataFrame, width: int = 3, min_rows: int = 10_000) -> DataFrame:
    """V7: the key that each statement would like: equality, then the first range column, else the ordering; cut after a unique column and at ``width``.

    ``reason`` tells why there is none.
    """
    equality, missing = order_equality()
    tail = F.when(F.size("ranges") > 0, F.slice("ranges", 1, 1)).otherwise(F.col("ordering"))
    indexable = lambda c: F.coalesce(_fact(c)["indexable"], F.lit(False))
    # the reason doesn't ask for the order, so that a filter on it costs little wherever it is put
    some = F.concat("equality", tail)
    reason = (
        F.when(F.col("rows").isNull(), "unknown_relation").when(F.col("rows") < min_rows, "table_too_small")
        .when(F.exists(some, indexable), F.lit(None).cast("string"))
        .when(F.exists(some, lambda c: ~_fact(c)["indexable"]), "unsupported_type")
        .when(F.size(some) > 0, "unknown_column").otherwise("no_indexable_predicate")
    )
    rows = facts.withColumns({"_eq": equality, "stats_missing": missing, "predicate": null_predicate(), "reason": reason})
    rows = rows.withColumn("_keep", F.filter(F.array_distinct(F.concat("_eq", tail)), indexable))
    unique = F.transform("_keep", lambda c: F.array_contains("equality", c) & F.coalesce(_fact(c)["n_distinct"] <= -1, F.lit(False)))
    at = F.array_position(unique, True)
    rows = rows.withColumn("_cut", F.when(at > 0, F.slice("_keep", F.lit(1), at.cast("int"))).otherwise(F.col("_keep")))
    return rows.withColumns({"columns": F.slice("_cut", 1, width), "wide": F.size("_cut") > width}).drop("_eq", "_keep", "_cut", "facts")


def covered(drafts: DataFrame, indexes: DataFrame, key: list[str]) -> DataFrame:
    """V8: drafts that no valid B-tree answers yet.

    An index answers if its first columns hold the draft's equality columns in any order and then the rest in place, or
    if it is unique and all its columns are tested for equality. A partial index must have the same predicate.
    """
    live = indexes.where("method = 'btree' and valid").groupBy(*key, "relid").agg(F.collect_set(F.struct(F.col("columns").alias("has"), "unique", F.col("predicate").alias("only"))).alias("_live"))  # a relation's own indexes, equal ones once
    n = F.coalesce(F.expr("array_position(transform(columns, c -> array_contains(equality, c)), false)"), F.lit(0))
    rows = drafts.where("reason is null").withColumn("_head", F.when(n == 0, F.size("columns")).otherwise((n - 1).cast("int")))

    def within(some: Column, all_: Column | str) -> Column:
        return F.forall(some, lambda c: F.array_contains(all_, c))

    def answers(i: Column) -> Column:
        first, rest = F.lit(1), F.size("columns") - F.col("_head")
        prefix = within(F.slice(i["has"], first, F.col("_head")), F.slice("columns", first, F.col("_head")))
        tail = (rest == 0) | (F.slice(i["has"], F.col("_head") + 1, rest) == F.slice("columns", F.col("_head") + 1, rest))
        by_key = (F.size(i["has"]) >= F.size("columns")) & tail & prefix
        by_unique = i["unique"] & (F.size(i["has"]) > 0) & within(i["has"], "equality")
        return ((F.size(i["only"]) == 0) | (i["only"] == F.col("predicate"))) & (by_key | by_unique)

    return rows.join(live, [*key, "relid"], "left").where(~F.coalesce(F.exists("_live", answers), F.lit(False))).drop("_live", "_head")


def merge_prefixes(drafts: DataFrame, key: list[str]) -> DataFrame:
    """V9: one candidate for each key; a key that begins another with the same predicate goes into the longest such, ties by name.

    Each draft yields its prefixes (a key is short), so containers are found by an equi-join. Drafts and candidates are
    written, as what follows reads them more than once.
    """
    rows = drafts.select(*key, "relid", "fingerprint", "columns", F.array_join("predicate", ",").alias("predicate"), "stats_missing", "wide")
    rows = settled(rows, "drafts")
    keys = rows.select(*key, "relid", "predicate", "columns").distinct()
    longer = keys.select(*key, "relid", "predicate", F.col("columns").alias("whole"), F.explode(F.transform(F.sequence(F.lit(1), F.size("columns")), lambda n: F.slice("columns", F.lit(1), n))).alias("columns"))
    target = longer.groupBy(*key, "relid", "predicate", "columns").agg(F.min_by("whole", F.struct((-F.size("whole")).alias("n"), F.array_join("whole", ",").alias("c"))).alias("whole"))
    moved = rows.join(target, [*key, "relid", "predicate", "columns"])
    merged = moved.groupBy(*key, "relid", "predicate", F.col("whole").alias("columns")).agg(
        F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"), F.bool_or("stats_missing").alias("stats_missing"), F.bool_or("wide").alias("wide"))
    return settled(merged, "candidates")


def weights(candidates: DataFrame, workload: DataFrame, key: list[str]) -> DataFrame:
    """The share of the workload's time that each candidate's statements take, each statement once."""
    total = workload.groupBy(*key).agg(F.sum("exec_ms").alias("_all"))
    per = candidates.select(*key, "relid", "predicate", "columns", F.explode("fingerprints").alias("fingerprint")).join(workload.select(*key, "fingerprint", "exec_ms", "calls"), [*key, "fingerprint"])
    sums = per.groupBy(*key, "relid", "predicate", "columns").agg(F.sum("exec_ms").alias("_ms"), F.sum("calls").alias("calls"))
    rows = candidates.join(sums, [*key, "relid", "predicate", "columns"], "left")
    rows = rows.join(total, key, "left") if key else rows.withColumn("_all", total.select("_all").scalar())
    return rows.withColumn("weight_pct", F.when(F.col("_all") > 0, 100.0 * F.coalesce("_ms", F.lit(0)) / F.col("_all")).otherwise(0.0)).drop("_ms", "_all")


def warnings(candidates: DataFrame, catalog: DataFrame, indexes: DataFrame, key: list[str]) -> DataFrame:
    """What speaks against a candidate, as a list of codes; similar indexes hold all its columns behind others."""
    candidates = settled(candidates, "weighed")
    live = indexes.where("method = 'btree' and valid").select(*key, "relid", "name", F.col("columns").alias("_has"))
    held = candidates.join(live, [*key, "relid"]).where(F.size(F.array_except("columns", "_has")) == 0).groupBy(*key, "relid", "predicate", "columns").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("similar"))
    count = indexes.groupBy(*key, "relid").agg(F.count("*").alias("_indexes"))
    rows = candidates.join(catalog.select(*key, "relid", "relkind", "reads", "writes"), [*key, "relid"], "left").join(count, [*key, "relid"], "left").join(held, [*key, "relid", "predicate", "columns"], "left")
    tests = {
        "similar_index": F.col("similar").isNotNull(), "many_indexes": F.col("_indexes") >= 10, "stats_missing": F.col("stats_missing"), "wide_index": F.col("wide"),
        "partition_root": F.col("relkind") == "p", "materialized_view": F.col("relkind") == "m", "write_heavy": (F.col("writes") >= 1000) & (F.col("writes") > 10 * F.col("reads")), "low_weight": F.col("weight_pct") < 1,
    }
    return rows.withColumn("warnings", F.filter(F.array(*(F.when(t, n) for n, t in tests.items())), lambda x: x.isNotNull())).drop("_indexes", "reads", "writes")


def rank_candidates(candidates: DataFrame, key: list[str], n: int = 50) -> DataFrame:
    """The n weightiest candidates of each key, ties by relation and columns."""
    return top_n(candidates, key, [F.desc("weight_pct"), F.asc("relid"), F.asc(F.array_join("columns", ",")), F.asc("predicate")], n)


def ddl_text(candidates: DataFrame, relations: DataFrame, edges: DataFrame, key: list[str], most: int = 20) -> DataFrame:
    """Statements that would build each candidate (key, relid, predicate, columns), for reading only.

    A plain table gets one index, built concurrently. A partitioned one (relkind p) gets an index on itself alone; below it
    each partition, from the top down by name (edges: key, child, parent), gets its own, on itself alone if it is partitioned again, and
    behind all below it is attached to the index of the table it is a direct partition of. ``most`` partitions are spelt out;
    of the others only the leaves are counted. Partitions lie at any depth; rounds are log2 of it.
    """
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    named = relations.select(*key, "relid", "schema", "table", "relkind", F.concat_ws(".", "schema", "table").alias("_name"))
    up = named.select(*key, F.col("relid").alias("parent"), F.col("_name").alias("_above"))
    links = edges.join(named.select(*key, F.col("relid").alias("child"), F.col("_name").alias("pid")), [*key, "child"]).join(up, [*key, "parent"])
    tops = named.join(links.select(*key, F.col("pid").alias("_name")), [*key, "_name"], "left_anti").select(*key, F.col("_name").alias("pid"), F.lit(None).cast("string").alias("parent"))
    paths = ancestry(links.select(*key, "pid", F.col("_above").alias("parent")).unionByName(tops), key, True)[0].select(*key, F.col("pid").alias("_name"), "root", "path")
    tree = named.join(paths, [*key, "_name"])

    cols = F.concat(F.lit("("), F.array_join(F.transform("columns", q), ", "), F.lit(")"), F.when(F.col("predicate") != "", F.concat(F.lit(" WHERE "), F.array_join(F.transform(F.split("predicate", ","), lambda c: F.concat(q(c), F.lit(" IS NULL"))), " AND "))).otherwise(""))
    name = lambda t: F.substring(F.concat_ws("_", t, F.array_join("columns", "_"), F.lit("idx")), 1, 63)
    index = lambda s, t: F.concat(q(s), F.lit("."), q(name(t)))
    table = F.concat(q(F.col("schema")), F.lit("."), q(F.col("table")))
    ident = [*key, "relid", "predicate", "columns"]
    own = candidates.join(named, [*key, "relid"])
    # every node below a candidate's table, itself included, with its parent's name
    whole = own.select(*ident, F.col("_name").alias("root"), F.col("relkind").alias("_kind")).where("_kind = 'p'")
    below = tree.select(*key, "root", "path", "schema", "table", "relkind", "_name", F.get("path", F.size("path") - 2).alias("_up"))
    parents = named.select(*key, F.col("_name").alias("_up"), F.col("schema").alias("_up_schema"), F.col("table").alias("_up_table"))
    nodes = whole.join(below, [*key, "root"]).join(parents, [*key, "_up"], "left")
    inner = F.col("relkind") == "p"
    rank = F.row_number().over(Window.partitionBy(*ident).orderBy("path")) - 1  # a table's partitions
    nodes = nodes.withColumn("_rank", rank)
    built = F.concat(F.when(inner, F.lit("CREATE INDEX ")).otherwise("CREATE INDEX CONCURRENTLY "), q(name(F.col("table"))), F.when(inner, F.lit(" ON ONLY ")).otherwise(" ON "), table, F.lit(" "), cols, F.lit(";"))
    joined = F.concat(F.lit("ALTER INDEX "), index(F.col("_up_schema"), F.col("_up_table")), F.lit(" ATTACH PARTITION "), index(F.col("schema"), F.col("table")), F.lit(";"))
    lines = F.array(F.struct(F.col("path").alias("at"), built.alias("line")), F.struct(F.concat("path", F.array(F.lit("\U0010ffff"))).alias("at"), F.when(F.col("_rank") > 0, joined).alias("line")))
    listed = F.col("_rank") <= most
    # a list of 2 * most lines at most
    script = F.array_join(F.transform(F.array_sort(F.filter(F.flatten(F.collect_list(F.when(listed, lines))), lambda x: x["line"].isNotNull())), lambda x: x["line"]), "\n")
    skipped = F.count_if(~listed & ~inner)
    scripts = nodes.groupBy(*ident).agg(script.alias("_script"), skipped.alias("_skipped"), F.max("_rank").alias("_parts"))
    more = F.when(F.col("_skipped") > 0, F.concat(F.lit("\n-- "), F.col("_skipped").cast("string"), F.lit(" more partitions are built and attached the same way")))
    text = F.when(F.col("_parts") > 0, F.concat("_script", F.coalesce(more, F.lit("")))).otherwise(F.concat(F.lit("CREATE INDEX "), F.when(F.col("relkind") == "p", "").otherwise("CONCURRENTLY "), q(name(F.col("table"))), F.lit(" ON "), table, F.lit(" "), cols, F.lit(";")))
    return own.join(scripts, ident, "left").withColumn("ddl", text).drop("_parts", "_script", "_skipped", "_name", "schema", "table", "relkind")


def not_analysed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Statements without a candidate, by reason."""
    return rows.where("reason is not null").groupBy(*key, "reason").agg(F.count_distinct("fingerprint").alias("n"))


def advise(usages: DataFrame, relations: DataFrame, columns: DataFrame, indexes: DataFrame, edges: DataFrame, workload: DataFrame, key: list[str], **cfg: int) -> DataFrame:
    """V2-V10, V12 in a row: ranked candidates with their weights."""
    bound = resolve_tables(usages, relations, edges, key).where("reason is null")
    drafts = draft_keys(with_column_facts(split_roles(bound, key), relations, columns, key), **cfg)
    return rank_candidates(weights(merge_prefixes(covered(drafts, indexes, key), key), workload, key), key)
