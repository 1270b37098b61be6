"""Sizes, bloat estimates and look-alike indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import safe_ratio
from fleetlens.functions.windows import top_n

# Page geometry in bytes.
BLOCK, ALIGN, PAGE_HEADER, HEAP_PAGE_HEADER, TUPLE_HEADER, ITEM_POINTER = 8192, 8, 24, 20, 23, 4
# What kinds of relations are called.
KINDS = {"r": "Tables", "i": "Indexes", "S": "Sequences", "v": "Views", "m": "Mat Views", "c": "Compose types", "t": "TOAST Tables", "f": "Foreign Tables", "p": "Partitioned table", "I": "Partitioned index"}


def _padding(x: Column) -> Column:
    """Bytes up to the next aligned address, 0 where x is aligned."""
    return (ALIGN - x % ALIGN) % ALIGN


def key_columns(indexes: DataFrame, key: list[str]) -> DataFrame:
    """(key, indexrelid, indrelid, pos, attnum): the columns of each index, included ones too."""
    return indexes.select(*key, "indexrelid", "indrelid", F.posexplode("indkey").alias("pos", "attnum"))


def index_bloat(indexes: DataFrame, attributes: DataFrame, key: list[str], min_bytes: int = 0) -> DataFrame:
    """Estimated bytes wasted by each B-tree: its pages less those that its rows need by the columns' statistics."""
    widths = attributes.where("avg_width is not null").select(*key, F.col("attrelid").alias("indrelid"), "attnum", "null_frac", "avg_width")
    data = key_columns(indexes.where("method = 'btree'"), key).join(widths, [*key, "indrelid", "attnum"]).groupBy(*key, "indexrelid").agg(
        F.max(F.coalesce("null_frac", F.lit(0.0))).alias("nulls"), F.sum((1 - F.coalesce("null_frac", F.lit(0.0))) * F.col("avg_width")).alias("width"))
    header = F.when(F.col("nulls") == 0, 2).otherwise(6)
    row = 2 + _padding(header) + F.col("width") + _padding(F.rint("width").cast("long"))
    need = F.ceil(F.col("reltuples") * (4 + row) / (BLOCK - PAGE_HEADER)) + 1
    sized = indexes.select(*key, "indexrelid", "indrelid", "reltuples", "relpages").join(data, [*key, "indexrelid"])
    wasted = (F.greatest(F.col("relpages") - need, F.lit(0)) * BLOCK).cast("long")
    return sized.select(*key, "indrelid", "indexrelid", wasted.alias("bloat_bytes"), (F.col("relpages") * BLOCK).cast("long").alias("index_bytes")).where(F.col("bloat_bytes") >= min_bytes)


def btree_on_array(indexes: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """Non-unique B-trees with an array among their key columns (included columns don't count)."""
    cols = key_columns(indexes.where("method = 'btree' and not `unique`").withColumn("indkey", F.slice("indkey", 1, F.col("nkeyatts"))), key)
    arrays = attributes.where("is_array").select(*key, F.col("attrelid").alias("indrelid"), "attnum")
    return cols.join(arrays, [*key, "indrelid", "attnum"], "left_semi").select(*key, "indrelid", "indexrelid").distinct()


def invalid_indexes(indexes: DataFrame, constraints: DataFrame, key: list[str]) -> DataFrame:
    """Indexes that are invalid or not ready, with the constraints that they serve."""
    owned = constraints.groupBy(*key, "indexrelid").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("constraints"))
    return indexes.where("not valid or not ready").join(owned, [*key, "indexrelid"], "left").select(*key, "indrelid", "indexrelid", "constraints")


def simplified(definition: Column, loose: bool = False) -> Column:
    """An index definition without name, null order and direction; if loose, without UNIQUE, INCLUDE and WHERE as well."""
    text = F.regexp_replace(definition, " INDEX .* ON ", " INDEX ON ")
    for words in (" NULLS FIRST", " NULLS LAST", " DESC"):
        text = F.regexp_replace(text, words + r"([,)])", "$1")
    if loose:
        text = F.replace(text, F.lit(" UNIQUE "), F.lit(" "))
        text = F.regexp_replace(F.regexp_replace(text, r" INCLUDE \([^)]*\)", ""), " WHERE .*$", "")
    return text


def similar_unique(indexes: DataFrame, key: list[str]) -> DataFrame:
    """Non-unique indexes that say the same as a unique one."""
    rows = indexes.withColumn("_like", F.replace(simplified(F.col("definition")), F.lit(" UNIQUE "), F.lit(" ")))
    left = rows.where("`unique`").select(*key, "indrelid", "_like", F.col("indexrelid").alias("unique_index"))
    right = rows.where("not `unique`").select(*key, "indrelid", "_like", F.col("indexrelid").alias("index"))
    return left.join(right, [*key, "indrelid", "_like"]).drop("_like")


def similar_loose(indexes: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of indexes that differ at most in name, direction, null order, UNIQUE, INCLUDE and WHERE."""
    rows = indexes.select(*key, "indrelid", "indexrelid", simplified(F.col("definition"), True).alias("_like"))
    return rows.join(rows.withColumnRenamed("indexrelid", "indexrelid2"), [*key, "indrelid", "_like"]).where("indexrelid < indexrelid2").drop("_like")


def index_top_size(indexes: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """The largest indexes of each key, ties by id."""
    return top_n(indexes, key, [F.desc("size_bytes"), F.asc("indexrelid")], n).select(*key, "indexrelid", "size_bytes", "rn")


def table_top_size(classes: DataFrame, index_pages: DataFrame, attributes: DataFrame, key: list[str], k: int, min_bytes: int = 512_000) -> DataFrame:
    """The k largest tables with estimated heap bloat.

    Candidates are cut by page counts first, so column statistics are read for few tables. A table with a column
    without statistics gets nulls, not an estimate. ``classes`` carries its overflow table's pages and rows.
    """
    pages = F.col("relpages") + F.coalesce("toast_pages", F.lit(0)) + F.coalesce("pages", F.lit(0))
    some = classes.where("relkind in ('r', 'p', 'm')").join(index_pages.select(*key, F.col("indrelid").alias("relid"), "pages"), [*key, "relid"], "left").withColumn("approx_pages", pages)
    cut = top_n(some, key, [F.desc("approx_pages"), F.asc("relid")], max(4 * k, 50)).where(F.col("total_bytes") > min_bytes).drop("rn")
    top = top_n(cut, key, [F.desc("total_bytes"), F.asc("relid")], k)
    cols = attributes.select(*key, F.col("attrelid").alias("relid"), "null_frac", "avg_width").join(top.select(*key, "relid"), [*key, "relid"], "left_semi")
    stats = cols.groupBy(*key, "relid").agg(
        F.count_if(F.col("avg_width").isNull()).alias("without"), F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("data"),
        F.max("null_frac").alias("nulls"), F.count_if(F.col("null_frac") != 0).alias("nullable"),
    )
    null_header = TUPLE_HEADER + 1 + F.floor(F.col("nullable") / 8)
    data_header = F.col("data") + TUPLE_HEADER + _padding(F.lit(TUPLE_HEADER))
    row = data_header + F.col("nulls") * (null_header + _padding(null_header)) + 4 + _padding(data_header)
    heap = (F.col("relpages") + F.coalesce("toast_pages", F.lit(0))) * BLOCK
    need = (F.ceil(F.col("reltuples") * row / (BLOCK - HEAP_PAGE_HEADER)) + F.ceil(F.coalesce("toast_tuples", F.lit(0)) / 4)) * BLOCK
    known = (F.col("without") == 0) & (F.col("relkind") == "r")
    est = top.join(stats, [*key, "relid"], "left").withColumns({"table_bytes": heap.cast("long"), "expected_bytes": F.when(known & (need > 0), need.cast("long"))})
    bloat = F.when(F.col("expected_bytes") <= F.col("table_bytes"), F.col("table_bytes") - F.col("expected_bytes")).otherwise(0)
    return est.withColumn("bloat_bytes", F.when(F.col("expected_bytes").isNotNull(), bloat)).select(*key, "relid", "rn", "total_bytes", "table_bytes", "expected_bytes", "bloat_bytes")


def row_estimate(attributes: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Estimated row size, rows in a page, whether rows overflow into side storage, and the columns that may (widest first)."""
    candidate = F.when(F.col("storage").isin("e", "x", "m") & F.col("avg_width").isNotNull(), F.struct((-F.col("avg_width")).alias("w"), F.col("attname").alias("name")))
    cols = attributes.groupBy(*key, F.col("attrelid").alias("relid")).agg(
        F.count("*").alias("columns_total"), F.count("avg_width").alias("columns_with_stats"), F.coalesce(F.sum("avg_width"), F.lit(0)).cast("long").alias("sum_avg_width"),
        F.array_join(F.transform(F.sort_array(F.collect_list(candidate)), lambda c: c["name"]), ",").alias("toast_candidates"),
    )
    size = TUPLE_HEADER + F.floor((F.col("columns_total") + 7) / 8) + F.col("sum_avg_width")
    fits = lambda share: F.floor(F.floor((BLOCK - PAGE_HEADER) * share / 100) / (F.col("row_bytes") + ITEM_POINTER))
    fill = F.coalesce(F.element_at("reloptions", "fillfactor").cast("int"), F.lit(100)) if "reloptions" in classes.columns else F.lit(100)
    rows = classes.select(*key, "relid", fill.alias("fillfactor")).join(cols, [*key, "relid"]).withColumn("row_bytes", size)
    return rows.withColumns({"will_toast": F.col("row_bytes") > BLOCK // 4, "rows_per_page": fits(F.col("fillfactor")), "rows_reserved": fits(100 - F.col("fillfactor"))})


def summary(classes: DataFrame, key: list[str], min_pages: int = 10) -> DataFrame:
    """Relations and their size by schema and kind, for kinds of more than ``min_pages`` pages."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("relkind")), F.col("relkind"))
    grouped = classes.groupBy(*key, "schema", kind.alias("kind")).agg(F.sum(F.coalesce("relpages", F.lit(0))).alias("pages"), F.count("*").alias("amount"))
    return grouped.where(F.col("pages") > min_pages).select(*key, "schema", "kind", (F.col("pages") * BLOCK).alias("approx_bytes"), "amount")


def measured_bloat(tuplestats: DataFrame) -> DataFrame:
    """Dead and free shares from measured tuples, null for empty tables."""
    return tuplestats.withColumns({"dead_pct": safe_ratio(F.col("dead_bytes"), F.col("table_bytes"), 100.0), "free_pct": safe_ratio(F.col("free_bytes"), F.col("table_bytes"), 100.0)})
