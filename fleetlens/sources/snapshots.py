"""Telemetry scans, snapshot storage, as-of lookups and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fleetlens.functions.exprs import sanitize
from fleetlens.functions.windows import running_last


def harmonise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Df with exactly the columns of ``schema``; what an older version lacks becomes typed nulls."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_telemetry(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Captured tables of several versions as one; each path is read with its own columns."""
    out = None
    for p in paths:
        part = harmonise(spark.read.parquet(p), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths")
    return out


def last_per_step(samples: DataFrame, step: str, tie: str = "value") -> DataFrame:
    """The last value of each series in each step, of equal times the one with the largest ``tie``."""
    return samples.groupBy("target", "signal", F.window("ts", step)["start"].alias("ts")).agg(F.max_by("value", F.struct("ts", tie)).alias("value"))


def range_evaluation(samples: DataFrame, start: str, end: str, step_s: int, look_back_s: int, tie: str = "value", fill: bool = False) -> DataFrame:
    """S2, range form: (target, signal, ts, value) at every step from ``start`` to ``end``: the newest sample at or before it.

    A sample counts for less than ``look_back_s`` seconds; a newest one without value marks its series as gone. Steps
    without a sample are absent, or with ``fill`` null, for each series that has samples in reach of the range. Of equal
    times the largest ``tie`` wins. Samples are first cut down to the newest between two steps, before the shuffle; then each covers
    its steps up to the next one's, so no step is searched.
    """
    if step_s <= 0:
        raise ValueError("a range has steps of a second or more")
    at, first, last = F.unix_micros("ts"), F.unix_micros(F.lit(start).cast("timestamp")), F.unix_micros(F.lit(end).cast("timestamp"))
    step, back, steps = step_s * 1_000_000, look_back_s * 1_000_000, F.floor((last - first) / (step_s * 1_000_000))
    near = samples.where((at > first - back) & (at <= last))
    slot = F.greatest(F.ceil((at - first) / step), F.lit(0)).cast("long")  # the first step that sees it
    newest = near.groupBy("target", "signal", slot.alias("slot")).agg(F.max(F.struct(at.alias("at"), F.col(tie).alias("tie"), "value")).alias("x"))
    following = F.lead("slot").over(Window.partitionBy("target", "signal").orderBy("slot"))  # a row for each step at most
    ends = F.least(F.coalesce(following - 1, steps), F.floor((F.col("x.at") + back - 1 - first) / step), steps)
    covered = newest.withColumn("_to", ends.cast("long")).where((F.col("_to") >= F.col("slot")) & F.col("x.value").isNotNull())
    rows = covered.select("target", "signal", F.explode(F.sequence("slot", "_to")).alias("slot"), F.col("x.value").alias("value"))
    if fill:
        grid = near.select("target", "signal").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))))
        rows = grid.join(rows, ["target", "signal", "slot"], "left")
    return rows.select("target", "signal", F.timestamp_micros(first + F.col("slot") * step).alias("ts"), "value")


def instant_evaluation(samples: DataFrame, at: str, look_back_s: int, tie: str = "value") -> DataFrame:
    """S2, instant form: each series' newest sample at ``at``, absent without one in reach."""
    return range_evaluation(samples, at, at, 1, look_back_s, tie)


def write_snapshot(report: DataFrame, path: str) -> None:
    """Sanitised texts in a dictionary by hash, numbers by day; what a day's dictionary has isn't written again."""
    spark = report.sparkSession
    rows = report.withColumn("query", sanitize(F.col("query"))).withColumn("query_hash", F.sha2("query", 256))
    texts = rows.select("dt", "query_hash", "query").dropDuplicates(["dt", "query_hash"])
    try:
        known = spark.read.parquet(f"{path}/texts").select("dt", "query_hash")
    except Exception as e:  # the first snapshot finds no dictionary
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        texts = texts.join(known.withColumn("dt", F.col("dt").cast(texts.schema["dt"].dataType)), ["dt", "query_hash"], "left_anti")
    texts.write.mode("append").partitionBy("dt").parquet(f"{path}/texts")
    rows.drop("query").write.mode("append").partitionBy("dt").parquet(f"{path}/rows")


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str, dt: str | None = None) -> DataFrame:
    """A snapshot's rows with their texts; of the texts only the days of the snapshot are read, of all days where ``dt`` isn't given."""
    rows = spark.read.parquet(f"{path}/rows").where(F.col("snapshot_id") == snapshot_id)
    texts = spark.read.parquet(f"{path}/texts")
    if dt is not None:
        rows, texts = (x.where(F.col("dt") == F.lit(dt)) for x in (rows, texts))
    else:
        texts = texts.where(F.col("dt").isin([r[0] for r in rows.select("dt").distinct().collect()]))  # a snapshot has a day or two
    texts = texts.dropDuplicates(["dt", "query_hash"])
    return rows.join(texts, ["dt", "query_hash"], "left")


def list_snapshots(rows: DataFrame) -> DataFrame:
    """Snapshots with the databases they cover."""
    return rows.groupBy("snapshot_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("database").cast("string"))), ",").alias("databases"), F.count("*").alias("n"))


def upsert_anchors(state: DataFrame, sample: DataFrame, key: list[str]) -> DataFrame:
    """The latest row of each key in state and sample; of equal times the sample's, then the largest by its columns."""
    both = state.withColumn("_new", F.lit(0)).unionByName(sample.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    latest = both.groupBy(*key).agg(F.max(F.struct("captured_at", "_new", F.struct(*columns).alias("_row"))).alias("_last"))
    return latest.select(*(F.col(f"_last._row.{c}").alias(c) for c in columns))


def asof(probes: DataFrame, snaps: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """For each probe the value of the newest snapshot at or before it: one union and one running value, no range join.

    Both lie in range partitions by key and time (see ``running_last``), so a key with a third of all rows is many tasks.
    """
    both = snaps.select(*key, ts, F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_probe"), F.lit(None).cast("long").alias("probe_id"))
    none = F.lit(None).cast(both.schema["_v"].dataType).alias("_v")
    both = both.unionByName(probes.select(*key, ts, none, F.lit(1).alias("_probe"), F.col("probe_id").cast("long")))
    found = running_last(both, key, [ts, "_probe", "probe_id"], "_v", "_found").where("_probe = 1")
    return found.select("probe_id", *key, ts, F.col("_found.v").alias(value))


def previous(snaps: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The time of the snapshot right before."""
    return snaps.withColumn("previous_at", F.lag(ts).over(Window.partitionBy(*key).orderBy(ts)))


def retention_by_bytes(days: DataFrame, key: list[str], budget: int, keep_days: int) -> DataFrame:
    """Days to drop: older than the ``keep_days`` newest, while what is newer or as old exceeds the budget."""
    w = Window.partitionBy(*key).orderBy(F.desc("dt"))
    held = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("held", held).withColumn("age", F.row_number().over(w)).where((F.col("held") > budget) & (F.col("age") > keep_days)).select(*key, "dt", "held")


def retention_by_age(days: DataFrame, oldest: str) -> DataFrame:
    """Days before ``oldest``."""
    return days.where(F.col("dt") < F.lit(oldest).cast("date"))


def trigger_events(events: DataFrame, n: int = 50, cluster: str = "", kind: str = "", outcome: str = "", since: str | None = None, before: str | None = None, after: tuple[str, int] | None = None) -> DataFrame:
    """Newest events first, by part of the cluster's name, kind, outcome and time (since, before]; a page has ``n`` rows, 50 unless 1 to 500.

    ``after`` is the (ts, event_id) of the last row seen, so that rows of equal time fall on one page or the next.
    """
    rows = events
    if cluster:
        rows = rows.where(F.contains(F.lower("cluster"), F.lit(cluster.lower())))
    for column, value in (("kind", kind), ("outcome", outcome)):
        if value:
            rows = rows.where(F.col(column) == value)
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if before:
        rows = rows.where(F.col("ts") < F.lit(before).cast("timestamp"))
    if after:
        ts, number = F.lit(after[0]).cast("timestamp"), after[1]
        rows = rows.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") < number)))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n if 0 < n <= 500 else 50)


def trigger_summary(events: DataFrame, key: list[str]) -> DataFrame:
    """Events by kind and outcome."""
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") != "ok").alias("n_failed"), F.max("ts").alias("last_at"))


LOGS = "ts timestamp, severity string, host string, db string, user string, text string, fields map<string,string>"


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S3: log records in JSON lines, as a table or as a stream of new files; lines that don't parse give nulls."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOGS).json(path)


def commit_hot(snapshot: DataFrame, anchors: DataFrame, path: str, version: int) -> None:
    """A snapshot and its anchors, visible together or not at all.

    Both are written to the version's own folder, and the version is entered among the commits last, as one empty file
    whose name is the version; no file is renamed or rewritten. Repeating a version writes it anew, so a retried batch is safe.
    """
    snapshot.write.mode("overwrite").parquet(f"{path}/snapshot/v={version}")
    anchors.write.mode("overwrite").parquet(f"{path}/anchors/v={version}")
    folder, system = _hadoop(snapshot.sparkSession, f"{path}/commits")
    system.mkdirs(folder)
    system.create(_hadoop(snapshot.sparkSession, f"{path}/commits/{version:019d}")[0], True).close()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, whichever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest committed version, by one listing of names; a reader that keeps it sees that version for good."""
    folder, system = _hadoop(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=None)


def read_hot(spark: SparkSession, path: str, part: str, version: int | None = None) -> DataFrame:
    """The ``snapshot`` or ``anchors`` of a committed version, the newest where none is given."""
    version = newest_version(spark, path) if version is None else version
    if version is None:
        raise ValueError("nothing is committed yet")
    return spark.read.parquet(f"{path}/{part}/v={version}")


def commit_stream(samples: DataFrame, key: list[str], path: str, checkpoint: str, report: Callable[[DataFrame, DataFrame], DataFrame]) -> DataStreamWriter:
    """A stream of samples as committed versions: each batch's snapshot, the anchors after it, and its outcome, exactly once.

    The batch's number is its version. ``report`` makes the snapshot from the batch and the anchors before it. A batch that is run again, after
    a failure anywhere between its writes, starts from the anchors of the newest version before its own and writes its own
    version anew; readers follow the commits, so rows of a version that broke off are never seen. The outcome ('ok', 'empty', or 'error'
    with its text) is part of the snapshot's commit; an error commits the anchors unchanged.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder, system = _hadoop(spark, f"{path}/commits")
        names = [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()] if system.exists(folder) else []
        before = max((v for v in names if v < number), default=None)
        anchors = read_hot(spark, path, "anchors", before) if before is not None else batch.limit(0)
        outcome, text = "ok", ""
        try:
            made = report(batch, anchors)
            made.write.mode("overwrite").parquet(f"{path}/report/v={number}")
            found = spark.read.schema(made.schema).parquet(f"{path}/report/v={number}")
            outcome = "empty" if found.isEmpty() else "ok"
        except AnalysisException as e:
            outcome, text = "error", str(e).splitlines()[0][:200]
        moved = upsert_anchors(anchors, batch, key) if outcome != "error" else anchors
        log = spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(outcome).alias("outcome"), F.lit(text).alias("error"))
        commit_hot(log, moved, path, number)

    return samples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(version, outcome, error) of every committed batch, errors and empty reports included."""
    last = newest_version(spark, path)
    log = spark.read.parquet(f"{path}/snapshot").select("version", "outcome", "error")
    folder, system = _hadoop(spark, f"{path}/commits")
    done = [(int(f.getPath().getName()),) for f in system.listStatus(folder) if f.getPath().getName().isdigit() and int(f.getPath().getName()) <= last]
    return log.join(spark.createDataFrame(done, "version long"), "version", "left_semi")
