"""What runs over a group's time in many tasks, against plain loops: lock trees, greedy choices, as-of, spikes in spans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.graph import lock_tree
from fleetlens.functions.timelines import greedy
from fleetlens.functions.windows import running_last
from fleetlens.operators import series
from fleetlens.sources import snapshots
from fleetlens.streaming import incidents
from fleetlens.streaming.replay import replayed
from fleetlens.streaming.segments import Carry, IncidentConfig, SpikeConfig, Stretch, events_in


@pytest.fixture
def many(spark):
    """Range partitions stay as small as they are dealt, as on large tables."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plain_tree(waits):
    """Level by level: a pid is added below any path that holds all its blockers, unless it stands somewhere already."""
    blockers = {}
    for pid, blocker in waits:
        blockers.setdefault(pid, set()).add(blocker)
    level = [[b] for b in {b for _, b in waits} - set(blockers)]
    paths = {p[-1]: p for p in level}
    while level:
        level = [[*p, pid] for p in level for pid, own in blockers.items() if pid not in paths and own <= set(p)]
        paths |= {p[-1]: p for p in level}
    return {(pid, p[0], len(p) - 1, tuple(p), sum(pid in q[:-1] for q in paths.values())) for pid, p in paths.items()}


def test_lock_trees_with_several_blockers(spark):
    dice, rows, want = random.Random(4), [], set()
    for k in range(40):
        n, waits = dice.randint(2, 9), set()
        for pid in range(1, n):
            kind = dice.random()
            if kind < 0.4:  # a queue: a pid waits for all before it
                own = range(max(0, pid - dice.randint(1, 4)), pid)
            elif kind < 0.8:
                own = dice.sample(range(pid), min(pid, dice.randint(1, 2)))
            else:  # cycles
                own = dice.sample([x for x in range(n) if x != pid], 1)
            waits |= {(pid, b) for b in own}
        rows += [(k, *w) for w in waits]
        want |= {(k, *r) for r in plain_tree(waits)}
    got = lock_tree(spark.createDataFrame(rows, "k int, pid int, blocker int"), ["k"]).collect()
    assert {(r.k, r.pid, r.root, r.level, tuple(r.path), r.blocked) for r in got} == want and len(got) == len(want)


def test_a_chain_of_ten_thousand_waits_and_a_hub(spark):
    chain = spark.range(1, 10_001).selectExpr("0 as k", "id + 1 as pid", "id as blocker")
    assert lock_tree(chain, ["k"], paths=False).where("root <> 1 or level <> pid - 1 or blocked <> 10001 - pid").count() == 0
    hub = lock_tree(spark.range(2, 100_002).selectExpr("0 as k", "id as pid", "1L as blocker"), ["k"])
    assert hub.where("pid = 1").first().blocked == 100_000 and hub.where("level = 1 and root = 1").count() == 100_000


def test_lock_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, pid int, blocker int")
    assert lock_tree(empty, ["k"]).collect() == [] and lock_tree(spark.createDataFrame([(0, 1, None)], empty.schema), ["k"]).collect() == []


def test_greedy_choices_over_many_partitions(many):
    dice = random.Random(8)
    rows, want = [], set()
    for k in range(12):
        t = sorted(dice.sample(range(100_000), 3000 if k == 0 else dice.randint(1, 60)))
        until = [x + dice.choice((0, 1, 50, 700, 40_000)) if k % 2 else x + 333 for x in t]
        rows += [(k, x, u) for x, u in zip(t, until)]
        free = -1
        for x, u in zip(t, until):
            if x >= free:
                want.add((k, x))
                free = max(u, x + 1)
    got = greedy(many.createDataFrame(rows, "k int, t long, until long"), ["k"]).collect()
    assert {(r.k, r.t) for r in got} == want and len(got) == len(want)
    assert greedy(many.createDataFrame([], "k int, t long, until long"), ["k"]).collect() == []


def test_debounce_of_one_host_with_all_rows(many):
    events = many.range(0, 300_000).select(F.lit("h").alias("h"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("k").alias("kind"))
    got = sorted(int(r.ts.timestamp()) for r in incidents.debounce(events, ["h"], 3600).select("ts").collect())
    step = -(-3600 // 7) * 7
    assert got == list(range(0, 300_000 * 7, step))


def test_asof_over_a_hot_key(many):
    dice = random.Random(1)
    snaps = [(k, t, dice.choice((None, t))) for k in (0, 1, None) for t in sorted(dice.sample(range(5000), 900 if k == 0 else 9))]
    probes = [(i, dice.choice((0, 0, 0, 1, 2)), dice.randrange(5000)) for i in range(2000)]
    got = snapshots.asof(many.createDataFrame(probes, "probe_id long, k int, ts long"), many.createDataFrame(snaps, "k int, ts long, v long"), ["k"], "ts", "v").collect()
    for r in got:
        newest = max((s[1] for s in snaps if s[0] == r.k and s[1] <= r.ts), default=None)
        assert r.v == next((s[2] for s in snaps if s[0] == r.k and s[1] == newest), None)
    assert len(got) == len(probes)


def test_previous_rank_and_plan_of_a_hot_object(many):
    tops = many.range(0, 5000).selectExpr("0 as o", "id as day", "cast(id % 100 as int) as rn")
    got = series.previous_rank(tops, ["o"], "day")
    assert got.where("(day = 0 and previous_rank is not null) or (day > 0 and previous_rank <> (day - 1) % 100)").count() == 0
    spread = running_last(tops, ["o"], ["day"], "rn", "x")
    assert spread.where("x <> rn").count() == 0
    parts = tops.repartitionByRange("o", "day").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 2500  # one object lies in many tasks


def samples_of(dice, n):
    t, x = [], 0.0
    for _ in range(n):
        x += 60 if dice.random() < 0.95 else dice.choice((0, 900, 4000, 90_000))
        t.append(x)
    level = dice.choice((1, 10))
    values = [float(max(0, level + (dice.choice((0, 6, 9)) if i // 30 % 3 == 1 else dice.choice((0, 1, -1))))) for i in range(n)]
    pairs = sorted(zip(t, values))
    return [p[0] for p in pairs], [p[1] for p in pairs]


def whole(t, values, spike, incident=None):
    return sorted((e[0], e[2], e[3]) for e in events_in(Stretch(np.array(t), np.array(values), 0, spike), Carry(), incident))


def test_cuts_anywhere_change_no_event():
    dice = random.Random(9)
    for _ in range(300):
        t, values = samples_of(dice, dice.randint(2, 200))
        spike = SpikeConfig(window_s=dice.choice((300, 1800)), percent=dice.choice((20, 50)), duration_s=dice.choice((60, 180)), coverage=0.5, floor=dice.choice((0, 1, 9)), min_gap_s=dice.choice((0, 1200)))
        incident = dice.choice((None, IncidentConfig(dice.choice((0, 60, 300)), dice.choice((0, 90, 900)), dice.choice((0, 600)))))
        carry, got = Carry(), []
        cuts = [0, *sorted(dice.sample(range(1, len(t)), min(3, len(t) - 1))), len(t)]
        for a, b in zip(cuts, cuts[1:]):
            low = int(np.searchsorted(t, t[a] - spike.window_s))
            got += events_in(Stretch(np.array(t[low:b]), np.array(values[low:b]), a - low, spike), carry, incident)
        assert sorted((e[0], e[2], e[3]) for e in got) == whole(t, values, spike, incident)


def test_spans_in_parallel_equal_the_whole_history(spark):
    dice = random.Random(2)
    spike, incident = SpikeConfig(window_s=1800, percent=30, duration_s=120, coverage=0.5, min_gap_s=3600), IncidentConfig(600, 7200, 3600)
    rows, want = [], {}
    for host in "abc":
        t, values = samples_of(dice, 1500 if host == "a" else 200)
        rows += [(host, x, v) for x, v in zip(t, values)]
        want[host] = whole(t, values, spike, incident)
    df = spark.createDataFrame(rows, "instance string, t double, active double").select("instance", F.timestamp_seconds("t").alias("ts"), "active")
    for span in (1800, 7200, 86_400):  # short spans have incidents and follow-ups that last for several
        got = replayed(df, spike, incident, span).collect()
        for host, events in want.items():
            assert sorted((r.kind, r["at"], r.value) for r in got if r.instance == host) == events
    assert sum(map(len, want.values())) > 20
    assert replayed(df.limit(0), spike, incident).collect() == []
    with pytest.raises(ValueError):
        replayed(df, spike, span_s=60)


@pytest.mark.parametrize(("values", "count", "coverage", "peak"), [([14, 15, 8, 12, 17, 9, 13, 11], 1, 0.75, 17), ([14, 15, 8, 7, 9], 0, 0, 0), ([14, 8, 12, 9, 11, 8], 0, 0, 0)])
def test_golden_shapes(values, count, coverage, peak):
    """Saw-tooth, long dip and flapping against a level of 10."""
    # the level before them is so long that the mean stays about 8, the threshold about 10
    t = np.arange(2000 + len(values)) * 30.0
    s = Stretch(t, np.array([8.0] * 2000 + values), 0, SpikeConfig(window_s=1e6, percent=25, duration_s=210, coverage=0.7))
    got = events_in(s, Carry())
    assert len(got) == count
    if count:
        assert (got[0][3], got[0][4]) == (peak, coverage)


def test_range_evaluation_against_a_plain_loop(spark):
    dice = random.Random(6)
    rows = [("t", f"s{dice.randrange(3)}", dice.randrange(0, 4000), dice.choice((None, float(dice.randrange(9)))), i) for i in range(160)]
    df = spark.createDataFrame(rows, "target string, signal string, t long, value double, tie long").withColumn("ts", F.timestamp_seconds("t"))
    start, end, step, back = 600, 3600, 250, 400
    at = lambda t: f"1970-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}"
    want = set()
    for s in {r[1] for r in rows}:
        for t in range(start, end + 1, step):
            seen = [r for r in rows if r[1] == s and t - back < r[2] <= t]
            newest = max(seen, key=lambda r: (r[2], r[4]), default=None)
            if newest and newest[3] is not None:
                want.add((s, t, newest[3]))
    got = snapshots.range_evaluation(df, at(start), at(end), step, back, "tie").collect()
    assert {(r.signal, int(r.ts.timestamp()), r.value) for r in got} == want and len(got) == len(want)
    full = snapshots.range_evaluation(df, at(start), at(end), step, back, "tie", fill=True).collect()
    assert {(r.signal, int(r.ts.timestamp()), r.value) for r in full if r.value is not None} == want and len(full) == 3 * len(range(start, end + 1, step))
    one = snapshots.instant_evaluation(df, at(1100), back, "tie").collect()
    assert {(r.signal, r.value) for r in one} == {(s, v) for s, t, v in want if t == 1100}
    assert snapshots.range_evaluation(df.limit(0), at(start), at(end), step, back, "tie").collect() == []


def test_baselines_add_up_by_day(spark):
    dice = random.Random(7)
    rows = [("t", "s", 3600 * dice.randrange(24 * 28), float(dice.randrange(30)) / 4) for _ in range(3000)]
    df = spark.createDataFrame(rows, "target string, signal string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    day = F.floor(F.col("t") / 86400)
    whole = {(r.how, r.median, r.n) for r in series.seasonal_baseline(df, 100).collect()}
    exact = {(r.how, r.m, r.n) for r in df.groupBy(series.hour_of_week(F.col("ts")).alias("how")).agg(F.median("value").alias("m"), F.count("*").alias("n")).collect()}
    assert whole == exact
    parts = [series.value_counts(df.where((day >= a) & (day < b))) for a, b in ((0, 10), (10, 20), (20, 28))]
    folded = series.fold_counts(series.fold_counts(parts[0], parts[1]), parts[2])
    assert {(r.how, r.median, r.n) for r in series.baseline_from_counts(folded, 100).collect()} == whole
    later = series.fold_counts(parts[0], parts[1], expired=parts[0])
    assert sorted(map(tuple, later.collect())) == sorted(map(tuple, parts[1].select(*later.columns).collect()))
    assert series.baseline_from_counts(parts[0], 10_000).collect() == []


def test_a_timer_brings_the_follow_up_and_state_is_the_window(spark, tmp_path):
    start = 1_700_000_000
    first = [("a", start + 30 * i, v) for i, v in enumerate([10] * 200 + [20] * 12)]
    later = [("b", first[-1][1] + 7200 + 30 * i, 5) for i in range(300)]
    for name, rows in (("1", first), ("2", later), ("3", [("b", later[-1][1] + 30, 5)])):
        df = spark.createDataFrame(rows, "instance string, t long, active long").select("instance", F.timestamp_seconds("t").alias("ts"), "active")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
        events = incidents.incident_stream(stream, SpikeConfig(), IncidentConfig(300, 900, 3600))
        q = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.instance, r.kind): r["at"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {("a", "activity_spike"), ("a", "deferred")} and got["a", "deferred"] == got["a", "activity_spike"] + 900
    state = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "cp"))
    assert state.count() <= 2 * (1800 // 30 + 1)  # of 513 samples
