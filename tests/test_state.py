"""Keyed state, timers and cursors: restarts, late rows, and equality with a plain replay."""

import shutil

from pyspark.sql import Row
from pyspark.sql import functions as F

from attestra.plans.alerts import CLOCK_MIN, versions
from attestra.plans.streams import FAILED_S, GOOD_S, _ask
from attestra.sources.cursor import Timelines
from attestra.streaming.runner import collected
from attestra.streaming.state import alert_lives, remembered, rocksdb, throttled
from tests.compare import of_spark


def in_files(spark, rows, folder, cuts):
    """The rows written as one file for each stretch of time; returns the files' paths in order."""
    out = []
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        path = f"{folder}/part{n}"
        rows.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.parquet(path)
        out.append(path)
    return out


def stream(spark, folder, schema, watermark):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*.parquet").withWatermark("ts", watermark)


def put(parts, folder):
    import glob
    import os

    os.makedirs(folder, exist_ok=True)
    for p in parts:
        for f in glob.glob(f"{p}/*.parquet"):
            shutil.copy(f, f"{folder}/{os.path.basename(os.path.dirname(f))}.parquet")


def test_alerts_go_on_from_the_checkpoint_and_do_not_depend_on_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    parts = in_files(spark, e, str(tmp_path), ["2024-01-01", "2024-01-08", "2024-01-15 13:00:00", "2024-01-24", "2024-03-01"])
    run = lambda folder, place: collected(alert_lives(versions(stream(spark, folder, e.schema, f"{CLOCK_MIN} minutes"))), place=str(tmp_path / place))
    with rocksdb(spark):
        put(parts, f"{tmp_path}/all")
        whole = of_spark(run(f"{tmp_path}/all", "one"))
        put(parts[:2], f"{tmp_path}/some")
        first = of_spark(run(f"{tmp_path}/some", "two"))
        put(parts[2:], f"{tmp_path}/some")
        both = of_spark(run(f"{tmp_path}/some", "two"))
    assert 0 < len(first[1]) < len(whole[1])
    assert both == whole
    from attestra import catalog

    assert whole == of_spark(catalog.queries()["alr04_alert_stream"](spark, sf_dir))
    assert {r[whole[0].index("action")] for r in whole[1]} >= {"CREATE", "UPDATE", "EXPIRE", "RESOLVE", "NO_ACTION", "ESCALATE_LEVEL_1"}


def test_decisions_of_one_row_equal_the_columns(spark):
    """The state machine's decision and the column expression give the same for every combination."""
    from itertools import product

    from attestra.operators.alerting import Alert, decided
    from attestra.plans.alerts import decision

    rows = [Row(rule=r, state=s, severity=v, old_severity=o, confidence=c, old_confidence=b, sources=n, old_sources=2, updated_s=u) for r, s, v, o, c, b, n, u in product(("R", None), (None, "ACTIVE", "ESCALATED", "ACKNOWLEDGED", "RESOLVED", "EXPIRED"), (1, 2), (1, 2), (0.8, 0.9, 0.95), (0.8, 0.85), (2, 3), (699, 700))]
    df = spark.createDataFrame(rows).withColumn("rule_id", F.col("rule")).withColumn("rank", F.col("severity")).withColumn("severity", F.element_at(F.array(F.lit("LOW"), F.lit("MODERATE"), F.lit("HIGH")), (F.col("rank") + 1).cast("int")))
    for r in df.withColumn("got", decision(F.lit(1000))).collect():
        now = Row(rule=r.rule, severity=r["rank"], confidence=r.confidence, sources=r.sources)
        assert r.got == decided(Alert(r.state, r.old_severity, r.old_confidence, r.old_sources, r.updated_s, 9000, 1), now, 1000)


def test_late_and_seen_versions_change_nothing(spark, tmp_path):
    columns = "code string, version long, at_s long, ts timestamp, severity int, confidence double, sources int, review_status string, rule string"
    row = lambda version, at, confidence=0.9, severity=3, sources=2, status="AUTO_PUBLISHED", rule="R": ("e", version, at, severity, confidence, sources, status, rule)
    lots = [
        [row(1, 1000), row(2, 1100, 0.92), row(3, 1200, 0.97), row(4, 1300, 0.97, status="QUARANTINED", sources=9)],
        [row(5, 1150, 0.1), row(6, 1400, 0.99, rule=None), row(7, 1500, 0.99, sources=12), row(8, 1701, 0.5, sources=13)],
        [row(9, 1701 + 3600, 0.9)],
    ]
    for n, lot in enumerate(lots):
        df = spark.createDataFrame([(c, v, a, None, s, f, k, r, u) for c, v, a, s, f, k, r, u in lot], columns).withColumn("ts", F.timestamp_seconds("at_s"))
        df.coalesce(1).write.parquet(f"{tmp_path}/p{n}")
    put([f"{tmp_path}/p{n}" for n in range(3)], f"{tmp_path}/in")
    with rocksdb(spark):
        got = collected(alert_lives(stream(spark, f"{tmp_path}/in", df.schema, "10 hours"))).collect()
    assert [(r["version"], r["class"], r["action"], r["status"], r["alerts"]) for r in sorted(got, key=lambda r: (r["version"] or 8.5))] == [
        (1, "new", "CREATE", "ACTIVE", 1),
        (2, "seen", "NO_ACTION", "ACTIVE", 1),  # 0.02 more than what was acted on
        (3, "updated", "UPDATE", "ACTIVE", 1),
        (4, "updated", "NO_ACTION", "ACTIVE", 1),  # not published, but known from now on
        (5, "late", "NO_ACTION", "ACTIVE", 1),
        (6, "seen", "NO_ACTION", "ACTIVE", 1),
        (7, "updated", "UPDATE", "ACTIVE", 1),
        (8, "updated", "UPDATE", "ACTIVE", 1),
        (None, None, "EXPIRE", "EXPIRED", 1),  # an hour to the second after the last update
        (9, "updated", "NO_ACTION", "EXPIRED", 1),  # within the cooldown
    ]


def test_remembered_answers_equal_a_replay(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).cast("bigint").alias("cell"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"), F.col("ts").cast("timestamp").alias("ts"))
    parts = in_files(spark, e, str(tmp_path), ["2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01"])
    put(parts, f"{tmp_path}/in")
    with rocksdb(spark):
        got = collected(remembered(stream(spark, f"{tmp_path}/in", e.schema, "10 minutes"), _ask, GOOD_S, FAILED_S)).collect()
    want, until, answer = [], -1, None
    for r in sorted(e.collect(), key=lambda r: (r.at_s, r.id)):
        state = ("failed" if answer is None else "hit") if until > r.at_s else "fetch"
        if state == "fetch":
            answer = _ask(r)
            until = r.at_s + (FAILED_S if answer is None else GOOD_S)
        want.append((1, r.id, state, answer))
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[1]) and {w[2] for w in want} == {"hit", "failed", "fetch"}


def test_cursors_bring_each_post_once(spark, tmp_path):
    spark.dataSource.register(Timelines)
    posts, place = f"{tmp_path}/posts", f"{tmp_path}/place"
    write = lambda rows: spark.createDataFrame(rows, "instance string, tag string, id long, account string").write.mode("append").partitionBy("instance", "tag").parquet(posts)
    poll = lambda: sorted((tuple(r) for r in collected(spark.readStream.format("timelines").option("path", posts).load(), place=place).collect()), key=str)
    first = [("a b", "x/y", 9, "u"), ("a b", "x/y", 10, "v"), ("a b", "z", 100, "u"), ("c", "z", 5, None)]
    write(first)
    assert poll() == sorted(first, key=str)
    assert poll() == sorted(first, key=str)  # nothing new
    more = [("a b", "x/y", 11, "w"), ("c", "z", 1000, "u"), ("d", "new", 1, "u")]
    write([*more, ("a b", "z", 99, "under the cursor")])
    assert poll() == sorted(first + more, key=str)
    write([("c", "z", i, "u") for i in range(2000, 2500)])
    assert len(poll()) == len(first + more) + 500


GATES = {"water": (5.0, 6), "thermal": (25.0, 24)}


def _reports(spark, n=260):
    from tests.test_tiles import crowd

    rows = [r for r in crowd(n, 4, 0.4) if r[4] in GATES]
    return spark.createDataFrame(rows, "id long, at_s long, lat double, lng double, family string").withColumn("ts", F.timestamp_seconds("at_s"))


def test_events_do_not_depend_on_arrival_and_go_on_from_the_checkpoint(spark, tmp_path):
    from attestra.operators.spatial import connected
    from attestra.operators.tiles import links
    from attestra.streaming.events import open_events

    point = lambda id_, km: (id_, 5000, 5.0 + km / 111.2, 70.0, "water")
    pairs, bridge = [point(9000, 0), point(9001, 1), point(9010, 8), point(9011, 9)], [point(9005, 4.5)]
    extra = spark.createDataFrame(pairs + bridge, "id long, at_s long, lat double, lng double, family string").withColumn("ts", F.timestamp_seconds("at_s"))
    df = _reports(spark).unionByName(extra).cache()
    want = {r.node: r.root for r in connected(spark, links(df, GATES)).collect()}
    lots = []
    for n in range(5):
        path = f"{tmp_path}/p{n}"
        lot = F.when(F.col("id") == 9005, 4).when(F.col("id") >= 9000, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5)))
        df.where(lot == n).unionByName(df.where(F.col("id") % 40 == n)).coalesce(1).write.parquet(path)  # some come twice
        lots.append(path)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    with rocksdb(spark):
        put(lots[:3], f"{tmp_path}/in")
        first = {r.id: r.event for r in open_events(read(), GATES, f"{tmp_path}/events", 10**7).members().collect()}
        put(lots[3:], f"{tmp_path}/in")
        events = open_events(read(), GATES, f"{tmp_path}/events", 10**7)
    got = {r.id: r.event for r in events.members().collect()}
    assert got == want and first != want and len(got) == events.members().count()
    changes = events.log().collect()
    assert {r.change for r in changes} == {"created", "extended", "merged"}
    assert sum(r.added for r in changes) == len(want)


def test_old_events_close_and_late_reports_are_left_out(spark, tmp_path):
    from attestra.operators.spatial import connected
    from attestra.operators.tiles import links
    from attestra.streaming.events import open_events

    df = _reports(spark).cache()
    want = {r.node: r.root for r in connected(spark, links(df, GATES)).collect()}
    put(in_files(spark, df, str(tmp_path), ["1970-01-01", "1970-01-02", "1970-01-03 07:00:00", "1970-01-05", "1971-01-01"]), f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    with rocksdb(spark):
        events = open_events(read(), GATES, f"{tmp_path}/events", 3600)
        assert {r.id: r.event for r in events.members().collect()} == want
        closed = events._kept("closed", "node bigint, root bigint, at_s bigint").count()
        assert 0 < closed < len(want)
        late = df.where("at_s < 20000").limit(5).withColumn("id", F.col("id") + 10**6)  # beside reports of a day that is over
        late.coalesce(1).write.parquet(f"{tmp_path}/part9")
        put([f"{tmp_path}/part9"], f"{tmp_path}/in")
        assert {r.id: r.event for r in open_events(read(), GATES, f"{tmp_path}/events", 3600).members().collect()} == want


def test_throttled_carries_on_over_a_restart_and_handles_each_once(spark, tmp_path):
    """Seven candidates, three a tick: delivered twice within a day they go out once, after a day again; the queue outlives the run."""
    hour, start = 3600, 1_704_067_200
    row = lambda trigger, event, at: (trigger, event, start - event, start + at, start + at)  # noqa: E731  a larger id is older
    first = [row("a", e, 0) for e in range(7)] + [row("a", e, 0) for e in range(7)] + [row("b", 1, 0)]
    second = [row("a", e, 2 * hour) for e in (0, 6, 9)] + [row("c", 1, 3 * hour)]
    third = [row("a", e, 40 * hour) for e in (2, 3)] + [row("c", 2, 45 * hour)]
    schema = "trigger string, event_id long, opened_s long, at_s long, s long"
    parts = []
    for n, rows in enumerate((first, second, third)):
        path = f"{tmp_path}/part{n}"
        spark.createDataFrame(rows, schema).select("trigger", "event_id", "opened_s", "at_s", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(path)
        parts.append(path)
    kind = spark.read.parquet(parts[0]).schema
    run = lambda folder, place: collected(throttled(stream(spark, folder, kind, "10 minutes"), 3, 300, 24 * hour), place=str(tmp_path / place))
    with rocksdb(spark):
        put(parts, f"{tmp_path}/all")
        whole = of_spark(run(f"{tmp_path}/all", "one"))
        put(parts[:1], f"{tmp_path}/some")
        early = run(f"{tmp_path}/some", "two").count()
        put(parts[1:], f"{tmp_path}/some")
        both_df = run(f"{tmp_path}/some", "two")
        both = of_spark(both_df)
    assert early < len(both[1]) and both == whole
    got = sorted((r.trigger, r.at_s - start, r.event_id) for r in both_df.collect())
    a = [g[1:] for g in got if g[0] == "a"]
    assert a[:3] == [(0, 4), (0, 5), (0, 6)]  # the oldest first
    assert sorted(e for _, e in a) == [0, 1, 2, 2, 3, 3, 4, 5, 6, 9]  # 0 and 6 came again within a day, 2 and 3 after it
    assert all(sum(at == t for t, _ in a) <= 3 for at, _ in a)
    assert [g for g in got if g[0] != "a"] == [("b", 0, 1), ("c", 3 * hour, 1), ("c", 45 * hour, 2)]


def test_throttled_calls_its_state_by_blocks():
    """5,000 candidates delivered twice and some more; each goes out once, oldest first, most a tick, with far fewer calls of the state than candidates."""
    from types import SimpleNamespace

    from attestra.streaming.state import Throttled

    calls = []

    class Held(dict):
        def get(self):
            return dict.get(self, ())

        def update(self, v):
            self[()] = v

        def clear(self):
            calls.append(dict.clear(self))

        def containsKey(self, k):
            calls.append(k)
            return k in self

        def getValue(self, k):
            calls.append(k)
            return dict.get(self, k)

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        def removeKey(self, k):
            calls.append(k)
            del self[k]

    timers, kept = [], {}
    handle = SimpleNamespace(getValueState=lambda name, schema: kept.setdefault(name, Held()), getMapState=lambda name, k, v: kept.setdefault(name, Held()), listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    t = Throttled(50, 300, 86_400)
    t.init(handle)
    row = lambda e, at: SimpleNamespace(trigger="a", event_id=e, opened_s=-(e * 7919 % 5003), at_s=at)
    out = list(t.handleInputRows(("a",), iter([row(e, 0) for e in range(5000)]), None))
    out += t.handleInputRows(("a",), iter([row(e, 100) for e in range(5000)]), None)
    clock = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1000)
    out += t.handleExpiredTimer(("a",), clock(900), None)
    out += t.handleInputRows(("a",), iter([row(e, 1000) for e in range(4990, 5003)]), None)
    out += t.handleExpiredTimer(("a",), clock(40_000), None)
    assert len(out) == 5003 and len(calls) < 1000
    order = sorted(range(5000), key=lambda e: row(e, 0).opened_s) + sorted(range(5000, 5003), key=lambda e: row(e, 0).opened_s)
    assert [(r.event_id, r.tick, r.at_s) for r in out] == [(e, i // 50, i // 50 * 300) for i, e in enumerate(order)]
    out = list(t.handleInputRows(("a",), iter([row(order[0], 90_000), row(order[4999], 90_000)]), None))
    assert [r.event_id for r in out] == [order[0]]  # handled over a day ago; the other at its tick, not yet
    assert not list(t.handleExpiredTimer(("a",), clock(300_000), None))
    assert not kept["value"] and not kept["marks"] and not kept["queue"]
