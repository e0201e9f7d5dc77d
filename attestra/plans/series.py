"""Station series: rolling features, robust baselines and anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.bindings import HOUR, cte, frame
from .registry import query

# Rolling length, least history, z and rate gates, floor of the scale.
ROLLING, LEAST, Z_GATE, FLOOR = 12, 5, 3.5, 0.1
_ORDER = "ORDER BY recorded_s, order_id, line"
_KEYS = ("recorded_s", "order_id", "line")


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a value: a missing one enters no history."""
    return frame(spark, sf_dir, "readings").where("rainfall_mm is not null").select("station", *_KEYS, F.col("rainfall_mm").alias("x"))


def median_of(values: Column) -> Column:
    """The median of an array, its middle two averaged; null for none."""
    n, s = F.size(values), F.sort_array(values)
    low, high = F.element_at(s, F.ceil(n / 2).cast("int")), F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


@query(
    cte("readings")
    + f"SELECT order_id, line, count(x) OVER w AS n, round(avg(x) OVER w, 5) AS mean, round(median(x) OVER w, 5) AS median, round(stddev_pop(x) OVER w, 4) AS std, x - lag(x) OVER o AS delta FROM (SELECT station, recorded_s, order_id, line, rainfall_mm AS x FROM readings WHERE rainfall_mm IS NOT NULL) WINDOW w AS (PARTITION BY station {_ORDER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY station {_ORDER})"
)
def win04_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, median and deviation of the 12 readings before each one, and the step from the last."""
    o = Window.partitionBy("station").orderBy(*_KEYS)
    w = o.rowsBetween(-ROLLING, -1)
    return present(spark, sf_dir).select("order_id", "line", F.count("x").over(w).alias("n"), F.round(F.avg("x").over(w), 5).alias("mean"), F.round(median_of(F.collect_list("x").over(w)), 5).alias("median"), F.round(F.stddev_pop("x").over(w), 4).alias("std"), (F.col("x") - F.lag("x").over(o)).alias("delta"))


@query(cte("readings") + f"SELECT order_id, line, sum(rainfall_mm) OVER (PARTITION BY station ORDER BY recorded_s RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS day_mm FROM readings")
def win05_trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("station").orderBy("recorded_s").rangeBetween(-(24 * HOUR - 1), 0)
    return frame(spark, sf_dir, "readings").select("order_id", "line", F.sum("rainfall_mm").over(w).alias("day_mm"))


@query(
    cte("readings")
    + f", s AS (SELECT station, rainfall_mm AS x FROM readings WHERE rainfall_mm IS NOT NULL), m AS (SELECT station, count(*) AS n, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY 1), d AS (SELECT station, quantile_cont(abs(x - med), 0.5) AS mad FROM s JOIN m USING (station) GROUP BY 1) SELECT station, n, round(med, 5) AS median, round(mad, 5) AS mad, round(greatest(1.4826 * mad, (q3 - q1) / 1.349, {FLOOR}), 5) AS scale FROM m JOIN d USING (station)"
)
def agg25_robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(present(spark, sf_dir)).select("station", "n", F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"), F.round("scale", 5).alias("scale"))


def baseline(rows: DataFrame) -> DataFrame:
    """station, n, median, mad, scale: exact quantiles; the scale is the widest of MAD, quartile span and floor."""
    m = rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(x, array(0.25, 0.5, 0.75))").alias("q"))
    d = rows.join(m.select("station", F.col("q")[1].alias("med")), "station").groupBy("station").agg(F.expr("percentile(abs(x - med), 0.5)").alias("mad"))
    both = m.join(d, "station")
    return both.select("station", "n", F.col("q")[1].alias("median"), "mad", F.greatest(1.4826 * F.col("mad"), (F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(FLOOR)).alias("scale"))


@query(
    cte("readings")
    + f""", s AS (SELECT station, order_id, line, rainfall_mm * (1 + (order_id % 211 = 0)::INT * 9) AS x FROM readings WHERE rainfall_mm IS NOT NULL), m AS (SELECT station, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY 1),
d AS (SELECT station, quantile_cont(abs(x - med), 0.5) AS mad FROM s JOIN m USING (station) GROUP BY 1) SELECT order_id, line, round(abs(x - med) / greatest(1.4826 * mad, (q3 - q1) / 1.349, {FLOOR}), 4) AS z FROM s JOIN m USING (station) JOIN d USING (station) WHERE abs(x - med) / greatest(1.4826 * mad, (q3 - q1) / 1.349, {FLOOR}) >= {Z_GATE}"""
)
def ml04_level_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings far from their station's median (some are made ten times as large)."""
    x = F.col("x") * F.when(F.col("order_id") % 211 == 0, 10).otherwise(1)
    rows = present(spark, sf_dir).withColumn("x", x)
    z = F.abs(F.col("x") - F.col("median")) / F.col("scale")
    return rows.join(baseline(rows), "station").where(z >= Z_GATE).select("order_id", "line", F.round(z, 4).alias("z"))


# Consecutive points that make a deviation persistent and a gap a pattern, and the share by which an interval may differ.
PERSISTENT, MISSING, IRREGULAR = 3, 3, 0.25
#: Some weeks are made ten times as wet, so that deviations last.
_WET = "CASE WHEN recorded_s // 1728000 % 7 = 0 THEN rainfall_mm * 10 ELSE rainfall_mm END"


def islands(readings: DataFrame) -> DataFrame:
    """station, kind, from_s, to_s, points of readings (station, recorded_s, tie, x, z): what lasts, in one sorted pass over each station.

    persistent: PERSISTENT consecutive points or more with z at Z_GATE or above; missing: MISSING consecutive points or more without a
    value; irregular, one row a station: its intervals that differ by more than IRREGULAR from the median one. An interval of 0 is
    none, and a missing point ends a deviation.
    """
    by = Window.partitionBy("station").orderBy("recorded_s", "tie")
    state = F.when(F.col("x").isNull(), "missing").when(F.col("z") >= Z_GATE, "persistent").otherwise("fine")
    rows = readings.withColumn("kind", state).withColumn("same", F.lag("kind").over(by).eqNullSafe(F.col("kind")).cast("int")).withColumn("island", F.sum(1 - F.col("same")).over(by))
    rows = rows.withColumn("gap", F.when(F.col("recorded_s") > F.lag("recorded_s").over(by), F.col("recorded_s") - F.lag("recorded_s").over(by)))
    runs = rows.where("kind <> 'fine'").groupBy("station", "kind", "island").agg(F.min("recorded_s").alias("from_s"), F.max("recorded_s").alias("to_s"), F.count(F.lit(1)).alias("points"))
    long = runs.where(F.col("points") >= F.when(F.col("kind") == "missing", MISSING).otherwise(PERSISTENT)).select("station", "kind", "from_s", "to_s", "points")
    usual = rows.groupBy("station").agg(F.expr("percentile(gap, 0.5)").alias("usual"))
    off = rows.join(usual, "station").where(F.abs(F.col("gap") - F.col("usual")) > IRREGULAR * F.col("usual")).groupBy("station").agg(F.min("recorded_s").alias("from_s"), F.max("recorded_s").alias("to_s"), F.count(F.lit(1)).alias("points"))
    return long.unionByName(off.select("station", F.lit("irregular").alias("kind"), "from_s", "to_s", "points"))


@query(
    cte("readings")
    + f""", r AS (SELECT station, recorded_s, order_id * 10 + line AS tie, {_WET} AS x FROM readings), q AS (SELECT station, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM r WHERE x IS NOT NULL GROUP BY 1),
d AS (SELECT station, quantile_cont(abs(x - med), 0.5) AS mad FROM r JOIN q USING (station) WHERE x IS NOT NULL GROUP BY 1), s AS (SELECT r.*, CASE WHEN x IS NULL THEN 'missing' WHEN abs(x - med) / greatest(1.4826 * mad, (q3 - q1) / 1.349, {FLOOR}) >= {Z_GATE} THEN 'persistent' ELSE 'fine' END AS kind, recorded_s - lag(recorded_s) OVER w AS gap FROM r LEFT JOIN q USING (station) LEFT JOIN d USING (station) WINDOW w AS (PARTITION BY station ORDER BY recorded_s, tie)),
i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY recorded_s, tie) - row_number() OVER (PARTITION BY station, kind ORDER BY recorded_s, tie) AS island FROM s), u AS (SELECT station, quantile_cont(gap, 0.5) AS usual FROM s WHERE gap > 0 GROUP BY 1)
SELECT station, kind, min(recorded_s) AS from_s, max(recorded_s) AS to_s, count(*) AS points FROM i WHERE kind <> 'fine' GROUP BY station, kind, island HAVING count(*) >= CASE kind WHEN 'missing' THEN {MISSING} ELSE {PERSISTENT} END
UNION ALL SELECT station, 'irregular', min(recorded_s), max(recorded_s), count(*) FROM s JOIN u USING (station) WHERE gap > 0 AND abs(gap - usual) > {IRREGULAR} * usual GROUP BY 1"""
)
def ml04_lasting_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations that persist, patterns of missing values, and irregular intervals of each station."""
    r = frame(spark, sf_dir, "readings").selectExpr("station", "recorded_s", "order_id * 10 + line AS tie", _WET.replace("//", "div") + " AS x")
    scale = baseline(r.where("x is not null"))
    return islands(r.join(scale, "station", "left").withColumn("z", F.abs(F.col("x") - F.col("median")) / F.col("scale")).select("station", "recorded_s", "tie", "x", "z"))


@query(cte("readings") + "SELECT station, arg_max(recorded_s, (rainfall_mm, -recorded_s)) AS peak_s, max(rainfall_mm) AS peak FROM readings WHERE rainfall_mm IS NOT NULL GROUP BY 1")
def win10_argmax_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(spark, sf_dir).groupBy("station").agg(F.max_by("recorded_s", F.struct("x", (-F.col("recorded_s")).alias("e"))).alias("peak_s"), F.max("x").alias("peak"))


@query(cte("reports") + "SELECT reporter, min(at_s) AS first_s, arg_min(id, (at_s, id)) AS first_id FROM reports GROUP BY 1")
def win09_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").groupBy("reporter").agg(F.min("at_s").alias("first_s"), F.min_by("id", F.struct("at_s", "id")).alias("first_id"))


def rate_limited(reports: DataFrame, seconds: int, most: int) -> DataFrame:
    """reporter, accepted, rejected: a report (reporter, at_s, id) is accepted if fewer than `most` accepted ones lie within `seconds` before it.

    The rule depends on what it decided before, so a reporter's reports come in order to one task, which keeps the last `most`
    accepted times only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, live, accepted, rejected = None, [], 0, 0
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for reporter, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reporter != name:
                    if name is not None:
                        out.append((name, accepted, rejected))
                    name, live, accepted, rejected = reporter, [], 0, 0
                live = [t for t in live if t > at - seconds]
                if len(live) < most:
                    live.append(at)
                    accepted += 1
                else:
                    rejected += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["reporter", "accepted", "rejected"])
        if name is not None:
            yield pa.RecordBatch.from_pydict({"reporter": [name], "accepted": pa.array([accepted], pa.int64()), "rejected": pa.array([rejected], pa.int64())})

    dealt = reports.where("reporter is not null and at_s is not null").select("reporter", "at_s", "id").repartition("reporter").sortWithinPartitions("reporter", "at_s", "id")
    return dealt.select("reporter", "at_s").mapInArrow(run, "reporter string, accepted bigint, rejected bigint")


@query(
    cte("reports")
    + """, e AS (SELECT reporter, list(at_s ORDER BY at_s, id) AS e FROM reports GROUP BY 1),
f AS (SELECT reporter, len(e) AS n, list_reduce(list_prepend({'live': []::BIGINT[], 'ok': 0::BIGINT, 't': 0::BIGINT}, list_transform(e, lambda t: {'live': []::BIGINT[], 'ok': 0::BIGINT, 't': t})),
  lambda a, x: CASE WHEN len(list_filter(a.live, lambda y: y > x.t - 86400)) < 2 THEN {'live': list_append(list_filter(a.live, lambda y: y > x.t - 86400), x.t), 'ok': a.ok + 1, 't': x.t} ELSE {'live': list_filter(a.live, lambda y: y > x.t - 86400), 'ok': a.ok, 't': x.t} END) AS r FROM e)
SELECT reporter, r.ok AS accepted, n - r.ok AS rejected FROM f"""
)
def stm06_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports a reporter and day are accepted; rejected ones do not count."""
    return rate_limited(frame(spark, sf_dir, "reports"), 86_400, 2)
