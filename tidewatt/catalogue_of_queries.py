"""The registered queries over the driver's tables, each with its DuckDB counterpart.

Events stand for points (``sources.points.events_as_points``); customers, nations and regions
for a tree of entities; orders for series of customers, for plans and for receipts. Sums and
means are rounded on both sides, since the order of additions is not fixed; means to eight digits, as ratios
of short decimals are often halves of the last of four.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatt import schemas as S
from tidewatt.errors import ConfigError, ModelError, TidewattError
from tidewatt.functions import floor_to, value_hours
from tidewatt.operators import aggregates as A, catalog as C, fleet, reconcile, revisions as R, rollup as U
from tidewatt.plans import coverage
from tidewatt.schemas import DAY, HOUR, MICROS, Resolution
from tidewatt.sources import files, replay, tsbs, wire, workload
from tidewatt.sources.points import events_as_points, parquet_probe
from tidewatt.store import Config, EngineStore, Transaction, restore_from, salvage_from

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

T0 = 1_704_067_200 * MICROS
MID = T0 + 15 * DAY
GAP = 3 * HOUR
HALF_HOUR = Resolution(micros=HOUR // 2)
SIX_HOURS = Resolution(micros=6 * HOUR)
STHLM_DAY = Resolution(unit="Day", tz="Europe/Stockholm")
STHLM_MONTH = Resolution(unit="Month", tz="Europe/Stockholm")
SAO_PAULO_YEAR = Resolution(unit="Year", tz="America/Sao_Paulo")

POINTS_SQL = f"""
points AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END::BIGINT AS series_id,
  us - ((us % {HOUR} + {HOUR}) % {HOUR}) AS valid_time, us AS knowledge_time, us + event_id % 7 * 60000000 AS change_time, format('{{:032x}}', event_id % 3) AS run_id,
  CAST(value AS DOUBLE) AS value, event_id AS append_seq, us FROM (SELECT *, epoch_us(ts) AS us FROM events))"""
LATEST_SQL = POINTS_SQL + """,
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, valid_time ORDER BY knowledge_time DESC, change_time DESC, append_seq DESC) AS place FROM points) WHERE place = 1)"""
NEXT_SQL = LATEST_SQL + """,
n AS (SELECT *, lead(valid_time) OVER s AS t1, lead(value) OVER s AS v1 FROM w WINDOW s AS (PARTITION BY series_id ORDER BY valid_time))"""
_POINT = "series_id, valid_time, knowledge_time, change_time, run_id, value, append_seq"
_POINT_NAMES = _POINT.split(", ")


def register(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.winners(events_as_points(spark, sf_dir))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at their own times."""
    return events_as_points(spark, sf_dir, valid_step=1)


def _r(name: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(name) if isinstance(name, str) else name, digits)


# --- point queries ---

register("points_history", f"WITH {POINTS_SQL} SELECT {_POINT} FROM points WHERE valid_time >= {T0 + 5 * DAY} AND valid_time < {T0 + 12 * DAY}")(
    lambda spark, d: R.history(events_as_points(spark, d), T0 + 5 * DAY, T0 + 12 * DAY).select(*_POINT_NAMES))
register("points_budgeted", f"WITH {POINTS_SQL} SELECT {_POINT} FROM points WHERE series_id = 2 AND valid_time >= {T0} AND valid_time < {T0 + 3 * DAY}")(
    lambda spark, d: R.budgeted(events_as_points(spark, d), 1_000_000, T0, T0 + 3 * DAY, 2).select(*_POINT_NAMES))
register("points_latest", f"WITH {LATEST_SQL} SELECT {_POINT} FROM w")(lambda spark, d: R.latest(events_as_points(spark, d)).select(*_POINT_NAMES))


def _cut_sql(condition: str, order: str = "knowledge_time DESC, change_time DESC, append_seq DESC") -> str:
    return f"WITH {POINTS_SQL} SELECT {_POINT} FROM (SELECT *, row_number() OVER (PARTITION BY series_id, valid_time ORDER BY {order}) AS place FROM points WHERE {condition}) WHERE place = 1"


register("points_as_of", _cut_sql(f"knowledge_time <= {MID} AND change_time <= {MID}"))(lambda spark, d: R.as_of(events_as_points(spark, d), MID).select(*_POINT_NAMES))
register("points_cutoffs", _cut_sql(f"change_time <= {MID}"))(lambda spark, d: R.with_cutoffs(events_as_points(spark, d), max_change=MID).select(*_POINT_NAMES))
register("points_run", _cut_sql(f"run_id = '{S.hex_id(1)}'", "change_time DESC, knowledge_time DESC, append_seq DESC"))(lambda spark, d: R.of_run(events_as_points(spark, d), S.hex_id(1)).select(*_POINT_NAMES))
register("series_stats", f"WITH {POINTS_SQL} SELECT series_id, count(*) AS revisions, min(valid_time) AS min_valid, max(valid_time) AS max_valid, max(valid_time) AS max_valid_end FROM points GROUP BY 1")(
    lambda spark, d: R.series_stats(events_as_points(spark, d)))
register("latest_per_series", f"WITH {LATEST_SQL} SELECT series_id, arg_max(valid_time, valid_time) AS valid_time, arg_max(value, valid_time) AS value FROM w GROUP BY 1")(
    lambda spark, d: R.latest_per_series(events_as_points(spark, d)).select("series_id", "valid_time", "value"))


@register("plan_vs_actual", f"""WITH {POINTS_SQL},
x AS (SELECT *, row_number() OVER (PARTITION BY run_id, valid_time ORDER BY change_time DESC, knowledge_time DESC, append_seq DESC) AS place FROM points WHERE series_id = 1 AND run_id IN ('{S.hex_id(0)}', '{S.hex_id(1)}')),
p AS (SELECT * FROM x WHERE place = 1 AND run_id = '{S.hex_id(1)}'), a AS (SELECT * FROM x WHERE place = 1 AND run_id = '{S.hex_id(0)}')
SELECT valid_time, p.value AS planned, a.value AS actual, round(a.value - p.value, 4) AS difference FROM p FULL JOIN a USING (valid_time)""")
def plan_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    out = R.plan_vs_actual(events_as_points(spark, d), 1, 1, S.hex_id(1))
    return out.select("valid_time", F.col("planned.value").alias("planned"), F.col("actual.value").alias("actual"), _r("difference").alias("difference"))


# --- aggregates ---



def _gauge_columns() -> list:
    return ["series_id", "count", _r("sum").alias("sum"), "min", "max", "first_ts", "first_value", "last_ts", "last_value", _r(value_hours(F.col("integral")), 3).alias("energy"), "covered",
            _r(F.when(F.col("covered") > 0, F.col("integral") / F.col("covered")), 8).alias("time_weighted_mean"), _r(F.col("sum") / F.col("count"), 8).alias("sample_mean")]


_GAUGE_SQL = f"""WITH {NEXT_SQL}, h AS (SELECT *, CASE WHEN t1 - valid_time <= {GAP} THEN t1 - valid_time ELSE 0 END AS dur FROM n)
SELECT series_id, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, min(valid_time) AS first_ts, arg_min(value, valid_time) AS first_value,
  max(valid_time) AS last_ts, arg_max(value, valid_time) AS last_value, round(sum(value * dur) / 3.6e9, 3) AS energy, CAST(sum(dur) AS BIGINT) AS covered,
  round(CASE WHEN sum(dur) > 0 THEN sum(value * dur) / sum(dur) END, 8) AS time_weighted_mean, round(sum(value) / count(*), 8) AS sample_mean FROM h GROUP BY 1"""
register("gauge_aggregate", _GAUGE_SQL)(lambda spark, d: A.gauge(A.gauge_winners(events_as_points(spark, d), GAP), GAP).select(*_gauge_columns()))
register("gauge_merge", _GAUGE_SQL)(lambda spark, d: A.merge_gauges(A.gauge_states(_winners(spark, d), GAP), GAP).select(*_gauge_columns()))

_STEP_SQL = "CASE WHEN v1 >= value THEN v1 - value WHEN v1 IS NOT NULL THEN greatest(v1, 0) END"
_COUNTER_SQL = f"""WITH {NEXT_SQL} SELECT series_id, count(*) AS count, min(valid_time) AS first_ts, arg_min(value, valid_time) AS first_value, max(valid_time) AS last_ts, arg_max(value, valid_time) AS last_value,
  round(coalesce(sum({_STEP_SQL}), 0), 3) AS positive_delta, CAST(count(*) FILTER (v1 < value) AS BIGINT) AS resets FROM n GROUP BY 1"""
_COUNTER_COLUMNS = ["series_id", "count", "first_ts", "first_value", "last_ts", "last_value"]
register("counter_delta", _COUNTER_SQL)(lambda spark, d: A.counter(_winners(spark, d)).select(*_COUNTER_COLUMNS, _r("positive_delta", 3).alias("positive_delta"), "resets"))
register("counter_merge", _COUNTER_SQL)(lambda spark, d: A.merge_counters(A.counter_states(_winners(spark, d))).select(*_COUNTER_COLUMNS, _r("positive_delta", 3).alias("positive_delta"), "resets"))
register("running_counter", f"""WITH {NEXT_SQL} SELECT series_id, valid_time, round(coalesce(sum({_STEP_SQL}) OVER (PARTITION BY series_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS increase FROM n""")(
    lambda spark, d: A.running_counter(_winners(spark, d)).withColumn("increase", _r("increase", 3)))
@register("interval_total", f"""WITH {LATEST_SQL} SELECT series_id, round(sum(value), 4) AS total, count(*) AS count, CAST(sum(append_seq % 4 * {HOUR // 4}) AS BIGINT) AS spanned FROM w GROUP BY 1""")
def interval_total(spark: SparkSession, d: str) -> DataFrame:
    """Totals of intervals of up to three quarters of an hour."""
    spans = _winners(spark, d).withColumn("valid_time_end", F.col("valid_time") + F.col("append_seq") % 4 * (HOUR // 4))
    return A.interval_totals(spans).withColumn("total", _r("total"))


register("state_duration", f"""WITH {LATEST_SQL}, s AS (SELECT series_id, valid_time, floor(value / 100) AS value FROM w), n AS (SELECT *, lead(valid_time) OVER (PARTITION BY series_id ORDER BY valid_time) AS t1 FROM s)
SELECT series_id, value AS state, count(*) AS reports, CAST(coalesce(sum(t1 - valid_time), 0) AS BIGINT) AS duration, max(valid_time) AS last_seen FROM n GROUP BY 1, 2""")(
    lambda spark, d: A.state_durations(_winners(spark, d).withColumn("value", F.floor(F.col("value") / 100).cast("double"))))
register("event_counts", f"WITH {LATEST_SQL} SELECT series_id, count(*) AS events, min(valid_time) AS first_ts, max(valid_time) AS last_ts FROM w GROUP BY 1")(lambda spark, d: A.event_counts(_winners(spark, d)))


# --- rollups ---

def _bucket_columns() -> list:
    return ["series_id", "bucket_start", "bucket_end", "count", _r("sum").alias("sum"), "min", "max", "first_ts", "first_value", "last_ts", "last_value", _r(value_hours(F.col("integral"))).alias("energy"), "covered"]


def _buckets_sql(source: str, start: str, end: str, steps: str, gap: int = GAP) -> str:
    """``start(t)``, ``end(b)`` and ``steps``: a list of bucket starts from t0 to t1 - 1."""
    return f"""{source},
iv AS (SELECT series_id, value, valid_time AS t0, t1, unnest({steps}) AS b FROM n WHERE t1 - valid_time > 0 AND t1 - valid_time <= {gap}),
u AS (SELECT series_id, {start.format(t='valid_time')} AS b, valid_time AS ts, value AS v, CAST(0 AS BIGINT) AS dur FROM n
  UNION ALL SELECT series_id, b, NULL, value, least(t1, {end.format(b='b')}) - greatest(t0, b) FROM iv)
SELECT series_id, b AS bucket_start, {end.format(b='b')} AS bucket_end, count(ts) AS count, round(coalesce(sum(v) FILTER (ts IS NOT NULL), 0), 4) AS sum, min(v) AS min, max(v) AS max, min(ts) AS first_ts, arg_min(v, ts) FILTER (ts IS NOT NULL) AS first_value,
  max(ts) AS last_ts, arg_max(v, ts) FILTER (ts IS NOT NULL) AS last_value, round(sum(v * dur) / 3.6e9, 4) AS energy, CAST(sum(dur) AS BIGINT) AS covered FROM u GROUP BY series_id, b"""


def _fixed_sql(source: str, width: int, gap: int = GAP) -> str:
    floor = f"({{t}} - (({{t}} % {width} + {width}) % {width}))"
    steps = f"generate_series({floor.format(t='valid_time')}, {floor.format(t='(t1 - 1)')}, {width})"
    return _buckets_sql(source, floor, f"({{b}} + {width})", steps, gap)


def _calendar_sql(source: str, unit: str, tz: str, gap: int) -> str:
    local = f"date_trunc('{unit}', (make_timestamp({{t}}) AT TIME ZONE 'UTC') AT TIME ZONE '{tz}')"
    utc = f"epoch_us({{x}} AT TIME ZONE '{tz}')"
    start = utc.format(x=local)
    steps = f"list_transform(generate_series({local.format(t='valid_time')}, {local.format(t='(t1 - 1)')}, INTERVAL 1 {unit}), lambda x: {utc.format(x='x')})"
    return _buckets_sql(source, start, utc.format(x=f"({local.format(t='{b}')} + INTERVAL 1 {unit})"), steps, gap)


register("gauge_rollup_30m", "WITH " + _fixed_sql(NEXT_SQL, HOUR // 2))(lambda spark, d: U.latest_rollup(events_as_points(spark, d), HALF_HOUR, GAP).select(*_bucket_columns()))
register("gauge_rollup_day_sthlm", "WITH " + _calendar_sql(NEXT_SQL, "day", "Europe/Stockholm", 26 * HOUR))(lambda spark, d: U.latest_rollup(events_as_points(spark, d), STHLM_DAY, 26 * HOUR).select(*_bucket_columns()))
register("gauge_rollup_month_sthlm", "WITH " + _calendar_sql(NEXT_SQL, "month", "Europe/Stockholm", GAP))(lambda spark, d: U.latest_rollup(events_as_points(spark, d), STHLM_MONTH, GAP).select(*_bucket_columns()))
register("gauge_rollup_year_sao_paulo", "WITH " + _calendar_sql(NEXT_SQL, "year", "America/Sao_Paulo", GAP))(lambda spark, d: U.latest_rollup(events_as_points(spark, d), SAO_PAULO_YEAR, GAP).select(*_bucket_columns()))
_RANGE_SQL = NEXT_SQL.replace("FROM points) WHERE place = 1", f"FROM points WHERE valid_time >= {T0 + 3 * DAY} AND valid_time < {T0 + 6 * DAY}) WHERE place = 1")
register("rollup_gauge_range", "WITH " + _fixed_sql(_RANGE_SQL, HOUR // 2))(lambda spark, d: U.rollup_gauge(events_as_points(spark, d), T0 + 3 * DAY, T0 + 6 * DAY, HALF_HOUR, GAP).select(*_bucket_columns()))
register("gauge_coarsen_6h", "WITH " + _fixed_sql(NEXT_SQL, 6 * HOUR))(lambda spark, d: U.coarsen(U.latest_rollup(events_as_points(spark, d), HALF_HOUR, GAP), SIX_HOURS).select(*_bucket_columns()))
register("counter_rollup_day", f"""WITH {NEXT_SQL} SELECT series_id, valid_time - valid_time % {DAY} AS bucket_start, valid_time - valid_time % {DAY} + {DAY} AS bucket_end, count(*) AS count, round(coalesce(sum({_STEP_SQL}), 0), 3) AS positive_delta,
  CAST(count(*) FILTER (v1 < value) AS BIGINT) AS resets FROM n GROUP BY 1, 2, 3""")(
    lambda spark, d: U.counter_rollup(_winners(spark, d), Resolution(micros=DAY)).select("series_id", "bucket_start", "bucket_end", "count", _r("positive_delta", 3).alias("positive_delta"), "resets"))


# --- harness shapes ---

_STATS_SQL = "count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", _r("sum"))


def _at(width: int, anchor) -> str:
    return f"us - ((us - {anchor}) % {width} + {width}) % {width}"


register("day_aggregate", f"WITH {POINTS_SQL} SELECT series_id, us - us % {DAY} AS bucket_start, {_STATS_SQL} FROM points GROUP BY 1, 2")(lambda spark, d: _rounded(U.anchored(_instants(spark, d), DAY, 0)))
register("five_minute_groups", f"WITH {POINTS_SQL} SELECT series_id, CAST((us - {T0}) // 300000000 AS BIGINT) AS slot, count(*) AS count, round(sum(value), 4) AS sum FROM points GROUP BY 1, 2")(
    lambda spark, d: _rounded(_instants(spark, d).groupBy("series_id", ((floor_to(F.col("valid_time"), 300 * MICROS, T0) - T0) / (300 * MICROS)).cast("long").alias("slot")).agg(F.count("*").alias("count"), F.sum("value").alias("sum"))))
_ODD = T0 + 7 * MICROS
register("anchored_5m", f"WITH {POINTS_SQL} SELECT series_id, {_at(300 * MICROS, _ODD)} AS bucket_start, {_STATS_SQL} FROM points GROUP BY 1, 2")(lambda spark, d: _rounded(U.anchored(_instants(spark, d), 300 * MICROS, _ODD)))
register("sample_by_first", f"WITH {POINTS_SQL}, f AS (SELECT series_id, min(us) AS a FROM points GROUP BY 1) SELECT series_id, {_at(300 * MICROS, 'a')} AS bucket_start, {_STATS_SQL} FROM points JOIN f USING (series_id) GROUP BY 1, 2")(
    lambda spark, d: _rounded(U.anchored_at_first(_instants(spark, d), 300 * MICROS)))
register("over_time_5m", f"WITH {POINTS_SQL} SELECT series_id, {_at(300 * MICROS, T0)} + {300 * MICROS} AS step_end, {_STATS_SQL} FROM points GROUP BY 1, 2")(
    lambda spark, d: _rounded(U.anchored(_instants(spark, d), 300 * MICROS, T0)).select("series_id", (F.col("bucket_start") + 300 * MICROS).alias("step_end"), "count", "sum", "min", "max"))
register("count_24h", f"WITH {POINTS_SQL} SELECT count(*) AS samples FROM points WHERE us >= {MID} AND us < {MID + DAY}")(lambda spark, d: R.in_range(_instants(spark, d), MID, MID + DAY).agg(F.count("*").alias("samples")))
register("parquet_probe", "SELECT count(l_quantity) AS count, round(sum(l_quantity), 4) AS sum FROM lineitem")(lambda spark, d: _rounded(parquet_probe(spark, f"{d}/lineitem.parquet", "l_quantity")))
register("parquet_probe_key", "SELECT count(l_quantity) AS count, round(sum(l_quantity), 4) AS sum FROM lineitem WHERE l_returnflag = 'R'")(lambda spark, d: _rounded(parquet_probe(spark, f"{d}/lineitem.parquet", "l_quantity", "l_returnflag", "R")))
register("segment_index", f"WITH {POINTS_SQL} SELECT series_id, us - us % {DAY} AS day, count(*) AS points, min(us) AS low, max(us) AS high FROM points GROUP BY 1, 2")(
    lambda spark, d: _instants(spark, d).groupBy("series_id", floor_to(F.col("valid_time"), DAY).alias("day")).agg(F.count("*").alias("points"), F.min("valid_time").alias("low"), F.max("valid_time").alias("high")))


# --- planning ---

def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour descriptors of every third UTC day of each series."""
    days = events_as_points(spark, d).select("series_id", floor_to(F.col("valid_time"), DAY).alias("start")).distinct().where(((F.col("start") - T0) / DAY).cast("long") % 3 == 0)
    return days.select("series_id", F.lit(HALF_HOUR.key).alias("resolution_key"), "start", (F.col("start") + DAY).alias("end"), F.lit(0).cast("long").alias("source_points"), F.lit("x").alias("path"))


_DESCRIPTORS_SQL = POINTS_SQL + f", d AS (SELECT DISTINCT series_id, valid_time - valid_time % {DAY} AS s FROM points WHERE (valid_time - valid_time % {DAY} - {T0}) // {DAY} % 3 = 0)"


@register("needed_shards", f"""WITH {_DESCRIPTORS_SQL}, b AS (SELECT series_id, min(valid_time) AS low, max(valid_time) AS high FROM points GROUP BY 1),
x AS (SELECT series_id, unnest(generate_series(low - low % {DAY}, high - high % {DAY}, {DAY})) AS s FROM b)
SELECT series_id, s AS start, s + {DAY} AS "end" FROM x ANTI JOIN d USING (series_id, s) WHERE s + {DAY} <= {T0 + 28 * DAY} AND s + {DAY} >= {T0 + 28 * DAY - 20 * DAY}""")
def needed_shards(spark: SparkSession, d: str) -> DataFrame:
    bounds = R.series_stats(events_as_points(spark, d)).select("series_id", F.col("min_valid").alias("low"), F.col("max_valid").alias("high"), F.lit(20 * DAY).alias("retain"))
    return coverage.needed(bounds, _descriptors(spark, d), HALF_HOUR, T0 + 28 * DAY)


@register("dirty_shards", f"""WITH {_DESCRIPTORS_SQL}, l AS (SELECT DISTINCT series_id, valid_time FROM points WHERE append_seq % 40 = 0)
SELECT DISTINCT d.series_id, d.s AS start, d.s + {DAY} AS "end" FROM d JOIN l ON d.series_id = l.series_id AND l.valid_time >= d.s - {GAP} AND l.valid_time <= d.s + {DAY}""")
def dirty_shards(spark: SparkSession, d: str) -> DataFrame:
    late = events_as_points(spark, d).where("append_seq % 40 = 0")
    gaps = events_as_points(spark, d).select("series_id").distinct().withColumn("gap", F.lit(GAP).cast("long"))
    return coverage.dirty(late, _descriptors(spark, d), gaps).select("series_id", "start", "end")


@register("retention_gates", f"""WITH {_DESCRIPTORS_SQL}, s AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS series_id),
b AS (SELECT series_id, min(valid_time) AS low FROM points GROUP BY 1), c AS (SELECT s.series_id, low, {T0 + 40 * DAY} - CASE s.series_id WHEN 1 THEN {60 * DAY} ELSE {25 * DAY} END AS cut FROM s LEFT JOIN b ON s.series_id = b.series_id)
SELECT CAST(series_id AS BIGINT) AS series_id, CAST(cut AS BIGINT) AS raw_before, low IS NULL OR low >= cut OR series_id = 4 AS eligible,
  CASE WHEN low IS NULL THEN 'no raw points exist' WHEN low >= cut THEN 'no raw points are older than the cutoff' WHEN series_id = 3 THEN 'raw retention requires at least one durable rollup tier'
    WHEN series_id = 4 THEN 'all configured durable rollup tiers cover the deletion range' ELSE 'durable current {HALF_HOUR.key} rollup does not cover raw data through the cutoff' END AS reason FROM c""")
def retention_gates(spark: SparkSession, d: str) -> DataFrame:
    tier = ((HALF_HOUR.row()), None)
    rows = [(k, S.hex_id(1), None, f"s{k}", "power", "W", "Gauge", GAP, ((60 if k == 1 else 25) * DAY, [] if k == 3 else [tier])) for k in range(1, 7)]
    bounds = events_as_points(spark, d).groupBy("series_id").agg(F.min("valid_time").alias("low"))
    whole = spark.range(0, 40).select(F.lit(4).cast("long").alias("series_id"), F.lit(HALF_HOUR.key).alias("resolution_key"), (F.col("id") * DAY + T0).alias("start"), (F.col("id") * DAY + T0 + DAY).alias("end"), F.lit(0).cast("long").alias("source_points"), F.lit("x").alias("path"))
    return coverage.retention_gates(spark.createDataFrame(rows, S.SERIES), bounds, _descriptors(spark, d).where("series_id != 4").unionByName(whole), T0 + 40 * DAY)


@register("range_overlap", f"""WITH {POINTS_SQL}, a AS (SELECT series_id, valid_time - valid_time % {DAY} AS day, min(valid_time) AS s, max(valid_time) + 1 AS e FROM points GROUP BY 1, 2),
w AS (SELECT unnest(generate_series({T0}, {T0 + 28 * DAY}, {7 * DAY})) + {DAY // 2} AS ws) SELECT ws AS window_start, count(*) AS segments FROM w JOIN a ON s < ws + {2 * DAY} AND ws < e GROUP BY 1""")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    segments = events_as_points(spark, d).groupBy("series_id", floor_to(F.col("valid_time"), DAY).alias("day")).agg(F.min("valid_time").alias("s"), (F.max("valid_time") + 1).alias("e"))
    windows = spark.range(5).select((F.col("id") * 7 * DAY + T0 + DAY // 2).alias("window_start"))  # five rows
    return F.broadcast(windows).join(segments, (F.col("s") < F.col("window_start") + 2 * DAY) & (F.col("window_start") < F.col("e"))).groupBy("window_start").agg(F.count("*").alias("segments"))


# --- catalogue ---

def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as entities; every fortieth customer's parent is missing."""
    def name(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind + "-"), F.col(key).cast("string"))

    regions = _table(spark, d, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nations = _table(spark, d, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))
    parent = F.when(F.col("c_custkey") % 40 == 0, F.lit("n-999")).otherwise(name("n", "c_nationkey"))
    return regions.unionByName(nations).unionByName(_table(spark, d, "customer").select(name("c", "c_custkey").alias("id"), parent.alias("parent")))


_TREE_SQL = """e AS (SELECT 'r-' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey FROM nation
  UNION ALL SELECT 'c-' || c_custkey, CASE WHEN c_custkey % 40 = 0 THEN 'n-999' ELSE 'n-' || c_nationkey END FROM customer)"""
register("catalog_orphans", f"WITH {_TREE_SQL} SELECT 'entity parent is missing' AS rule, id AS object FROM e WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM e)")(
    lambda spark, d: C.missing(_tree(spark, d), "parent", _tree(spark, d), "entity parent is missing"))
register("topological_levels", f"WITH RECURSIVE {_TREE_SQL}, l AS (SELECT id, 0 AS level FROM e WHERE parent IS NULL OR parent NOT IN (SELECT id FROM e) UNION ALL SELECT e.id, l.level + 1 FROM e JOIN l ON e.parent = l.id) SELECT id, level FROM l")(
    lambda spark, d: C.levels(_tree(spark, d).select("id", F.col("parent").alias("ref")), _tree(spark, d)))
register("catalog_listing", f"WITH {_TREE_SQL} SELECT id, parent FROM e")(lambda spark, d: C.listing(_tree(spark, d)))
register("catalog_lookup", f"WITH {_TREE_SQL} SELECT id, parent FROM e WHERE id = 'n-7'")(lambda spark, d: C.lookup(_tree(spark, d), "n-7"))
register("catalog_counts", "SELECT 'customer' AS kind, count(*) AS objects FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")(
    lambda spark, d: C.counts({n: _table(spark, d, n) for n in ("customer", "nation", "region")}))
register("upserts_last_win", "SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")(
    lambda spark, d: C.last_wins(_table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("commit_seq"))))


@register("reference_cycles", """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 < 7 THEN c_custkey - c_custkey % 50 + (c_custkey % 50 * 3 + c_nationkey) % 50 ELSE c_custkey - 1 - c_nationkey % 3 END AS ref FROM customer),
w AS (SELECT id, ref AS at, 1 AS steps FROM c WHERE ref IN (SELECT id FROM c) UNION ALL SELECT w.id, c.ref, steps + 1 FROM w JOIN c ON c.id = w.at WHERE c.ref IN (SELECT id FROM c) AND steps < 60)
SELECT 'customers in a circle' AS rule, CAST(id AS VARCHAR) AS object FROM w WHERE steps = 60""")
def reference_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Customers refer to others of their fifty: some in circles, some into them, the rest in chains that end. The SQL
    walks on from each: who has gone sixty steps among fifty has been somewhere twice, and never ends."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    ref = F.when(key % 50 < 7, key - key % 50 + (key % 50 * 3 + nation) % 50).otherwise(key - 1 - nation % 3)
    customers = _table(spark, d, "customer").select(key.alias("id"), ref.alias("ref"))
    return C.cycles(customers, customers, "customers in a circle")


_STATUS = "CASE {k} % 5 WHEN 0 THEN 'Candidate' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Deployed' WHEN 3 THEN 'Superseded' ELSE 'Cancelled' END"


@register("plan_transitions", f"""WITH t AS (SELECT o_orderkey AS k, {_STATUS.format(k='o_orderkey')} AS a, {_STATUS.format(k='(o_orderkey // 5 + o_custkey)')} AS b FROM orders)
SELECT 'plan status cannot follow' AS rule, printf('%032x', k) AS object FROM t WHERE a <> b AND (a || b) NOT IN ('CandidateApproved', 'CandidateCancelled', 'CandidateSuperseded', 'ApprovedDeployed', 'ApprovedCancelled', 'ApprovedSuperseded', 'DeployedSuperseded')
UNION ALL SELECT 'plan identity changed', printf('%032x', k) FROM t WHERE k % 11 = 0""")
def plan_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plans before and after an update."""
    orders = _table(spark, d, "orders")
    names = F.array(*[F.lit(s) for s in ("Candidate", "Approved", "Deployed", "Superseded", "Cancelled")])
    key = F.lpad(F.lower(F.hex("o_orderkey")), 32, "0")

    def plans(status: Column, scenario: Column) -> DataFrame:
        values = {"id": key, "run_id": F.lit(S.hex_id(1)), "status": F.get(names, (status % 5).cast("int")), "horizon_start": F.lit(0).cast("long"), "horizon_end": F.lit(DAY), "resolution_micros": F.lit(HOUR), "scenario": scenario}
        return orders.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.PLANS.fields])

    old = plans(F.col("o_orderkey"), F.lit("base"))
    new = plans(F.floor(F.col("o_orderkey") / 5) + F.col("o_custkey"), F.when(F.col("o_orderkey") % 11 == 0, "other").otherwise("base"))
    none = C.empty_catalog(spark)
    return C.transition_rules(none | {"plans": old}, none | {"plans": new})


@register("catalog_rules", "SELECT 'entity kind is blank' AS rule, 'c-' || c_custkey AS object FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'entity validity is empty', 'c-' || c_custkey FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'entity is its own parent', 'c-' || c_custkey FROM customer WHERE c_custkey % 13 = 0")
def catalog_rules(spark: SparkSession, d: str) -> DataFrame:
    key, ident = F.col("c_custkey"), F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))
    values = {"id": ident, "kind": F.when(key % 9 == 0, " ").otherwise("site"), "name": F.col("c_name"), "parent": F.when(key % 13 == 0, ident), "valid_from": F.lit(5).cast("long"), "valid_to": F.when(key % 7 == 0, 5).otherwise(9)}
    entities = _table(spark, d, "customer").select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.ENTITIES.fields])
    return C.self_rules(C.empty_catalog(spark) | {"entities": entities})


@register("point_rules", f"""WITH {POINTS_SQL} SELECT 'point ends before it starts' AS rule, CAST(series_id AS VARCHAR) AS object FROM points WHERE append_seq % 50 = 0 UNION ALL SELECT 'point value is not finite', CAST(series_id AS VARCHAR) FROM points WHERE append_seq % 70 = 0
UNION ALL SELECT 'point series is not defined', '5' UNION ALL SELECT 'point run is not defined', '{S.hex_id(2)}'""")
def point_rules(spark: SparkSession, d: str) -> DataFrame:
    points = events_as_points(spark, d).withColumn("valid_time_end", F.when(F.col("append_seq") % 50 == 0, F.col("valid_time") - 1).otherwise(F.col("valid_time"))).withColumn("value", F.when(F.col("append_seq") % 70 == 0, float("nan")).otherwise(F.col("value")))
    series = spark.createDataFrame([(k,) for k in range(1, 5)], "id long")
    return C.point_rules(points, series, spark.createDataFrame([(S.hex_id(1),)], "id string"))


# --- reconciliation and ingress ---

def _stored(points: DataFrame) -> DataFrame:
    """What arrived: every fiftieth point lost, every seventieth twice, some values changed."""
    kept = points.where("append_seq % 50 != 0").withColumn("value", F.when(F.col("append_seq") % 90 == 1, F.col("value") + 1).otherwise(F.col("value")))
    return kept.unionByName(kept.where("append_seq % 70 = 0"))


_SIDES_SQL = POINTS_SQL + """, e AS (SELECT series_id, valid_time, knowledge_time, change_time, run_id, CAST(value AS VARCHAR) AS value FROM points),
k AS (SELECT series_id, valid_time, knowledge_time, change_time, run_id, CASE WHEN append_seq % 90 = 1 THEN value + 1 ELSE value END AS value, append_seq FROM points WHERE append_seq % 50 <> 0),
s AS (SELECT series_id, valid_time, knowledge_time, change_time, run_id, CAST(value AS VARCHAR) AS value FROM k UNION ALL SELECT series_id, valid_time, knowledge_time, change_time, run_id, CAST(value AS VARCHAR) FROM k WHERE append_seq % 70 = 0)"""
register("reconcile_points", f"""WITH {_SIDES_SQL} SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM (SELECT * FROM e INTERSECT ALL SELECT * FROM s)) AS matched,
  (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM s)) AS missing, (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM e)) AS unexpected""")(
    lambda spark, d: reconcile.point_counts(reconcile.compare_points(events_as_points(spark, d), _stored(events_as_points(spark, d)))))


@register("reconcile_catalog", """WITH own AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer),
supplied AS (SELECT *, 2 AS seq FROM own UNION ALL SELECT id, 'older', balance, 1 FROM own), last AS (SELECT id, arg_max(name, seq) AS name, arg_max(balance, seq) AS balance FROM supplied GROUP BY 1),
stored AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'changed' ELSE name END AS name, balance FROM own WHERE id % 10 <> 0)
SELECT last.id, CASE WHEN stored.id IS NULL THEN 'missing' WHEN last.name IS DISTINCT FROM stored.name OR last.balance IS DISTINCT FROM stored.balance THEN 'different' ELSE 'match' END AS outcome FROM last LEFT JOIN stored ON last.id = stored.id""")
def reconcile_catalog(spark: SparkSession, d: str) -> DataFrame:
    own = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    supplied = own.withColumn("commit_seq", F.lit(2)).unionByName(own.withColumn("name", F.lit("older")).withColumn("commit_seq", F.lit(1)))
    stored = own.where("id % 10 != 0").withColumn("name", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("name")))
    return reconcile.compare_catalog(supplied, stored)


@register("reconcile_receipts", """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS source_id, o_orderkey AS sequence, printf('%X', o_orderkey) AS commit_id, 1 AS records, o_custkey AS points, sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders),
s AS (SELECT source_id, sequence, CASE WHEN sequence % 11 = 0 THEN 'other' ELSE commit_id END AS commit_id, records, CASE WHEN sequence % 13 = 0 THEN -1 ELSE points END AS points, CASE WHEN sequence % 17 = 0 THEN 'x' ELSE sha END AS sha FROM e WHERE sequence % 10 <> 0)
SELECT e.source_id, e.sequence, CASE WHEN s.sequence IS NULL THEN 'missing' WHEN s.commit_id <> e.commit_id THEN 'commit conflict' WHEN s.records <> e.records OR s.points <> e.points THEN 'shape mismatch' WHEN s.sha <> e.sha THEN 'payload mismatch'
  WHEN e.sequence > 500 THEN 'not durable' ELSE 'match' END AS outcome FROM e LEFT JOIN s ON e.source_id = s.source_id AND e.sequence = s.sequence""")
def reconcile_receipts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    expected = _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source_id"), key.alias("sequence"), F.hex(key).alias("commit_id"), F.lit(1).cast("long").alias("records"), F.col("o_custkey").alias("points"), F.sha2(key.cast("string"), 256).alias("payload_sha"))
    n = F.col("sequence")
    stored = expected.where("sequence % 10 != 0").withColumn("commit_id", F.when(n % 11 == 0, "other").otherwise(F.col("commit_id"))).withColumn("points", F.when(n % 13 == 0, -1).otherwise(F.col("points"))).withColumn("payload_sha", F.when(n % 17 == 0, "x").otherwise(F.col("payload_sha")))
    return reconcile.compare_receipts(expected, stored, expected.select("source_id").distinct().withColumn("durable", F.lit(500)))


# --- fleets ---

@register("fleet_rollup", """SELECT r_name AS region, year(o_orderdate) * 100 + month(o_orderdate) AS month, count(*) AS points, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS min, max(o_totalprice) AS max
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def fleet_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Points of all series below each top entity, by month: partial sums per customer first, so
    that only (customer, month) rows meet the dimension tables."""
    own = _table(spark, d, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    tree = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # fixed size
    joined = own.join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(tree), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("r_name").alias("region"), "month").agg(F.sum("n").alias("points"), _r(F.sum("s"), 2).alias("total"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("vehicle"), F.col("event_type").alias("fleet"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"))


_READINGS_SQL = "r AS (SELECT user_id AS vehicle, event_type AS fleet, epoch_us(ts) AS ts, CAST(value AS DOUBLE) AS value, event_id AS seq FROM events)"
_SLOTS_SQL = _READINGS_SQL + f", a AS (SELECT vehicle, fleet, ts - ts % {HOUR} AS slot, sum(value) / count(value) AS mean FROM r GROUP BY 1, 2, 3 HAVING sum(value) / count(value) > 30)"
register("fleet_last_reading", f"WITH {_READINGS_SQL} SELECT vehicle, fleet, max(ts) AS ts, arg_max(value, row(ts, seq)) AS value FROM r GROUP BY 1, 2")(lambda spark, d: fleet.last_reading(_readings(spark, d)))
register("fleet_low_level", f"WITH {_READINGS_SQL}, l AS (SELECT vehicle, fleet, max(ts) AS ts, arg_max(value, row(ts, seq)) AS value FROM r GROUP BY 1, 2) SELECT * FROM l WHERE value < 20")(lambda spark, d: fleet.below(_readings(spark, d), 20))
register("fleet_stationary", f"WITH {_READINGS_SQL} SELECT vehicle, fleet, round(sum(value) / count(value), 8) AS mean FROM r WHERE ts >= {T0} AND ts < {T0 + 10 * DAY} GROUP BY 1, 2 HAVING sum(value) / count(value) < 40")(
    lambda spark, d: fleet.stationary(_readings(spark, d), T0, T0 + 10 * DAY, 40).withColumn("mean", _r("mean", 8)))
register("fleet_long_sessions", f"WITH {_SLOTS_SQL.replace('FROM r GROUP', f'FROM r WHERE ts >= {T0} AND ts < {T0 + 20 * DAY} GROUP')} SELECT vehicle, fleet, count(*) AS slots FROM a GROUP BY 1, 2 HAVING count(*) > 3")(
    lambda spark, d: fleet.long_sessions(_readings(spark, d), T0, T0 + 20 * DAY, HOUR, 30, 3))
register("fleet_daily_activity", f"WITH {_SLOTS_SQL} SELECT fleet, slot - slot % {DAY} AS day, count(*) AS slots FROM a GROUP BY 1, 2")(lambda spark, d: fleet.daily_activity(_readings(spark, d), HOUR, 30))
register("fleet_daily_duration", f"WITH {_SLOTS_SQL}, x AS (SELECT vehicle, fleet, slot - slot % {DAY} AS day, count(*) AS slots FROM a GROUP BY 1, 2, 3) SELECT vehicle, fleet, round(sum(slots) / count(*), 8) AS mean_slots FROM x GROUP BY 1, 2")(
    lambda spark, d: fleet.mean_daily_duration(_readings(spark, d), HOUR, 30).withColumn("mean_slots", _r("mean_slots", 8)))
register("fleet_breakdowns", f"WITH {_READINGS_SQL}, x AS (SELECT *, lag(value) OVER (PARTITION BY vehicle ORDER BY ts, seq) AS b FROM r) SELECT fleet, CAST(count(*) FILTER (b >= 50 AND value < 50) AS BIGINT) AS breakdowns FROM x GROUP BY 1")(
    lambda spark, d: fleet.breakdowns(_readings(spark, d), 50))
register("fleet_mean", f"WITH {_READINGS_SQL} SELECT fleet, ts - ts % {DAY} AS day, round(sum(value) / count(value), 8) AS mean FROM r GROUP BY 1, 2")(lambda spark, d: fleet.mean_by_fleet(_readings(spark, d)).withColumn("mean", _r("mean", 8)))


# --- the store ---

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a local one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewatt-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _define(store: EngineStore, raw_days: int | None = None) -> None:
    policy = (raw_days * DAY if raw_days else None, [(HALF_HOUR.row(), None)])
    tx = Transaction().upsert("entities", {"id": S.hex_id(1), "kind": "site", "name": "site", "valid_from": 0})
    tx.upsert("series", *[{"id": k, "owner_entity": S.hex_id(1), "name": f"s{k}", "physical_quantity": "power", "canonical_unit": "W", "semantics": "Gauge", "maximum_gap_micros": GAP, "rollup_policy": policy} for k in range(1, 6)])
    tx.upsert("runs", *[{"id": S.hex_id(k), "kind": "Forecast", "status": "Succeeded", "created_at": 0, "knowledge_time": 0, "workflow": "w", "model": "m", "model_version": "1"} for k in (1, 2)])
    store.commit(tx)


_STORE_SQL = "WITH " + _fixed_sql(NEXT_SQL, HOUR // 2)


@register("store_hybrid_gauge", f"SELECT * FROM ({_STORE_SQL}) WHERE series_id = 1 AND bucket_start >= {T0 + 2 * DAY} AND bucket_start < {T0 + 20 * DAY}")
def store_hybrid_gauge(spark: SparkSession, d: str) -> DataFrame:
    """Load, maintain, load late points, seal, and query: stored buckets where they still hold."""
    points = events_as_points(spark, d)
    with EngineStore.open(spark, _folder(spark, "store")) as store:
        _define(store)
        store.append(points.where("append_seq % 500 != 3"))
        store.maintain(T0 + 15 * DAY)
        store.append(points.where("append_seq % 500 = 3"))
        store.seal()
        return store.query_gauge(1, T0 + 2 * DAY, T0 + 20 * DAY, HALF_HOUR).buckets.select(*_bucket_columns())


@register("store_materialized_gauge", f"SELECT * FROM ({_STORE_SQL}) WHERE bucket_start >= {T0 + DAY} AND bucket_start < {T0 + 10 * DAY}")
def store_materialized_gauge(spark: SparkSession, d: str) -> DataFrame:
    """All series' stored buckets, as maintenance wrote them."""
    with EngineStore.open(spark, _folder(spark, "store")) as store:
        _define(store)
        store.append(events_as_points(spark, d))
        store.maintain(T0 + 12 * DAY)
        return U.fixed_range(store.buckets(), T0 + DAY, T0 + 10 * DAY).select(*_bucket_columns())


#: Points of a frame: as many as the frame's bounds hold, at 320 bytes of escaped JSON a point at most.
FRAME_POINTS = min(wire.MAX_POINTS, wire.MAX_FRAME_BYTES // 320)


def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    """All events streamed in as frames of one source, the first frame twice; the points that the store then
    holds. A refused frame is an error."""
    from tidewatt.streaming.ingest import start_ingest

    folder = _folder(spark, "stream")
    own = events_as_points(spark, d)
    span = F.floor(F.col("append_seq") / FRAME_POINTS).cast("long").alias("span")
    held = own.groupBy(span).agg(F.array_sort(F.collect_list(F.struct("append_seq", *S.POINT_IDENTITY))).alias("p"))
    cuts = held.select("span", "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / FRAME_POINTS).cast("int"))).alias("cut"))  # more than one if numbers repeat
    number = (F.shiftleft(F.col("span"), 20) + F.col("cut") + 1).alias("sequence")
    bodies = cuts.select(F.lit(S.hex_id(9)).alias("source_id"), number, F.lpad(F.hex(number), 32, "a").alias("commit_id"),
                         F.transform(F.slice("p", F.col("cut") * FRAME_POINTS + 1, FRAME_POINTS), lambda x: x.dropFields("append_seq")).alias("points"))
    bodies.write.json(f"{folder}/in")
    sent = wire.read_batches(spark, f"{folder}/in")
    first = sent.agg(F.min("sequence")).first()[0]
    sent.where(F.col("sequence") == first).write.mode("append").json(f"{folder}/in")
    outcomes: list[dict] = []
    with EngineStore.open(spark, f"{folder}/store") as store:
        _define(store)
        stream = wire.read_batches(spark, f"{folder}/in", stream=True)
        start_ingest(store, stream, f"{folder}/checkpoint", on_outcomes=lambda _, found: outcomes.extend(found)).awaitTermination()
        refused = [o for o in outcomes if o["outcome"] not in ("accepted", "replayed")]
        if refused:
            raise TidewattError(f"{len(refused)} of {len(outcomes)} frames refused, first {refused[0]}")
        return store.points()


@register("stream_ingest", f"WITH {POINTS_SQL} SELECT series_id, valid_time, knowledge_time, change_time, run_id, value FROM points")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All events are streamed in; the points that the store then holds."""
    return ingest_events(spark, d).select("series_id", "valid_time", "knowledge_time", "change_time", "run_id", "value")


_BATCHES_SQL = POINTS_SQL + """, q AS (SELECT *, append_seq % 3 + 1 AS src, (us - {t0}) // {day} % 4 + 1 AS number FROM points)""".format(t0=T0, day=DAY)


def _ingressed(spark: SparkSession, d: str, store: EngineStore) -> None:
    """Events as batches of three sources, four a source by day; each is sent twice, and the third source's later ones
    are refused: their series is not defined."""
    _define(store)
    points = events_as_points(spark, d)
    number = (F.floor((F.col("knowledge_time") - T0) / DAY) % 4 + 1).cast("long")
    dealt = points.withColumn("source", F.col("append_seq") % 3 + 1).withColumn("number", number)
    for source in (1, 2, 3):
        for sequence in range(1, 5):
            own = dealt.where((F.col("source") == source) & (F.col("number") == sequence)).select(*points.columns)
            if source == 3 and sequence > 2:
                own = own.withColumn("series_id", F.lit(99).cast("long"))
            for _ in range(2):
                tx = Transaction().with_ingress_identity(S.hex_id(source), sequence, S.hex_id(100 * source + sequence)).append_points(own)
                try:
                    store.commit(tx)
                except ModelError:
                    pass


def _ingress_config(spark: SparkSession, d: str) -> Config:
    """Batches as large as the number range of a commit allows."""
    return Config(max_batch_points=1 << S.BATCH_BITS, max_batch_bytes=1 << 40)


@register("ingress_receipts", f"""WITH {_BATCHES_SQL} SELECT printf('%032x', CAST(src AS BIGINT)) AS source_id, CAST(number AS BIGINT) AS sequence, printf('%032x', CAST(100 * src + number AS BIGINT)) AS commit_id, count(*) AS points
FROM q WHERE NOT (src = 3 AND number > 2) GROUP BY src, number""")
def ingress_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of ordered, identified commits: one a batch, however often it is sent, none of refused ones."""
    with EngineStore.open(spark, _folder(spark, "store"), _ingress_config(spark, d)) as store:
        _ingressed(spark, d, store)
        return store.commits().select("source_id", "sequence", "commit_id", "points")


@register("ingress_watermarks", f"""WITH {_BATCHES_SQL} SELECT printf('%032x', CAST(src AS BIGINT)) AS source_id, CAST(max(number) AS BIGINT) AS accepted, CAST(max(number) AS BIGINT) AS durable FROM q WHERE NOT (src = 3 AND number > 2) GROUP BY src""")
def ingress_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """How far each source has come, after its batches have been flushed."""
    with EngineStore.open(spark, _folder(spark, "store"), _ingress_config(spark, d)) as store:
        _ingressed(spark, d, store)
        store.flush(S.hex_id(1), 4)
        rows = [(k, v["accepted"], v["durable"]) for k, v in store.all_watermarks().items()]  # a row a source
        return spark.createDataFrame(rows, "source_id string, accepted long, durable long")


@register("store_salvage", f"""WITH {POINTS_SQL} SELECT {_POINT.replace(', append_seq', '')} FROM points WHERE (us - {T0}) // {DAY} < 10""")
def store_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Three loads, the second broken: what salvage keeps is the first."""
    folder = _folder(spark, "store")
    points = events_as_points(spark, d)
    day = F.floor((F.col("knowledge_time") - T0) / DAY)
    with EngineStore.open(spark, f"{folder}/whole") as store:
        for low, high in ((-1 << 30, 10), (10, 20), (20, 1 << 30)):
            store.append(points.where((day >= low) & (day < high)))
        broken = store.manifest["points"][1]["path"]
    files.delete(spark, f"{folder}/whole/{broken}")
    salvage_from(spark, f"{folder}/whole", f"{folder}/saved")
    with EngineStore.open(spark, f"{folder}/saved", read_only=True) as saved:
        return saved.points().select(*_POINT_NAMES[:-1])


@register("store_restore", f"WITH {POINTS_SQL} SELECT {_POINT.replace(', append_seq', '')} FROM points")
def store_restore(spark: SparkSession, d: str) -> DataFrame:
    """Two loads, sealed, swept, backed up and restored."""
    folder = _folder(spark, "store")
    points = events_as_points(spark, d)
    with EngineStore.open(spark, f"{folder}/whole") as store:
        store.append(points.where("append_seq % 2 = 0"))
        store.append(points.where("append_seq % 2 = 1"))
        store.seal()
        store.sweep()
        store.backup_to(f"{folder}/backup")
    restore_from(spark, f"{folder}/backup", f"{folder}/copy")
    with EngineStore.open(spark, f"{folder}/copy", read_only=True) as copy:
        return copy.points().select(*_POINT_NAMES[:-1])


@register("store_active_rollups", f"""WITH {POINTS_SQL}, b AS (SELECT series_id, count(*) AS n, min(valid_time) AS low, max(valid_time) AS high FROM points GROUP BY 1),
x AS (SELECT series_id, n, unnest(generate_series(low - low % {DAY}, high - high % {DAY}, {DAY})) AS s FROM b)
SELECT series_id, s AS start, s + {DAY} AS "end", CAST(n AS BIGINT) AS source_points FROM x WHERE s + {DAY} <= {T0 + 12 * DAY}""")
def store_active_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors after maintenance, and after a second call that finds nothing to do."""
    with EngineStore.open(spark, _folder(spark, "store")) as store:
        _define(store)
        store.append(events_as_points(spark, d))
        store.maintain(T0 + 12 * DAY)
        store.maintain(T0 + 12 * DAY)
        return store.active_rollups().select("series_id", "start", "end", "source_points")


@register("point_checksums", f"WITH {POINTS_SQL} SELECT a.series_id, count(*) AS points, true AS same_in_any_order, true AS sees_equal_rows FROM points a GROUP BY 1")
def point_checksums(spark: SparkSession, d: str) -> DataFrame:
    """A checksum does not depend on the order of points, and sees a point that is there three times."""
    points = events_as_points(spark, d)
    twice_more = points.unionByName(points.where("append_seq % 100 = 1")).unionByName(points.where("append_seq % 100 = 1"))
    sums = [U.point_checksum(df).select("series_id", F.col("checksum").alias(f"c{k}"), F.col("points").alias(f"n{k}")) for k, df in enumerate((points, points.orderBy(F.desc("append_seq")), twice_more))]
    both = sums[0].join(sums[1], "series_id").join(sums[2], "series_id")
    return both.select("series_id", F.col("n0").alias("points"), (F.col("c0") == F.col("c1")).alias("same_in_any_order"), (F.col("c0") != F.col("c2")).alias("sees_equal_rows"))


# --- sources ---

@register("tsbs_lines", """WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(value AS DOUBLE) AS value FROM events)
SELECT 'truck_' || user_id AS truck, 'readings.velocity' AS series, us AS valid_time, value FROM e WHERE event_type <> 'error'
UNION ALL SELECT 'truck_' || user_id, 'diagnostics.fuel_state', us, value FROM e WHERE event_type = 'error'""")
def tsbs_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as line protocol and read back: points under their trucks' and series' names."""
    folder = _folder(spark, "tsbs")
    events = _table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", F.col("value").cast("double").alias("value"))
    tags = F.concat(F.lit(",name=truck_"), F.col("user_id").cast("string"), F.lit(",fleet=South "))
    field = F.when(F.col("event_type") == "error", F.lit("fuel_state=")).otherwise(F.lit("velocity="))
    table = F.when(F.col("event_type") == "error", F.lit("diagnostics")).otherwise(F.lit("readings"))
    events.select(F.concat(table, tags, field, F.col("value").cast("string"), F.lit(" "), (F.col("us") * 1000).cast("string"))).write.text(folder)
    out = tsbs.read_tsbs(spark, folder)
    names = out["series"].select(F.col("id").alias("series_id"), F.col("name").alias("series"), F.col("owner_entity").alias("owner"))
    trucks = out["entities"].select(F.col("id").alias("owner"), F.col("name").alias("truck"))
    return out["points"].join(names.join(trucks, "owner"), "series_id").select("truck", "series", "valid_time", "value")  # points meet a table once


@register("replay_lines", f"SELECT 'd' || (user_id + 1) AS driver, 's' || (user_id * 100 + n + 1) AS metric, {replay.ORIGIN_MICROS // 1000} + offset_ms AS ts_ms, value FROM (SELECT user_id, event_id % 5 AS n, (epoch_us(min(ts)) - {T0}) // 1000 AS offset_ms, CAST(arg_min(value, row(ts, event_id)) AS DOUBLE) AS value FROM events GROUP BY user_id, event_id % 5)")
def replay_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and fifth, written as a sanitized CSV and read back as samples."""
    folder = _folder(spark, "replay")
    events = _table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    firsts = events.groupBy("user_id", (F.col("event_id") % 5).alias("n")).agg(F.min(F.struct("us", "event_id", "value")).alias("x"))
    rows = firsts.select((F.col("user_id") + 1).alias("driver_id"), (F.col("user_id") * 100 + F.col("n") + 1).alias("series_id"), F.floor((F.col("x.us") - T0) / 1000).cast("long").alias("offset_ms"), F.col("x.value").alias("value"))
    rows.orderBy("driver_id", "series_id", "offset_ms").coalesce(1).write.option("header", True).csv(folder)
    out = replay.read_replay(spark, folder)
    return replay.samples(out["points"], out["series"]).select("driver", "metric", "ts_ms", "value")


@register("workload_bundle", None)  # a seeded generator: SQL could only state its sizes, which a test does
def workload_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The generated fortnight, written as a bundle and read back: its published sizes, and a week of five-minute buckets."""
    folder = _folder(spark, "bundle")
    config = workload.WorkloadConfig()
    workload.write_bundle(workload.generate(spark, config), folder)
    made = workload.read_bundle(spark, folder)
    week = made["points"].where(f"series_id = 1 and valid_time < {config.start_micros + 7 * DAY}")
    buckets = U.build(R.winners(week), Resolution(micros=300 * MICROS), 180 * MICROS).agg(F.count("*").alias("buckets"))
    counts = [made[k].agg(F.count("*").alias(k)) for k in ("points", "series", "runs", "plans")]
    out = buckets
    for c in counts:  # one row each
        out = out.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")
    return out
