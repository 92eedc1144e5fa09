"""A store in SQL: views of its tables, and table functions for revision queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewatt.operators import revisions as R
from tidewatt.store import EngineStore

_COLUMNS = "series_id BIGINT, valid_time BIGINT, valid_time_end BIGINT, knowledge_time BIGINT, change_time BIGINT, run_id STRING, value DOUBLE, quality BIGINT, flags BIGINT, append_seq BIGINT"
_NAMES = ", ".join(c.split()[0] for c in _COLUMNS.split(", "))


_BUCKETS = "series_id BIGINT, bucket_start BIGINT, bucket_end BIGINT, count BIGINT, sum DOUBLE, min DOUBLE, max DOUBLE, integral DOUBLE, covered BIGINT"
#: A sample, and a piece for each bucket that its hold reaches over: the least and greatest value count what is held.
_ROLLUP = """
    SELECT series_id, p.b, p.b + gauge_rollup.width, count(p.ts), sum(if(p.ts IS NULL, 0D, value)), min(value), max(value), sum(value * p.dur), sum(p.dur)
    FROM (
      SELECT series_id, value, explode(concat(
        array(struct(valid_time - pmod(valid_time, gauge_rollup.width) AS b, valid_time AS ts, 0L AS dur)),
        if(until > valid_time AND until - valid_time <= gauge_rollup.gap,
           transform(sequence(valid_time - pmod(valid_time, gauge_rollup.width), until - 1 - pmod(until - 1, gauge_rollup.width), gauge_rollup.width),
                     b -> struct(b AS b, CAST(NULL AS BIGINT) AS ts, least(until, b + gauge_rollup.width) - greatest(valid_time, b) AS dur)),
           CAST(array() AS ARRAY<STRUCT<b: BIGINT, ts: BIGINT, dur: BIGINT>>)))) AS p
      FROM (SELECT series_id, valid_time, value, lead(valid_time) OVER (PARTITION BY series_id ORDER BY valid_time) AS until FROM tidewatt_latest
            WHERE series_id = gauge_rollup.series AND valid_time >= gauge_rollup.range_start AND valid_time < gauge_rollup.range_end))
    GROUP BY series_id, p.b"""


def _ranked(order: str, condition: str) -> str:
    return (f"SELECT {_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY series_id, valid_time ORDER BY {order}) AS place FROM tidewatt_points WHERE {condition}) WHERE place = 1")


def register(spark: SparkSession, store: EngineStore) -> None:
    """Views tidewatt_points, tidewatt_latest and one a catalogue kind; functions
    points_as_of(moment), points_with_cutoffs(max_knowledge, max_change), points_of_run(run), and
    gauge_rollup(series, range_start, range_end, width, gap): the latest points of the range in fixed buckets."""
    store.points().createOrReplaceTempView("tidewatt_points")
    R.latest(store.points()).createOrReplaceTempView("tidewatt_latest")
    for kind, df in store.catalog().items():
        df.createOrReplaceTempView(f"tidewatt_{kind}")
    across, within = (", ".join(f"{c} DESC" for c in order) for order in (R.BY_KNOWLEDGE, R.BY_CHANGE))
    for name, args, order, condition in (
        ("points_as_of", "moment BIGINT", across, "knowledge_time <= points_as_of.moment AND change_time <= points_as_of.moment"),
        ("points_with_cutoffs", "max_knowledge BIGINT, max_change BIGINT", across, "knowledge_time <= points_with_cutoffs.max_knowledge AND change_time <= points_with_cutoffs.max_change"),
        ("points_of_run", "run STRING", within, "run_id = points_of_run.run"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({_COLUMNS}) RETURN {_ranked(order, condition)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION gauge_rollup(series BIGINT, range_start BIGINT, range_end BIGINT, width BIGINT, gap BIGINT) RETURNS TABLE ({_BUCKETS}) RETURN {_ROLLUP}")
