"""Behavioural vectors of the point, aggregate, rollup and catalogue operators."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatt import schemas as S
from tidewatt.errors import InvalidArgument, LimitError, ModelError
from tidewatt.functions import bucket_end, bucket_start, floor_to, time_weighted_mean, value_hours
from tidewatt.operators import aggregates as A, catalog as C, fleet, reconcile, revisions as R, rollup as U
from tidewatt.plans import coverage
from tidewatt.schemas import DAY, HOUR, MICROS, Resolution

SEC = MICROS


def points(spark, rows, series=1):
    """(valid, value) or (valid, knowledge, change, value[, run]) rows, in append order."""
    out = []
    for k, row in enumerate(rows):
        if len(row) == 2:
            t, v = row
            out.append((series, t, t, t, t, S.ZERO_ID, float(v), 0, 0, k))
        else:
            t, known, changed, v, *run = row
            out.append((series, t, t, known, changed, S.hex_id(run[0]) if run else S.ZERO_ID, float(v), 0, 0, k))
    return spark.createDataFrame(out, S.POINTS)


def one(df):
    (row,) = df.collect()
    return row


def test_revisions(spark):
    p = points(spark, [(100, 10, 11, 1), (200, 10, 11, 2), (100, 20, 21, 3), (50, 30, 30, 9)])
    values = lambda df: sorted((r["valid_time"], r["value"]) for r in df.collect())
    assert values(R.latest(p)) == [(50, 9), (100, 3), (200, 2)]
    assert values(R.as_of(p, 15)) == [(100, 1), (200, 2)]
    assert values(R.as_of(p, 9)) == []
    assert values(R.latest(p, 0, 75)) == [(50, 9)]
    assert values(R.with_cutoffs(p, max_knowledge=20, max_change=20)) == [(100, 1), (200, 2)]
    assert [(r["valid_time"], r["knowledge_time"]) for r in R.history(p).collect()] == [(50, 30), (100, 10), (100, 20), (200, 10)]
    with pytest.raises(InvalidArgument):
        R.latest(p, 10, 10)
    with pytest.raises(LimitError):
        R.budgeted(p, 3)
    assert R.budgeted(p, 4).count() == 4


def test_two_orders_of_preference(spark):
    """Across runs knowledge comes first, within one run change does; later appends win ties."""
    p = points(spark, [(1, 20, 10, 1, 5), (1, 10, 20, 2, 5), (1, 20, 10, 3, 5)])
    assert one(R.latest(p))["value"] == 3
    assert one(R.of_run(p, S.hex_id(5)))["value"] == 2
    runs = points(spark, [(1, 10, 10, 1, 100), (1, 20, 20, 2, 100), (1, 30, 30, 3, 101)])
    assert [one(x)["value"] for x in (R.latest(runs), R.as_of(runs, 15), R.of_run(runs, S.hex_id(100)))] == [3, 1, 2]


def test_plan_vs_actual(spark):
    p = points(spark, [(1, 0, 0, 5000, 7), (2, 0, 0, 1, 7)], 1).unionByName(points(spark, [(1, 4800), (3, 2)], 2))
    rows = {r["valid_time"]: r for r in R.plan_vs_actual(p, 1, 2, S.hex_id(7)).collect()}
    assert rows[1]["difference"] == -200 and rows[2]["actual"] is None and rows[3]["planned"] is None and rows[3]["difference"] is None


def test_gauge_vectors(spark):
    p = points(spark, [(0, 1), (SEC, 3), (3 * SEC, 5), (6 * SEC, 2)])
    r = one(A.gauge(R.winners(p), 10 * SEC))
    assert r["integral"] / r["covered"] == pytest.approx(22 / 6) and r["count"] == 4
    r = one(A.gauge(R.winners(points(spark, [(0, 2), (60 * SEC, 2)])), 5 * SEC).withColumn("m", time_weighted_mean(F.col("integral"), F.col("covered"))))
    assert r["covered"] == 0 and r["m"] is None
    assert one(A.gauge(R.winners(p), None))["covered"] == 0
    with pytest.raises(InvalidArgument):
        A.gauge(p, -1)


def test_merge_equals_direct_over_random_days(spark):
    rng = random.Random(1)
    rows = sorted({rng.randrange(0, 6 * DAY) for _ in range(120)})
    p = R.winners(points(spark, [(t, rng.randint(-50, 50)) for t in rows]))
    direct, merged = one(A.gauge(p, 3 * HOUR)), one(A.merge_gauges(A.gauge_states(p, 3 * HOUR), 3 * HOUR))
    assert {k: direct[k] for k in direct.asDict()} == pytest.approx({k: merged[k] for k in direct.asDict()})
    direct, merged = one(A.counter(p)), one(A.merge_counters(A.counter_states(p)))
    assert direct.asDict() == pytest.approx(merged.asDict())


def test_counter_vectors(spark):
    p = R.winners(points(spark, [(k * SEC, v) for k, v in enumerate((100, 105, 2, 7))]))
    r = one(A.counter(p))
    assert (r["positive_delta"], r["resets"]) == (12, 1)
    assert sorted(x["increase"] for x in A.running_counter(p).collect()) == [0, 5, 7, 12]


def test_states_out_of_order_are_refused(spark):
    states = A.gauge_states(R.winners(points(spark, [(0, 1), (10, 2)])), 5)
    with pytest.raises(PySparkException, match="out of time order"):
        A.merge_gauges(states.unionByName(states.withColumn("first_ts", F.lit(5).cast("long"))), 5).collect()


def test_extension_aggregates(spark):
    p = R.winners(points(spark, [(0, 1), (10, 2), (30, 1), (60, 1)]))
    rows = {r["state"]: (r["reports"], r["duration"]) for r in A.state_durations(p).collect()}
    assert rows == {1.0: (3, 10 + 30), 2.0: (1, 20)}
    assert one(A.event_counts(p))["events"] == 4 and one(A.interval_totals(p))["total"] == 5


def test_fixed_rollup_vectors(spark):
    p = R.winners(points(spark, [(0, 2), (7 * SEC, 4), (12 * SEC, 8)]))
    five = U.build(p, Resolution(micros=5 * SEC), 60 * SEC)
    rows = sorted(five.withColumn("m", F.col("integral") / F.col("covered")).collect(), key=lambda r: r["bucket_start"])
    assert [r["covered"] for r in rows] == [5 * SEC, 5 * SEC, 2 * SEC]
    assert [r["m"] for r in rows] == pytest.approx([2.0, 3.2, 4.0])
    r = one(U.merge_exact(five.where(F.col("bucket_start") < 10 * SEC), F.lit(1)))
    assert (r["bucket_start"], r["bucket_end"], r["covered"], r["integral"] / r["covered"]) == (0, 10 * SEC, 10 * SEC, pytest.approx(2.6))
    with pytest.raises(PySparkException, match="not adjacent"):
        U.merge_exact(five.where(F.col("bucket_start") != 5 * SEC), F.lit(1)).collect()
    assert [r["bucket_start"] for r in U.fixed_range(five, 5 * SEC, 10 * SEC).collect()] == [5 * SEC]
    with pytest.raises(InvalidArgument):
        U.build(p, Resolution(micros=1), 10_000_000)
    with pytest.raises(InvalidArgument):
        Resolution(micros=0)


def test_held_values_and_empty_buckets(spark):
    """A bucket without a sample has the held value as min and max; none is made where nothing holds."""
    rows = U.build(R.winners(points(spark, [(0, 7), (12 * SEC, 1), (100 * SEC, 3)])), Resolution(micros=5 * SEC), 20 * SEC).collect()
    by = {r["bucket_start"]: r for r in rows}
    assert by[5 * SEC]["count"] == 0 and by[5 * SEC]["min"] == by[5 * SEC]["max"] == 7 and by[5 * SEC]["sum"] == 0 and by[5 * SEC]["first_ts"] is None
    assert set(by) == {0, 5 * SEC, 10 * SEC, 100 * SEC}


def test_negative_times(spark):
    df = spark.createDataFrame([(-SEC,)], "t long").select(floor_to(F.col("t"), 5 * SEC).alias("f"))
    assert one(df)["f"] == -5 * SEC


@pytest.mark.parametrize("moment, unit, tz, hours", [
    (1_774_785_600, "Day", "Europe/Stockholm", 23), (1_792_929_600, "Day", "Europe/Stockholm", 25), (1_541_332_800, "Day", "America/Sao_Paulo", 23),
    (1_774_785_600, "Month", "Europe/Stockholm", 31 * 24 - 1), (1_774_785_600, "Year", "Europe/Stockholm", 365 * 24)])
def test_calendar_buckets_have_their_real_length(spark, moment, unit, tz, hours):
    resolution = Resolution(unit=unit, tz=tz)
    t = F.lit(moment * SEC).cast("long")
    r = one(spark.range(1).select(bucket_start(t, resolution).alias("a"), bucket_end(t, resolution).alias("b")))
    assert r["b"] - r["a"] == hours * HOUR
    assert coverage.bucket_of(moment * SEC, resolution) == (r["a"], r["b"])
    assert r["a"] <= moment * SEC < r["b"]


def test_constant_power_over_the_short_day(spark):
    day = Resolution(unit="Day", tz="Europe/Stockholm")
    start, end = coverage.bucket_of(1_774_785_600 * SEC, day)
    r = one(U.build(R.winners(points(spark, [(start, 1000), (end, 1000)])), day, 26 * HOUR).where(F.col("bucket_start") == start).withColumn("wh", value_hours(F.col("integral"))))
    assert r["covered"] == 23 * HOUR and r["wh"] == pytest.approx(23_000)


def test_cover():
    assert coverage.cover([(0, 10), (10, 20)], 0, 20) == ([0, 1], [])
    assert coverage.cover([(0, 10), (15, 20)], 0, 30) == ([0, 1], [(10, 15), (20, 30)])
    assert coverage.cover([(0, 5), (0, 12), (4, 14)], 0, 14) == ([1, 2], [])
    assert coverage.cover([], 3, 9) == ([], [(3, 9)])
    with pytest.raises(InvalidArgument):
        coverage.envelope(5, 5, Resolution(micros=5))
    assert coverage.envelope(7, 11, Resolution(micros=5)) == (5, 15)


def catalog(spark, **changes):
    base = {
        "entities": [{"id": S.hex_id(1), "kind": "site", "name": "a", "valid_from": 0}], "relations": [{"id": S.hex_id(2), "kind": "feeds", "source": S.hex_id(1), "target": S.hex_id(1), "valid_from": 0}],
        "series": [{"id": 1, "owner_entity": S.hex_id(1), "name": "s", "physical_quantity": "power", "canonical_unit": "W", "semantics": "Gauge", "maximum_gap_micros": 2 * SEC, "rollup_policy": (None, [(Resolution(micros=5).row(), None)])}],
        "runs": [{"id": S.hex_id(3), "kind": "Optimization", "status": "Succeeded", "created_at": 0, "knowledge_time": 0, "workflow": "w", "model": "m", "model_version": "1"}],
        "plans": [{"id": S.hex_id(4), "run_id": S.hex_id(3), "status": "Candidate", "horizon_start": 0, "horizon_end": 9, "resolution_micros": 3, "scenario": "base", "objective_terms": {"x": 1.0}}]}
    for kind, rows in changes.items():
        base[kind] = rows if rows and rows[0].get("id") else [{**base[kind][0], **rows[0]}]
    return {k: spark.createDataFrame([tuple(r.get(f.name) for f in S.CATALOG[k].fields) for r in rows], S.CATALOG[k]) for k, rows in base.items()}


def test_valid_catalogue_passes(spark):
    C.validate(catalog(spark), catalog(spark))
    assert [r["kind"] for r in C.snapshot_order(catalog(spark)).collect()] == ["entity", "relation", "series", "run", "plan"]


@pytest.mark.parametrize("change, rule", [
    ({"entities": [{"kind": " "}]}, "entity kind is blank"), ({"entities": [{"valid_to": 0}]}, "entity validity is empty"), ({"entities": [{"parent": S.hex_id(1)}]}, "its own parent"), ({"entities": [{"parent": S.hex_id(9)}]}, "parent is missing"),
    ({"entities": [{"properties": {"p": ("Float", None, None, float("inf"), None)}}]}, "entity properties"), ({"relations": [{"target": S.hex_id(9)}]}, "target is missing"),
    ({"series": [{"owner_relation": S.hex_id(2)}]}, "exactly one owner"), ({"series": [{"maximum_gap_micros": -1}]}, "gap is negative"), ({"series": [{"rollup_policy": (0, [])}]}, "raw retention"),
    ({"series": [{"rollup_policy": (None, [(("Calendar", None, "Day", "Mars/Olympus"), None)])}]}, "series tier"), ({"series": [{"rollup_policy": (None, [(("Fixed", 0, None, None), None)])}]}, "series tier"),
    ({"runs": [{"kind": "Forecast"}]}, "not an optimization"), ({"runs": [{"parent_run": S.hex_id(3)}]}, "run provenance forms a cycle"), ({"plans": [{"supersedes": S.hex_id(4)}]}, "supersedes itself"),
    ({"plans": [{"horizon_end": 0}]}, "horizon is empty"), ({"plans": [{"objective_terms": {"x": float("nan")}}]}, "objective is not finite"), ({"plans": [{"run_id": S.hex_id(8)}]}, "plan run is missing")])
def test_catalogue_rules(spark, change, rule):
    with pytest.raises(ModelError, match=rule):
        C.validate(catalog(spark, **change))


def test_transitions(spark):
    old = catalog(spark)
    for change, ok in (({"plans": [{"status": "Approved"}]}, True), ({"plans": [{"status": "Deployed"}]}, False), ({"plans": [{"scenario": "other"}]}, False), ({"runs": [{"workflow": "other"}]}, False), ({"runs": [{"created_at": 5}]}, False)):
        found = C.transition_rules(old, catalog(spark, **change)).count()
        assert (found == 0) == ok, change


def test_point_rules(spark):
    own = catalog(spark)
    p = points(spark, [(1, 1), (2, 0, 0, float("nan"), 3), (3, 0, 0, 1, 77)]).unionByName(points(spark, [(1, 1)], 2))
    assert sorted(r["rule"] for r in C.point_rules(p, own["series"], own["runs"]).collect()) == ["point run is not defined", "point series is not defined", "point value is not finite"]


def test_reconcile_tells_bits_and_copies_apart(spark):
    sent = points(spark, [(1, 0.0), (2, 5), (2, 5), (3, 1)])
    got = points(spark, [(1, -0.0), (2, 5), (3, 1), (3, 1), (99, 4)])
    r = one(reconcile.point_counts(reconcile.compare_points(sent, got)))
    assert (r["expected"], r["stored"], r["matched"], r["missing"], r["unexpected"]) == (4, 4, 2, 2, 2)


def test_identifiers():
    assert S.signed((1 << 64) - 1) == -1 and S.unsigned(-1) == (1 << 64) - 1
    assert S.hex_id((1 << 128) - 1) == "f" * 32
    with pytest.raises(InvalidArgument):
        S.hex_id(1 << 128)
    with pytest.raises(ModelError):
        Resolution(unit="Day", tz="Nowhere/Land")
    assert Resolution(unit="Day", tz="Europe/Stockholm").key == "calendar/Day/Europe/Stockholm" and Resolution(micros=300).key == "fixed/300"


def test_breakdowns_follow_a_vehicle_over_midnight(spark):
    import random

    from tidewatt.operators import fleet

    rng = random.Random(3)
    rows = [(v, rng.choice("ab"), rng.randrange(0, 40 * S.DAY), float(rng.randrange(100)), k) for k, v in enumerate(rng.choices(range(9), k=400))]
    want = {"a": 0, "b": 0}
    for v in range(9):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[4]))
        for x, y in zip(own, own[1:], strict=False):
            want[y[1]] += x[3] >= 50 > y[3]
    got = fleet.breakdowns(spark.createDataFrame(rows, "vehicle long, fleet string, ts long, value double, seq long"), 50).collect()
    assert {r["fleet"]: r["breakdowns"] for r in got} == want


def test_long_chains_and_cycles(spark):
    """Single references by jumping pointers, several by peeling; chains are never too long."""
    n = 300
    chain = [(k, k - 1) for k in range(1, n)]
    nodes = spark.range(-5, n + 50).select("id")
    found = C.cycles(spark.createDataFrame(chain, "id long, ref long"), nodes, "r")
    assert found.count() == 0
    ring = [(n + k, n + (k + 1) % 5) for k in range(5)] + [(n + 10 + k, n + 9 + k) for k in range(1, 5)] + [(n + 10, n)]
    want = {str(a) for a, _ in ring}
    assert {r["object"] for r in C.cycles(spark.createDataFrame(chain + ring, "id long, ref long"), nodes, "r").collect()} == want
    short = [(k, k - 1) for k in range(1, 20)]
    assert {r["object"] for r in C.cycles(spark.createDataFrame([*short, *ring, (n, 5)], "id long, ref long"), nodes, "r").collect()} == want


def test_a_mean_at_the_limit_is_not_past_it(spark):
    """Sums of doubles go by the order of additions: 119.99999999999999, 120.0 or 120.00000000000001."""
    from itertools import permutations

    low = high = None
    for k in range(1, 4000):
        for x, y, z in permutations((k / 100, (2 * k + 7) / 100, (12000 - 3 * k - 7) / 100)):
            low = (x, y, z) if x + y + z < 120 else low
            high = (x, y, z) if x + y + z > 120 else high
    rows = [(v, "a", t, x, t) for v, values in enumerate((low, high, (40.0, 39.98), (40.0, 40.02))) for t, x in enumerate(values)]
    readings = spark.createDataFrame(rows, "vehicle long, fleet string, ts long, value double, seq long").coalesce(1)
    assert [r["vehicle"] for r in fleet.stationary(readings, 0, 10, 40).collect()] == [2]
    assert [r["vehicle"] for r in fleet.active_slots(readings, 10, 40).collect()] == [3]
    odd = spark.createDataFrame([(1, "a", 0, x, k) for k, x in enumerate((1e300, None, 1e-30))] + [(2, "a", 0, float("nan"), 0), (3, "a", 0, None, 0)] + [(4, "a", 0, 9e19, k) for k in range(2)], readings.schema)
    assert {r["vehicle"]: str(r["mean"]) for r in fleet.stationary(odd, 0, 10, 1e301).collect()} == {1: "5e+299", 4: "9e+19"}
