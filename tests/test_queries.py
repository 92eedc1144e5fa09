"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatt import catalogue_of_queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    want = duck.sql(core.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_down_and_shuffle_once(spark):
    from tidewatt.operators import revisions as R
    from tidewatt.sources.points import events_as_points

    plan = R.winners(events_as_points(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    read = core.QUERIES["parquet_probe_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in read and "l_quantity:double,l_returnflag:string>" in read


def test_stream_ingest_takes_all_events(spark, monkeypatch):
    from tidewatt.errors import TidewattError
    from tidewatt.sources import wire
    from tidewatt.sources.points import events_as_points

    columns = ["series_id", "valid_time", "knowledge_time", "change_time", "run_id", "value"]
    want = events_as_points(spark, SF).select(*columns).collect()
    monkeypatch.setattr(core, "FRAME_POINTS", -(-len(want) // 3))
    assert sorted(core.ingest_events(spark, SF).select(*columns).collect()) == sorted(want)
    monkeypatch.setattr(wire, "MAX_POINTS", len(want) // 4)
    with pytest.raises(TidewattError):
        core.ingest_events(spark, SF)


def test_workload_bundle_has_its_published_sizes(spark):
    assert core.QUERIES["workload_bundle"](spark, SF).collect() == [(2016, 65_958, 9, 14, 7)]


def test_timestamps_of_lines_are_exact(spark, tmp_path):
    from tidewatt.sources import tsbs

    stamps = [1704571070203536, 1704571070203537]  # more nanoseconds than a double can tell apart
    (tmp_path / "a").write_text("\n".join(f"readings,name=truck_1,fleet=South velocity=1 {t}000" for t in stamps))
    assert sorted(r["valid_time"] for r in tsbs.read_tsbs(spark, str(tmp_path / "a"))["points"].collect()) == stamps


def test_points_of_lines_get_their_series_where_they_are(spark, tmp_path):
    """No shuffle of points; ids are those of the published rule, for a field whose ordinal carries too, and without tags."""
    from tidewatt.sources import tsbs

    sets = [{"name": f"truck_{k}", "fleet": "a=b"} for k in range(5)] + [{}]
    lines = ["diagnostics" + "".join(f",{k}={v}" for k, v in tags.items()) + " status=1i,fuel_state=0.5 7000" for tags in sets]
    (tmp_path / "a").write_text("\n".join(lines))
    out = tsbs.read_tsbs(spark, str(tmp_path / "a"))
    assert "Exchange" not in out["points"]._jdf.queryExecution().executedPlan().toString()
    want = sorted((u - (1 << 64) if u >> 63 else u, v) for tags in sets for at, v in ((16, 1.0), (14, 0.5)) for u in [tsbs.tag_key(tags) * 16 + at])
    assert sorted((r["series_id"], r["value"]) for r in out["points"].collect()) == want
    assert sorted(r["id"] for r in out["series"].collect()) == [k for k, _ in want] and out["entities"].count() == len(sets)
