"""The store: commits, idempotency, rollups, planning, files, streams, loaders, command line."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from tidewatt import cli, schemas as S, sql
from tidewatt.errors import (
    CommitIdConflict, ConfigError, InvalidArgument, LimitError, LockedError, ModelError, NotAccepted, Overloaded, ReadOnlyError, SequenceNotIncreasing, SourceSequenceConflict, StorageFault)
from tidewatt.operators import revisions as R, rollup as U
from tidewatt.schemas import DAY, MICROS as SEC, Resolution
from tidewatt.sources import files, replay, tsbs, wire, workload
from tidewatt.store import Config, EngineStore, Transaction, restore_from, salvage_from
from tidewatt.streaming.ingest import apply_batches, start_ingest
from tidewatt.streaming.writer import BoundedWriter

FIVE = Resolution(micros=5 * SEC)
STHLM = Resolution(unit="Day", tz="Europe/Stockholm")
A, B = S.hex_id(10), S.hex_id(11)


def rows(spark, values, series=1, first=0):
    return spark.createDataFrame([(series, t, t, t, t, S.ZERO_ID, float(v), 0, 0, first + k) for k, (t, v) in enumerate(values)], S.POINTS)


def definitions(tiers=(FIVE,), raw=None, series=(1,)):
    tx = Transaction().upsert("entities", {"id": S.hex_id(1), "kind": "site", "name": "a", "valid_from": 0})
    return tx.upsert("series", *[{"id": k, "owner_entity": S.hex_id(1), "name": "s", "physical_quantity": "power", "canonical_unit": "W", "semantics": "Gauge", "maximum_gap_micros": 2 * SEC, "rollup_policy": (raw, [(t.row(), None) for t in tiers])} for k in series])


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def starts(query):
    return [(r["bucket_start"], r["count"], r["integral"], r["covered"]) for r in query.buckets.collect()]


def test_rollups_from_raw_to_stored_and_back(spark, root):
    """Materialized, undone by a late point, built again; equal to raw at every step."""
    ramp = [(k * SEC, k) for k in range(21)]
    with EngineStore.open(spark, root) as store:
        store.commit(definitions((FIVE, STHLM), raw=DAY))
        raw = store.query_gauge(1, 0, 20 * SEC, FIVE)
        assert raw.source == "Raw" and starts(raw) == []
        store.commit(Transaction().append_points(rows(spark, ramp)))
        first = store.query_gauge(1, 0, 20 * SEC, FIVE)
        assert first.source == "Raw" and len(starts(first)) == 4
        store.maintain(DAY)
        stored = store.query_gauge(1, 0, 20 * SEC, FIVE)
        assert stored.source == "Materialized" and starts(stored) == starts(first)
        generation = store.manifest["generation"]
        assert store.maintain(DAY)["built"] == 0 and store.manifest["generation"] == generation
        store.commit(Transaction().append_points(rows(spark, [(7 * SEC, 100)])))
        late = store.query_gauge(1, 0, 20 * SEC, FIVE)
        assert late.source == "Raw" and starts(late) != starts(first)
        store.maintain(DAY)
        again = store.query_gauge(1, 0, 20 * SEC, FIVE)
        assert again.source == "Materialized" and starts(again) == starts(late)
        hybrid = store.query_gauge(1, 0, DAY + 5 * SEC, FIVE)
        assert hybrid.source == "Hybrid" and starts(hybrid)[:4] == starts(late)
        (gate,) = store.retention_gates(2 * DAY).collect()
        assert not gate["eligible"] and "calendar/Day/Europe/Stockholm" in gate["reason"]
        with pytest.raises(ModelError):
            store.query_gauge(9, 0, 5, FIVE)
        assert store.check_integrity()["ok"]


def test_unrelated_series_keep_their_rollups(spark, root):
    with EngineStore.open(spark, root) as store:
        store.commit(definitions(series=(1, 2)))
        store.append(rows(spark, [(k * SEC, k) for k in range(30)]).unionByName(rows(spark, [(k * SEC, k) for k in range(30)], 2)))
        store.maintain(2 * DAY)
        paths = {r["series_id"]: r["path"] for r in store.active_rollups().collect()}
        store.append(rows(spark, [(3 * SEC, 8)]))
        assert [r["series_id"] for r in store.active_rollups().collect()] == [2]
        store.maintain(2 * DAY)
        assert {r["series_id"]: r["path"] for r in store.active_rollups().collect()}[2] == paths[2]


def test_ties_survive_sealing_and_reopening(spark, root):
    with EngineStore.open(spark, root) as store:
        store.append(rows(spark, [(5, 1), (5, 2)]))
        store.seal()
        store.append(rows(spark, [(5, 3)]))
        assert [r["value"] for r in store.latest().collect()] == [3] and [r["value"] for r in store.history().collect()] == [1, 2, 3]
        assert store.seal()["sealed_points"] == 1 and store.seal()["files"] == 0
    with EngineStore.open(spark, root, read_only=True) as reader:
        assert [r["value"] for r in reader.latest().collect()] == [3]
        assert reader.stats()["points"] == 3 and reader.stats()["sealed"] == 2
        for call in (lambda: reader.append(rows(spark, [(1, 1)])), lambda: reader.maintain(1), reader.seal):
            with pytest.raises(ReadOnlyError):
                call()


def test_ordered_ingress(spark, root):
    """Check order: replay, commit id, sequence; gaps are fine; sources are apart."""
    def tx(source, sequence, commit, value=1):
        return Transaction().with_ingress_identity(source, sequence, S.hex_id(commit)).append_points(rows(spark, [(sequence, value)]))

    with EngineStore.open(spark, root, Config(durability="manual")) as store:
        store.commit(definitions())
        assert not store.commit(tx(A, 5, 1)).deduplicated
        assert store.commit(tx(A, 5, 1)).deduplicated
        for wrong, error in ((tx(A, 5, 1, 2), SourceSequenceConflict), (tx(A, 5, 2), SourceSequenceConflict), (tx(A, 9, 1), CommitIdConflict), (tx(A, 4, 3), SequenceNotIncreasing), (tx(S.ZERO_ID, 1, 9), InvalidArgument)):
            with pytest.raises(error):
                store.commit(wrong)
        store.commit(tx(A, 50, 4))
        store.commit(tx(B, 1, 5))
        assert store.watermarks(A) == {"accepted": 50, "durable": None}
        with pytest.raises(NotAccepted):
            store.flush(B, 2)
        store.flush(B, 1)
        assert store.all_watermarks() == {A: {"accepted": 50, "durable": 50}, B: {"accepted": 1, "durable": 1}}
        assert store.receipt(A, 50)["points"] == 1 and store.contains_commit(S.hex_id(4)) and not store.contains_commit(S.hex_id(3))
        assert store.points().count() == 3
    with EngineStore.open(spark, root) as store:
        assert store.commit(tx(A, 50, 4)).deduplicated


def test_identified_commits_limits_and_refusals(spark, root):
    with EngineStore.open(spark, root, Config(max_batch_points=2)) as store:
        store.commit(definitions())
        one = Transaction().with_commit_id(S.hex_id(7)).append_points(rows(spark, [(1, 1)]))
        assert [store.commit(one).deduplicated for _ in range(2)] == [False, True]
        with pytest.raises(CommitIdConflict):
            store.commit(Transaction().with_commit_id(S.hex_id(7)).append_points(rows(spark, [(1, 2)])))
        with pytest.raises(LimitError):
            store.commit(Transaction().append_points(rows(spark, [(1, 1)] * 3)))
        before = store.manifest
        with pytest.raises(ModelError, match="series is not defined"):
            store.commit(Transaction().append_points(rows(spark, [(1, 1)], 99)))
        with pytest.raises(ModelError, match="not finite"):
            store.append(rows(spark, [(1, float("nan"))]))
        assert store.manifest == before and store.commit(Transaction()).commit_seq is None
        with pytest.raises(LockedError):
            EngineStore.open(spark, root)
        store.config.max_store_bytes = 1
        with pytest.raises(LimitError):
            store.commit(Transaction().append_points(rows(spark, [(1, 1)])))
    for wrong in ({"durability": "maybe"}, {"max_batch_points": 0}):
        with pytest.raises(ConfigError):
            Config(**wrong)


def test_backup_restore_salvage_sweep(spark, root, tmp_path):
    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        for k in range(3):
            store.append(rows(spark, [(k * SEC, k)]))
        store.maintain(DAY)
        out = store.backup_to(f"file://{tmp_path}/backup")
        with pytest.raises(InvalidArgument):
            store.backup_to(f"file://{tmp_path}/backup")
        store.seal()
        for k in range(4):
            store.append(rows(spark, [(DAY * 9 + k, k)]))
        assert store.sweep() and store.check_integrity()["ok"] and store.points().count() == 7
    assert restore_from(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/copy")["digest"] == out["digest"]
    with EngineStore.open(spark, f"file://{tmp_path}/copy") as copy:
        assert copy.points().count() == 3 and copy.query_gauge(1, 0, 5 * SEC, FIVE).source == "Materialized"
        broken = copy.manifest["points"][1]["path"]
    (victim,) = list((tmp_path / "copy" / broken).rglob("*.parquet"))
    victim.write_bytes(b"PAR1 nothing PAR1")
    for crc in (tmp_path / "copy" / broken).rglob(".*.crc"):
        crc.unlink()
    with EngineStore.open(spark, f"file://{tmp_path}/copy", read_only=True) as copy:
        assert not copy.check_integrity()["ok"]
    report = salvage_from(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/saved")
    assert not report["complete"] and report["points"] == 1
    with EngineStore.open(spark, f"file://{tmp_path}/saved") as saved:
        assert saved.points().count() == 1 and saved.catalog()["series"].count() == 1


def batch(spark, source, sequence, commit, values):
    return Transaction().with_ingress_identity(source, sequence, S.hex_id(commit)).append_points(rows(spark, values))


def test_salvage_is_a_prefix_of_commits(spark, root, tmp_path):
    """Points, receipts and watermarks end at the same commit: what was lost is accepted when it is sent again."""
    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        for k in (1, 2):
            store.commit(batch(spark, A, k, k, [(k * SEC, k)]))
        store.seal()
        for k in (3, 4, 5):
            store.commit(batch(spark, A, k, k, [(k * SEC, k)]))
        store.commit(Transaction().with_commit_id(S.hex_id(50)).upsert("entities", {"id": S.hex_id(2), "kind": "late", "name": "b", "valid_from": 0}))
        sealed, live = store.manifest["points"][0], store.manifest["points"][2]
        assert sealed["sealed"] and (sealed["first"], sealed["commit"]) == (2, 3)

    def spoil(path):
        for f in (tmp_path / "store" / path).rglob("*"):
            if f.suffix == ".parquet":
                f.write_bytes(b"PAR1 nothing PAR1")
            elif f.suffix == ".crc":
                f.unlink()

    assert salvage_from(spark, root, f"file://{tmp_path}/whole")["complete"]
    with EngineStore.open(spark, f"file://{tmp_path}/whole") as whole:
        assert whole.points().count() == 5 and whole.watermarks(A) == {"accepted": 5, "durable": 5} and whole.catalog()["entities"].count() == 2
        assert whole.commit(batch(spark, A, 5, 5, [(5 * SEC, 5)])).deduplicated
    spoil(live["path"])
    report = salvage_from(spark, root, f"file://{tmp_path}/saved")
    assert not report["complete"] and report["points"] == 3
    with EngineStore.open(spark, f"file://{tmp_path}/saved") as saved:
        assert saved.points().count() == 3 and saved.watermarks(A) == {"accepted": 3, "durable": 3} and saved.commits().count() == 3 and saved.catalog()["entities"].count() == 1
        for k in (4, 5):
            assert not saved.commit(batch(spark, A, k, k, [(k * SEC, k)])).deduplicated
        assert saved.points().count() == 5 and saved.check_integrity()["ok"]
    spoil(sealed["path"])
    report = salvage_from(spark, root, f"file://{tmp_path}/little")
    with EngineStore.open(spark, f"file://{tmp_path}/little") as little:
        assert little.points().count() == 0 and little.watermarks(A) is None and little.catalog()["series"].count() == 1
        assert not little.commit(batch(spark, A, 1, 1, [(SEC, 1)])).deduplicated


def test_logs_stay_few(spark, root, monkeypatch):
    """Receipts are merged level by level; every one is still found."""
    from tidewatt import store as module

    monkeypatch.setattr(module, "MERGE_LOGS", 3)
    with EngineStore.open(spark, root) as store:
        for k in range(1, 11):
            store.commit(Transaction().with_commit_id(S.hex_id(100 + k)).upsert("entities", {"id": S.hex_id(k), "kind": "site", "name": "a", "valid_from": 0}))
        assert len(store.manifest["commits"]) == 2 and len(store.manifest["catalog"]["entities"]) == 2
        assert store.commits().count() == 10 and store.catalog()["entities"].count() == 10 and store.contains_commit(S.hex_id(104))
        store.sweep()
        assert store.commits().count() == 10


def test_order_of_points_without_numbers(spark, root):
    same = [(1, 5, 5, 5, 5, S.ZERO_ID, float(v), 0, 0) for v in (3, 9, 4)]
    points = spark.createDataFrame(same, "series_id long, valid_time long, valid_time_end long, knowledge_time long, change_time long, run_id string, value double, quality int, flags int")
    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        store.commit(Transaction().append_points(points))  # the last of a transaction wins
        assert [r["value"] for r in store.latest().collect()] == [4.0]
        store.append(points.repartition(3))  # a load without numbers: the greatest
        assert [r["value"] for r in store.latest().collect()] == [9.0] and store.points().select("append_seq").distinct().count() == 6


def test_maintain_reads_only_what_it_needs(spark, root):
    from unittest.mock import patch

    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        store.append(rows(spark, [(k * DAY // 4, k) for k in range(40)]))
        assert store.maintain(9 * DAY + 5)["built"] > 0
        with patch.object(EngineStore, "points", side_effect=AssertionError("read")):
            assert store.maintain(9 * DAY + 6)["built"] == 0
        store.append(rows(spark, [(12 * DAY, 1)]))
        seen = []
        build = U.build
        with patch.object(U, "build", side_effect=lambda df, *rest: (seen.append(df._jdf.queryExecution().executedPlan().toString()), build(df, *rest))[1]):
            assert store.maintain(20 * DAY)["built"] > 0
        assert seen and "PartitionFilters: [isnotnull(valid_day" in seen[0]


def test_checksums_see_equal_rows(spark):
    from tidewatt.operators.rollup import bucket_checksum, point_checksum

    one, three = rows(spark, [(1, 1)]), rows(spark, [(1, 1)] * 3)
    assert point_checksum(one).first()["checksum"] != point_checksum(three).first()["checksum"]
    buckets = U.build(R.winners(one), FIVE, 2 * SEC)
    assert bucket_checksum(buckets).first()["checksum"] != bucket_checksum(buckets.unionByName(buckets).unionByName(buckets)).first()["checksum"]


def test_rollup_in_sql(spark, root):
    with EngineStore.open(spark, root) as store:
        store.commit(definitions(series=(1, 2)))
        store.append(rows(spark, [(k * SEC * 3 // 2, k % 7) for k in range(40)]).unionByName(rows(spark, [(0, 9)], 2)))
        store.append(rows(spark, [(6 * SEC, 100)]))
        sql.register(spark, store)
        names = "bucket_start, bucket_end, count, sum, min, max, integral, covered"
        got = spark.sql(f"SELECT {names} FROM gauge_rollup(1, {3 * SEC}, {50 * SEC}, {5 * SEC}, {2 * SEC})").collect()
        want = U.latest_rollup(R.in_range(store.points(), 3 * SEC, 50 * SEC, 1), FIVE, 2 * SEC).select(*names.split(", ")).collect()
        assert len(want) == 10 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_maintenance_by_elapsed_time(spark, root, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.json").write_text(json.dumps(body(A, k + 1, k + 1, [(k * DAY + 1, k)])))
    ticks = iter([0, 5, 12, 13, 40])
    seen = []
    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        store.maintain = lambda now: seen.append(now)
        stream = wire.read_batches(spark, str(folder), stream=True, files_per_trigger=1)
        start_ingest(store, stream, f"file://{tmp_path}/checkpoint", maintain_after=10, clock=lambda: next(ticks)).awaitTermination()
    assert seen == [12, 40]


def test_late_points_of_a_long_gap(spark):
    from tidewatt.plans import coverage

    year = 366 * DAY
    held = spark.createDataFrame([(1, "a", 100 * year, 101 * year, 1, "x"), (1, "b", 5 * DAY, 6 * DAY, 1, "x"), (2, "b", 5 * DAY, 6 * DAY, 1, "x")], S.DESCRIPTORS)
    for gap, times, want in ((SEC, [5 * DAY - SEC], {"b"}), (SEC, [5 * DAY - SEC - 1, 6 * DAY + 1], set()), (SEC, [6 * DAY], {"b"}), (90 * year, [11 * year], {"a"}), (1 << 62, [4 * DAY], {"a", "b"}), (90 * year, [102 * year], set())):
        points = rows(spark, [(t, 1) for t in times])
        gaps = spark.createDataFrame([(1, gap), (2, gap)], "series_id long, gap long")
        got = coverage.dirty(points, held, gaps).collect()
        assert {r["resolution_key"] for r in got} == want and len(got) == len(want)


def test_publishing_by_bytes_and_export(spark, root, tmp_path):
    with EngineStore.open(spark, root, Config(durability="every", every_bytes=700)) as store:
        store.commit(definitions())
        seen = []
        for k in range(12):
            store.commit(batch(spark, A, k + 1, k + 1, [(k * SEC, k)]))
            seen.append(store.watermarks(A)["durable"])
        assert seen[0] is None and any(x for x in seen) and seen == sorted(seen, key=lambda x: x or 0) and len(set(seen)) < 8
        store.flush()
        assert store.watermarks(A) == {"accepted": 12, "durable": 12}
        store.seal()
        store.append(rows(spark, [(99 * SEC, 1)]))
        assert store.create_segment(f"file://{tmp_path}/out")["points"] == 13
        with pytest.raises(InvalidArgument):
            store.create_segment(f"file://{tmp_path}/out")
        names = ["series_id", "valid_time", "value"]
        assert sorted(spark.read.parquet(f"file://{tmp_path}/out").select(*names).collect()) == sorted(store.points().select(*names).collect())
    for wrong in ({"durability": "every"}, {"every_bytes": 5}):
        with pytest.raises(ConfigError):
            Config(**wrong)


def test_many_spans(spark):
    from tidewatt import store as module

    table = spark.range(1000).select(F.col("id").alias("bucket_start"), (F.col("id") + 1).alias("bucket_end"))
    spans = [(k, k + 2) for k in range(0, 1000, 10)]
    assert len(spans) > module.MAX_ARMS and module._within(table, spans).count() == 200 == sum(module._within(table, spans[a : a + 50]).count() for a in (0, 50))


def test_manifest_falls_back_to_the_last_whole_generation(spark, root, tmp_path):
    with EngineStore.open(spark, root) as store:
        store.append(rows(spark, [(1, 1)]))
        store.append(rows(spark, [(2, 2)]))
        newest = store.manifest["generation"]
    path = tmp_path / "store" / "manifests" / f"{newest:012d}.json"
    path.write_text("{")
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    with EngineStore.open(spark, root, read_only=True) as store:
        assert store.points().count() == 1
    for p in path.parent.glob("*.json"):
        p.write_text("{")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(StorageFault):
        EngineStore.open(spark, root, read_only=True)


def body(source, sequence, commit, values, **upserts):
    points = [{"series_id": 1, "valid_time": t, "valid_time_end": t, "knowledge_time": t, "change_time": t, "run_id": S.ZERO_ID, "value": float(v), "quality": 0, "flags": 0} for t, v in values]
    return {"source_id": source, "sequence": sequence, "commit_id": S.hex_id(commit), "points": points, **upserts}


def test_frames():
    frame = body(A, 1, 1, [(1, 2)])
    assert wire.decode(wire.encode("CommitBatch", frame)) == ("CommitBatch", frame)
    assert wire.decode(wire.encode("Hello", {"source_id": A})) == ("Hello", {"source_id": A})
    raw = wire.encode("CommitBatch", frame)
    for wrong in (raw.replace(b"2.0", b"3.0"), raw.replace(b"TWIN", b"NONE"), b"{}", b"\xff"):
        with pytest.raises(InvalidArgument):
            wire.decode(wrong)
    for wrong, error in ((body(S.ZERO_ID, 1, 1, [(1, 1)]), InvalidArgument), (body(A, 1, 1, []), InvalidArgument), (body(A, 1, 1, [(1, float("inf"))]), ModelError), (body(A, 1, 1, [(1, 1)] * 16385), LimitError)):
        with pytest.raises(error):
            wire.encode("CommitBatch", wrong)


def test_streaming_ingest_and_reconciliation(spark, root, tmp_path):
    site = {"id": S.hex_id(1), "kind": "site", "name": "a", "valid_from": 0}
    series = {"id": 1, "owner_entity": S.hex_id(1), "name": "s", "physical_quantity": "power", "canonical_unit": "W", "semantics": "Gauge"}
    folder = tmp_path / "in"
    folder.mkdir()
    good = [body(A, 1, 1, [(1, 1)], entities=[site], series=[series]), body(A, 2, 2, [(2, 2), (3, 3)]), body(B, 7, 3, [(4, 4)])]
    (folder / "a.json").write_text("\n".join(map(json.dumps, [*good, good[0], body(B, 8, 3, [(9, 9)]), body(B, 9, 4, [(9, float(5))]) | {"points": [dict(body(B, 9, 4, [(9, 9)])["points"][0], series_id=77)]}])))
    seen = []
    with EngineStore.open(spark, root) as store:
        start_ingest(store, wire.read_batches(spark, str(folder), stream=True), f"file://{tmp_path}/checkpoint", lambda n, out: seen.extend(out), seal_segments=2).awaitTermination()
        assert sorted(o["outcome"] for o in seen) == ["CommitIdConflict", "ModelError", "accepted", "accepted", "accepted", "replayed"]
        assert store.points().count() == 4 and sum(p["sealed"] for p in store.manifest["points"]) == 1
        assert {o["outcome"] for o in apply_batches(store, wire.read_batches(spark, str(folder)))} == {"replayed", "CommitIdConflict", "ModelError"}
        sent = tmp_path / "sent"
        sent.mkdir()
        (sent / "a.json").write_text("\n".join(map(json.dumps, good)))
        report = cli.reconcile_store(spark, store, str(sent))
        assert report["content_matches"] and report["ready_to_release_source_copy"] and report["points"]["matched"] == 4
        (sent / "a.json").write_text("\n".join(map(json.dumps, [*good[:2], body(B, 7, 3, [(4, 5)]), body(B, 70, 30, [(5, 5)])])))
        report = cli.reconcile_store(spark, store, str(sent))
        assert not report["content_matches"] and report["points"]["missing"] == 2 and report["receipts"]["missing"] == 1 and len(report["details"]) >= 3
        sql.register(spark, store)
        assert spark.sql("SELECT * FROM points_as_of(2)").count() == 2 and spark.sql("SELECT * FROM tidewatt_latest").count() == 4
        assert spark.sql(f"SELECT value FROM points_of_run('{S.ZERO_ID}') WHERE valid_time = 4").collect()[0][0] == 4


def test_batches_committed_together_are_as_one_by_one(spark, root, tmp_path):
    """Outcomes, receipts, points and watermarks; one generation instead of one a batch."""
    stray = body(A, 4, 4, [(4, 4)])
    stray["points"][0]["series_id"] = 77
    ends = body(A, 5, 5, [(5, 5)])
    ends["points"][0]["valid_time_end"] = 1
    sent = [body(A, 1, 1, [(1, 1), (2, 0.1)]), body(A, 1, 1, [(1, 1), (2, 0.1)]), body(A, 2, 2, [(3, -2.5e-7)]), body(A, 3, 2, [(3, 3)]), stray, ends,
            body(B, 1, 6, [(6, 6)]), body(B, 1, 7, [(7, 7)]), body(B, 2, 8, []), body(S.ZERO_ID, 1, 9, [(9, 9)]), body(B, 3, 10, [(DAY + 1, 1e300)])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, sent)))
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "a.json").write_text("\n".join(map(json.dumps, [sent[0], sent[2], body(A, 0, 20, [(1, 1)]), sent[6]])))
    found = []
    for k, config in enumerate((Config(max_store_bytes=1 << 40), Config())):
        with EngineStore.open(spark, f"{root}-{k}", config) as store:
            store.commit(definitions())
            before = store.manifest["generation"]
            seen = apply_batches(store, wire.read_batches(spark, str(tmp_path / "in")))
            assert store.manifest["generation"] - before == (1 if k else 4) and not files.names(spark, f"{root}-{k}/stage")
            seen += apply_batches(store, wire.read_batches(spark, str(tmp_path / "again")))
            assert store.check_integrity()["ok"]
            found.append((seen, sorted(store.commits().collect()), sorted(store.points().collect()), store.all_watermarks(), store.manifest["next_commit"]))
    assert found[0] == found[1]
    assert sorted(o["outcome"] for o in found[0][0]) == sorted(["accepted"] * 4 + ["replayed"] * 4 + ["CommitIdConflict", "ModelError", "ModelError", "SourceSequenceConflict", "InvalidArgument", "InvalidArgument", "SequenceNotIncreasing"])


def test_bounded_writer(spark, root):
    with EngineStore.open(spark, root) as store:
        store.commit(definitions())
        writer = BoundedWriter(store, max_entries=1, max_points=3)
        with pytest.raises(LimitError):
            writer.try_submit(body(A, 1, 1, [(k, k) for k in range(4)]))
        first = writer.try_submit(body(A, 1, 1, [(1, 1)]))
        with pytest.raises(Overloaded):
            for _ in range(100):
                writer.try_submit(body(A, 2, 2, [(2, 2)]))
        second = writer.submit_until(body(A, 1, 9, [(2, 2)]), time.monotonic() + 120)
        assert first.result().points == 1
        with pytest.raises(SourceSequenceConflict):
            second.result()
        writer.flush_until(time.monotonic() + 120, A, 1).result()
        assert writer.health()["state"] == "running" and writer.health()["watermarks"][A]["durable"] == 1
        store.poisoned = True
        with pytest.raises(StorageFault):
            writer.submit_until(body(A, 3, 3, [(3, 3)]), time.monotonic() + 120).result()
        with pytest.raises(StorageFault):
            while True:
                writer.try_submit(body(A, 4, 4, [(3, 3)]))
        writer.close()
        store.poisoned = False


def test_tsbs(spark, tmp_path):
    lines = ["readings,name=truck_1,fleet=South latitude=52.5,velocity=3i 1451606400000000000", "diagnostics,name=truck_1,fleet=South fuel_state=0.5,status=2i 1451606400000001000", "readings,fleet=South velocity=9 1451606410000000000"]
    (tmp_path / "a").write_text("\n".join(lines))
    out = tsbs.read_tsbs(spark, str(tmp_path / "a"))
    key = tsbs.tag_key({"name": "truck_1", "fleet": "South"})
    got = {S.unsigned(r["series_id"]): (r["valid_time"], r["value"]) for r in out["points"].collect()}
    assert got[key * 16 + 4] == (1451606400000000, 52.5) and got[key * 16 + 16] == (1451606400000001, 2.0) and len(got) == 5
    assert {r["name"] for r in out["entities"].collect()} == {"truck_1", f"missing-name-{tsbs.tag_key({'fleet': 'South'}):015x}"}
    assert {r["semantics"] for r in out["series"].collect() if r["name"] == "diagnostics.status"} == {"State"}
    for bad in ("other a=1 1000", "readings a=1 1001", "readings,x=1 velocity=1 1000", "readings velocity=z 1000", "readings velocity=1 1000 9", "readings velocity=1,velocity=2 1000", "readings speed=1 1000"):
        (tmp_path / "b").write_text(bad)
        with pytest.raises(ModelError):
            tsbs.read_tsbs(spark, str(tmp_path / "b"))


def test_replay(spark, tmp_path):
    text = "driver_id,series_id,offset_ms,value\n1,10,0,1.5\n1,10,1000,2.5\n2,18446744073709551615,5,3\n"
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(text)
    out = replay.read_replay(spark, str(tmp_path / "p.csv.gz"))
    assert sorted((r["series_id"], r["valid_time"] - replay.ORIGIN_MICROS, r["value"]) for r in out["points"].collect()) == [(-1, 5000, 3.0), (10, 0, 1.5), (10, 1_000_000, 2.5)]
    assert out["entities"].count() == 2 and out["series"].count() == 2
    assert {(r["driver"], r["metric"], r["ts_ms"]) for r in replay.samples(out["points"], out["series"]).where("metric = 's10'").collect()} == {("d1", "s10", replay.ORIGIN_MICROS // 1000), ("d1", "s10", replay.ORIGIN_MICROS // 1000 + 1000)}
    for bad in ("a,b\n", text.replace("2,184", "0,184"), text + "2,10,7,1\n", text + "1,10,x,1\n", text.replace("1.5", "inf")):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ModelError):
            replay.read_replay(spark, str(tmp_path / "bad.csv"))


def test_workload_bundle_and_command_line(spark, tmp_path, capsys):
    config = workload.WorkloadConfig()
    made = workload.generate(spark, config)
    assert made["points"].count() == 65_958 and made["series"].count() == 9 and made["runs"].count() == 14 and made["plans"].count() == 7
    week = made["points"].where(f"series_id = 1 and valid_time < {config.start_micros + 7 * DAY}")
    assert U.build(R.winners(week), Resolution(micros=300 * SEC), 180 * SEC).count() == 2016
    assert workload.generate(spark, workload.WorkloadConfig(sites=2, days=1))["points"].where("series_id < 100").exceptAll(workload.generate(spark, workload.WorkloadConfig(sites=1, days=1))["points"]).count() == 0
    with pytest.raises(ConfigError):
        workload.WorkloadConfig(sites=257)
    assert len(workload.batches(workload.generate(spark, workload.WorkloadConfig(days=1, cadence_seconds=3600))["points"], 400)) == 3
    bundle, store = f"file://{tmp_path}/bundle", f"file://{tmp_path}/store"
    run = lambda *args: (cli.main([str(a) for a in args], spark), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert run("generate", bundle, "--days", 1, "--cadence-seconds", 900)[0] == 0
    assert run("load", store, bundle)[1]["points"] == workload.read_bundle(spark, bundle)["points"].count()
    assert run("maintain", store, workload.START_MICROS + 2 * DAY)[1]["built"] > 0
    assert run("seal", store)[1]["files"] == 1
    assert run("inspect", store)[1]["series"] == 9
    assert run("check-store", store) [0] == 0
    assert run("backup", store, f"file://{tmp_path}/b")[0] == 0 and run("restore", f"file://{tmp_path}/b", f"file://{tmp_path}/c")[0] == 0
    assert run("salvage", f"file://{tmp_path}/c", f"file://{tmp_path}/d")[0] == 0
    assert run("restore", f"file://{tmp_path}/nothing", f"file://{tmp_path}/e") [0] == 2
    files.delete(spark, bundle + "/snapshot/points")
    made["points"].limit(3).write.parquet(bundle + "/snapshot/points")
    with pytest.raises(StorageFault):
        workload.read_bundle(spark, bundle)
