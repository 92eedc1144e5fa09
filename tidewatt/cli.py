"""Command line: inspect, check-store, seal, sweep, maintain, backup, restore, salvage, generate, ingest, reconcile.

Prints one JSON object. Exit status: 0 fine, 2 an error, 3 found something wrong.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from tidewatt.errors import TidewattError
from tidewatt.operators import reconcile
from tidewatt.sources import wire, workload
from tidewatt.store import EngineStore, Transaction, restore_from, salvage_from
from tidewatt import schemas as S


def session(master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("tidewatt").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def expected_tables(spark: SparkSession, path: str):
    """Points, upserts and receipts that a folder of batches says were sent."""
    batches = wire.read_batches(spark, path)
    points = batches.select(F.explode("points").alias("p")).select("p.*")
    upserts = {kind: batches.select("sequence", F.posexplode(kind).alias("k", "o")).select("o.*", (F.col("sequence") * 65536 + F.col("k")).alias("commit_seq")) for kind in wire.ORDER}
    counts = [F.coalesce(F.size(k), F.lit(0)) for k in wire.ORDER]
    records = sum((c for c in counts), F.when(F.size("points") > 0, 1).otherwise(0))
    receipts = batches.select("source_id", "sequence", "commit_id", records.cast("long").alias("records"), F.greatest(F.size("points"), F.lit(0)).cast("long").alias("points"), F.lit(None).cast("string").alias("payload_sha"))
    return points, upserts, receipts


def reconcile_store(spark: SparkSession, store: EngineStore, path: str) -> dict:
    points, upserts, receipts = expected_tables(spark, path)
    current = store.catalog()
    durable = spark.createDataFrame([(k, v["durable"]) for k, v in store.all_watermarks().items()] or [(S.ZERO_ID, None)], "source_id string, durable long")
    return reconcile.report(points, store.points(), {k: (upserts[k], current[k]) for k in wire.ORDER}, receipts.drop("payload_sha").join(store.commits().select("source_id", "sequence", "payload_sha"), ["source_id", "sequence"], "left"), store.commits(), durable)


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[dict, int]:
    if args.command == "restore":
        return restore_from(spark, args.source, args.target), 0
    if args.command == "salvage":
        out = salvage_from(spark, args.source, args.target)
        return out, 0 if out["complete"] else 3
    if args.command == "generate":
        config = workload.WorkloadConfig(args.seed, args.sites, args.days, args.cadence_seconds)
        return workload.write_bundle(workload.generate(spark, config), args.target, args.seed), 0
    with EngineStore.open(spark, args.store, read_only=args.command in ("inspect", "check-store", "backup", "reconcile")) as store:
        if args.command == "inspect":
            return store.stats(), 0
        if args.command == "check-store":
            out = store.check_integrity()
            return out, 0 if out["ok"] else 3
        if args.command == "seal":
            return store.seal(), 0
        if args.command == "sweep":
            return {"deleted": store.sweep()}, 0
        if args.command == "maintain":
            out = store.maintain(args.now)
            return {**out, "gates": [r.asDict() for r in out["gates"].collect()]}, 0
        if args.command == "backup":
            return store.backup_to(args.target), 0
        if args.command == "reconcile":
            out = reconcile_store(spark, store, args.batches)
            return out, 0 if out["ready_to_release_source_copy"] else 3
        if args.command == "load":
            tables = workload.read_bundle(spark, args.bundle)
            tx = Transaction()
            for kind in ("entities", "series", "runs", "plans"):
                tx.upsert(kind, *[r.asDict(recursive=True) for r in tables[kind].collect()])
            store.commit(tx)
            return {"points": store.append(tables["points"]).points}, 0
        from tidewatt.streaming.ingest import apply_batches

        return {"outcomes": apply_batches(store, wire.read_batches(spark, args.batches))}, 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatt", description=__doc__)
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, extra in {"inspect": [], "check-store": [], "seal": [], "sweep": [], "maintain": ["now"], "backup": ["target"], "ingest": ["batches"], "load": ["bundle"], "reconcile": ["batches"]}.items():
        p = sub.add_parser(name)
        p.add_argument("store")
        for x in extra:
            p.add_argument(x, type=int if x == "now" else str)
    for name in ("restore", "salvage"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
    p = sub.add_parser("generate")
    p.add_argument("target")
    for name, value in (("seed", 42), ("sites", 1), ("days", 7), ("cadence_seconds", 60)):
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=int, default=value)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out, status = run(args, spark or session(args.master))
    except TidewattError as error:
        print(json.dumps({"error": type(error).__name__, "detail": str(error)}))
        return 2
    print(json.dumps(out, sort_keys=True, default=str))
    return status


if __name__ == "__main__":
    sys.exit(main())
