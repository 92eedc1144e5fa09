"""The store: Parquet files made visible by a versioned manifest.

    manifests/<generation>.json   what is visible; a new one is published by a rename
    points/file=<id>/             points by UTC day, sorted by series and time
    catalog/<kind>/<file>/        upsert logs; like those of commits, a name begins with its first commit and level
    commits/<file>/               commits and ingress receipts
    stats/<file>/                 per file of points: points and bounds of each series
    descriptors/<file>/           all current rollup descriptors
    rollups/<file>/               buckets
    stage/<file>/                 batches while they are applied

Readers never list directories. One writer holds ``writer.lock``. A commit writes its files,
then publishes one manifest that also drops the descriptors its points make wrong: points
and rollups cannot disagree, whenever a writer stops. Later maintenance only adds files.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatt import errors, schemas as S
from tidewatt.errors import (
    CommitIdConflict, ConfigError, InvalidArgument, LimitError, LockedError, ModelError, NotAccepted, ReadOnlyError, SequenceNotIncreasing,
    SourceChanged, SourceSequenceConflict, StorageFault, TidewattError)
from tidewatt.functions import floor_to
from tidewatt.operators import aggregates as A, catalog as C, revisions as R, rollup as U
from tidewatt.plans import coverage as P
from tidewatt.schemas import Resolution
from tidewatt.sources import files

#: Manifest generations kept.
KEEP_GENERATIONS = 3
#: Log files of one level that are merged into one of the next: a log of n commits is a few files times the logarithm of n.
MERGE_LOGS = 16
_POINTS_STORED = [*S.POINT_FIELDS, "valid_day"]


@dataclass
class Config:
    durability: str = "always"  # or "manual": visible to this handle, published by flush(); or "every": by as many bytes
    every_bytes: int = 0
    max_batch_points: int = S.MAX_BATCH_POINTS
    max_batch_bytes: int = S.MAX_BATCH_BYTES
    max_store_bytes: int | None = None
    min_free_bytes: int | None = None

    def __post_init__(self):
        if self.durability not in ("always", "manual", "every"):
            raise ConfigError(f"unknown durability {self.durability}")
        if (self.every_bytes > 0) != (self.durability == "every"):
            raise ConfigError("every_bytes is for the durability \"every\", and positive")
        if not 0 < self.max_batch_points <= 1 << S.BATCH_BITS or self.max_batch_bytes <= 0:
            raise ConfigError("a batch limit is out of range")


@dataclass
class Transaction:
    """Upserts and points that become visible together."""

    commit_id: str | None = None
    source_id: str | None = None
    sequence: int | None = None
    upserts: dict[str, list] = field(default_factory=dict)
    points: DataFrame | None = None

    def upsert(self, kind: str, *rows: dict) -> Transaction:
        if kind not in S.CATALOG:
            raise InvalidArgument(f"unknown kind {kind}")
        self.upserts.setdefault(kind, []).extend(rows)
        return self

    def append_points(self, points: DataFrame) -> Transaction:
        self.points = points if self.points is None else self.points.unionByName(points)
        return self

    def with_commit_id(self, commit_id: str) -> Transaction:
        self.commit_id = commit_id
        return self

    def with_ingress_identity(self, source_id: str, sequence: int, commit_id: str) -> Transaction:
        self.source_id, self.sequence, self.commit_id = source_id, sequence, commit_id
        return self

    @property
    def records(self) -> int:
        return sum(map(len, self.upserts.values())) + (self.points is not None)


@dataclass
class Commit:
    commit_seq: int | None
    records: int
    points: int
    deduplicated: bool = False


@dataclass
class RollupQuery:
    buckets: DataFrame
    source: str  # Materialized, Hybrid or Raw
    generation: int


def _content(df: DataFrame) -> tuple[int, int | None, int | None, str]:
    """Rows, bounds of the valid time and an order-free checksum (a sum: equal rows do not cancel) of a table of points."""
    hashed = F.xxhash64(*[F.col(c).cast("string") for c in S.POINT_FIELDS]).cast("decimal(20,0)")
    row = df.agg(F.count("*"), F.min("valid_time"), F.max("valid_time"), F.sum(hashed)).first()
    return row[0], row[1], row[2], str(row[3] or 0)


def _log_name(folder: str, first: int, level: int) -> str:
    return f"{folder}/{first:016d}-{level:02d}-{uuid.uuid4().hex}"


def _first_commit(name: str) -> int:
    return int(name.rsplit("/", 1)[1].split("-")[0])


def _level(name: str) -> int:
    return int(name.rsplit("/", 1)[1].split("-")[1])


class EngineStore:
    """A handle on a store; ``open`` one for reading or, alone, for writing."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict, config: Config, token: str | None):
        self.spark, self.root, self.manifest, self.config, self.token = spark, root, manifest, config, token
        self.published = manifest["generation"]
        self.poisoned = False
        self.pending_bytes = 0

    # --- opening ---

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config | None = None, read_only: bool = False) -> EngineStore:
        root = root.rstrip("/")
        token = None
        if not read_only:
            files.make(spark, f"{root}/manifests")
            token = uuid.uuid4().hex
            if not files.create_text(spark, f"{root}/writer.lock", token):
                raise LockedError(f"{root} has a writer")
        try:
            return cls(spark, root, cls._load(spark, root), config or Config(), token)
        except Exception:
            if token:
                files.delete(spark, f"{root}/writer.lock")
            raise

    @staticmethod
    def _load(spark: SparkSession, root: str) -> dict:
        """The newest manifest that can be read; an empty one for a new store."""
        found = [n for n in files.names(spark, f"{root}/manifests") if n.endswith(".json")]
        for name in reversed(found):
            try:
                manifest = json.loads(files.read_text(spark, f"{root}/manifests/{name}"))
                if manifest["format"] == 1:
                    return manifest
            except (ValueError, KeyError, TypeError):
                continue
        if found:
            raise StorageFault(f"no manifest of {root} can be read")
        return {"format": 1, "generation": 0, "next_commit": 1, "points": [], "catalog": {k: [] for k in S.CATALOG}, "commits": [], "descriptors": None, "n_descriptors": 0, "sources": {}}

    def close(self) -> None:
        if self.token:
            if not self.poisoned:
                self.flush()
            files.delete(self.spark, f"{self.root}/writer.lock")
            self.token = None

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()

    def _writable(self) -> None:
        if not self.token:
            raise ReadOnlyError("the store is open for reading only")
        if self.poisoned:
            raise StorageFault("the writer failed; open the store again")

    def _publish(self, manifest: dict, durable: bool = True) -> None:
        """Make ``manifest`` the current one; the only moment at which anything becomes visible."""
        manifest = {**manifest, "generation": self.manifest["generation"] + 1}
        if durable:
            manifest["sources"] = {k: {**v, "durable": v["accepted"]} for k, v in manifest["sources"].items()}
            try:
                files.publish_text(self.spark, f"{self.root}/manifests/{manifest['generation']:012d}.json", json.dumps(manifest, sort_keys=True))
            except Exception:
                self.poisoned = True
                raise
            self.published, self.pending_bytes = manifest["generation"], 0
            for name in [n for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")][:-KEEP_GENERATIONS]:
                files.delete(self.spark, f"{self.root}/manifests/{name}")
        self.manifest = manifest

    def flush(self, source_id: str | None = None, through: int | None = None) -> None:
        """Publish what has been accepted; with a cursor, only if it has been accepted."""
        self._writable()
        if source_id is not None and through is not None and (self.manifest["sources"].get(source_id, {}).get("accepted") or -1) < through:
            raise NotAccepted(f"{source_id}: {through} has not been accepted")
        if self.published != self.manifest["generation"]:
            self._publish(self.manifest)

    # --- reading ---

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def points(self) -> DataFrame:
        """All points, with the partition column ``valid_day``."""
        paths = [self._path(p["path"]) for p in self.manifest["points"]]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.POINTS.fields) + ", valid_day bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", file string").option("basePath", self._path("points")).parquet(*paths).select(*_POINTS_STORED)

    def catalog(self) -> dict[str, DataFrame]:
        """The current objects of each kind: the last upsert of each id."""
        return {kind: self._current(kind, self.manifest["catalog"][kind]) for kind in S.CATALOG}

    def _log(self, kind: str, paths: list[str]) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType([*S.CATALOG[kind].fields, T.StructField("commit_seq", T.LongType())])
        return self.spark.read.schema(schema).parquet(*[self._path(p) for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _log_frame(self, kind: str | None, paths: list[str]) -> DataFrame:
        """The rows of log files of a kind; of the commits if there is none."""
        if kind is not None:
            return self._log(kind, paths)
        return self.spark.read.schema(S.RECEIPTS).parquet(*[self._path(p) for p in paths]) if paths else self.spark.createDataFrame([], S.RECEIPTS)

    def _current(self, kind: str, paths: list[str]) -> DataFrame:
        return C.last_wins(self._log(kind, paths))

    def commits(self) -> DataFrame:
        return self._log_frame(None, self.manifest["commits"])

    def descriptors(self) -> DataFrame:
        path = self.manifest["descriptors"]
        return self.spark.read.schema(S.DESCRIPTORS).parquet(self._path(path)) if path else self.spark.createDataFrame([], S.DESCRIPTORS)

    def active_rollups(self) -> DataFrame:
        return self.descriptors().orderBy("series_id", "resolution_key", "start")

    def buckets(self) -> DataFrame:
        names = [r[0] for r in self.descriptors().where("path is not null").select("path").distinct().collect()]  # a row a maintenance run
        return self.spark.read.schema(S.BUCKETS).parquet(*[self._path(n) for n in names]) if names else self.spark.createDataFrame([], S.BUCKETS)

    def latest(self, series=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return R.latest(self.points(), start, end, series)

    def as_of(self, moment: int, series=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return R.as_of(self.points(), moment, start, end, series)

    def history(self, series=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return R.history(self.points(), start, end, series)

    def run(self, run_id: str, series=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return R.of_run(self.points(), run_id, start, end, series)

    def receipt(self, source_id: str, sequence: int):
        return self.commits().where((F.col("source_id") == source_id) & (F.col("sequence") == sequence)).first()

    def watermarks(self, source_id: str) -> dict | None:
        return self.manifest["sources"].get(source_id)

    def all_watermarks(self) -> dict[str, dict]:
        return dict(sorted(self.manifest["sources"].items()))

    def contains_commit(self, commit_id: str) -> bool:
        return bool(self.commits().where(F.col("commit_id") == commit_id).limit(1).count())

    def stats(self) -> dict:
        row = self.points().agg(F.count("*").alias("points"), F.countDistinct("series_id").alias("series")).first()
        return {"points": row["points"], "series": row["series"], "generation": self.manifest["generation"], "segments": len(self.manifest["points"]), "sealed": sum(p["sealed"] for p in self.manifest["points"]), "rollups": self.manifest["n_descriptors"], "stored_bytes": files.size(self.spark, self.root)}

    # --- writing ---

    def _write(self, df: DataFrame, folder: str, name: str | None = None) -> str:
        name = name or f"{folder}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(self._path(name))
        return name

    def _add_log(self, held: list[str], folder: str, schema, frame: DataFrame, commit_seq: int) -> list[str]:
        """``held`` and one more file; ``MERGE_LOGS`` files of a level become one of the next."""
        held = [*held, self._write(frame.coalesce(1), folder, _log_name(folder, commit_seq, 0))]
        while len(held) >= MERGE_LOGS and len({_level(x) for x in held[-MERGE_LOGS:]}) == 1:
            last = held[-MERGE_LOGS:]
            merged = self.spark.read.schema(schema).parquet(*[self._path(x) for x in last]).coalesce(1)
            held = [*held[:-MERGE_LOGS], self._write(merged, folder, _log_name(folder, _first_commit(last[0]), _level(last[0]) + 1))]
        return held

    def _write_points(self, points: DataFrame, sealed: bool, commit_seq: int, small: bool = False) -> dict:
        """A batch within the limits is one file a day, a load is dealt by range. Sorted by series and time within UTC days: row-group statistics act as a sparse index."""
        stored = points.select(*S.POINT_FIELDS, floor_to(F.col("valid_time"), S.DAY).alias("valid_day"))
        dealt = (stored.coalesce(1) if small else stored.repartitionByRange("valid_day", "series_id", "valid_time")).sortWithinPartitions("valid_day", "series_id", "valid_time", "knowledge_time", "change_time", "append_seq")
        name = f"points/file={uuid.uuid4().hex}"
        try:
            dealt.write.mode("errorifexists").partitionBy("valid_day").parquet(self._path(name))
        except Exception:
            files.delete(self.spark, self._path(name))
            raise
        if not files.names(self.spark, self._path(name)) or all(n.startswith("_") for n in files.names(self.spark, self._path(name))):
            return {"path": name, "points": 0, "low": None, "high": None, "checksum": "0", "sealed": sealed, "commit": commit_seq, "first": commit_seq}
        n, low, high, checksum = _content(self._segment(name))
        stats = self._write(R.series_stats(self._segment(name)).coalesce(1), "stats")
        return {"path": name, "points": n, "low": low, "high": high, "checksum": checksum, "sealed": sealed, "commit": commit_seq, "first": commit_seq, "stats": stats}

    def series_bounds(self) -> DataFrame:
        """(series_id, revisions, min_valid, max_valid) of all points, from the files' own tables: a row a series and file."""
        names = [self._path(p["stats"]) for p in self.manifest["points"] if p.get("stats")]
        schema = "series_id long, revisions long, min_valid long, max_valid long, max_valid_end long"
        if not names:
            return self.spark.createDataFrame([], schema).drop("max_valid_end")
        return self.spark.read.schema(schema).parquet(*names).groupBy("series_id").agg(F.sum("revisions").alias("revisions"), F.min("min_valid").alias("min_valid"), F.max("max_valid").alias("max_valid"))

    def _segment(self, name: str) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.POINTS.fields) + ", valid_day bigint"
        return self.spark.read.schema(schema).parquet(self._path(name))

    def _numbered(self, points: DataFrame, commit_seq: int, small: bool) -> tuple[DataFrame, int]:
        """Points with ``append_seq`` from their order in the batch; commit numbers used.

        Without a number of its own (no column, or nulls), a point of a transaction has its place in it; in a bulk
        load only points of equal keys have to be told apart, and are by their other values: the greatest wins.
        """
        if "append_seq" not in points.columns or not points.where("append_seq is null").isEmpty():
            if small:
                place = F.monotonically_increasing_id()
                points = (points.orderBy(F.col("append_seq").asc_nulls_first()) if "append_seq" in points.columns else points).coalesce(1).withColumn("append_seq", place)
            else:
                own = F.col("append_seq").cast("long") if "append_seq" in points.columns else F.lit(None).cast("long")
                key = Window.partitionBy("series_id", "valid_time", "knowledge_time", "change_time")
                place = F.row_number().over(key.orderBy("given", "run_id", "value", "valid_time_end", "quality", "flags"))
                # what has a number keeps it; the rest comes before it
                points = points.withColumn("given", own).withColumn("append_seq", F.coalesce("given", place - (1 << 20))).drop("given")
        bounds = points.agg(F.min("append_seq"), F.max("append_seq")).first()
        low = bounds[0] or 0
        width = 1 + ((bounds[1] or 0) - low >> S.BATCH_BITS)
        base = commit_seq << S.BATCH_BITS
        return points.withColumn("append_seq", F.lit(base) + F.col("append_seq") - low), width

    def append(self, points: DataFrame) -> Commit:
        """Bulk load without catalogue checks; ``append_seq`` gives the order of equal keys."""
        self._writable()
        C.refuse(C.point_rules(points))
        seq = self.manifest["next_commit"]
        numbered, width = self._numbered(points, seq, small=False)
        segment = self._write_points(numbered, False, seq)
        if not segment["points"]:
            files.delete(self.spark, self._path(segment["path"]))
            return Commit(None, 0, 0)
        manifest = {**self.manifest, "next_commit": seq + width, "points": [*self.manifest["points"], segment]}
        self._finish(manifest, segment, files.size(self.spark, self._path(segment["path"])))
        return Commit(seq, 0, segment["points"])

    def _finish(self, manifest: dict, segment: dict | None, size: int) -> None:
        if segment and segment["points"] and self.manifest["n_descriptors"]:
            manifest = self._invalidate(manifest, self._segment(segment["path"]))
        self.pending_bytes += size
        c = self.config
        self._publish(manifest, durable=c.durability == "always" or c.durability == "every" and self.pending_bytes >= c.every_bytes)

    def _invalidate(self, manifest: dict, points: DataFrame) -> dict:
        """Late data: descriptors that the points reach go, the rest stays current."""
        held = self.descriptors()
        gaps = self.catalog()["series"].select(F.col("id").alias("series_id"), F.col("maximum_gap_micros").alias("gap"))
        keep = held.join(P.dirty(points, held, gaps).select("series_id", "resolution_key", "start"), ["series_id", "resolution_key", "start"], "left_anti").select(*held.columns)
        return self._with_descriptors(manifest, keep)

    def _with_descriptors(self, manifest: dict, descriptors: DataFrame) -> dict:
        name = self._write(descriptors, "descriptors")
        return {**manifest, "descriptors": name, "n_descriptors": self.spark.read.schema(S.DESCRIPTORS).parquet(self._path(name)).count()}

    def _payload(self, tx: Transaction) -> tuple[str, int, int]:
        """SHA-256 over the canonical rows, number of points, bytes. Bounded by the batch limits."""
        upserts = json.dumps(tx.upserts, sort_keys=True, default=str)
        digest = hashlib.sha256(upserts.encode())
        n = size = 0
        if tx.points is not None:
            found = tx.points.select("series_id").limit(self.config.max_batch_points + 1).count()
            if found > self.config.max_batch_points:
                raise LimitError(f"a batch of more than {self.config.max_batch_points} points")
            rows = tx.points.select(F.to_json(F.struct(*[F.col(c).cast("string") for c in sorted(tx.points.columns)])).alias("j"))
            row = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("j")), F.lit(0)).alias("size"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("j", 256))), ""), 256).alias("sha")).first()
            n, size = row["n"], row["size"]
            digest.update(row["sha"].encode())
        return digest.hexdigest(), n, size + len(upserts)

    def _guard_space(self) -> None:
        c = self.config
        if c.max_store_bytes is not None and files.size(self.spark, self.root) >= c.max_store_bytes:
            raise LimitError("the store has reached its size limit")
        if c.min_free_bytes is not None and files.free_bytes(self.spark, self.root) < c.min_free_bytes:
            raise LimitError("too little free space")

    def commit(self, tx: Transaction) -> Commit:
        """All of a transaction or nothing; identified ones are applied once."""
        self._writable()
        if tx.source_id is not None:
            return self._commit_ingress(tx)
        if not tx.records:
            return Commit(None, 0, 0)
        sha, n, size = self._payload(tx)
        if tx.commit_id is not None:
            known = self.commits().where(F.col("commit_id") == tx.commit_id).first()
            if known is not None:
                if known["source_id"] != "" or known["payload_sha"] != sha:
                    raise CommitIdConflict(tx.commit_id)
                return Commit(known["commit_seq"], known["records"], known["points"], True)
        return self._apply(tx, sha, n, size)

    def _commit_ingress(self, tx: Transaction) -> Commit:
        """Order of checks: exact replay, commit id, then the sequence."""
        if tx.source_id == S.ZERO_ID:
            raise InvalidArgument("source zero is reserved")
        if tx.commit_id is None or tx.sequence is None:
            raise InvalidArgument("an ingress identity has a sequence and a commit id")
        sha, n, size = self._payload(tx)
        known = self.receipt(tx.source_id, tx.sequence)
        if known is not None:
            if known["commit_id"] != tx.commit_id or known["payload_sha"] != sha:
                raise SourceSequenceConflict(f"{tx.source_id}: {tx.sequence}")
            return Commit(known["commit_seq"], known["records"], known["points"], True)
        if self.contains_commit(tx.commit_id):
            raise CommitIdConflict(tx.commit_id)
        last = self.manifest["sources"].get(tx.source_id, {}).get("accepted")
        if last is not None and tx.sequence <= last:
            raise SequenceNotIncreasing(f"{tx.source_id}: {tx.sequence} after {last}")
        return self._apply(tx, sha, n, size)

    def commit_together(self, heads: list, frames: DataFrame) -> list[Commit | TidewattError]:
        """Identified batches of points, in their order, as if each were committed by itself: a commit a head, or the
        error that refuses it. A refused batch leaves no trace, so the others need not wait for it.

        ``heads`` are rows of ``wire.heads``, ``frames`` the table of their batches. Points are written once, and one
        manifest shows all of them; numbers of commits and points are those of single commits.
        """
        self._writable()
        names = self.spark.createDataFrame([(h["frame"], h["source_id"], h["sequence"], h["commit_id"]) for h in heads], "frame long, source_id string, sequence long, commit_id string")
        log = self.commits()  # the driver has these heads, so a table of them can be broadcast
        receipts = {(r["source_id"], r["sequence"]): (r["commit_id"], r["payload_sha"], Commit(r["commit_seq"], r["records"], r["points"], True))
                    for r in log.join(F.broadcast(names.select("source_id", "sequence")), ["source_id", "sequence"], "left_semi").collect()}
        ids = {r[0] for r in log.join(F.broadcast(names.select("commit_id")), "commit_id", "left_semi").select("commit_id").collect()}
        undefined = self._undefined(frames.join(F.broadcast(names.select("frame")), "frame", "left_semi"))
        accepted = {k: v["accepted"] for k, v in self.manifest["sources"].items()}
        first = seq = self.manifest["next_commit"]
        results: list[Commit | TidewattError] = []
        taken, rows = [], []
        for h in heads:
            source, number, name = h["source_id"], h["sequence"], h["commit_id"]
            sha, size = hashlib.sha256(b"{}" + h["digest"].encode()).hexdigest() if h["digest"] else "", h["size"] + 2
            known = receipts.get((source, number))
            if h["refusal"]:
                results.append(getattr(errors, h["refusal"]["kind"])(h["refusal"]["detail"]))
            elif h["n"] > self.config.max_batch_points:
                results.append(LimitError(f"a batch of more than {self.config.max_batch_points} points"))
            elif known is not None:
                results.append(known[2] if known[:2] == (name, sha) else SourceSequenceConflict(f"{source}: {number}"))
            elif name in ids:
                results.append(CommitIdConflict(name))
            elif accepted.get(source) is not None and number <= accepted[source]:
                results.append(SequenceNotIncreasing(f"{source}: {number} after {accepted[source]}"))
            elif size > self.config.max_batch_bytes:
                results.append(LimitError(f"a batch of more than {self.config.max_batch_bytes} bytes"))
            elif h["frame"] in undefined:
                results.append(ModelError("; ".join(undefined[h["frame"]])))
            else:
                results.append(Commit(seq, 1, h["n"]))
                receipts[source, number] = (name, sha, Commit(seq, 1, h["n"], True))
                ids.add(name)
                accepted[source] = number
                taken.append((h["frame"], seq))
                rows.append((source, number, name, 1, h["n"], size, sha, seq))
                seq += 1
        if not taken:
            return results
        numbers = self.spark.createDataFrame(taken, "frame long, commit_seq long")
        points = frames.join(F.broadcast(numbers), "frame").select("commit_seq", F.posexplode("points").alias("place", "p"))
        points = points.select("p.*", (F.shiftleft("commit_seq", S.BATCH_BITS) + F.col("place")).alias("append_seq"))
        n = sum(r[4] for r in rows)
        segment = {**self._write_points(points, False, seq - 1, small=n <= S.MAX_BATCH_POINTS), "first": first}
        if segment["points"] != n:
            raise StorageFault("a commit lost points")
        manifest = {**self.manifest, "next_commit": seq, "points": [*self.manifest["points"], segment]}
        manifest["commits"] = self._add_log(manifest["commits"], "commits", S.RECEIPTS, self.spark.createDataFrame(rows, S.RECEIPTS), first)
        manifest["sources"] = {**manifest["sources"], **{r[0]: {"durable": None, **manifest["sources"].get(r[0], {}), "accepted": accepted[r[0]]} for r in rows}}
        self._finish(manifest, segment, sum(r[5] for r in rows))
        return results

    def _undefined(self, frames: DataFrame) -> dict[int, list[str]]:
        """Frames whose points name a series or run that the catalogue does not have, and which."""
        catalog, found = self.catalog(), []
        for kind, key, rule in (("series", "series_id", "point series is not defined"), ("runs", "run_id", "point run is not defined")):
            named = frames.select("frame", F.explode(F.array_distinct(F.col(f"points.{key}"))).alias("ref"))
            own = named if kind == "series" else named.where(F.col("ref") != S.ZERO_ID)
            lost = own.join(catalog[kind].select(F.col("id").alias("ref")), "ref", "left_anti")
            found.append(lost.select("frame", F.concat(F.lit(rule + " ("), F.col("ref").cast("string"), F.lit(")")).alias("text")))
        rows = found[0].unionByName(found[1]).groupBy("frame").agg(F.slice(F.array_sort(F.collect_set("text")), 1, 10).alias("texts")).collect()  # a row a frame at most
        return {r["frame"]: r["texts"] for r in rows}

    def _apply(self, tx: Transaction, sha: str, n: int, size: int) -> Commit:
        if size > self.config.max_batch_bytes:
            raise LimitError(f"a batch of more than {self.config.max_batch_bytes} bytes")
        self._guard_space()
        seq = self.manifest["next_commit"]
        manifest = {**self.manifest, "next_commit": seq + 1, "catalog": dict(self.manifest["catalog"])}
        logs = {}
        for kind, rows in tx.upserts.items():
            frame = self.spark.createDataFrame([tuple(r.get(f.name) for f in S.CATALOG[kind].fields) + (k,) for k, r in enumerate(rows)], self._log(kind, []).schema)
            logs[kind] = C.last_wins(frame).withColumn("commit_seq", F.lit(seq).cast("long"))
        before = self.catalog()
        after = {k: C.last_wins(self._log(k, self.manifest["catalog"][k]).unionByName(logs[k])) if k in logs else v for k, v in before.items()}
        if logs:
            C.validate(after, before, {k: v.drop("commit_seq") for k, v in logs.items()})
        segment = None
        if tx.points is not None:
            C.refuse(C.point_rules(tx.points, after["series"], after["runs"]))
            numbered, _ = self._numbered(tx.points, seq, small=True)
            segment = self._write_points(numbered, False, seq, small=True)
            if segment["points"]:
                manifest["points"] = [*manifest["points"], segment]
        for kind, frame in logs.items():
            manifest["catalog"][kind] = self._add_log(manifest["catalog"][kind], f"catalog/{kind}", frame.schema, frame, seq)
        if tx.commit_id is not None:
            receipt = (tx.source_id or "", tx.sequence if tx.source_id else -1, tx.commit_id, tx.records, n, size, sha, seq)
            manifest["commits"] = self._add_log(manifest["commits"], "commits", S.RECEIPTS, self.spark.createDataFrame([receipt], S.RECEIPTS), seq)
        if tx.source_id is not None:
            known = manifest["sources"].get(tx.source_id, {"durable": None})
            manifest["sources"] = {**manifest["sources"], tx.source_id: {**known, "accepted": tx.sequence}}
        self._finish(manifest, segment, size)
        return Commit(seq, tx.records, n)

    # --- rollups ---

    def _tiers(self) -> DataFrame:
        """(series_id, gap, resolution, retain) of every gauge series."""
        series = self.catalog()["series"].where("semantics = 'Gauge'")
        tiers = series.select(F.col("id").alias("series_id"), F.coalesce("maximum_gap_micros", F.lit(0)).alias("gap"), F.explode("rollup_policy.tiers").alias("tier"))
        return tiers.select("series_id", "gap", "tier.resolution", F.col("tier.retain_for_micros").alias("retain"))

    def maintain(self, now: int) -> dict:
        """Drop expired descriptors, build completed shards that lack one, publish once.

        One plan for all series of a resolution. What is needed comes from the files' tables of series, so points
        are read only for it, and only from the days it lies in; nothing is read if neither points, policies nor
        descriptors have changed since the last call and no shard has been completed. A completed shard without
        a point gets a descriptor without a file, so that coverage has no holes.
        """
        self._writable()
        state = json.dumps([[p["path"] for p in self.manifest["points"]], self.manifest["catalog"]["series"], self.manifest["descriptors"]])
        seen = self.manifest.get("maintained")
        if seen and seen["state"] == hashlib.sha256(state.encode()).hexdigest() and seen["at"] <= now < seen["next"]:
            return {"built": 0, "expired": 0, "generation": self.manifest["generation"], "gates": self.retention_gates(now)}
        tiers = self._tiers()
        resolutions = [Resolution.of(r[0]) for r in tiers.select("resolution").distinct().collect()]  # as many as policies use
        held = self.descriptors()
        manifest, built, kept = dict(self.manifest), 0, held
        keys = None
        new: list[DataFrame] = []
        points = self.points()
        bounds = self.series_bounds().select("series_id", F.col("min_valid").alias("low"), F.col("max_valid").alias("high"), F.col("revisions"))
        for resolution in resolutions:
            r = F.col("resolution")
            match = (r["micros"] == resolution.micros) if resolution.micros else (r["unit"] == resolution.unit) & (r["tz"] == resolution.tz)
            own = tiers.where(match).select("series_id", "gap", "retain").dropDuplicates(["series_id"])
            expiry = own.select("series_id", F.lit(resolution.key).alias("resolution_key"), F.col("retain"))
            keys = expiry if keys is None else keys.unionByName(expiry)
            need = P.needed(bounds.join(own, "series_id"), held, resolution, now).persist()
            try:
                if need.isEmpty():
                    continue
                widest = own.agg(F.max("gap")).first()[0] or 0
                reach = need.groupBy("series_id").agg(F.min("start").alias("from"), F.max("end").alias("to")).join(own.select("series_id", "gap"), "series_id")
                first, last = reach.agg(F.min(F.col("from") - F.col("gap")), F.max(F.col("to") + F.greatest("gap", F.lit(1)))).first()
                own_days = points.where((F.col("valid_day") >= first - first % S.DAY) & (F.col("valid_day") <= last))  # literals: whole days are skipped
                near = own_days.join(reach, "series_id").where((F.col("valid_time") >= F.col("from") - F.col("gap")) & (F.col("valid_time") < F.col("to") + F.greatest("gap", F.lit(1))))
                made = U.build(R.winners(near, carry=F.col("gap")) if widest <= A.MAX_CARRY else R.winners(near), resolution, F.col("gap")).where(F.col("bucket_end") <= now).withColumn("start", P.shard_start(F.col("bucket_start"), resolution))
                made = made.join(need, ["series_id", "start"], "left_semi").drop("start")
                name = self._write(made.repartitionByRange("series_id", "bucket_start").sortWithinPartitions("series_id", "bucket_start"), "rollups")
                done = self._write(need.join(bounds.select("series_id", "revisions"), "series_id").select("series_id", F.lit(resolution.key).alias("resolution_key"), "start", "end", F.col("revisions").alias("source_points"), F.lit(name).alias("path")), "descriptors")
                new.append(self.spark.read.schema(S.DESCRIPTORS).parquet(self._path(done)))
                built += new[-1].count()
            finally:
                need.unpersist()
        expired = 0
        if keys is not None and manifest["n_descriptors"]:
            kept = held.join(keys, ["series_id", "resolution_key"], "left").where(F.col("retain").isNull() | (F.col("end") >= F.lit(now) - F.col("retain"))).select(*held.columns)
            expired = manifest["n_descriptors"] - kept.count()
        if built or expired:
            manifest = self._with_descriptors(manifest, reduce(DataFrame.unionByName, [kept, *new]))
        state = json.dumps([[p["path"] for p in manifest["points"]], manifest["catalog"]["series"], manifest["descriptors"]])
        manifest["maintained"] = {"at": now, "next": _next_boundary(now, resolutions), "state": hashlib.sha256(state.encode()).hexdigest()}
        if built or expired:
            self._publish(manifest)
        else:
            self.manifest = manifest  # nothing to publish: the note is the handle's own until the next generation
        return {"built": built, "expired": expired, "generation": self.manifest["generation"], "gates": self.retention_gates(now)}

    def query_gauge(self, series_id: int, start: int, end: int, resolution: Resolution) -> RollupQuery:
        """Stored buckets where descriptors cover the range, buckets from raw points elsewhere."""
        begin, stop = P.envelope(start, end, resolution)
        row = self.catalog()["series"].where(F.col("id") == series_id).select("semantics", "maximum_gap_micros").first()
        if row is None:
            raise ModelError(f"series {series_id} is not defined")
        if row["semantics"] != "Gauge":
            raise ModelError(f"series {series_id} is not a gauge")
        gap = row["maximum_gap_micros"] or 0
        own = self.descriptors().where((F.col("series_id") == series_id) & (F.col("resolution_key") == resolution.key) & (F.col("start") < stop) & (F.col("end") > begin)).collect()
        used, gaps = P.cover([(d["start"], d["end"]) for d in own], begin, stop)
        parts = []
        if used:
            names = sorted({own[k]["path"] for k in used if own[k]["path"]})
            spans = [(own[k]["start"], own[k]["end"]) for k in used]
            if names:
                stored = self.spark.read.schema(S.BUCKETS).parquet(*[self._path(n) for n in names]).where(F.col("series_id") == series_id)
                parts.append(_within(U.overlapping(stored, start, end), spans))
        if gaps:
            low, high = gaps[0][0] - gap, gaps[-1][1] + max(gap, 1)
            near = _spanned(R.in_range(self.points(), low, high, series_id), [(a - gap, b + max(gap, 1)) for a, b in gaps], F.col("valid_time"), F.col("valid_time") + 1)
            parts.append(_within(U.latest_rollup(near, resolution, gap), gaps))
        source = "Raw" if not used else "Materialized" if not gaps else "Hybrid"
        buckets = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], S.BUCKETS)
        return RollupQuery(buckets.orderBy("bucket_start"), source, self.manifest["generation"])

    def retention_gates(self, now: int) -> DataFrame:
        bounds = self.series_bounds().select("series_id", F.col("min_valid").alias("low"))
        return P.retention_gates(self.catalog()["series"], bounds, self.descriptors(), now)

    # --- files ---

    def seal(self) -> dict:
        """Rewrite all live files as one sorted, sealed one; ``append_seq`` keeps ties apart."""
        self._writable()
        live = [p for p in self.manifest["points"] if not p["sealed"]]
        if not live:
            return {"sealed_points": 0, "files": 0}
        union = reduce(DataFrame.unionByName, [self._segment(p["path"]) for p in live])
        segment = {**self._write_points(union, True, max(p["commit"] for p in live)), "first": min(p["first"] for p in live)}
        if segment["points"] != sum(p["points"] for p in live):
            raise StorageFault("sealing lost points")
        self._publish({**self.manifest, "points": [p for p in self.manifest["points"] if p["sealed"]] + [segment]})
        return {"sealed_points": segment["points"], "files": len(live)}

    def create_segment(self, path: str) -> dict:
        """Export all points of this handle, sealed or not, as one table sorted like a sealed file; nothing may be there."""
        if files.exists(self.spark, path):
            raise InvalidArgument(f"{path} is there already")
        self.points().repartitionByRange("valid_day", "series_id", "valid_time").sortWithinPartitions("valid_day", "series_id", "valid_time", "knowledge_time", "change_time", "append_seq").write.partitionBy("valid_day").parquet(path)
        return {"points": sum(p["points"] for p in self.manifest["points"]), "generation": self.manifest["generation"]}

    def _referenced(self, manifests: list[dict]) -> set[str]:
        names = set()
        for m in manifests:
            names |= {p["path"] for p in m["points"]} | {p["stats"] for p in m["points"] if p.get("stats")} | set(m["commits"]) | {x for v in m["catalog"].values() for x in v}
            if m["descriptors"]:
                names.add(m["descriptors"])
                if files.exists(self.spark, self._path(m["descriptors"])):
                    names |= {r[0] for r in self.spark.read.schema(S.DESCRIPTORS).parquet(self._path(m["descriptors"])).where("path is not null").select("path").distinct().collect()}
        return names

    def sweep(self) -> list[str]:
        """Delete files that no kept manifest refers to."""
        self._writable()
        kept = [json.loads(files.read_text(self.spark, f"{self.root}/manifests/{n}")) for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        keep, gone = self._referenced([*kept, self.manifest]), []
        for folder in ["points", "stats", "commits", "descriptors", "rollups", "stage", *[f"catalog/{k}" for k in S.CATALOG]]:
            for name in files.names(self.spark, self._path(folder)):
                if f"{folder}/{name}" not in keep:
                    files.delete(self.spark, self._path(f"{folder}/{name}"))
                    gone.append(f"{folder}/{name}")
        return gone

    def check_integrity(self) -> dict:
        """Read everything and hold it against the manifest and the rules of buckets."""
        problems = []
        for p in self.manifest["points"]:
            try:
                n, low, high, checksum = _content(self._segment(p["path"]))
                if (n, low, high, checksum) != (p["points"], p["low"], p["high"], p["checksum"]):
                    problems.append(f"{p['path']} differs from the manifest")
            except Exception as error:
                problems.append(f"{p['path']} cannot be read: {str(error).splitlines()[0][:200]}")
        broken = 0
        if not problems:
            try:
                broken = bucket_violations(self.buckets()).count()
            except Exception as error:
                problems.append(f"rollups cannot be read: {str(error).splitlines()[0][:200]}")
        if broken:
            problems.append(f"{broken} buckets break a rule")
        return {"ok": not problems, "problems": problems, "generation": self.manifest["generation"], "segments": len(self.manifest["points"]), "points": sum(p["points"] for p in self.manifest["points"])}

    def backup_to(self, target: str) -> dict:
        """Copy what the current manifest shows to a place where nothing is; complete or absent."""
        if self.token:
            self.flush()
        target = target.rstrip("/")
        if files.exists(self.spark, target):
            raise InvalidArgument(f"{target} is there already")
        stage = f"{target}.{uuid.uuid4().hex}.stage"
        for name in sorted(self._referenced([self.manifest])):
            files.copy(self.spark, self._path(name), f"{stage}/{name}")
        files.make(self.spark, f"{stage}/manifests")
        files.publish_text(self.spark, f"{stage}/manifests/{self.manifest['generation']:012d}.json", json.dumps(self.manifest, sort_keys=True))
        digest = files.tree_digest(self.spark, stage)
        files.rename(self.spark, stage, target)
        return {"generation": self.manifest["generation"], "digest": digest}


#: Spans up to which a condition names them; more are joined as a table.
MAX_ARMS = 64


def _spanned(rows: DataFrame, spans: list[tuple[int, int]], low: Column, high: Column) -> DataFrame:
    """Rows whose low..high (end exclusive) lies wholly in one of the spans; touching and overlapping spans are one."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and joined[-1][1] >= a:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    if len(joined) <= MAX_ARMS:
        return rows.where(reduce(lambda x, y: x | y, [(low >= a) & (high <= b) for a, b in joined]))
    table = rows.sparkSession.createDataFrame([tuple(x) for x in joined], "span_from long, span_to long")
    # spans do not overlap, so a row meets one at most; the planner broadcasts the spans of one query
    return rows.join(table, (low >= F.col("span_from")) & (high <= F.col("span_to")), "left_semi")


def _within(buckets: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Buckets that lie wholly in one of the spans."""
    return _spanned(buckets, spans, F.col("bucket_start"), F.col("bucket_end"))


def _next_boundary(now: int, resolutions: list[Resolution]) -> int:
    """When the next shard can be completed: a whole number of every tier's buckets, a quarter of an hour away at most."""
    step = math.gcd(S.HOUR // 4, *[r.micros for r in resolutions if r.micros])
    return now - now % step + step


def bucket_violations(buckets: DataFrame) -> DataFrame:
    """Stored buckets that cannot be right."""
    c = F.col
    has = c("first_ts").isNotNull()
    wrong = ((c("bucket_end") <= c("bucket_start")) | (c("count") < 0) | (c("covered") < 0) | (c("covered") > c("bucket_end") - c("bucket_start")) | (has != (c("count") > 0)) | (c("last_ts").isNotNull() != has)
             | (has & ((c("first_ts") < c("bucket_start")) | (c("last_ts") >= c("bucket_end")) | (c("first_ts") > c("last_ts")))) | (c("min") > c("max")) | (c("min").isNull() != c("max").isNull())
             | ((c("count") > 0) & c("min").isNull()) | F.isnan("sum") | F.isnan("integral"))
    return buckets.where(F.coalesce(wrong, F.lit(False)))


def restore_from(spark: SparkSession, backup: str, target: str) -> dict:
    """Copy a backup to a place where nothing is, and hold the copy against it."""
    backup, target = backup.rstrip("/"), target.rstrip("/")
    if files.exists(spark, target):
        raise InvalidArgument(f"{target} is there already")
    if not files.exists(spark, f"{backup}/manifests"):
        raise StorageFault(f"{backup} is not a backup")
    before = files.tree_digest(spark, backup)
    stage = f"{target}.{uuid.uuid4().hex}.stage"
    files.copy(spark, backup, stage)
    if files.exists(spark, f"{stage}/writer.lock"):
        files.delete(spark, f"{stage}/writer.lock")
    if files.tree_digest(spark, stage) != before:
        files.delete(spark, stage)
        raise StorageFault("the copy differs from the backup")
    files.rename(spark, stage, target)
    return {"digest": before, "generation": EngineStore._load(spark, target)["generation"]}


def salvage_from(spark: SparkSession, source: str, target: str) -> dict:
    """The longest run of commits from the first that can be read whole, as a new store without rollups.

    A file that cannot be read, or differs from the manifest, ends the run before its first commit. Points, catalogue,
    receipts and watermarks all end there, so that a source that sends the lost batches again is not told that
    they are known.
    """
    source, target = source.rstrip("/"), target.rstrip("/")
    if files.exists(spark, target):
        raise InvalidArgument(f"{target} is there already")
    manifest = EngineStore._load(spark, source)
    reader = EngineStore(spark, source, manifest, Config(), None)
    end, stopped = manifest["next_commit"], None  # commits below ``end`` are whole

    def readable(name: str, first: int, check) -> None:
        nonlocal end, stopped
        try:
            check()
        except Exception as error:
            if first < end:
                end, stopped = first, f"{name}: {str(error).splitlines()[0][:200]}"

    def same_points(p: dict) -> None:
        if _content(reader._segment(p["path"])) != (p["points"], p["low"], p["high"], p["checksum"]):
            raise StorageFault("content differs")

    logs = [(None, n) for n in manifest["commits"]] + [(kind, n) for kind, own in manifest["catalog"].items() for n in own]
    for p in manifest["points"]:
        readable(p["path"], p["first"], lambda p=p: same_points(p))
    for kind, name in logs:
        readable(name, _first_commit(name), lambda kind=kind, name=name: reader._log_frame(kind, [name]).agg(F.sum(F.length(F.to_json(F.struct("*"))))).first())
    keep = [dict(p) for p in manifest["points"] if p["commit"] < end]
    cut = [p for p in manifest["points"] if p["first"] < end <= p["commit"]]
    out = {**manifest, "generation": manifest["generation"] + 1, "next_commit": end, "points": keep, "descriptors": None, "n_descriptors": 0, "commits": [], "catalog": {k: [] for k in S.CATALOG}}
    out.pop("maintained", None)
    writer = EngineStore(spark, target, out, Config(), "salvage")
    for p in keep:
        files.copy(spark, f"{source}/{p['path']}", f"{target}/{p['path']}")
        p["stats"] = writer._write(R.series_stats(writer._segment(p["path"])).coalesce(1), "stats")
    for p in cut:  # a sealed file of commits on both sides
        part = writer._write_points(reader._segment(p["path"]).where(F.col("append_seq") < end << S.BATCH_BITS), True, end - 1)
        out["points"] = [*out["points"], {**part, "first": p["first"]}]
    for kind, name in logs:
        if _first_commit(name) < end:
            writer._write(reader._log_frame(kind, [name]).where(F.col("commit_seq") < end), "", name)
            (out["commits"] if kind is None else out["catalog"][kind]).append(name)
    accepted = writer._log_frame(None, out["commits"]).where("source_id != ''").groupBy("source_id").agg(F.max("sequence").alias("sequence")).collect()  # a row a source
    out["sources"] = {r["source_id"]: {"accepted": r["sequence"], "durable": r["sequence"]} for r in accepted}
    if EngineStore._load(spark, source)["generation"] != manifest["generation"]:
        raise SourceChanged(source)
    files.make(spark, f"{target}/manifests")
    files.publish_text(spark, f"{target}/manifests/{out['generation']:012d}.json", json.dumps(out, sort_keys=True))
    return {"complete": stopped is None, "stopped_at": stopped, "commits_below": end, "segments": len(out["points"]), "points": sum(p["points"] for p in out["points"])}
