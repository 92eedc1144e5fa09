"""A seeded workload: sites with telemetry, prices, forecasts in two revisions and plans.

Random draws are numbered (SplitMix64 of seed and number), so every site is made by itself on
an executor and the whole does not depend on how the work is dealt out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt import schemas as S
from tidewatt.errors import ConfigError, StorageFault
from tidewatt.schemas import DAY, HOUR, MICROS, Resolution
from tidewatt.sources import files

MAX_SITES, MAX_DAYS, MAX_POINTS = 256, 366, 4_000_000
START_MICROS = 1_767_225_600_000_000
STOCKHOLM = "Europe/Stockholm"
# The series of a site, (offset, name, quantity, unit, semantics).
SITE_SERIES = [
    (1, "grid_power", "power", "W", "Gauge"), (2, "solar_power", "power", "W", "Gauge"), (3, "battery_power", "power", "W", "Gauge"), (4, "state_of_charge", "state_of_charge", "%", "Gauge"),
    (5, "import_energy", "energy", "Wh", "Counter"), (6, "outdoor_temperature", "temperature", "Cel", "Gauge"), (7, "spot_price", "energy_price", "EUR/MWh", "Gauge"),
    (8, "load_forecast", "power", "W", "Gauge"), (9, "planned_battery_power", "power", "W", "Gauge"),
]
_STEP = 300 * MICROS


@dataclass(frozen=True)
class WorkloadConfig:
    seed: int = 42
    sites: int = 1
    days: int = 7
    cadence_seconds: int = 60
    start_micros: int = START_MICROS

    def __post_init__(self):
        if not (1 <= self.sites <= MAX_SITES and 1 <= self.days <= MAX_DAYS and 1 <= self.cadence_seconds <= 86400):
            raise ConfigError("a workload limit is out of range")
        if self.start_micros % DAY:
            raise ConfigError("the workload starts at a UTC midnight")
        if self.sites * self.days * (6 * 86400 // self.cadence_seconds + 24 + 3 * 288) > MAX_POINTS:
            raise ConfigError(f"a workload of more than {MAX_POINTS} points")


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws number ``first`` (from 0) on: SplitMix64 as numbers from 0 to below 1."""
    with np.errstate(over="ignore"):
        state = np.uint64(seed % (1 << 64)) + np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        state ^= state >> np.uint64(31)
    return (state >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _battery(hour: np.ndarray) -> np.ndarray:
    return np.where(hour < 5, 1600.0, np.where((hour >= 17) & (hour < 21), -2000.0, 0.0))


def site_points(config: WorkloadConfig, site: int):
    """Columns of one site's points, in the order in which they are recorded."""
    cadence = config.cadence_seconds * MICROS
    steps = config.days * DAY // cadence
    index = np.arange(steps + 1, dtype=np.int64)
    since = index * cadence
    priced = (index < steps) & (since % HOUR == 0)
    per_day = DAY // _STEP
    n_draws = 1 + 3 * len(index) + int(priced.sum()) + config.days * (3 + 2 * per_day)
    u = draws(config.seed, site * n_draws, n_draws)
    at = 1 + 3 * index + np.concatenate([[0], np.cumsum(priced)[:-1]])
    signed = lambda x: 2 * x - 1
    phase = since % DAY / DAY
    hour = phase * 24
    daily = np.sin(2 * np.pi * phase)
    scale = 1 + 0.03 * site
    temperature = 7 + 8 * daily + 0.4 * signed(u[at])
    demand = scale * (4200 - 1300 * daily + 90 * np.maximum(18 - temperature, 0)) + 120 * signed(u[at + 1])
    solar = scale * 5500 * np.maximum(np.sin(np.pi * (phase - 0.25) / 0.5), 0) * (0.85 + 0.15 * u[at + 2])
    battery = _battery(hour)
    grid = demand - solar + battery
    hours = cadence / 3.6e9
    charge, level = np.empty(len(index)), 52 + 5 * signed(u[0])
    for k, b in enumerate((battery * hours / 120).tolist()):
        level = min(max(level + b, 5.0), 95.0)
        charge[k] = level
    gained = np.maximum(grid, 0) * hours
    energy = 100_000 + 10_000 * site + np.cumsum(gained)
    half = steps // 2
    energy[half:] = np.cumsum(gained[half:]) - gained[half]
    there = ~((index % 997 >= 500) & (index % 997 < 504))
    valid = config.start_micros + since
    zero = np.zeros(int(there.sum()), np.int64)
    parts = []

    def add(offset, t, end, known, changed, run, value, quality, flags, order):
        parts.append({"series_id": np.full(len(t), site * 100 + offset), "valid_time": t, "valid_time_end": end, "knowledge_time": known, "change_time": changed, "run_id": run, "value": value, "quality": quality, "flags": flags, "order": order})

    t = valid[there]
    quality, flags = (index[there] % 4093 == 0).astype(np.int64), (index[there] == half).astype(np.int64)
    for offset, values in enumerate((grid, solar, battery, charge, energy, temperature), 1):
        add(offset, t, t, t, t, np.full(len(t), S.ZERO_ID), values[there], quality, flags, index[there] * 10 + offset)
    t = valid[priced]
    price = 35 + np.where((hour[priced] >= 17) & (hour[priced] < 21), 85.0, 0.0) + 4 * signed(u[at[priced] + 3])
    zero = np.zeros(len(t), np.int64)
    add(7, t, t + HOUR, t, t, np.full(len(t), S.ZERO_ID), price, zero, zero, index[priced] * 10 + 7)
    base = 1 + 3 * len(index) + int(priced.sum())
    step = np.arange(per_day, dtype=np.int64) * _STEP
    shape = (4200 - 1300 * np.sin(2 * np.pi * step / DAY)) * scale
    for day in range(config.days):
        start = config.start_micros + day * DAY
        own = base + day * (3 + 2 * per_day) + 3
        issue, revised = start - 12 * HOUR, start + 6 * HOUR
        t = start + step
        full = np.full(per_day, 0, np.int64)
        place = (steps + 1 + day) * 10 + full
        add(8, t, t, full + issue, full + issue, np.full(per_day, _run(site, day, 1)), shape + 450 * signed(u[own : own + 2 * per_day : 2]), full, full, place)
        late = t >= revised
        n = int(late.sum())
        add(8, t[late], t[late], np.full(n, revised), np.full(n, revised), np.full(n, _run(site, day, 1)), (shape + 180 * signed(u[own + 1 : own + 1 + 2 * per_day : 2]))[late], full[late], full[late], place[late] + 1)
        add(9, t, t + _STEP, full + issue, full + issue + 60 * MICROS, np.full(per_day, _run(site, day, 2)), _battery(step / HOUR), full, full, place + 2)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _run(site: int, day: int, kind: int) -> str:
    return S.hex_id((site + 1) << 64 | day << 8 | kind)


def generate(spark: SparkSession, config: WorkloadConfig | None = None) -> dict[str, DataFrame]:
    """entities, series, runs, plans and points of the workload."""
    config = config or WorkloadConfig()

    def run(batches):
        import pandas as pd

        for batch in batches:
            for site in batch["id"].tolist():
                frame = pd.DataFrame(site_points(config, site))
                frame["append_seq"] = (site << 36) + frame.pop("order").astype("int64")
                yield frame[S.POINT_FIELDS]

    points = spark.range(0, config.sites, 1, config.sites).mapInPandas(run, S.POINTS)
    day, steps = config.days, range(config.days)
    gauge = (14 * DAY, [(Resolution(micros=_STEP).row(), 180 * DAY), (Resolution(micros=6 * _STEP).row(), None), (Resolution(unit="Day", tz=STOCKHOLM).row(), None), (Resolution(unit="Month", tz=STOCKHOLM).row(), None)])
    entities, series, runs, plans = [], [], [], []
    cadence = config.cadence_seconds * MICROS
    n_index = day * DAY // cadence
    n_priced = sum(1 for k in range(n_index) if k * cadence % HOUR == 0)
    site_draws = 1 + 3 * (n_index + 1) + n_priced + day * (3 + 2 * (DAY // _STEP))
    for site in range(config.sites):
        owner = S.hex_id(site + 1)
        entities.append((owner, "site", f"site-{site:05}", None, config.start_micros, None, {"timezone": ("Text", None, None, None, STOCKHOLM), "benchmark_site": ("Integer", None, site, None, None)}))
        series += [(site * 100 + k, owner, None, name, quantity, unit, kind, 3 * cadence, gauge if kind == "Gauge" else (90 * DAY, [])) for k, name, quantity, unit, kind in SITE_SERIES]
        for d in steps:
            start = config.start_micros + d * DAY
            issue = start - 12 * HOUR
            u = draws(config.seed, site * site_draws + 1 + 3 * (n_index + 1) + n_priced + d * (3 + 2 * (DAY // _STEP)), 3)
            runs += [(_run(site, d, 1), "Forecast", "Succeeded", issue, issue, "day_ahead_forecast", "deterministic-benchmark", "1", None, None, {}),
                     (_run(site, d, 2), "Optimization", "Succeeded", issue + 60 * MICROS, issue, "battery_dispatch", "price-peak-arbitrage", "1", None, _run(site, d, 1), {})]
            plans.append((_run(site, d, 0x80), _run(site, d, 2), "Deployed", start, start + DAY, _STEP, "base", {"energy_cost_eur": 42 + 5 * float(u[0]), "peak_kw": 6 + float(u[1])}, 48 + 6 * float(u[2]), None, {}))
    tables = {"entities": entities, "series": series, "runs": runs, "plans": plans}
    return {name: spark.createDataFrame(rows, S.CATALOG[name]) for name, rows in tables.items()} | {"points": points}


def batches(points: DataFrame, size: int) -> list[DataFrame]:
    """Points in append order, ``size`` to a batch (a workload is bounded by MAX_POINTS)."""
    from pyspark.sql import Window

    numbered = points.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("append_seq", "series_id")) - 1) / size)).persist()
    count = (numbered.agg(F.max("batch")).first()[0] if not numbered.isEmpty() else -1) + 1
    return [numbered.where(F.col("batch") == k).drop("batch") for k in range(count)]


# The columns of the bundle's files.
BUNDLE = {
    "entities": ["id as entity_id", "kind", "name", "parent as parent_id", "valid_from", "valid_to"], "series": ["id as series_id", "owner_entity", "name", "physical_quantity", "canonical_unit", "semantics"],
    "runs": ["id as run_id", "kind", "status", "created_at", "knowledge_time", "workflow", "model", "model_version", "input_snapshot"],
    "plans": ["id as plan_id", "run_id", "status", "horizon_start", "horizon_end", "resolution_micros", "scenario", "objective_value"], "points": S.POINT_IDENTITY}


def write_bundle(tables: dict[str, DataFrame], folder: str, seed: int = 0) -> dict:
    """CSV files for others, lossless Parquet beside them, and a summary with counts and checksum."""
    spark = tables["points"].sparkSession
    counts = {}
    for name, columns in BUNDLE.items():
        df = tables[name]
        own = df.selectExpr(*columns)
        own = own.withColumn("value", F.format_string("%.17f", "value")) if name == "points" else own
        own.write.mode("errorifexists").option("header", "true").csv(f"{folder}/{name}.csv")
        df.write.mode("errorifexists").parquet(f"{folder}/snapshot/{name}")
        counts[name] = spark.read.parquet(f"{folder}/snapshot/{name}").count()
    summary = {"format": 1, "seed": seed, **counts, "checksum": _checksum(spark, folder)}
    files.publish_text(spark, f"{folder}/summary.json", json.dumps(summary, sort_keys=True))
    return summary


def _checksum(spark: SparkSession, folder: str) -> str:
    row = spark.read.parquet(f"{folder}/snapshot/points").agg(F.sum(F.xxhash64(*[F.col(c).cast("string") for c in S.POINT_IDENTITY]).cast("decimal(20,0)"))).first()
    return str(row[0] or 0)


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle, held against its summary."""
    summary = json.loads(files.read_text(spark, f"{folder}/summary.json"))
    tables = {name: spark.read.schema(S.POINTS if name == "points" else S.CATALOG[name]).parquet(f"{folder}/snapshot/{name}") for name in BUNDLE}
    if any(tables[n].count() != summary[n] for n in BUNDLE) or _checksum(spark, folder) != summary["checksum"]:
        raise StorageFault(f"{folder} differs from its summary")
    return tables
