"""Schemas of the data model, identifiers and resolutions.

128-bit ids are 32 lower-case hexadecimal digits; zero is a value, not null. Times are UTC
microseconds. ``append_seq`` stands for the order in which points were appended.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tidewatt.errors import InvalidArgument, ModelError

ZERO_ID = "0" * 32
MICROS = 1_000_000
HOUR = 3600 * MICROS
DAY = 24 * HOUR
#: Points of one batch; fits the 20 bits that ``append_seq`` keeps for the place in a batch.
MAX_BATCH_POINTS = 262_144
MAX_BATCH_BYTES = 64 << 20
BATCH_BITS = 20

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields) -> T.StructType:
    """A trailing underscore marks a nullable field."""
    return T.StructType([T.StructField(n.rstrip("_"), t, n.endswith("_")) for n, t in fields.items()])


PROPERTY = T.StructType([T.StructField("kind", _S), T.StructField("b", T.BooleanType()), T.StructField("i", _L), T.StructField("d", _D), T.StructField("s", _S)])
PROPERTIES = T.MapType(_S, PROPERTY)
POINTS = _struct(series_id=_L, valid_time=_L, valid_time_end=_L, knowledge_time=_L, change_time=_L, run_id=_S, value=_D, quality=_L, flags=_L, append_seq=_L)
POINT_FIELDS = [f.name for f in POINTS.fields]
#: What a point is, without its place in the log.
POINT_IDENTITY = POINT_FIELDS[:-1]
RESOLUTION = T.StructType([T.StructField("kind", _S), T.StructField("micros", _L), T.StructField("unit", _S), T.StructField("tz", _S)])
TIER = T.StructType([T.StructField("resolution", RESOLUTION), T.StructField("retain_for_micros", _L)])
ROLLUP_POLICY = T.StructType([T.StructField("raw_retain_for_micros", _L), T.StructField("tiers", T.ArrayType(TIER))])
ENTITIES = _struct(id=_S, kind=_S, name=_S, parent_=_S, valid_from=_L, valid_to_=_L, properties_=PROPERTIES)
RELATIONS = _struct(id=_S, kind=_S, source=_S, target=_S, valid_from=_L, valid_to_=_L, properties_=PROPERTIES)
SERIES = _struct(id=_L, owner_entity_=_S, owner_relation_=_S, name=_S, physical_quantity=_S, canonical_unit=_S, semantics=_S, maximum_gap_micros_=_L, rollup_policy_=ROLLUP_POLICY)
RUNS = _struct(id=_S, kind=_S, status=_S, created_at=_L, knowledge_time=_L, workflow=_S, model=_S, model_version=_S, parent_run_=_S, input_snapshot_=_S, attributes_=PROPERTIES)
PLANS = _struct(id=_S, run_id=_S, status=_S, horizon_start=_L, horizon_end=_L, resolution_micros=_L, scenario=_S, objective_terms_=T.MapType(_S, _D), objective_value_=_D, supersedes_=_S, attributes_=PROPERTIES)
CATALOG = {"entities": ENTITIES, "relations": RELATIONS, "series": SERIES, "runs": RUNS, "plans": PLANS}
BUCKETS = _struct(series_id=_L, bucket_start=_L, bucket_end=_L, count=_L, sum=_D, min_=_D, max_=_D, first_ts_=_L, first_value_=_D, last_ts_=_L, last_value_=_D, integral=_D, covered=_L)
BUCKET_FIELDS = [f.name for f in BUCKETS.fields]
DESCRIPTORS = _struct(series_id=_L, resolution_key=_S, start=_L, end=_L, source_points=_L, path_=_S)
RECEIPTS = _struct(source_id=_S, sequence=_L, commit_id=_S, records=_L, points=_L, bytes=_L, payload_sha=_S, commit_seq=_L)

#: The domains of the enumerations.
SEMANTICS = ("Gauge", "Counter", "IntervalTotal", "State", "Event")
RUN_KINDS = ("Forecast", "Optimization", "Import", "Control", "Reconciliation")
RUN_STATUSES = ("Pending", "Running", "Succeeded", "Failed", "Cancelled")
TERMINAL_RUN_STATUSES = ("Succeeded", "Failed", "Cancelled")
PLAN_STATUSES = ("Candidate", "Approved", "Deployed", "Superseded", "Cancelled")
PLAN_TRANSITIONS = {"Candidate": ("Approved", "Cancelled", "Superseded"), "Approved": ("Deployed", "Cancelled", "Superseded"), "Deployed": ("Superseded",), "Superseded": (), "Cancelled": ()}
CALENDAR_UNITS = ("Day", "Month", "Year")


def hex_id(value: int) -> str:
    """A 128-bit id from a whole number."""
    if not 0 <= value < 1 << 128:
        raise InvalidArgument(f"{value} is not a 128-bit id")
    return f"{value:032x}"


def signed(series_id: int) -> int:
    """An unsigned 64-bit series id as the long that holds it."""
    if not 0 <= series_id < 1 << 64:
        raise InvalidArgument(f"{series_id} is not an unsigned 64-bit id")
    return series_id - (1 << 64) if series_id >> 63 else series_id


def unsigned(series_id: int) -> int:
    return series_id % (1 << 64)


@dataclass(frozen=True)
class Resolution:
    """A fixed number of microseconds, or a calendar unit in an IANA time zone."""

    micros: int | None = None
    unit: str | None = None
    tz: str | None = None

    def __post_init__(self):
        if (self.micros is None) == (self.unit is None):
            raise ModelError("a resolution is either fixed or a calendar unit")
        if self.micros is not None and self.micros <= 0:
            raise InvalidArgument("a resolution is positive")
        if self.unit is not None:
            if self.unit not in CALENDAR_UNITS:
                raise ModelError(f"unknown calendar unit {self.unit}")
            check_zone(self.tz)

    @property
    def key(self) -> str:
        return f"fixed/{self.micros}" if self.micros else f"calendar/{self.unit}/{self.tz}"

    @property
    def shard_micros(self) -> int | None:
        """Width of a shard: the UTC day if buckets divide it, else one bucket; None: one calendar bucket."""
        if self.micros is None:
            return None
        return DAY if self.micros <= DAY and DAY % self.micros == 0 else self.micros

    def row(self) -> tuple:
        return ("Fixed", self.micros, None, None) if self.micros else ("Calendar", None, self.unit, self.tz)

    @classmethod
    def of(cls, row) -> Resolution:
        return cls(micros=row["micros"]) if row["kind"] == "Fixed" else cls(unit=row["unit"], tz=row["tz"])


def check_zone(tz: str | None) -> None:
    from zoneinfo import available_timezones

    if not tz or not re.fullmatch(r"[A-Za-z0-9_+\-/]+", tz) or tz not in available_timezones():
        raise ModelError(f"{tz!r} is not an IANA time zone")
