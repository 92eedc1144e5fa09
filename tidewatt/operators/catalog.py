"""Catalogue rules: lookups, existence, cycles, transitions, dependency order.

Every check returns violations, (rule, object, detail) rows; ``validate`` raises on any. Checks
are joins of tables, so they hold for catalogues of any size; a table is only searched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatt import schemas as S
from tidewatt.errors import ModelError
from tidewatt.functions import blank, finite



def lookup(table: DataFrame, object_id) -> DataFrame:
    return table.where(F.col("id") == object_id)


def listing(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def counts(catalog: dict[str, DataFrame]) -> DataFrame:
    """kind, objects: one row a table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("objects")).select(F.lit(name).alias("kind"), "objects") for name, df in catalog.items()])


def last_wins(log: DataFrame, order: str = "commit_seq") -> DataFrame:
    """The current state of an upsert log: per id the row of the last commit."""
    fields = [c for c in log.columns if c not in ("id", order)]
    return log.groupBy("id").agg(F.max_by(F.struct(*fields), order).alias("row")).select("id", "row.*")


def _violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("object"))


def self_rules(catalog: dict[str, DataFrame]) -> DataFrame:
    """Rules that need only the object itself, of the kinds given."""
    from zoneinfo import available_timezones

    c = F.col
    zero = c("id") == S.ZERO_ID
    spans = c("valid_to").isNotNull() & (c("valid_to") <= c("valid_from"))
    def bad_properties(name: str) -> Column:
        return F.exists(F.map_entries(name), lambda e: blank(e["key"]) | (e["value"]["d"].isNotNull() & ~finite(e["value"]["d"])))
    tiers = c("rollup_policy.tiers")
    bad_tier = F.exists(tiers, lambda t: (t["retain_for_micros"].isNotNull() & (t["retain_for_micros"] <= 0)) | (
        (t["resolution"]["kind"] == "Fixed") & ~F.coalesce(t["resolution"]["micros"] > 0, F.lit(False))) | (
        (t["resolution"]["kind"] == "Calendar") & ~(F.coalesce(t["resolution"]["unit"].isin(*S.CALENDAR_UNITS), F.lit(False)) & F.coalesce(F.array_contains(F.lit(sorted(available_timezones())), t["resolution"]["tz"]), F.lit(False)))))
    rules = {
        "entities": ({"entity id is zero": zero, "entity kind is blank": blank(c("kind")), "entity name is blank": blank(c("name")), "entity validity is empty": spans, "entity is its own parent": c("parent") == c("id"), "entity properties": bad_properties("properties")},),
        "relations": ({"relation id is zero": zero, "relation kind is blank": blank(c("kind")), "relation validity is empty": spans, "relation properties": bad_properties("properties")},),
        "series": ({
            "series id is zero": c("id") == 0, "series name is blank": blank(c("name")), "series quantity is blank": blank(c("physical_quantity")), "series unit is blank": blank(c("canonical_unit")),
            "series has not exactly one owner": c("owner_entity").isNull() == c("owner_relation").isNull(), "series semantics are unknown": ~c("semantics").isin(*S.SEMANTICS), "series gap is negative": c("maximum_gap_micros") < 0,
            "series raw retention is not positive": c("rollup_policy.raw_retain_for_micros") <= 0, "series tier": bad_tier},),
        "runs": ({"run id is zero": zero, "run workflow is blank": blank(c("workflow")), "run kind is unknown": ~c("kind").isin(*S.RUN_KINDS), "run status is unknown": ~c("status").isin(*S.RUN_STATUSES), "run attributes": bad_properties("attributes")},),
        "plans": ({
            "plan id is zero": zero, "plan run is zero": c("run_id") == S.ZERO_ID, "plan scenario is blank": blank(c("scenario")), "plan horizon is empty": c("horizon_end") <= c("horizon_start"), "plan resolution is not positive": c("resolution_micros") <= 0,
            "plan supersedes itself": c("supersedes") == c("id"), "plan status is unknown": ~c("status").isin(*S.PLAN_STATUSES), "plan objective is not finite": F.exists(F.map_values("objective_terms"), lambda x: ~finite(x)) | (c("objective_value").isNotNull() & ~finite(c("objective_value"))), "plan attributes": bad_properties("attributes")},),
    }
    parts = [_violations(df, "id", rules[kind][0]) for kind, df in catalog.items()]
    return reduce(DataFrame.unionByName, parts)


def missing(child: DataFrame, key: str, parent: DataFrame, rule: str, parent_key: str = "id") -> DataFrame:
    """Children whose reference has no parent: a left anti join."""
    want = child.where(F.col(key).isNotNull()).select(F.col("id").cast("string").alias("object"), F.col(key).alias("ref"))
    return want.join(parent.select(F.col(parent_key).alias("ref")), "ref", "left_anti").select(F.lit(rule).alias("rule"), "object")


#: Which column of which kind refers to which kind.
REFERENCES = (
    ("entities", "parent", "entities", "entity parent is missing"), ("relations", "source", "entities", "relation source is missing"), ("relations", "target", "entities", "relation target is missing"),
    ("series", "owner_entity", "entities", "series owner entity is missing"), ("series", "owner_relation", "relations", "series owner relation is missing"),
    ("runs", "parent_run", "runs", "run parent is missing"), ("runs", "input_snapshot", "runs", "run input is missing"),
    ("plans", "run_id", "runs", "plan run is missing"), ("plans", "supersedes", "plans", "superseded plan is missing"))


def reference_rules(children: dict[str, DataFrame], catalog: dict[str, DataFrame]) -> list[DataFrame]:
    """References of ``children`` that ``catalog`` does not hold; plans of runs of a wrong kind."""
    found = [missing(children[kind], key, catalog[parent], rule) for kind, key, parent, rule in REFERENCES if kind in children]
    if "plans" in children:
        others = catalog["runs"].where(F.col("kind") != "Optimization").select(F.col("id").alias("run_id"))
        found.append(children["plans"].join(others, "run_id", "left_semi").select(F.lit("plan run is not an optimization").alias("rule"), F.col("id").alias("object")))
    return found


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): longest chain of references below each node; -1 for nodes on or above a cycle.

    Peels: nodes whose references have all been placed get the next level. Each round is two
    joins; a round's result is cut from its lineage by a checkpoint where one can be kept.
    """
    placed = None
    left = nodes.select("id").distinct()
    links = edges.select("id", "ref").where("ref is not null").distinct().join(nodes.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi")
    level = 0
    while True:
        ready = left.join(links.select("id").distinct(), "id", "left_anti")
        ready = _cut(ready)
        if ready.isEmpty():
            break
        found = ready.withColumn("level", F.lit(level))
        placed = found if placed is None else placed.unionByName(found)
        left = _cut(left.join(ready, "id", "left_anti"))
        links = _cut(links.join(ready.select(F.col("id").alias("ref")), "ref", "left_anti"))
        level += 1
    stuck = left.withColumn("level", F.lit(-1))
    return stuck if placed is None else placed.unionByName(stuck)


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder; without one, keep the lineage and cache."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


def cycles(edges: DataFrame, nodes: DataFrame, rule: str) -> DataFrame:
    """Nodes that lie on a cycle of references or lead into one.

    Where a node has one reference at most, its pointer jumps to its reference's: after k rounds it has gone
    2^k steps, so what still points somewhere after more steps than there are references never ends.
    Otherwise references to a node without references are dropped until nothing changes. Rounds: the
    logarithm of the number of references, or the longest chain; none is refused.
    """
    links = edges.select("id", "ref").where("ref is not null")
    if not links.isEmpty():
        links = _cut(links.distinct().join(nodes.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("id", "ref"))
    left = links.count()
    if left and links.groupBy("id").count().where("count > 1").isEmpty():
        steps, most = 1, left
        while left and steps <= most:
            links = _cut(links.join(links.select(F.col("id").alias("ref"), F.col("ref").alias("then")), "ref").select("id", F.col("then").alias("ref")))
            left, steps = links.count(), 2 * steps
    else:
        while left:
            links = _cut(links.join(links.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("id", "ref"))
            before, left = left, links.count()
            if left == before:
                break
    return links.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("object")).distinct()


def cycle_rules(catalog: dict[str, DataFrame], kinds=("entities", "runs", "plans")) -> list[DataFrame]:
    found = []
    if "entities" in kinds:
        e = catalog["entities"]
        found.append(cycles(e.select("id", F.col("parent").alias("ref")), e, "entity parents form a cycle"))
    if "runs" in kinds:
        runs = catalog["runs"]
        provenance = runs.select("id", F.col("parent_run").alias("ref")).unionByName(runs.select("id", F.col("input_snapshot").alias("ref")))
        found.append(cycles(provenance, runs, "run provenance forms a cycle"))
    if "plans" in kinds:
        plans = catalog["plans"]
        found.append(cycles(plans.select("id", F.col("supersedes").alias("ref")), plans, "plan succession forms a cycle"))
    return found


def transition_rules(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Changes of runs and plans that their state machines forbid."""
    def both(name: str) -> DataFrame:
        a, b = old[name], new[name]
        return a.select("id", F.struct(*a.columns).alias("o")).join(b.select("id", F.struct(*b.columns).alias("n")), "id")

    def differ(*names: str) -> Column:
        return reduce(lambda x, y: x | y, [~F.col(f"o.{n}").eqNullSafe(F.col(f"n.{n}")) for n in names])

    def same_json(name: str) -> Column:
        return F.to_json(f"o.{name}").eqNullSafe(F.to_json(f"n.{name}"))

    allowed = reduce(lambda x, y: x | y, [(F.col("o.status") == a) & F.col("n.status").isin(a, *b) for a, b in S.PLAN_TRANSITIONS.items()])
    runs = _violations(both("runs"), "id", {
        "a terminal run changed": F.col("o.status").isin(*S.TERMINAL_RUN_STATUSES) & (differ("kind", "status", "created_at", "knowledge_time", "workflow", "model", "model_version", "parent_run", "input_snapshot") | ~same_json("attributes")),
        "run kind or creation changed": differ("kind", "created_at")})
    plans = _violations(both("plans"), "id", {
        "plan identity changed": differ("run_id", "horizon_start", "horizon_end", "resolution_micros", "scenario", "supersedes"), "plan status cannot follow": ~allowed})
    return runs.unionByName(plans)


def point_rules(points: DataFrame, series: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Rules of points; with a catalogue, that series and runs are defined (run zero always is)."""
    own = _violations(points, "series_id", {"point ends before it starts": F.col("valid_time_end") < F.col("valid_time"), "point value is not finite": ~finite(F.col("value"))})
    if series is None or runs is None:
        return own
    unknown = points.select("series_id").distinct().join(series.select(F.col("id").alias("series_id")), "series_id", "left_anti").select(F.lit("point series is not defined").alias("rule"), F.col("series_id").cast("string").alias("object"))
    stray = points.where(F.col("run_id") != S.ZERO_ID).select("run_id").distinct().join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti").select(F.lit("point run is not defined").alias("rule"), F.col("run_id").alias("object"))
    return own.unionByName(unknown).unionByName(stray)


def validate(catalog: dict[str, DataFrame], before: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None) -> None:
    """Raise ModelError if the catalogue, or the way it changed, breaks a rule.

    With ``changed`` (the upserted rows by kind) only these and what refers to them is checked:
    an upsert removes nothing, so references to other objects stay good.
    """
    rows = catalog if changed is None else changed
    found = [self_rules(rows), *reference_rules(rows, catalog)]
    if before is not None and ("runs" in rows or "plans" in rows):
        found.append(transition_rules(before, {**catalog, **rows}))
    refuse(reduce(DataFrame.unionByName, found))
    looped = cycle_rules(catalog, [k for k in ("entities", "runs", "plans") if k in rows])
    if looped:
        refuse(reduce(DataFrame.unionByName, looped))


def refuse(violations: DataFrame) -> None:
    rows = violations.limit(10).collect()
    if rows:
        raise ModelError("; ".join(f"{r['rule']} ({r['object']})" for r in rows))


def snapshot_order(catalog: dict[str, DataFrame]) -> DataFrame:
    """(phase, level, kind, id): an order in which every object follows what it refers to."""
    e, r, s, runs, plans = (catalog[k] for k in ("entities", "relations", "series", "runs", "plans"))
    provenance = runs.select("id", F.col("parent_run").alias("ref")).unionByName(runs.select("id", F.col("input_snapshot").alias("ref")))
    parts = [
        (0, "entity", levels(e.select("id", F.col("parent").alias("ref")), e)), (1, "relation", r.select("id").withColumn("level", F.lit(0))), (2, "series", s.select(F.col("id").cast("string").alias("id")).withColumn("level", F.lit(0))),
        (3, "run", levels(provenance, runs)), (4, "plan", levels(plans.select("id", F.col("supersedes").alias("ref")), plans))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(phase).alias("phase"), F.col("level"), F.lit(kind).alias("kind"), "id") for phase, kind, df in parts]).orderBy("phase", "level", "id")


def empty_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in S.CATALOG.items()}
