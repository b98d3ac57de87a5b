"""Fail-closed validation of published snapshots: the first violated rule wins, and a stale one hides its claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAFE = 2**53 - 1
FUTURE_MS = 5_000
SCOPE = "published_local_snapshot"
HEALTH = "not_publicly_observable"

# Operational states, and those without a state or in quarantine.
STATES = (
    "running_predecision",
    "running_flat",
    "paper_position_open",
    "terminal_reconciliation_pending",
    "failed_closed",
    "not_launched_pending_review",
    "rejected_prelaunch_integrity_review",
    "invalid_prelaunch_cutoff_identity_mismatch",
    "retired",
)
NO_STATE = STATES[5:8]
QUARANTINED = STATES[6:8]
SHA = "^[0-9a-f]{64}$"

EVIDENCE = "struct<decisions:bigint,terminals:bigint,failedClosed:boolean,coverageGapOpen:boolean,evidenceHealthy:boolean>"
LANE = (
    "struct<id:string,name:string,collectorVersion:string,epochId:string,mode:string,operationalStatus:string,paperOnly:boolean,liveApproved:boolean,"
    "promotionApproved:boolean,quarantined:boolean,crossEpochPoolingAllowed:boolean,observedAtMs:bigint,firstDecisionBoundaryMs:bigint,strategyCount:bigint,"
    f"evidence:{EVIDENCE},source:struct<manifestIdentityValid:boolean,manifestSha256:string,stateMaterialSha256:string>>"
)
SCHEMA = f"key string, schema string, schemaVersion int, publishedAt string, publishedAtMs bigint, staleAfterMs bigint, observerScope string, localDaemonHealth string, lanes array<{LANE}>"


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _count(c: Column) -> Column:
    return _sure(c.between(0, MAX_SAFE))


def first_violation(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that doesn't hold (null counts as not holding), null if all hold."""
    return F.coalesce(*(F.when(~_sure(holds), F.lit(message)) for holds, message in rules))


# The contract's messages, here and in ``lane_violation``, ``violation`` and ``publish``.
def _evidence_rules(e: Column, state: Column) -> list[tuple[Column, str]]:
    free = state.isin(*NO_STATE)
    zero = (e["decisions"] == 0) & (e["terminals"] == 0)
    shut = zero & e["failedClosed"] & e["coverageGapOpen"].isNull() & (e["evidenceHealthy"] == F.lit(False))
    early = state == "running_predecision"
    rules = [(e.isNotNull(), ".evidence must be an object")]
    rules += [(_count(e[k]), f".evidence.{k} must be a non-negative integer") for k in ("decisions", "terminals")]
    rules += [(free | e[k].isNotNull(), f".evidence.{k} must be boolean or an allowed null") for k in ("failedClosed", "coverageGapOpen", "evidenceHealthy")]
    rules += [(~early | (e[k] == F.lit(v)), f".evidence.{k} must be {str(v).lower()}") for k, v in (("failedClosed", False), ("coverageGapOpen", False), ("evidenceHealthy", True))]
    return rules + [
        (~early | zero, " running_predecision must have zero decisions and terminals"),
        ((state != "not_launched_pending_review") | zero, " not-launched lane must have zero decisions and terminals"),
        ((state != "rejected_prelaunch_integrity_review") | _sure(shut), " rejected prelaunch lane must be quarantined with zero evidence"),
        ((state != "invalid_prelaunch_cutoff_identity_mismatch") | _sure(shut), " invalid prelaunch lane must be terminally quarantined with zero evidence"),
    ]


def lane_violation(lane: Column) -> Column:
    """What is wrong with one lane, after its prefix."""
    state, source = lane["operationalStatus"], lane["source"]
    hash_ok = lambda c: c.isNull() | c.rlike(SHA)
    none, seen = state.isin(*NO_STATE), lane["observedAtMs"].isNotNull() & source["stateMaterialSha256"].isNotNull()
    claims = lane["observedAtMs"].isNotNull() | source["stateMaterialSha256"].isNotNull()
    mismatch = state == STATES[7]
    rules = [(lane.isNotNull(), " must be an object")]
    rules += [(lane[k] != "", f".{k} must be a non-empty string") for k in ("id", "name", "collectorVersion", "epochId", "operationalStatus")]
    rules += [(state.isin(*STATES), ".operationalStatus is unknown"), (lane["mode"] == "paper", ".mode must be paper")]
    rules += [(lane[k] == F.lit(v), f".{k} must be {str(v).lower()}") for k, v in (("paperOnly", True), ("liveApproved", False), ("promotionApproved", False))]
    rules += [
        (lane["quarantined"].isNotNull(), ".quarantined must be boolean"),
        (lane["crossEpochPoolingAllowed"] == F.lit(False), ".crossEpochPoolingAllowed must be false"),
        (lane["observedAtMs"].isNull() | _count(lane["observedAtMs"]), ".observedAtMs is invalid"),
        (_count(lane["firstDecisionBoundaryMs"]), ".firstDecisionBoundaryMs is invalid"),
        (lane["strategyCount"].between(1, MAX_SAFE), ".strategyCount is invalid"),
        *_evidence_rules(lane["evidence"], state),
        (source["manifestIdentityValid"].isNotNull(), ".source manifest identity flag is invalid"),
        (hash_ok(source["manifestSha256"]), ".source.manifestSha256 is invalid"),
        (hash_ok(source["stateMaterialSha256"]), ".source.stateMaterialSha256 is invalid"),
        (~(none & claims), " prelaunch lane must not claim a state observation"),
        (none | seen, " active lane requires a material state observation"),
        (~mismatch | ((source["manifestIdentityValid"] == F.lit(False)) & source["manifestSha256"].isNull()), " invalid prelaunch identity may not publish a manifest hash"),
        (mismatch | (source["manifestIdentityValid"] & source["manifestSha256"].isNotNull()), " requires a valid manifest identity and hash"),
        (state.isin(*QUARANTINED) == lane["quarantined"], ".quarantined disagrees with operational status"),
    ]
    return first_violation(*rules)


def violation(schema_name: str) -> Column:
    """What is wrong with a snapshot row of ``SCHEMA``: its head, then each lane in order, then what holds over all lanes."""
    published, lanes = F.col("publishedAtMs"), F.col("lanes")
    parsed = F.unix_millis(F.try_to_timestamp("publishedAt"))
    head = first_violation(
        ((F.col("schema") == schema_name) & (F.col("schemaVersion") == 1), "research snapshot schema is unknown"),
        (_count(published) & (parsed == published), "research snapshot publication time is invalid"),
        (F.col("staleAfterMs").between(60_000, 86_400_000), "research snapshot freshness window is invalid"),
        (F.col("observerScope") == SCOPE, "research observer scope is invalid"),
        (F.col("localDaemonHealth") == HEALTH, "research snapshot may not claim public daemon health"),
        (F.size("lanes") > 0, "research snapshot lanes are missing"),
    )
    prefix = lambda i, said: F.concat(F.lit("lanes["), i.cast("string"), F.lit("]"), said)
    each = F.array_compact(F.transform(lanes, lambda x, i: prefix(i, lane_violation(x))))
    late = F.array_compact(F.transform(lanes, lambda x, i: F.when(x["observedAtMs"] > published, prefix(i, F.lit(".observedAtMs is after publication")))))
    ids = F.transform(lanes, lambda x: x["id"])
    same = F.when(F.size(F.array_distinct(ids)) != F.size(ids), "research snapshot lane ids are duplicated")
    return F.coalesce(head, F.get(each, F.lit(0)), F.get(late, F.lit(0)), same)


def publish(snapshots: DataFrame, schema_name: str, now_ms: Column | int) -> DataFrame:
    """One row per snapshot: availability (unavailable, stale or current), age, blocker and public lanes.

    A violation, or a publication over five seconds ahead, makes it unavailable with no lanes; a stale one
    keeps its lanes, without state, observation or evidence.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("long")
    rows = snapshots.withColumns({"wrong": violation(schema_name), "age": now - F.col("publishedAtMs")})
    rows = rows.withColumn("said", F.coalesce("wrong", F.when(~_sure((now >= 0) & (F.col("age") >= -FUTURE_MS)), "publication time is in the future")))
    good, stale = F.col("said").isNull(), F.col("age") > F.col("staleAfterMs")
    kept = lambda c: F.when(good, c)

    def public(lane: Column) -> Column:
        shown = lane.withField("operationalStatus", F.when(stale, "snapshot_stale").otherwise(lane["operationalStatus"]))
        shown = shown.withField("observedAtMs", F.when(~stale, lane["observedAtMs"]))
        evidence = F.struct(*(F.when(~stale, lane["evidence"][k]).alias(k) for k in ("decisions", "terminals", "failedClosed", "coverageGapOpen", "evidenceHealthy")))
        return shown.withField("evidence", evidence)

    return rows.select(
        "key",
        F.when(~good, "unavailable").when(stale, "stale").otherwise("current").alias("availability"),
        kept(F.col("publishedAt")).alias("publishedAt"), kept(F.col("publishedAtMs")).alias("publishedAtMs"), kept(F.col("age")).alias("ageMs"), kept(F.col("staleAfterMs")).alias("staleAfterMs"),
        F.when(~good, F.concat(F.lit("research lane contract failed closed: "), "said")).when(stale, "published research snapshot is stale; operational claims are hidden").alias("blocker"),
        F.when(good, F.transform("lanes", public)).otherwise(F.array()).alias("lanes"),
    )
