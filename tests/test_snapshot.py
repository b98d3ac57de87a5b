"""Snapshot contract: current, stale, future and violated."""

import copy

import pytest

from quillbase.operators import snapshot

NOW = 1_784_140_000_000
LANE = {
    "id": "a", "name": "A", "collectorVersion": "v", "epochId": "e", "mode": "paper", "operationalStatus": "running_flat", "paperOnly": True, "liveApproved": False, "promotionApproved": False,
    "quarantined": False, "crossEpochPoolingAllowed": False, "observedAtMs": NOW, "firstDecisionBoundaryMs": 1, "strategyCount": 2,
    "evidence": {"decisions": 3, "terminals": 1, "failedClosed": False, "coverageGapOpen": False, "evidenceHealthy": True},
    "source": {"manifestIdentityValid": True, "manifestSha256": "a" * 64, "stateMaterialSha256": "b" * 64},
}
BASE = {"key": "k", "schema": "lanes", "schemaVersion": 1, "publishedAt": "2026-07-15T18:26:40.000Z", "publishedAtMs": NOW, "staleAfterMs": 7_200_000, "observerScope": snapshot.SCOPE, "localDaemonHealth": snapshot.HEALTH, "lanes": [LANE]}


def publish(spark, now=NOW, lane=None, evidence=None, source=None, more=(), **head):
    row = copy.deepcopy(BASE) | head
    if row["lanes"]:
        row["lanes"][0] |= lane or {}
        row["lanes"][0]["evidence"] |= evidence or {}
        row["lanes"][0]["source"] |= source or {}
        row["lanes"] += copy.deepcopy(list(more))
    return snapshot.publish(spark.createDataFrame([row], snapshot.SCHEMA), "lanes", now).first()


def test_current(spark):
    r = publish(spark)
    assert r.availability == "current" and r.blocker is None and r.ageMs == 0 and r.lanes[0].evidence.decisions == 3


def test_stale_hides_claims(spark):
    assert publish(spark, NOW + 7_200_000).availability == "current"
    r = publish(spark, NOW + 7_200_001)
    assert r.availability == "stale" and r.lanes[0].operationalStatus == "snapshot_stale" and r.lanes[0].observedAtMs is None and r.lanes[0].evidence.decisions is None


def test_future(spark):
    assert publish(spark, NOW - 5_000).availability == "current"
    r = publish(spark, NOW - 5_001)
    assert r.availability == "unavailable" and r.blocker.endswith("publication time is in the future") and r.lanes == []


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"schemaVersion": 2}, "research snapshot schema is unknown"),
        ({"publishedAt": "2026-07-15T18:26:41.000Z"}, "research snapshot publication time is invalid"),
        ({"staleAfterMs": 59_999}, "research snapshot freshness window is invalid"),
        ({"observerScope": "x"}, "research observer scope is invalid"),
        ({"lanes": []}, "research snapshot lanes are missing"),
        ({"lane": {"liveApproved": True}}, "lanes[0].liveApproved must be false"),
        ({"lane": {"name": ""}}, "lanes[0].name must be a non-empty string"),
        ({"lane": {"operationalStatus": "odd"}}, "lanes[0].operationalStatus is unknown"),
        ({"lane": {"strategyCount": 0}}, "lanes[0].strategyCount is invalid"),
        ({"evidence": {"decisions": -1}}, "lanes[0].evidence.decisions must be a non-negative integer"),
        ({"evidence": {"failedClosed": None}}, "lanes[0].evidence.failedClosed must be boolean or an allowed null"),
        ({"lane": {"operationalStatus": "running_predecision"}}, "lanes[0] running_predecision must have zero decisions and terminals"),
        ({"source": {"manifestSha256": "zz"}}, "lanes[0].source.manifestSha256 is invalid"),
        ({"source": {"stateMaterialSha256": None}}, "lanes[0] active lane requires a material state observation"),
        ({"lane": {"operationalStatus": "not_launched_pending_review"}, "evidence": {"decisions": 0, "terminals": 0}}, "lanes[0] prelaunch lane must not claim a state observation"),
        ({"lane": {"quarantined": True}}, "lanes[0].quarantined disagrees with operational status"),
        ({"lane": {"observedAtMs": NOW + 1}}, "lanes[0].observedAtMs is after publication"),
        ({"more": [LANE]}, "research snapshot lane ids are duplicated"),
        ({"more": [LANE | {"mode": "live"}]}, "lanes[1].mode must be paper"),
    ],
)
def test_first_violation(spark, change, said):
    r = publish(spark, **change)
    assert r.availability == "unavailable" and r.blocker == f"research lane contract failed closed: {said}"
