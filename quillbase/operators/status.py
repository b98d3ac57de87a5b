"""The public status record of accounts, assembled as one nested row each, and the rows that a page shows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbase.functions.expr import iso_ms

# What the record says of things that can't be observed from outside.
HIDDEN = "not_publicly_observable"
ELIGIBILITY = "local attempt, cooldown, lock, and process state are not externally observable"
NOTE = "Public exchange freshness does not prove local executor or supervisor health."


def sources(errors: Column) -> Column:
    """What the record says of its sources, from a map of those that failed (null counts as none)."""
    errors = F.coalesce(errors, F.create_map().cast("map<string,string>"))
    return F.struct(F.when(F.size(errors) > 0, "partial").otherwise("ok").alias("publicApi"), errors.alias("errors"))


def assemble(accounts: DataFrame, signals: DataFrame, protection: DataFrame, performance: DataFrame, lanes: DataFrame, errors: Column | None, key: str, now_ms: Column, version: int = 1) -> DataFrame:
    """One row per account: key, schemaVersion, generatedAt, researchLanes, account, signal, protection, services, status, sources.

    Every frame has ``key``, by another name than those, and at most one row for each; what an account lacks is a null struct. ``errors`` is a map of
    sources that failed, over the columns of ``accounts`` (null counts as none).
    """
    def held(df: DataFrame, name: str, *more: Column) -> DataFrame:
        return df.select(F.col(key).alias(f"_{name}"), F.struct(*(F.col(c) for c in df.columns if c != key), *more).alias(name))

    unknown = F.lit(None).cast("boolean").alias("executionEligibility"), F.lit(ELIGIBILITY).alias("executionEligibilityReason")
    base = accounts.select(F.col(key), F.struct(*(F.col(c) for c in accounts.columns if c != key)).alias("own"), (F.lit(None).cast("map<string,string>") if errors is None else errors).alias("errors"), now_ms.alias("now"))
    for name, df, more in (("signal", signals, unknown), ("protection", protection, ()), ("performance", performance, ()), ("researchLanes", lanes, ())):
        base = base.join(held(df, name, *more), F.col(key) == F.col(f"_{name}"), "left")
    services = F.struct(*(F.lit(HIDDEN).alias(n) for n in ("executor", "timedExit", "researchMonitor")))
    status = F.struct(F.lit("public_exchange_only").alias("observerScope"), F.lit(HIDDEN).alias("localDaemonHealth"), F.lit(NOTE).alias("note"))
    return base.select(
        key, F.lit(version).alias("schemaVersion"), iso_ms(F.col("now")).alias("generatedAt"), "researchLanes", F.col("own").withField("performance", F.col("performance")).alias("account"),
        "signal", "protection", services.alias("services"), status.alias("status"), sources(F.col("errors")).alias("sources"),
    )


def lane_rows(published: DataFrame) -> DataFrame:
    """A row for each lane of published snapshots: what is shown of its state and evidence, and its tag."""
    rows = published.select("key", "availability", F.posexplode("lanes").alias("at", "lane"))
    evidence, current = F.col("lane.evidence"), F.col("availability") == "current"
    told = F.concat(evidence["decisions"].cast("string"), F.lit(" decisions / "), evidence["terminals"].cast("string"), F.lit(" terminals"))
    return rows.select(
        "key", "at", F.col("lane.name").alias("name"), F.col("lane.collectorVersion").alias("version"),
        F.when(current, F.col("lane.operationalStatus")).otherwise(F.col("availability")).alias("status"),
        F.when(evidence["decisions"].isNotNull(), told).otherwise("hidden until fresh").alias("evidence"),
        F.when(F.col("lane.quarantined"), "QUARANTINED").otherwise("PAPER ONLY").alias("tag"),
    )
