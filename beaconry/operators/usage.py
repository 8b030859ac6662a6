"""Usage per billing owner, and error groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage(rows: DataFrame) -> DataFrame:
    """Tagged rows (kind, billing_owner, token, organization_id, ord) counted per owner; one per row. Token and organization are the first row's."""
    first = F.min_by(F.struct("token", "organization_id"), "ord").alias("f")
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = rows.groupBy("billing_owner").agg(count("web", "server").alias("events"), count("error").alias("error_tracking"), count("vital").alias("web_vitals"), first)
    return out.select("billing_owner", "events", "error_tracking", "web_vitals", "f.token", "f.organization_id")


def usage_events(counted: DataFrame, sessions: DataFrame) -> DataFrame:
    """Long form without zeros, and one session_replays row per distinct session (billing_owner, session_id)."""
    long = counted.unpivot("billing_owner", ["events", "error_tracking", "web_vitals"], "metric", "units").where("units > 0")
    replays = sessions.select("billing_owner", "session_id").distinct().select("billing_owner", F.lit("session_replays").alias("metric"), F.lit(1).cast("long").alias("units"))
    return long.unionByName(replays)


def usage_by_window(rows: DataFrame, seconds: int = 5) -> DataFrame:
    """Usage per owner and flush window of the event time `received_at`; the same plan in batch and in a stream."""
    w = F.window("received_at", f"{seconds} seconds")
    count = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    out = rows.groupBy(w.alias("w"), "billing_owner").agg(count("web", "server").alias("events"), count("error").alias("error_tracking"), count("vital").alias("web_vitals"))
    return out.select(F.unix_millis("w.start").alias("window_ms"), "billing_owner", "events", "error_tracking", "web_vitals")


def error_groups(rows: DataFrame) -> DataFrame:
    """Rows of one group hash are an issue, of one exact hash a variant; weights are the rows' counts."""
    return rows.groupBy("project_id", "group_hash").agg(F.sum("count").alias("occurrences"), F.countDistinct("exact_hash").alias("variants"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"))
