"""Web vitals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn


def explode_vitals(requests: DataFrame) -> DataFrame:
    """One row a vital; requests without vitals or with an invalid one go whole. requests has vitals: array of (pos, metric, value, attributes)."""
    whole = (F.size("vitals") > 0) & F.forall("vitals", lambda v: fn.valid_vital(v["metric"], v["value"]))
    rows = requests.where(whole).select("*", F.explode("vitals").alias("vital")).drop("vitals")
    return rows.select("*", "vital.pos", "vital.metric", "vital.value", F.coalesce("vital.attributes", F.lit("{}")).alias("attributes")).drop("vital")


def vital_dims(rows: DataFrame) -> DataFrame:
    """device, os and browser: metadata, else the user agent's, else Unknown. Versions are the user agent's; empty ones are null."""
    named = {n: F.coalesce(f"m_{n}", f"ua_{n}", F.lit("Unknown")) for n in ("device", "os", "browser")}
    return rows.withColumns(named | {v: F.nullif(F.col(f"ua_{v}"), F.lit("")) for v in ("os_version", "browser_version")})


def flag_sessions(sessions: DataFrame, signals: DataFrame, flag: str) -> DataFrame:
    """sessions (project_id, session_id, window_id, first_ms) with `flag`: a signal of the session's window came once it was there.

    Signals carry project_id, session_id, window_id (null: the session's) and received_ms; only each window's last matters.
    """
    last = signals.groupBy("project_id", "session_id", F.coalesce("window_id", "session_id").alias("window_id")).agg(F.max("received_ms").alias("last_ms"))
    out = sessions.join(last, ["project_id", "session_id", "window_id"], "left")
    return out.withColumn(flag, F.coalesce(F.col("last_ms") >= F.col("first_ms"), F.lit(False))).drop("last_ms")
