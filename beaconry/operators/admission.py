"""Project context, request admission and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn


def project_context(projects: DataFrame, sources: DataFrame, organizations: DataFrame, members: DataFrame) -> DataFrame:
    """One row a project: its billing owner and its data sources by reference id, of which the last declared wins."""
    rule = F.struct("data_type", "metric_shape", "regex", "allow_negative", "allow_float", "min_value", "max_value")
    last = sources.groupBy("project_id", "reference_id").agg(F.max_by(rule, "ord").alias("rule"))
    maps = last.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("reference_id", "rule"))).alias("sources"))
    owners = members.where("role = 'owner'").groupBy("organization_id").agg(F.min("user_id").alias("org_owner"))
    out = projects.join(organizations, "organization_id", "left").join(owners, "organization_id", "left").join(maps, "project_id", "left")
    return out.withColumn("billing_owner", F.coalesce("org_owner", "owner_id"))


def attach_context(requests: DataFrame, context: DataFrame) -> DataFrame:
    """Requests with their project's columns; `authorized` is false for unknown tokens. Spark broadcasts contexts while they are small."""
    return requests.join(context.withColumn("authorized", F.lit(True)), "token", "left").withColumn("authorized", F.coalesce("authorized", F.lit(False)))


def token_of(body: Column, header: Column) -> Column:
    """A request's token: the body's, else the header's without its scheme."""
    return F.coalesce(fn.blank_to_null(body), fn.blank_to_null(F.regexp_replace(header, "^Bearer ", "")))


def attach_ip_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with ip_allowed and ip_denied (what the rules of their token say of their address) and ip_restricted.

    Addresses are looked up by equality, so a token may have any number of rules.
    """
    each = rules.groupBy("token", F.col("ip").alias("client_ip")).agg(F.bool_or("allowed").alias("ip_allowed"), F.bool_or(~F.col("allowed")).alias("ip_denied"))
    limited = rules.where("allowed").select("token", F.lit(True).alias("ip_restricted")).distinct()
    out = requests.join(each, ["token", "client_ip"], "left").join(limited, "token", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ip_allowed", "ip_denied", "ip_restricted")})


def ip_verdict() -> Column:
    """Null, or why the address is refused: an exact denial wins; with allow rules one must match."""
    return F.when(F.col("ip_denied"), "IP address blocked").when(F.col("ip_restricted") & ~F.col("ip_allowed"), "IP address not allowed")


def feature_gate(route: Column, errors: Column, vitals: Column, replays: Column) -> tuple[Column, Column, Column]:
    """(keep the request, keep its errors, notice) by the project's features."""
    notice = F.when((route == "error") & ~errors, "error tracking disabled").when((route == "vitals") & ~vitals, "web vitals disabled").when((route == "replay") & ~replays, "replays disabled")
    return notice.isNull(), errors & notice.isNull(), notice


def admission(requests: DataFrame) -> DataFrame:
    """reject_reason per request; the first failing check names it, in each route's order.

    Requests carry authorized, route, hosts, host, what attach_ip_rules adds, and the feature flags.
    """
    keep, keep_errors, notice = feature_gate(F.col("route"), F.coalesce("error_tracking_enabled", F.lit(True)), F.coalesce("web_vitals_enabled", F.lit(True)), F.coalesce("replays_enabled", F.lit(True)))
    host = F.when(~F.col("route").isin("collect", "error") & ~fn.hostname_allowed(F.col("hosts"), F.col("host")), "Origin not allowed")
    ip = ip_verdict()
    early = F.col("route").isin("vitals", "replay")
    reason = F.when(~F.col("authorized"), "Unauthorized").otherwise(F.when(early, F.coalesce(host, notice, ip)).otherwise(F.coalesce(host, ip, notice)))
    return requests.withColumn("reject_reason", reason).withColumn("keep_errors", keep_errors)
