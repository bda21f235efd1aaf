"""Access control: which frames a caller may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(tenant: str, roles: list[str], groups: list[str], principal: str) -> Column:
    """Whether a frame (tenant, visibility, roles, groups, principals as JSON arrays) is visible; missing metadata: no."""

    def listed(column: str, mine: list[str]) -> Column:
        theirs = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
        return F.arrays_overlap(theirs, F.array(*[F.lit(x) for x in mine]).cast("array<string>"))

    restricted = listed("roles", roles) | listed("groups", groups) | listed("principals", [principal])
    return F.coalesce((F.col("tenant") == tenant) & ((F.col("visibility") == "public") | ((F.col("visibility") == "restricted") & restricted)), F.lit(False))


def enforce(frames: DataFrame, tenant: str | None, roles: list[str], groups: list[str], principal: str, mode: str = "enforce") -> DataFrame:
    """Visible frames only (enforce), or all with ``acl_allowed`` (audit). Enforcing without a tenant is an error.

    The filter comes before any top-k, so a page is never short because of what its reader may not see.
    """
    if mode == "enforce" and not tenant:
        raise ValueError("access control cannot be enforced without a tenant")
    marked = frames.withColumn("acl_allowed", allowed(tenant or "", roles, groups, principal))
    return marked if mode == "audit" else marked.where("acl_allowed").drop("acl_allowed")


def counters(frames: DataFrame, tenant: str, roles: list[str], groups: list[str], principal: str) -> DataFrame:
    """One row: allowed, denied, cross_tenant, missing."""
    ok = allowed(tenant, roles, groups, principal)
    return frames.agg(F.count_if(ok).alias("allowed"), F.count_if(~ok).alias("denied"), F.count_if(F.col("tenant") != tenant).alias("cross_tenant"), F.count_if(F.col("tenant").isNull() | F.col("visibility").isNull()).alias("missing"))
