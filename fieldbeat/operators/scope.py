"""Who may see which merchants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.schema import ROLES


@dataclass(frozen=True)
class Caller:
    """The user on whose behalf a read runs; an unknown role is refused, never widened."""

    user_id: str
    role: str

    def __post_init__(self):
        object.__setattr__(self, "role", (self.role or "").strip())
        if self.role not in ROLES:
            raise PermissionError(f"unknown role {self.role!r}")

    def require(self, *roles: str) -> None:
        if self.role not in roles:
            raise PermissionError(f"{self.role} is not one of {', '.join(roles)}")


def active(merchants: DataFrame) -> DataFrame:
    return merchants.where(F.col("is_active"))


def team(users: DataFrame, manager_id: str, with_self: bool = True) -> DataFrame:
    """Ids of a manager's direct reports and, if wanted, the manager's own, as ``id``."""
    member = F.col("manager_id") == manager_id
    if with_self:
        member = member | (F.col("id") == manager_id)
    return users.where(member).select("id")


def in_scope(merchants: DataFrame, users: DataFrame, caller: Caller) -> DataFrame:
    """The merchants a caller sees: a DSP its own, a Manager the team's, an Admin all."""
    if caller.role == "Admin":
        return merchants
    if caller.role == "DSP":
        return merchants.where(F.col("assigned_dsp_id") == caller.user_id)
    members = team(users, caller.user_id).withColumnRenamed("id", "assigned_dsp_id")
    return merchants.join(members, "assigned_dsp_id", "left_semi").select(merchants.columns)


def region_of(users: DataFrame, caller: Caller) -> Column:
    """Scalar subquery: the caller's region."""
    return users.where(F.col("id") == caller.user_id).select("region").scalar()


def viewer_owners(users: DataFrame) -> DataFrame:
    """(viewer_id, owner_id): whose merchants each DSP and Manager sees.

    At most three rows per user. Admins see everything by role, so they have no rows:
    pairing each Admin with each merchant would only repeat the merchant table.
    """
    itself = users.where(F.col("role").isin("DSP", "Manager")).select(
        F.col("id").alias("viewer_id"), F.col("id").alias("owner_id"))
    managers = users.where(F.col("role") == "Manager").select(F.col("id").alias("viewer_id"))
    reports = users.where(F.col("manager_id") != F.col("id")).select(
        F.col("manager_id").alias("viewer_id"), F.col("id").alias("owner_id"))
    return itself.unionByName(reports.join(managers, "viewer_id"))


def entitlements(users: DataFrame, merchants: DataFrame) -> DataFrame:
    """(viewer_id, merchant_id) for every DSP and Manager at once."""
    owned = merchants.select(
        F.col("assigned_dsp_id").alias("owner_id"), F.col("id").alias("merchant_id"))
    return viewer_owners(users).join(owned, "owner_id").select("viewer_id", "merchant_id")
