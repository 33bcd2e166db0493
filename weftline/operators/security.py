"""Row and function access by role level, owner and group. Lower levels are more privileged; a row's level is the greatest that may see it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOD, ADMIN, INTERNAL, PARTNER, PUBLIC = 0, 1, 5, 10, 100


@dataclass(frozen=True)
class UserContext:
    user_id: str | None = None
    role_level: int = PUBLIC
    groups: tuple[str, ...] = field(default=())


def user_context(users: DataFrame, user_id: str, role_level: int | None = None) -> UserContext:
    """Level: the argument, else the user's role_level, else required_access_level, else public. Unknown users are public."""
    row = users.where(F.col("id") == user_id).select("role_level", "required_access_level", "groups").first()
    if row is None:
        return UserContext(user_id, PUBLIC if role_level is None else role_level)
    level = next((x for x in (role_level, row.role_level, row.required_access_level) if x is not None), PUBLIC)
    return UserContext(user_id, level, tuple(row.groups or ()))


def row_filter(ctx: UserContext, mode: str = "or", level: str = "required_access_level", owner: str = "userid", group: str = "groupid", default: int = INTERNAL) -> Column:
    """Rows the context may see. or: by level, or as owner, or by group; and: by level and (unowned, owner or group). Null levels count as ``default``."""
    by_level = F.lit(ctx.role_level) <= F.coalesce(F.col(level), F.lit(default))
    own = F.coalesce(F.col(owner) == F.lit(ctx.user_id), F.lit(False)) if ctx.user_id is not None else F.lit(False)
    grouped = F.coalesce(F.col(group).isin(*ctx.groups), F.lit(False)) if ctx.groups else F.lit(False)
    if mode == "and":
        return by_level & (F.col(owner).isNull() | own | grouped)
    return by_level | own | grouped


def secured(df: DataFrame, ctx: UserContext | None, mode: str = "or") -> DataFrame:
    """``df`` as the context sees it; without a context, as the system does: all of it. Missing security columns are added as null."""
    if ctx is None:
        return df
    for c, t in (("userid", "string"), ("groupid", "string"), ("required_access_level", "int")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.where(row_filter(ctx, mode))


def secure_view(df: DataFrame, name: str, ctx: UserContext, mode: str = "or") -> None:
    secured(df, ctx, mode).createOrReplaceTempView(name)


def allowed_functions(functions: DataFrame, level: int | None, column: str = "required_access_level") -> DataFrame:
    """Functions a level may call; none means the system, which may call all. Functions without a level are public."""
    return functions if level is None else functions.where(F.lit(level) <= F.coalesce(F.col(column), F.lit(PUBLIC)))


def visible_levels(levels: Sequence[int], user_level: int | None) -> list[int]:
    return [x for x in levels if user_level is None or user_level <= x]
