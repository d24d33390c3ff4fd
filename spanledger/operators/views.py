"""Query options of the named views: range, filters, search, sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import UNATTRIBUTED


def in_range(created: Column, now: int, days: int | None, day_start: int | None = None) -> Column:
    """The rows of the last days (trailing seconds), since day_start (today), or all; undated rows are only in all."""
    if day_start is not None:
        return created >= day_start
    return F.lit(True) if days is None else created >= now - days * 86400


def matches(provider: str | None = None, model: str | None = None, project: str | None = None, session: str | None = None) -> Column:
    """provider and model ignore case; a project forgives a trailing separator, (unattributed) is null; a session is exact."""
    out = F.lit(True)
    for column, wanted in (("provider", provider), ("model", model)):
        if wanted is not None:
            out = out & (F.lower(column) == wanted.lower())
    if project is not None:
        bare = project.rstrip("/\\") or project
        out = out & F.coalesce(F.coalesce("project", F.lit(UNATTRIBUTED)).isin(project, bare, bare + "/", bare + "\\"), F.lit(False))
    if session is not None:
        out = out & F.coalesce(F.col("session_id") == session, F.lit(False))
    return out


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with text in any of the columns, case aside."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.where(hit)


#: Each view's columns to sort by, with the default one and its direction.
SORTS = {
    "models": (["tokens", "cost", "requests", "model"], "tokens", True), "projects": (["cost", "tokens", "requests", "project"], "cost", True),
    "sessions": (["first_seen", "tokens", "cost", "requests"], "first_seen", True), "routing": (["cost_per_success", "tasks", "tokens", "agent"], "cost_per_success", False),
}


def sort_view(df: DataFrame, view: str, keys: list[str], by: str | None = None, descending: bool | None = None) -> DataFrame:
    """A view in the order asked for, unknown values last in either direction, ties by the group's keys."""
    columns, default, down = SORTS[view]
    name = by or default
    if name not in columns:
        raise ValueError(f"{view} can't be sorted by {name}")
    down = down if descending is None else descending
    return df.orderBy(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), *keys)
