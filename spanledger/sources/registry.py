"""The ordered list of sources; the order is the priority in merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.journal import Journal
from ..operators.supersede import merge_sources
from ..session import materialize
from . import lines, stores, telemetry


@dataclass(frozen=True)
class Source:
    id: str
    label: str
    enabled: bool
    interval: int
    has_rows: bool
    has_billing: bool
    read: Callable[[SparkSession, str, str], DataFrame] | None


def _events(spark: SparkSession, path: str, billing: str) -> DataFrame:
    return stores.event_usage(stores.read_store(spark, path, "assistant_usage_events", stores.EVENTS), stores.read_store(spark, path, "sessions", stores.SESSIONS), billing)


def _billed(rows: DataFrame, billing: str) -> DataFrame:
    return rows.withColumn("billing", F.lit(billing))


SOURCES = [
    Source("opencode", "OpenCode", True, 30, True, False, lambda s, p, b: stores.message_usage(stores.read_store(s, p, "message", "data string, time_created long"))),
    Source("claude_code", "Claude Code", True, 30, True, True, lambda s, p, b: _billed(lines.transcript_usage(lines.read_lines(s, p)), b)),
    Source("codex", "Codex", True, 30, True, True, lambda s, p, b: _billed(lines.rollout_usage(lines.read_lines(s, p, "*.jsonl*")), b)),
    Source("copilot", "Copilot", True, 30, True, True, _events),
    Source("gemini", "Gemini", True, 30, True, True, lambda s, p, b: telemetry.telemetry_usage(telemetry.read_objects(s, p), b)),
    Source("journal", "Journal", True, 60, True, False, lambda s, p, b: Journal(s, p).scan_usage()),
    Source("rates", "Rate refresh", False, 3600, False, False, None),
]


def read_source(spark: SparkSession, source: Source, path: str, billing: str = "per_token") -> DataFrame:
    """The rows of a source, written once: seq, by which rows are matched later, is then the same however often they are read."""
    return materialize(source.read(spark, path, billing), source.id)


def read_all(spark: SparkSession, paths: dict[str, str], dedup_base: bool = False, billing: dict[str, str] | None = None) -> DataFrame:
    """Usage rows of all sources with a path, in registry order, merged by identity. seq carries the source's place first.

    billing gives what is known of how a source is paid (subscription or per_token); only sources that support it are stamped.
    """
    frames = []
    for place, source in enumerate(SOURCES):
        if source.read and source.id in paths:
            paid = (billing or {}).get(source.id, "per_token") if source.has_billing else "per_token"
            rows = read_source(spark, source, paths[source.id], paid)
            frames.append(rows.withColumn("seq", F.lit(place).cast("long") * F.lit(1 << 58) + F.col("seq")))
    if not frames:
        raise ValueError("no source has a path")
    return merge_sources(frames[0], frames[1:], dedup_base)


def usage(spark: SparkSession, paths: dict[str, str], rates: DataFrame, tiers: DataFrame, periods: DataFrame, billing: dict[str, str] | None = None) -> DataFrame:
    """From the logs to priced rows: read and classify every source, merge by identity, estimate what has no cost, decide what that means."""
    return lookup.apply_estimates(lookup.estimate(read_all(spark, paths, billing=billing), rates, tiers, periods))


def report(spark: SparkSession, paths: dict[str, str]) -> list[dict]:
    """id, status, rows and detail of each source; a source that fails says so and hides none of the others."""
    out = []
    for source in SOURCES:
        row = {"id": source.id, "label": source.label, "present": source.id in paths, "rows": 0, "status": "absent", "detail": ""}
        if source.read and source.id in paths:
            try:
                row |= {"rows": source.read(spark, paths[source.id], "per_token").count(), "status": "ok"}
            except Exception as e:
                row |= {"status": "failed", "detail": str(e).splitlines()[0][:200]}
        out.append(row)
    return out
