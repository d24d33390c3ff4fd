"""Rate tables, limit records and small configuration files."""

from __future__ import annotations

import json
import tomllib
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import format_duration, listed_price, rfc3339_seconds, slug, strip_html
from ..operators.limits import fraction
from ..schema import TOKEN_BUCKETS
from .lines import S, struct

_RATE_FIELDS = ", ".join(f"r_{c} double" for c in TOKEN_BUCKETS)
RATE_SCHEMA = f"key string, curated boolean, free boolean, {_RATE_FIELDS}"
TIER_SCHEMA = f"key string, threshold long, {_RATE_FIELDS}"
PERIOD_SCHEMA = f"key string, through string, {_RATE_FIELDS}"


def _numbers(entry: dict) -> list[float | None] | None:
    """The rates of an entry in bucket order; None if one isn't a number from 0."""
    out = []
    for c in TOKEN_BUCKETS:
        v = entry.get(c)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v < float("inf")):
            return None
        out.append(None if v is None else float(v))
    return out


def _is_date(text: str) -> bool:
    try:
        return len(text) == 10 and bool(date.fromisoformat(text))
    except ValueError:
        return False


def read_rates_toml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(rates, tiers, periods, warnings) of a curated TOML table; a bad tier or period is told and never applied."""
    doc = tomllib.loads(Path(path).read_text())
    rates, tiers, periods, warnings = [], [], [], []
    for key, entry in doc.get("model", {}).items():
        if (own := _numbers(entry)) is None:
            warnings.append(f"{key}: bad rate")
            continue
        rates.append((key.lower(), True, entry.get("free") is True, *own))
        for name, sub in entry.items():
            if name.startswith("tier-"):
                size, nums = name[5:], _numbers(sub) if isinstance(sub, dict) else None
                if size.isdigit() and nums:
                    tiers.append((key.lower(), int(size), *nums))
                else:
                    warnings.append(f"{key}: bad {name}")
        for sub in entry.get("period", []):
            nums, through = _numbers(sub), str(sub.get("through", ""))
            if nums and _is_date(through):
                periods.append((key.lower(), through, *nums))
            else:
                warnings.append(f"{key}: bad period")
    dated = spark.createDataFrame(periods, PERIOD_SCHEMA).withColumn("through", F.to_date("through"))
    return spark.createDataFrame(rates, RATE_SCHEMA), spark.createDataFrame(tiers, TIER_SCHEMA), dated, warnings


def read_rates_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rates, tiers, skipped: one row) of a compact table, `key<TAB>field=rate...[<TAB>tier=n]` a line."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    parts = lines.select(F.split("value", "\t").alias("p")).select(F.lower(F.trim(F.col("p")[0])).alias("key"), F.slice("p", F.lit(2), F.size("p") - 1).alias("f"))
    good = (F.col("key") != "") & (F.size("f") > 0) & F.forall("f", lambda x: x.rlike(r"^(input|output|reasoning|cache_read|cache_write)=[0-9]+(\.[0-9]+)?$|^tier=[0-9]+$|^free=true$"))
    fields = F.map_from_entries(F.transform("f", lambda x: F.struct(F.split(x, "=")[0].alias("k"), F.split(x, "=")[1].alias("v"))))
    read = parts.where(good).where("size(array_distinct(transform(f, x -> split(x, '=')[0]))) = size(f)").withColumn("m", fields)
    nums = [F.col("m")[c].cast("double").alias(f"r_{c}") for c in TOKEN_BUCKETS]
    rates = read.where("m['tier'] is null").select("key", F.lit(False).alias("curated"), (F.coalesce(F.col("m")["free"], F.lit("")) == "true").alias("free"), *nums)
    tiers = read.where("m['tier'] is not null").select("key", F.col("m")["tier"].cast("long").alias("threshold"), *nums)
    return rates, tiers, parts.agg(F.sum((~good).cast("int")).alias("skipped"))


def pricing_rows(html: DataFrame, text: str) -> DataFrame:
    """key, cells and prices of the rows of tables whose header speaks of input and output, from HTML pages."""
    tables = html.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))).alias("t")).where("lower(t) like '%input%' and lower(t) like '%output%'")
    rows = tables.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    cells = rows.select(F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)).alias("raw")).where("size(raw) > 1")
    clean = cells.withColumn("cells", F.transform("raw", strip_html))
    return clean.select(slug(F.col("cells")[0]).alias("key"), "cells", F.transform(F.slice("cells", F.lit(2), F.size("cells") - 1), listed_price).alias("prices"))


PANEL = struct(id=S, name=S, updatedAt=S, ready=T.BooleanType(), tierLabel=S, usageStatusText=S, limits=T.ArrayType(struct(label=S, title=S, percent=T.DoubleType(), resetsAt=S)))


def read_panel_records(spark: SparkSession, path: str) -> DataFrame:
    """agent, name, ready, tier, status_text, updated_at, windows: every record, those without windows included.

    One JSON object a file; hidden files aside. A window's share is at most 1; one below zero or not a number is no window.
    """
    r = spark.read.schema(PANEL).option("multiLine", "true").option("pathGlobFilter", "[!.]*.json").json(path)
    window = lambda w: F.struct(F.coalesce(w["title"], w["label"]).alias("label"), fraction(w["percent"]).alias("fraction"), w["resetsAt"].alias("resets_at"))
    windows = F.filter(F.transform(F.coalesce("limits", F.array().cast(PANEL["limits"].dataType)), window), lambda w: w["fraction"].isNotNull())
    return r.select(F.col("id").alias("agent"), "name", "ready", F.col("tierLabel").alias("tier"), F.col("usageStatusText").alias("status_text"), F.col("updatedAt").alias("updated_at"), windows.alias("windows"))


def read_panel_limits(spark: SparkSession, path: str) -> DataFrame:
    """agent, tier, updated_at, label, fraction, resets_at: the windows of every record."""
    return read_panel_records(spark, path).select("agent", "tier", "updated_at", F.explode("windows").alias("w")).select("agent", "tier", "updated_at", "w.*")


# The window kinds of a cached utilisation record and their names.
CACHE_KINDS = {"session": "Session (5-hour)", "weekly_all": "Weekly (all models)", "weekly_scoped": "Weekly"}
# Only what is declared is read: account identifiers and the like never leave the scan.
CACHE = struct(cachedUsageUtilization=struct(
    fetchedAtMs=T.DoubleType(), utilization=struct(limits=T.ArrayType(struct(kind=S, percent=T.DoubleType(), resets_at=S, scope=struct(model=struct(display_name=S))))),
))


def read_cached_limits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(windows: fetched_at, label, fraction, resets_at; dropped: one row) of cached utilisation, a JSON object a file.

    Kinds outside the vocabulary and percentages that aren't numbers from 0 are dropped and counted.
    """
    r = spark.read.schema(CACHE).option("multiLine", "true").json(path)
    at = F.floor(F.col("cachedUsageUtilization.fetchedAtMs") / 1000).cast("long")
    each = r.select(at.alias("fetched_at"), F.explode("cachedUsageUtilization.utilization.limits").alias("l"))
    model, kind = F.col("l.scope.model.display_name"), F.col("l.kind")
    label = F.create_map(*(F.lit(x) for pair in CACHE_KINDS.items() for x in pair))[kind]
    label = F.when(kind == "weekly_scoped", F.concat(label, F.coalesce(F.concat(F.lit(" · "), model), F.lit(" (scoped)")))).otherwise(label)
    named = each.select("fetched_at", label.alias("label"), fraction(F.col("l.percent") / 100).alias("fraction"), rfc3339_seconds(F.col("l.resets_at")).alias("resets_at"))
    good = F.col("label").isNotNull() & F.col("fraction").isNotNull()
    return named.where(good), named.agg(F.coalesce(F.sum((~good).cast("int")), F.lit(0)).alias("dropped"))


# The window kinds of a status line.
STATUS_WINDOWS = {"five_hour": "5h", "seven_day": "7d", "spend_limit": "spend"}
STATUS_LINE = struct(rate_limits=struct(**{k: struct(used_percentage=T.DoubleType(), resets_at=T.DoubleType()) for k in STATUS_WINDOWS}))


def status_windows(lines: DataFrame, now: int) -> DataFrame:
    """The live windows of each status line, as an array and as one text such as `5h 42% (resets 2h 14m)`."""
    r = lines.select("*", F.from_json("line", STATUS_LINE).alias("s"))
    each = F.array(*(F.struct(F.lit(short).alias("label"), F.col(f"s.rate_limits.{k}.used_percentage").alias("pct"), F.col(f"s.rate_limits.{k}.resets_at").cast("long").alias("at")) for k, short in STATUS_WINDOWS.items()))
    live = F.filter(each, lambda w: w["pct"].isNotNull() & (w["at"].isNull() | (w["at"] > now)))
    shown = F.transform("live", lambda w: F.concat(w["label"], F.lit(" "), F.round(w["pct"]).cast("long").cast("string"), F.lit("%"), F.when(w["at"].isNotNull(), F.concat(F.lit(" (resets "), format_duration(w["at"] - now), F.lit(")"))).otherwise("")))
    return r.withColumn("live", live).withColumn("status_line", F.array_join(shown, " · ")).drop("s")


def read_account(path: str) -> dict | None:
    """Whether an account block is there, and its two tier keys; any failure is no evidence."""
    try:
        block = json.loads(Path(path).read_text()).get("oauthAccount")
        return {k: block.get(k) for k in ("organizationRateLimitTier", "userRateLimitTier")} if isinstance(block, dict) else None
    except (OSError, ValueError, AttributeError):
        return None


def billing_of(explicit: str | None = None, api_key: bool = False, account: dict | None = None, plan: str | None = None) -> tuple[str, str]:
    """(billing, evidence): an explicit setting, then an API key, then an account block, then a plan's name."""
    if explicit in ("subscription", "per_token"):
        return explicit, "setting"
    if api_key:
        return "per_token", "api key"
    if account is not None:
        return "subscription", "account"
    if plan and plan.strip():
        return "subscription", "plan label"
    return "per_token", "unknown"


def sticky_billing(before: tuple[str, str] | None, now: tuple[str, str]) -> tuple[str, str]:
    """Evidence once seen outlasts a poll that sees none."""
    return before if before and now[1] == "unknown" and before[1] != "unknown" else now


def transcript_of(folder: str, session: str, agent: str | None) -> str:
    """The subagent's transcript if there is one, else the session's."""
    own = Path(folder) / session / "subagents" / f"agent-{agent}.jsonl"
    return str(own if agent and own.exists() else Path(folder) / f"{session}.jsonl")
