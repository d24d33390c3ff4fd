"""Exports: rows as JSON and CSV, the summary document, alerts and the desktop record."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_guard
from ..schema import TOKEN_BUCKETS, is_billable, needs_price, total_tokens
from . import routing as R
from . import usage as U

# The columns of the CSV, in their order; new ones go to the end.
CSV_COLUMNS = [
    "provider", "model", "category", "cost_status", "requests", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "cost", "created", "project", "session_id", "api_equivalent_cost",
]


def csv_rows(usage: DataFrame) -> DataFrame:
    """The rows of the CSV as text columns: nulls empty, costs in plain decimals, text guarded against being run by a spreadsheet."""
    named = usage.withColumnsRenamed({c: f"{c}_tokens" for c in TOKEN_BUCKETS})
    text = {f.name for f in named.schema if f.dataType.simpleString() == "string"}
    money = {f.name for f in named.schema if f.dataType.simpleString() == "double"}
    return named.select(*(F.coalesce(csv_guard(F.col(c)) if c in text else plain_decimal(F.col(c)) if c in money else F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS))


def plain_decimal(value: Column) -> Column:
    """A number without exponent, to 18 decimals, without zeros at its end."""
    return F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def write_csv(usage: DataFrame, path: str) -> None:
    csv_rows(usage).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


# The fields of an exported row and what they are of ours.
JSON_FIELDS = {
    "provider": "provider", "model": "model", "category": "category", "cost_status": "cost_status", "requests": "requests", "input_tokens": "input", "output_tokens": "output", "reasoning_tokens": "reasoning", "cache_read_tokens": "cache_read",
    "cache_write_tokens": "cache_write", "cost": "cost", "billing": "billing", "incomplete": "incomplete", "created": "created", "project": "project", "session_id": "session_id", "api_equivalent_cost": "api_equivalent_cost",
}
SCHEMA_VERSION = 1
MOST_LISTED = 10_000


def published(usage: DataFrame) -> DataFrame:
    """Usage rows under the names of the published document."""
    return usage.select(*(F.col(ours).alias(name) for name, ours in JSON_FIELDS.items()))


def json_rows(usage: DataFrame) -> DataFrame:
    """One JSON object a row, nulls written."""
    rows = published(usage)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def _list(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def by_model(usage: DataFrame, top: int, rate: DataFrame | None = None) -> DataFrame:
    """The model list of the summary: by provider, model, category and status, with sessions and, if given, list rates (model, rate)."""
    out = U.top_with_other(usage, ["provider", "model", "category", "cost_status"], top, {"sessions": F.count_distinct("session_id")})
    listed = rate.select("model", F.col("rate").alias("list_input_rate")) if rate is not None else None
    return U.with_ratios(out.join(listed, "model", "left") if listed is not None else out)


def by_project(usage: DataFrame, top: int) -> DataFrame:
    named = usage.withColumn("project", F.coalesce("project", F.lit(U.UNATTRIBUTED)))
    first, last = U.seen()
    models = F.count_distinct(F.concat_ws("/", "provider", "model"))
    return U.with_ratios(U.top_with_other(named, ["project"], top, {"sessions": F.count_distinct("session_id"), "models": models, "first_seen": first, "last_seen": last}))


def by_session(usage: DataFrame, top: int) -> DataFrame:
    """The session list of the summary; `other` also holds the rows without session."""
    return U.with_ratios(U.top_with_other(usage, ["session_id"], top, U.session_details()))


def summary(usage: DataFrame, now: int, top: int = 10, rate: DataFrame | None = None, budgets: DataFrame | None = None, limits: DataFrame | None = None, routing: DataFrame | None = None, withheld: DataFrame | None = None, sources: list[dict] = (), scope: dict | None = None) -> dict:
    """The summary document: totals and the largest groups, each list with `other` so that it adds up.

    Lists hold at most top rows; what reaches the driver are these reports, never rows. For all groups use the frames
    (by_model() and so on, with top 0): a document of more than MOST_LISTED entries a list is refused.
    """
    if not 0 < top <= MOST_LISTED:
        raise ValueError(f"a document lists 1 to {MOST_LISTED} groups; the frames give all")
    shown = lambda rows: {"rows": [{k: v for k, v in r.items() if k != "shown"} for r in rows if r["shown"]], "other": next(({k: v for k, v in r.items() if k != "shown"} for r in rows if not r["shown"]), None)}
    transitions = R.escalations(usage, rate) if rate is not None else None
    days = [{**r, "day": str(r["day"])} for r in _list(U.by_day(usage))]
    return {
        "schema_version": SCHEMA_VERSION, "generated_at": now, "filters": {k: (scope or {}).get(k) for k in ("provider", "model", "project", "session")}, "range": {k: (scope or {}).get(k) for k in ("label", "since")}, "sources": list(sources),
        "totals": _list(U.with_ratios(usage.agg(*U.counters())))[0], "by_category": sorted(_list(U.by_category(usage)), key=lambda r: -r["tokens"]), "by_model": shown(_list(by_model(usage, top, rate))), "by_project": shown(_list(by_project(usage, top))),
        "by_session": shown(_list(by_session(usage, top))), "by_day": {"rows": days, "undated_requests": _list(U.undated_requests(usage))[0]["undated_requests"]}, "burn": _list(U.burn(usage, now))[0], "coverage": _list(U.coverage(usage))[0],
        "budgets": _list(budgets.orderBy("name")) if budgets is not None else [], "limits": _list(limits) if limits is not None else [], "provenance": _list(U.provenance(usage)),
        "escalations": {**_list(transitions[0])[0], "transitions": _list(transitions[1])} if transitions else None,
        "routing": {"events": routing.count(), "aggregates": _list(R.aggregates(routing)), "withheld": _list(R.withheld_by_reason(withheld)) if withheld is not None else []} if routing is not None else None,
    }


def usage_document(usage: DataFrame, limits: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row a record of the full export, by section: rows, limits, escalations and provenance."""
    part = lambda name, df: df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    return part("rows", usage).unionByName(part("limits", limits)).unionByName(part("escalations", transitions)).unionByName(part("provenance", U.provenance(usage)))


def routing_rows(events: DataFrame, since: int | None = None) -> DataFrame:
    """Routing events as text columns of a CSV: all history unless a range is given."""
    kept = events if since is None else events.where(F.col("created") >= since)
    text = {f.name for f in kept.schema if f.dataType.simpleString() == "string"}
    return kept.select(*(F.coalesce(csv_guard(F.col(c)) if c in text else F.col(c).cast("string"), F.lit("")).alias(c) for c in kept.columns))


def routing_document(events: DataFrame, since: int | None = None) -> DataFrame:
    """One JSON object for each agent, model and provider with its aggregates and rates; an unknown stays null."""
    kept = events if since is None else events.where(F.col("created") >= since)
    agg = R.aggregates(kept)
    keys = ["agent", "model", "provider"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = agg.alias("a").join(R.rates(agg).alias("r"), same).select("a.*", "r.basis", "r.cost_per_success", "r.success_rate", *(f"r.{c}_rate" for c in R.OBSERVED))
    return both.select(F.to_json(F.struct(*both.columns), {"ignoreNullFields": "false"}).alias("json"))


def check_budgets(status: DataFrame) -> tuple[list[dict], int]:
    """(the budgets that ask for something to be done, exit code: 1 if there are any)."""
    alerts = [r.asDict() for r in actionable(status).orderBy("name").collect()]
    return alerts, int(bool(alerts))


def doctor(sources: list[dict], usage: DataFrame, stats: DataFrame) -> list[str]:
    """A report of a few lines: each source, the journal's tables, and what the costs stand on."""
    out = [f"{s['id']}: {s['status']}, {s['rows']} rows" + (f" ({s['detail']})" if s["detail"] else "") for s in sources]
    out += [f"journal {r['table_name']}: {r['n']} rows" for r in stats.orderBy("table_name").collect()]
    return out + [f"{r['cost_status']}: {r['requests']} requests" for r in U.provenance(usage).orderBy("place").collect()]


def unknown_keys(value, shape, at: str = "") -> list[str]:
    """The keys of a document that its shape (nested dicts, one-element lists, None for any scalar) doesn't name."""
    if isinstance(value, dict):
        if not isinstance(shape, dict):
            return [at or "."]
        return [p for k, v in value.items() for p in (unknown_keys(v, shape[k], f"{at}.{k}") if k in shape else [f"{at}.{k}"])]
    if isinstance(value, list) and isinstance(shape, list):
        return [p for v in value for p in unknown_keys(v, shape[0], at + "[]")]
    return []


def actionable(status: DataFrame) -> DataFrame:
    """The budgets that ask for something to be done."""
    return status.where(F.col("level") != "ok")


# How a budget's period is spoken of.
PERIOD_NOUN = {"daily": "day", "weekly": "week", "monthly": "month"}


def desktop_record(usage: DataFrame, budgets: list[dict], now: int, id_: str = "opencode", name: str = "OpenCode", balance: dict | None = None, zone: str = "UTC") -> dict:
    """The record of a desktop panel: tokens by model, of today and of seven days, sessions and prompts, budgets as meters, and what they stand on.

    budgets are budget_status() rows with period and resets_at. The days and models of the document are aggregated first.
    """
    today = U.local_day(F.lit(now), zone)
    on_day = (F.col("created") > 0) & (U.local_day(F.col("created"), zone) == today)
    priced = is_billable() & F.col("cost").isNotNull()
    asked = needs_price()
    t = usage.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("requests"), F.lit(0)).alias("prompts"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum(F.when(on_day, F.col("requests"))), F.lit(0)).alias("today_prompts"),
        F.count_distinct(F.when(on_day, F.col("session_id"))).alias("today_sessions"), F.coalesce(F.sum(F.when(on_day, total_tokens())), F.lit(0)).alias("today_tokens"),
        F.coalesce(F.sum(F.when(asked, F.col("requests"))), F.lit(0)).alias("billable"), F.coalesce(F.sum(F.when(asked & ~priced, F.col("requests"))), F.lit(0)).alias("unpriced"), F.first(today).alias("today"),
    ).first()
    models = sorted(_list(U.record_models(usage, on_day)), key=lambda r: r["model"] or "")
    days = {str(r["day"]): r["tokens"] for r in _list(U.record_days(usage, now, zone).orderBy("day"))}
    first = datetime.fromtimestamp(now, ZoneInfo(zone)).date()
    recent = [str(first - timedelta(days=back)) for back in range(6, -1, -1)]
    label = lambda b: b["scope"] if b["scope"] == "global" else f"{b['scope']}:{b['scope_name']}"
    requests = lambda b: b.get("priced_requests", 0) + b["unpriced_requests"] + b["quota_requests"]
    notes = [f"{t['unpriced']} of {t['billable']} billable requests have no price; spend is a floor."] if t["unpriced"] else []
    notes += [f"{label(b)} {b['period']}: {b['unpriced_requests']} budgeted requests have no price; its meter is a floor." for b in budgets if b["unpriced_requests"]]
    quota = [f"{label(b)} {b['period']}: all {b['quota_requests']} requests are on quota; its meter has nothing per-token to draw." for b in budgets if b["quota_requests"] and requests(b) == b["quota_requests"]]
    leading = balance or (budgets[0] if budgets else None)
    title = lambda b: f"{b['period'].capitalize()} budget"
    record = {
        "schemaVersion": 1, "id": id_, "name": name, "updatedAt": datetime.fromtimestamp(now, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "ready": bool(t["rows"] or budgets), "hasLocalStats": True, "hasPromptStats": True,
        "tierLabel": f"Budget ${leading['limit']:.0f}/{PERIOD_NOUN[leading['period']]}" if leading else "Pay as you go", "usageStatusText": "Spend partly unpriced" if notes else "Budget on quota" if quota else "", "authHelpText": " ".join(notes + quota),
        "limits": [{"label": f"{title(b)} ({label(b)})", "title": title(b), "percent": min(max(b["spend"] / b["limit"], 0.0), 1.0) if b["limit"] > 0 else 0.0, "resetsAt": b.get("resets_at", "")} for b in budgets],
        "todayPrompts": t["today_prompts"], "todaySessions": t["today_sessions"], "todayTotalTokens": t["today_tokens"], "todayTokensByModel": {r["model"]: r["today_tokens"] for r in models if r["today_tokens"] is not None},
        "recentDays": [{"date": d, "messageCount": days.get(d, 0)} for d in recent], "totalPrompts": t["prompts"], "totalSessions": t["sessions"], "activeDays": len(days), "activeDates": list(days),
        "modelUsage": {r["model"]: {"inputTokens": r["input_tokens"], "outputTokens": r["output_tokens"], "cacheReadInputTokens": r["cache_read_input_tokens"], "cacheCreationInputTokens": r["cache_creation_input_tokens"]} for r in models},
    }
    if balance:
        record["balance"] = {"remaining": max(balance["limit"] - balance["spend"], 0.0), "funded": balance["limit"], "spent": balance["spend"], "currency": "USD", "estimated": True}
    return record


def balance_budget(budgets: list[dict], name: str | None = None) -> dict | None:
    """Which budget a balance is shown of: the named one, else the global monthly, else any global, else the first."""
    order = [lambda b: name is not None and b["name"] == name, lambda b: b["scope"] == "global" and b.get("period") == "monthly", lambda b: b["scope"] == "global", lambda b: True]
    return next((b for wanted in order for b in budgets if wanted(b)), None)


def validate_budget(entry: dict) -> list[str]:
    """What is wrong with a budget: names by scope, a positive limit, percentages from 0 to 100, warning below critical."""
    scope, name = entry.get("scope", "global"), (entry.get("name") or "").strip()
    warn, critical = entry.get("warn_pct", 75.0), entry.get("critical_pct", 90.0)
    rules = {
        "unknown scope": scope in ("global", "provider", "model"), "a scope needs a name": scope == "global" or name != "", "a global budget has no name": scope != "global" or name == "", "the limit must be positive": entry.get("limit", 0) > 0,
        "percentages go from 0 to 100": 0 < warn <= 100 and 0 < critical <= 100, "the warning must be below critical": warn < critical,
    }
    return [text for text, ok in rules.items() if not ok]


def write_atomic(path: str, text: str) -> None:
    """Write a small file so that a reader sees the old or the new one, readable by its owner only."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w") as f:
            f.write(text)
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
