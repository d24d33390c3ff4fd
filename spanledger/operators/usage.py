"""Totals and rollups of usage rows. A cost that can't be established stays null and is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent, scaled_round
from ..schema import CATEGORIES, COST_STATUSES, TOKEN_BUCKETS, is_billable, is_free_or_local, is_quota, needs_price, ordinal, total_tokens

UNATTRIBUTED = "(unattributed)"
COUNTERS = ["requests", *TOKEN_BUCKETS, "cost", "priced_requests", "unpriced_requests", "quota_requests", "api_equivalent_cost"]


def counters() -> list[Column]:
    """The additive measures of a bucket; all combine before the shuffle."""
    priced = is_billable() & F.col("cost").isNotNull()
    when = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    return [
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKEN_BUCKETS),
        F.coalesce(F.sum(F.when(priced, F.col("cost"))), F.lit(0.0)).alias("cost"), when(priced, F.col("requests")).alias("priced_requests"),
        when(needs_price() & ~priced, F.col("requests")).alias("unpriced_requests"), when(is_quota(), F.col("requests")).alias("quota_requests"), F.sum("api_equivalent_cost").alias("api_equivalent_cost"),
    ]


def merge_counters() -> list[Column]:
    """counters() of buckets."""
    return [F.sum(c) if c == "api_equivalent_cost" else F.coalesce(F.sum(c), F.lit(0.0 if c == "cost" else 0)) for c in COUNTERS]


def cost_value() -> Column:
    """A bucket's dollars where they are a fact: null if it holds work that costs money and none of it is priced."""
    return F.when((F.col("priced_requests") > 0) | ((F.col("unpriced_requests") == 0) & (F.col("quota_requests") == 0)), scaled_round(F.col("cost"), 6))


def with_ratios(buckets: DataFrame) -> DataFrame:
    """Buckets with their tokens, honest cost and ratios; a ratio over nothing recorded is null."""
    prompt, cached = F.col("input") + F.col("cache_read") + F.col("cache_write"), F.col("cache_read") + F.col("cache_write")
    out = buckets.withColumn("tokens", total_tokens())
    return out.withColumns({
        "cost_value": cost_value(), "cost_is_floor": cost_value().isNotNull() & (F.col("unpriced_requests") > 0), "cache_hit_pct": F.when(cached > 0, percent(F.col("cache_read"), prompt)),
        "output_pct": percent(F.col("output"), F.col("tokens")), "reasoning_pct": F.when(F.col("reasoning") > 0, percent(F.col("reasoning"), F.col("tokens"))),
        "tokens_per_request": scaled_round(F.try_divide(F.col("tokens"), F.col("requests")), 1), "cost_per_request": F.when(F.col("priced_requests") > 0, scaled_round(scaled_round(F.col("cost"), 9) / F.col("priced_requests"), 6)),
        "api_equivalent_cost": scaled_round(F.col("api_equivalent_cost"), 6),
    }).drop("cost")


def totals(usage: DataFrame) -> DataFrame:
    """One row: requests, buckets, billable cost (0.0 over nothing), unknown and quota requests."""
    b = usage.agg(*counters())
    return b.select("requests", *TOKEN_BUCKETS, scaled_round(F.col("cost"), 6).alias("cost"), F.col("unpriced_requests").alias("unknown_requests"), "quota_requests", scaled_round(F.col("api_equivalent_cost"), 6).alias("api_equivalent_cost"))


def _each(spark, column: str, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{column} string, place int")


def category_tiles(usage: DataFrame) -> DataFrame:
    """Each category with its requests, tokens and known cost; categories without rows have zeros."""
    per = usage.groupBy("category").agg(*counters()).select("category", "requests", total_tokens().alias("tokens"), "cost")
    out = _each(usage.sparkSession, "category", CATEGORIES).join(per, "category", "left")
    return out.select("category", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "tokens")), scaled_round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


def model_table(usage: DataFrame) -> DataFrame:
    """By provider, model, category and status; cost is null until a billable one is seen. Tokens first, then key."""
    keys = ["provider", "model", "category", "cost_status"]
    known = F.sum(F.when(is_billable(), F.col("cost")))
    out = usage.groupBy(*keys).agg(F.sum("requests").alias("requests"), *(F.sum(c).alias(c) for c in TOKEN_BUCKETS), scaled_round(known, 6).alias("cost"))
    out = out.withColumn("tokens", total_tokens())
    return out.orderBy(F.desc("tokens"), "provider", "model", ordinal(F.col("category"), CATEGORIES), ordinal(F.col("cost_status"), COST_STATUSES))


def top_with_other(usage: DataFrame, keys: list[str], top: int, more: dict[str, Column] | None = None) -> DataFrame:
    """The top groups by tokens (all if top is 0), and one row `other` of the rest and of rows whose key is null.

    rows + other = totals. Ranks are taken over groups, which a first aggregation has made; the rest is merged from
    those groups, never from the rows again. more are further aggregates of a group, null in `other`.
    """
    more = more or {}
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    groups = usage.groupBy(*keys).agg(*counters(), *(a.alias(n) for n, a in more.items())).withColumns({"_keyed": keyed, "_tokens": total_tokens()})
    ranked = groups.where("_keyed").orderBy(F.desc("_tokens"), *keys)
    if top:
        ranked = ranked.limit(top)  # a top-k: each partition keeps k, then they are merged
    kept = ranked.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.lit(True).alias("_shown"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    flagged = groups.join(kept, same, "left").select(*keys, *COUNTERS, *more, F.coalesce("_shown", F.lit(False)).alias("shown"))
    names = [F.when(F.col("shown"), F.col(k)).alias(k) for k in keys]
    said = [F.first(F.when(F.col("shown"), F.col(n)), ignorenulls=True).alias(n) for n in more]
    merged = flagged.select(*names, "shown", *COUNTERS, *more).groupBy(*keys, "shown").agg(*(m.alias(c) for m, c in zip(merge_counters(), COUNTERS)), *said)
    return merged.where("shown or requests > 0")


def session_details(models_shown: int = 6) -> dict[str, Column]:
    """What a session's entry names: its first project, its first models in order and how many there are, and how long it ran."""
    models = F.sort_array(F.collect_set(F.concat_ws("/", "provider", "model")))
    first, last = seen()
    return {
        "project": F.min_by(F.col("project"), F.when(F.col("project").isNotNull(), F.col("seq"))), "models": F.array_join(F.slice(models, 1, models_shown), ","), "models_total": F.size(models), "first_seen": first, "last_seen": last,
        "duration_secs": last - first,
    }


def by_category(usage: DataFrame) -> DataFrame:
    return with_ratios(usage.groupBy("category").agg(*counters()))


def seen() -> list[Column]:
    """First and last dated second of a group; undated rows say nothing."""
    dated = F.when(F.col("created") > 0, F.col("created"))
    return [F.min(dated).alias("first_seen"), F.max(dated).alias("last_seen")]


def by_project(usage: DataFrame) -> DataFrame:
    """By project, null as (unattributed), with distinct sessions and models."""
    named = usage.withColumn("project", F.coalesce("project", F.lit(UNATTRIBUTED)))
    spec = F.concat_ws("/", "provider", "model")
    return with_ratios(named.groupBy("project").agg(*counters(), F.count_distinct("session_id").alias("sessions"), F.count_distinct(spec).alias("models"), *seen()))


def by_session(usage: DataFrame, models_shown: int = 6) -> DataFrame:
    """By session (rows without one left out): its first models in order, how many there are, and how long it ran."""
    spec = F.concat_ws("/", "provider", "model")
    per = usage.where("session_id is not null").groupBy("session_id").agg(*counters(), F.sort_array(F.collect_set(spec)).alias("all_models"), *seen())
    return with_ratios(per).select("session_id", "requests", "tokens", "cost_value", "unpriced_requests", F.array_join(F.slice("all_models", 1, models_shown), ",").alias("models"), F.size("all_models").alias("models_total"), (F.col("last_seen") - F.col("first_seen")).alias("duration"))


def local_day(created: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(created), zone))


def undated_requests(usage: DataFrame) -> DataFrame:
    """One row: the requests that are on no day."""
    return usage.agg(F.coalesce(F.sum(F.when(F.col("created") <= 0, F.col("requests"))), F.lit(0)).alias("undated_requests"))


def by_day(usage: DataFrame, zone: str = "UTC", most: int = 31) -> DataFrame:
    """The newest local days with usage; undated rows are in none."""
    dated = usage.where("created > 0").withColumn("day", local_day(F.col("created"), zone))
    return with_ratios(dated.groupBy("day").agg(*counters())).orderBy(F.desc("day")).limit(most)


def daily_totals(usage: DataFrame, zone: str = "UTC") -> DataFrame:
    """Every local day from the first to the last, days without usage included."""
    per = usage.where("created > 0").withColumn("day", local_day(F.col("created"), zone)).groupBy("day").agg(*counters())
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    out = days.join(per, "day", "left")
    return out.select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", *TOKEN_BUCKETS, "unpriced_requests", "quota_requests")), scaled_round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


def trailing_series(usage: DataFrame, today: int, days: int = 7) -> DataFrame:
    """Tokens of the last days up to the epoch day today, absent days as 0."""
    fixed = usage.sparkSession.range(today - days + 1, today + 1).select(F.col("id").cast("int").alias("epoch_day"))
    per = usage.where("created > 0").groupBy(F.floor(F.col("created") / 86400).cast("int").alias("epoch_day")).agg(F.sum(total_tokens()).alias("tokens"))
    return fixed.join(per, "epoch_day", "left").select("epoch_day", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def rollup_cost() -> Column:
    """A rollup's cost for sorting: 0.0 beside unpriced or quota requests is unknown."""
    return F.when((F.col("cost") == 0) & ((F.col("unpriced_requests") > 0) | (F.col("quota_requests") > 0)), F.lit(None).cast("double")).otherwise(F.col("cost"))


def project_totals(usage: DataFrame) -> DataFrame:
    """By project: dearest first, unknown cost last, then tokens, then name."""
    per = usage.withColumn("project", F.coalesce("project", F.lit(UNATTRIBUTED))).groupBy("project").agg(*counters(), F.count_distinct("session_id").alias("sessions"))
    out = per.withColumns({"tokens": total_tokens(), "cost": scaled_round(F.col("cost"), 6)}).withColumn("sort_cost", rollup_cost())
    return out.select("project", "requests", "tokens", "cost", "sort_cost", "unpriced_requests", "quota_requests", "sessions").orderBy(F.col("sort_cost").desc_nulls_last(), F.desc("tokens"), "project")


def session_totals(usage: DataFrame) -> DataFrame:
    """By session: start, end, the first project known by seq, and the opening model; most recent first."""
    rows = usage.where("session_id is not null")
    per = rows.groupBy("session_id").agg(
        *counters(), *seen(), F.min_by(F.col("project"), F.when(F.col("project").isNotNull(), F.col("seq"))).alias("project"), F.min_by("model", F.struct("created", "seq")).alias("opening_model"),
        F.count_distinct("model").alias("models"),
    )
    out = per.withColumns({"tokens": total_tokens(), "cost": scaled_round(F.col("cost"), 6)})
    return out.select("session_id", "requests", "tokens", "cost", "unpriced_requests", "first_seen", "last_seen", "project", "opening_model", "models").orderBy(F.col("last_seen").desc_nulls_last(), "session_id")


def burn(usage: DataFrame, now: int, window: int = 3600, least: int = 5) -> DataFrame:
    """One row of the trailing window (now - window, now]: rates a minute and an hour, and whether they can be projected."""
    b = usage.where((F.col("created") > now - window) & (F.col("created") <= now)).agg(*counters())
    out = b.select("requests", total_tokens().alias("tokens"), scaled_round(F.col("cost"), 6).alias("cost"), "unpriced_requests", "quota_requests")
    return out.withColumns({
        "tokens_per_minute": scaled_round(F.col("tokens") * 60.0 / window, 6), "cost_per_hour": scaled_round(F.col("cost") * 3600.0 / window, 6),
        "projectable": (F.col("requests") >= least) & (F.col("cost") > 0), "quota_only": (F.col("quota_requests") > 0) & (F.col("quota_requests") == F.col("requests")),
    })


def coverage(usage: DataFrame) -> DataFrame:
    """Priced over billable requests, quota apart; null over none."""
    b = usage.agg(*counters())
    billable = F.col("priced_requests") + F.col("unpriced_requests")
    return b.select("priced_requests", billable.alias("billable_requests"), "quota_requests", percent(F.col("priced_requests"), billable, 4).alias("coverage_pct"))


def provenance(usage: DataFrame) -> DataFrame:
    """Each cost status, rows or not. A cost is null for quota, unavailable and absent statuses; else null costs count as 0."""
    per = usage.groupBy("cost_status").agg(F.count(F.lit(1)).alias("n"), F.sum("requests").alias("requests"), F.sum(total_tokens()).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    out = _each(usage.sparkSession, "cost_status", COST_STATUSES).join(per, "cost_status", "left")
    kept = F.when((is_billable() | is_free_or_local()) & F.col("n").isNotNull(), scaled_round(F.col("cost"), 6))
    return out.select("cost_status", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "requests", "tokens")), kept.alias("cost"))


def reported_share(usage: DataFrame) -> DataFrame:
    """Of the billable dollars the share that providers reported; null over none."""
    sums = usage.agg(F.sum(F.when(is_billable(), F.col("cost"))).alias("billable"), F.sum(F.when(F.col("cost_status") == "reported", F.col("cost"))).alias("reported"))
    return sums.select(scaled_round(F.coalesce("billable", F.lit(0.0)), 6).alias("billable_cost"), F.when(F.col("billable") > 0, percent(F.coalesce("reported", F.lit(0.0)), F.col("billable"), 4)).alias("reported_share"))


def budget_status(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spend, unpriced and quota requests of each budget and its level.

    budgets: name, scope (global, provider, model), scope_name, since, limit, warn_pct, critical_pct. Usage is first
    rolled up by provider, model and the periods' starts, so that what meets the few budgets is small.
    """
    starts = budgets.select(F.col("since").alias("_k")).where("_k is not null").distinct().withColumn("_until", F.lead("_k").over(Window.orderBy("_k")))
    within = (F.col("created") >= F.col("_k")) & (F.col("_until").isNull() | (F.col("created") < F.col("_until")))
    rolled = usage.join(F.broadcast(starts), within).groupBy(F.lower("provider").alias("_p"), F.lower("model").alias("_m"), "_k").agg(*counters())
    wanted = budgets.withColumn("_name", F.lower("scope_name"))
    whole = F.col("scope") == "global"
    matches = (F.col("_k") >= F.col("since")) & (whole | ((F.col("scope") == "provider") & (F.col("_p") == F.col("_name"))) | ((F.col("scope") == "model") & (F.col("_m") == F.col("_name"))))
    keys = ["name", "scope", "scope_name", "since", "limit", "warn_pct", "critical_pct"]
    per = wanted.join(rolled, matches, "left").groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cost", "unpriced_requests", "quota_requests")))
    pct = F.when(F.col("limit") > 0, F.col("cost") / F.col("limit") * 100).otherwise(0.0)
    level = F.when(F.col("pct") >= 100, "exceeded").when(F.col("pct") >= F.col("critical_pct"), "critical").when(F.col("pct") >= F.col("warn_pct"), "warn").otherwise("ok")
    out = per.withColumn("pct", pct).withColumn("level", level)
    return out.select("name", "scope", "scope_name", "limit", scaled_round(F.col("cost"), 6).alias("spend"), "unpriced_requests", "quota_requests", scaled_round(F.col("pct"), 4).alias("pct"), "level")


def projection(budget: DataFrame, rate: DataFrame, least: int = 5) -> DataFrame:
    """When each budget runs out at the burn rate: seconds, or why there is no telling.

    rate is the single row of burn(). Seconds are an upper bound where the spend or the rate leaves out unpriced requests.
    """
    r = rate.select(F.col("requests").alias("r_requests"), F.col("cost_per_hour").alias("r_cost"), F.col("projectable"), F.col("quota_only"), F.col("unpriced_requests").alias("r_unpriced"), F.col("quota_requests").alias("r_quota"))
    remaining = F.col("limit") - F.col("spend")
    reason = (
        F.when(~F.col("projectable") & (F.col("r_requests") < least), "too few requests").when(~F.col("projectable") & F.col("quota_only"), "on quota").when(~F.col("projectable") & (F.col("r_unpriced") > 0), "unpriced")
        .when(~F.col("projectable"), "no spend").when(remaining <= 0, "already over")
    )
    joined = budget.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one").drop("_one")
    seconds = F.when(reason.isNull(), F.round(remaining / F.col("r_cost") * 3600).cast("long"))
    bound = reason.isNull() & ((F.col("unpriced_requests") > 0) | (F.col("quota_requests") > 0) | (F.col("r_unpriced") > 0) | (F.col("r_quota") > 0))
    return joined.select("name", scaled_round(remaining, 6).alias("remaining"), seconds.alias("seconds"), reason.alias("reason"), bound.alias("is_upper_bound"))


def record_tallies(usage: DataFrame, day_start: int) -> DataFrame:
    """Prompts, sessions, active days and tokens, of all rows and since day_start."""
    today = F.col("created") >= day_start
    return usage.agg(
        F.sum("requests").alias("total_prompts"), F.sum(F.when(today, F.col("requests"))).alias("today_prompts"), F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct(F.when(today, F.col("session_id"))).alias("today_sessions"), F.count_distinct(F.when(F.col("created") > 0, F.floor(F.col("created") / 86400))).alias("active_days"),
        F.sum(total_tokens()).alias("total_tokens"), F.sum(F.when(today, total_tokens())).alias("today_tokens"),
    )


def record_models(usage: DataFrame, day: Column) -> DataFrame:
    """By model: the buckets of a desktop record (reasoning counts as output), and the tokens of its day."""
    t = total_tokens()
    return usage.groupBy("model").agg(
        F.sum("input").alias("input_tokens"), F.sum(F.col("output") + F.col("reasoning")).alias("output_tokens"), F.sum("cache_read").alias("cache_read_input_tokens"), F.sum("cache_write").alias("cache_creation_input_tokens"),
        F.sum(F.when(day, t)).alias("today_tokens"),
    )


def record_days(usage: DataFrame, now: int, zone: str = "UTC") -> DataFrame:
    """day, tokens of every local day with rows."""
    return usage.where("created > 0").groupBy(local_day(F.col("created"), zone).alias("day")).agg(F.sum(total_tokens()).alias("tokens"))


def journal_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n, oldest of the tables of a journal; a table without times, such as the tally, has its days."""
    out = None
    for name, df in tables.items():
        at = "created" if "created" in df.columns else "day"
        part = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(at) > 0, F.col(at))).alias("oldest")).select(F.lit(name).alias("table_name"), "n", "oldest")
        out = part if out is None else out.unionByName(part)
    return out


def project_labels(paths: DataFrame, path: str) -> DataFrame:
    """(path, label): of each path the shortest suffix of segments that no other path has; the whole path if none is."""
    distinct = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    parts = distinct.withColumn("parts", F.filter(F.split("path", r"[/\\]+"), lambda x: x != ""))
    suffixes = parts.where(F.size("parts") > 0).select("path", F.size("parts").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", -k, k), "/"))).alias("k", "suffix"))
    owners = suffixes.groupBy("suffix").agg(F.count_distinct("path").alias("owners"))
    unique = suffixes.join(owners.where("owners = 1"), "suffix").groupBy("path").agg(F.min_by("suffix", "k").alias("label"))
    return distinct.join(unique, "path", "left").select("path", F.coalesce("label", "path").alias("label"))


def apportion(parts: DataFrame, group: str, item: str, weight: str, total: int) -> DataFrame:
    """Whole shares of total: one for each weight above zero, the rest by the largest remainders; ties go by item.

    A group's shares add up to total. A group without weight, or with more weights above zero than shares, has no rows. parts are
    aggregated: an item is one row of its group, of which there are no more than total.
    """
    sums = Window.partitionBy(group)
    w = parts.withColumns({"_sum": F.sum(weight).over(sums), "_present": F.sum((F.col(weight) > 0).cast("long")).over(sums)}).where(F.col("_sum") > 0).where(F.col("_present") <= total)
    scaled = f"({weight} * ({total}L - _present))"
    w = w.withColumns({"_base": F.expr(f"CASE WHEN {weight} > 0 THEN 1 + {scaled} div _sum ELSE 0 END"), "_rest": F.expr(f"CASE WHEN {weight} > 0 THEN {scaled} % _sum ELSE -1 END")})
    w = w.withColumns({"_left": F.lit(total) - F.sum("_base").over(sums), "_place": F.row_number().over(sums.orderBy(F.desc("_rest"), item))})
    return w.select(group, item, weight, (F.col("_base") + (F.col("_place") <= F.col("_left")).cast("long")).alias("share"))
