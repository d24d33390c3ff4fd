"""The catalogue of usage queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import limits, lookup, routing, supersede, usage, views
from ..schema import total_tokens
from ..session import table
from . import adapters as A

NOW, DAY = A.NOW, A.DAY_START
QUERIES, SQL = {}, {}
Rows = Callable[[SparkSession, str], DataFrame]
R9 = lambda x: f"round(({x}) * 1000000000.0) / 1000000000.0"
R6 = lambda x: f"round(({x}) * 1000000.0) / 1000000.0"
R4 = lambda x: f"round(({x}) * 10000.0) / 10000.0"
R1 = lambda x: f"round(({x}) * 10.0) / 10.0"


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query, with the SQL that follows the given common table expressions."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH RECURSIVE " + ", ".join(ctes) + "\n" if ctes else "") + sql
        return f

    return register


RATIOS_SQL = f"""requests, input, output, reasoning, cache_read, cache_write, priced_requests, unpriced_requests, quota_requests, cast(NULL AS DOUBLE) AS api_equivalent_cost,
    input + output + reasoning + cache_read + cache_write AS tokens,
    CASE WHEN priced_requests > 0 OR (unpriced_requests = 0 AND quota_requests = 0) THEN {R6("cost")} END AS cost_value, priced_requests > 0 AND unpriced_requests > 0 AS cost_is_floor,
    CASE WHEN cache_read + cache_write > 0 THEN {R1("cache_read * 100.0 / (input + cache_read + cache_write)")} END AS cache_hit_pct,
    CASE WHEN input + output + reasoning + cache_read + cache_write > 0 THEN {R1("output * 100.0 / (input + output + reasoning + cache_read + cache_write)")} END AS output_pct,
    CASE WHEN reasoning > 0 THEN {R1("reasoning * 100.0 / (input + output + reasoning + cache_read + cache_write)")} END AS reasoning_pct,
    CASE WHEN requests > 0 THEN {R1("(input + output + reasoning + cache_read + cache_write) / cast(requests AS DOUBLE)")} END AS tokens_per_request,
    CASE WHEN priced_requests > 0 THEN {R6(R9("cost") + " / priced_requests")} END AS cost_per_request"""


@query("q01_totals", f"SELECT requests, input, output, reasoning, cache_read, cache_write, {R6('cost')} AS cost, unpriced_requests AS unknown_requests, quota_requests, cast(NULL AS DOUBLE) AS api_equivalent_cost FROM (SELECT {A.COUNTERS_SQL} FROM usage)", A.USAGE_SQL)
def q01(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(A.usage(spark, d))


@query("q02_categories", f"""SELECT c.category, c.place, coalesce(u.requests, 0) AS requests, coalesce(u.input + u.output + u.reasoning + u.cache_read + u.cache_write, 0) AS tokens, {R6("coalesce(u.cost, 0.0)")} AS cost
FROM (VALUES ('LOCAL', 0), ('FREE', 1), ('PAID', 2), ('CLOUD', 3), ('UNKNOWN', 4)) c(category, place) LEFT JOIN (SELECT category, {A.COUNTERS_SQL} FROM usage GROUP BY category) u ON u.category = c.category""", A.USAGE_SQL)
def q02(spark: SparkSession, d: str) -> DataFrame:
    return usage.category_tiles(A.usage(spark, d))


@query("q03_bucket", f"SELECT {RATIOS_SQL} FROM (SELECT {A.COUNTERS_SQL} FROM usage)", A.USAGE_SQL)
def q03(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_ratios(A.usage(spark, d).agg(*usage.counters()))


@query("q04_models", f"""SELECT provider, model, category, cost_status, cast(sum(requests) AS BIGINT) AS requests, cast(sum(input) AS BIGINT) AS input, cast(sum(output) AS BIGINT) AS output, cast(sum(reasoning) AS BIGINT) AS reasoning,
  cast(sum(cache_read) AS BIGINT) AS cache_read, cast(sum(cache_write) AS BIGINT) AS cache_write, {R6("sum(cost) FILTER (billable)")} AS cost, cast(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY ALL""", A.USAGE_SQL)
def q04(spark: SparkSession, d: str) -> DataFrame:
    return usage.model_table(A.usage(spark, d))


def _top_sql(keys: list[str], top: int) -> str:
    k = ", ".join(keys)
    keyed = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    shown = ", ".join(f"CASE WHEN shown THEN {x} END AS {x}" for x in keys)
    return f"""SELECT {k}, shown, cast(sum(requests) AS BIGINT) AS requests, cast(sum(input) AS BIGINT) AS input, cast(sum(output) AS BIGINT) AS output, cast(sum(reasoning) AS BIGINT) AS reasoning, cast(sum(cache_read) AS BIGINT) AS cache_read,
  cast(sum(cache_write) AS BIGINT) AS cache_write, {R6("sum(cost)")} AS cost, cast(sum(priced_requests) AS BIGINT) AS priced_requests, cast(sum(unpriced_requests) AS BIGINT) AS unpriced_requests, cast(sum(quota_requests) AS BIGINT) AS quota_requests
FROM (SELECT {shown}, shown, * EXCLUDE ({k}, shown) FROM (SELECT *, {keyed} AND row_number() OVER (PARTITION BY {keyed} ORDER BY input + output + reasoning + cache_read + cache_write DESC, {k}) <= {top} AS shown
  FROM (SELECT {k}, {A.COUNTERS_SQL} FROM usage GROUP BY {k}))) GROUP BY {k}, shown HAVING shown OR sum(requests) > 0"""


@query("q05_top_models", _top_sql(["provider", "model"], 5), A.USAGE_SQL)
def q05(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_with_other(A.usage(spark, d), ["provider", "model"], 5).drop("api_equivalent_cost").withColumn("cost", X.scaled_round(F.col("cost"), 6))


@query("q05_top_sessions", _top_sql(["session_id"], 10), A.USAGE_SQL)
def q05s(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_with_other(A.usage(spark, d), ["session_id"], 10).drop("api_equivalent_cost").withColumn("cost", X.scaled_round(F.col("cost"), 6))


@query("q06_by_category", f"SELECT category, {RATIOS_SQL} FROM (SELECT category, {A.COUNTERS_SQL} FROM usage GROUP BY category)", A.USAGE_SQL)
def q06(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_category(A.usage(spark, d))


SEEN_SQL = "min(created) FILTER (created > 0) AS first_seen, max(created) FILTER (created > 0) AS last_seen"


@query("q07_by_project", f"SELECT project, sessions, models, first_seen, last_seen, {RATIOS_SQL} FROM (SELECT coalesce(project, '(unattributed)') AS project, count(DISTINCT session_id) AS sessions, count(DISTINCT concat_ws('/', provider, model)) AS models, {SEEN_SQL}, {A.COUNTERS_SQL} FROM usage GROUP BY 1)", A.DATED_SQL)
def q07(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.by_project(rows(spark, d))


@query("q08_by_session", f"""SELECT session_id, requests, input + output + reasoning + cache_read + cache_write AS tokens, CASE WHEN priced_requests > 0 OR (unpriced_requests = 0 AND quota_requests = 0) THEN {R6("cost")} END AS cost_value,
  unpriced_requests, array_to_string(m[1:6], ',') AS models, cast(len(m) AS INTEGER) AS models_total, last_seen - first_seen AS duration
FROM (SELECT session_id, list_sort(list(DISTINCT concat_ws('/', provider, model))) AS m, {SEEN_SQL}, {A.COUNTERS_SQL} FROM usage WHERE session_id IS NOT NULL GROUP BY session_id)""", A.DATED_SQL)
def q08(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.by_session(rows(spark, d))


@query("q09_by_day", f"SELECT day, {RATIOS_SQL} FROM (SELECT cast(to_timestamp(created) AT TIME ZONE 'UTC' AS DATE) AS day, {A.COUNTERS_SQL} FROM usage WHERE created > 0 GROUP BY 1) ORDER BY day DESC LIMIT 31", A.DATED_SQL)
def q09(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.by_day(rows(spark, d))


@query("q10_project_totals", f"""SELECT project, requests, tokens, cost, CASE WHEN cost = 0 AND (unpriced_requests > 0 OR quota_requests > 0) THEN NULL ELSE cost END AS sort_cost, unpriced_requests, quota_requests, sessions
FROM (SELECT project, requests, input + output + reasoning + cache_read + cache_write AS tokens, {R6("cost")} AS cost, unpriced_requests, quota_requests, sessions FROM (SELECT coalesce(project, '(unattributed)') AS project, count(DISTINCT session_id) AS sessions, {A.COUNTERS_SQL} FROM usage GROUP BY 1))""", A.USAGE_SQL)
def q10(spark: SparkSession, d: str) -> DataFrame:
    return usage.project_totals(A.usage(spark, d))


@query("q11_session_totals", f"""SELECT session_id, requests, input + output + reasoning + cache_read + cache_write AS tokens, {R6("cost")} AS cost, unpriced_requests, first_seen, last_seen, project, opening_model, models
FROM (SELECT session_id, {SEEN_SQL}, arg_min(project, seq) FILTER (project IS NOT NULL) AS project, arg_min(model, created * 100000000 + seq) AS opening_model, count(DISTINCT model) AS models, {A.COUNTERS_SQL} FROM usage WHERE session_id IS NOT NULL GROUP BY session_id)""", A.DATED_SQL)
def q11(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.session_totals(rows(spark, d))


@query("q12_daily_totals", f"""SELECT d.day, {", ".join(f"coalesce(u.{c}, 0) AS {c}" for c in ("requests", "input", "output", "reasoning", "cache_read", "cache_write", "unpriced_requests", "quota_requests"))}, {R6("coalesce(u.cost, 0.0)")} AS cost
FROM (SELECT cast(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM per) d LEFT JOIN per u ON u.day = d.day""", A.DATED_SQL, f"per AS (SELECT cast(to_timestamp(created) AT TIME ZONE 'UTC' AS DATE) AS day, {A.COUNTERS_SQL} FROM usage WHERE created > 0 GROUP BY 1)")
def q12(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.daily_totals(rows(spark, d))


BURN_SQL = f"""burn AS (SELECT requests, input + output + reasoning + cache_read + cache_write AS tokens, {R6("cost")} AS cost, unpriced_requests, quota_requests,
  {R6("(input + output + reasoning + cache_read + cache_write) * 60.0 / 604800")} AS tokens_per_minute, {R6(R6("cost") + " * 3600.0 / 604800")} AS cost_per_hour, requests >= 5 AND cost > 0 AS projectable, quota_requests > 0 AND quota_requests = requests AS quota_only
  FROM (SELECT {A.COUNTERS_SQL} FROM usage WHERE created > {NOW - 604800} AND created <= {NOW}))"""
BUDGET_SQL = f"""status AS (SELECT name, scope, scope_name, "limit", {R6("cost")} AS spend, unpriced_requests, quota_requests, {R4("cost / \"limit\" * 100")} AS pct,
  CASE WHEN cost / "limit" * 100 >= 100 THEN 'exceeded' WHEN cost / "limit" * 100 >= critical_pct THEN 'critical' WHEN cost / "limit" * 100 >= warn_pct THEN 'warn' ELSE 'ok' END AS level
  FROM (SELECT name, scope, scope_name, "limit", warn_pct, critical_pct, {A.COUNTERS_SQL} FROM budgets b LEFT JOIN usage u ON u.created >= b.since AND (b.scope = 'global' OR (b.scope = 'provider' AND lower(u.provider) = lower(b.scope_name)) OR (b.scope = 'model' AND lower(u.model) = lower(b.scope_name)))
  GROUP BY name, scope, scope_name, "limit", warn_pct, critical_pct))"""


@query("q13_burn", "SELECT * FROM burn", A.DATED_SQL, BURN_SQL)
def q13(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.burn(rows(spark, d), NOW, 604800)


@query("q14_projection", f"""SELECT name, {R6('"limit" - spend')} AS remaining, CASE WHEN reason IS NULL THEN cast(round(("limit" - spend) / cost_per_hour * 3600) AS BIGINT) END AS seconds, reason,
  reason IS NULL AND (s_unpriced > 0 OR s_quota > 0 OR b_unpriced > 0 OR b_quota > 0) AS is_upper_bound
FROM (SELECT s.name, s."limit", s.spend, b.cost_per_hour, s.unpriced_requests AS s_unpriced, s.quota_requests AS s_quota, b.unpriced_requests AS b_unpriced, b.quota_requests AS b_quota,
  CASE WHEN NOT projectable AND b.requests < 5 THEN 'too few requests' WHEN NOT projectable AND quota_only THEN 'on quota' WHEN NOT projectable AND b.unpriced_requests > 0 THEN 'unpriced' WHEN NOT projectable THEN 'no spend' WHEN "limit" - spend <= 0 THEN 'already over' END AS reason
  FROM status s, burn b)""", A.DATED_SQL, BURN_SQL, A.BUDGETS_SQL, BUDGET_SQL)
def q14(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    u = rows(spark, d)
    return usage.projection(usage.budget_status(u, A.budgets(spark)), usage.burn(u, NOW, 604800))


@query("q15_coverage", f"SELECT priced_requests, priced_requests + unpriced_requests AS billable_requests, quota_requests, CASE WHEN priced_requests + unpriced_requests > 0 THEN {R4('priced_requests * 100.0 / (priced_requests + unpriced_requests)')} END AS coverage_pct FROM (SELECT {A.COUNTERS_SQL} FROM usage)", A.USAGE_SQL)
def q15(spark: SparkSession, d: str) -> DataFrame:
    return usage.coverage(A.usage(spark, d))


@query("q16_provenance", f"""SELECT s.cost_status, s.place, coalesce(u.n, 0) AS n, coalesce(u.requests, 0) AS requests, coalesce(u.tokens, 0) AS tokens, CASE WHEN s.place < 5 AND u.n IS NOT NULL THEN {R6("u.cost")} END AS cost
FROM (VALUES ('reported', 0), ('calculated', 1), ('estimated', 2), ('free', 3), ('local', 4), ('quota', 5), ('unavailable', 6)) s(cost_status, place)
LEFT JOIN (SELECT cost_status, count(*) AS n, cast(sum(requests) AS BIGINT) AS requests, cast(sum(tokens) AS BIGINT) AS tokens, coalesce(sum(cost), 0.0) AS cost FROM usage GROUP BY 1) u ON u.cost_status = s.cost_status""", A.USAGE_SQL)
def q16(spark: SparkSession, d: str) -> DataFrame:
    return usage.provenance(A.usage(spark, d))


@query("q16_reported_share", f"SELECT {R6('coalesce(b, 0.0)')} AS billable_cost, CASE WHEN b > 0 THEN {R4('coalesce(r, 0.0) * 100.0 / b')} END AS reported_share FROM (SELECT sum(cost) FILTER (billable) AS b, sum(cost) FILTER (cost_status = 'reported') AS r FROM usage)", A.USAGE_SQL)
def q16s(spark: SparkSession, d: str) -> DataFrame:
    return usage.reported_share(A.usage(spark, d))


@query("q17_budgets", "SELECT * FROM status", A.DATED_SQL, A.BUDGETS_SQL, BUDGET_SQL)
def q17(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.budget_status(rows(spark, d), A.budgets(spark))


_N = lambda c: f"cast(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
AGG_SQL = f"""agg AS (SELECT agent, model, provider, count(*) AS tasks, cast(sum(tokens) AS BIGINT) AS tokens, {R6("coalesce(sum(cost) FILTER (pr), 0.0)")} AS cost, {_N("pr")} AS priced_tasks, {_N("NOT pr AND NOT fr AND cost_status <> 'quota'")} AS unpriced_tasks,
  {_N("cost_status = 'quota'")} AS quota_tasks, {_N("fr")} AS free_tasks, {", ".join(f"cast(sum({c}) AS BIGINT) AS {c}_sum, count({c}) AS {c}_observed, {_N(c + ' > 0')} AS {c}_affected" for c in routing.OBSERVED)}, {_N("test_result")} AS passes, {_N("NOT test_result")} AS failures
  FROM (SELECT *, cost_status IN ('reported', 'calculated', 'estimated') AND cost IS NOT NULL AS pr, cost_status IN ('free', 'local') AS fr FROM routing) GROUP BY ALL)"""


@query("q18_routing", "SELECT * FROM agg", A.ROUTING_SQL, AGG_SQL)
def q18(spark: SparkSession, d: str) -> DataFrame:
    return routing.aggregates(A.routing(spark, d))


@query("q19_routing_rates", f"""SELECT agent, model, provider, basis, CASE basis WHEN 'free' THEN 0.0 WHEN 'exact' THEN {R6("cost / passes")} END AS cost_per_success, CASE WHEN passes + failures > 0 THEN {R4("passes * 100.0 / (passes + failures)")} END AS success_rate,
  {", ".join(f"CASE WHEN {c}_observed > 0 THEN {R4(f'{c}_affected * 100.0 / {c}_observed')} END AS {c}_rate" for c in routing.OBSERVED)}
FROM (SELECT *, CASE WHEN passes = 0 THEN 'no_successes' WHEN unpriced_tasks > 0 AND priced_tasks = 0 THEN 'unpriced' WHEN unpriced_tasks > 0 THEN 'floor' WHEN quota_tasks > 0 AND priced_tasks = 0 THEN 'quota' WHEN quota_tasks > 0 THEN 'plus_quota' WHEN priced_tasks > 0 THEN 'exact' ELSE 'free' END AS basis FROM agg)""", A.ROUTING_SQL, AGG_SQL)
def q19(spark: SparkSession, d: str) -> DataFrame:
    return routing.rates(routing.aggregates(A.routing(spark, d)))


@query("q20_withheld", "SELECT reason, cast(sum(runs) AS BIGINT) AS runs FROM tally WHERE day + 86399 >= 800000000 GROUP BY reason", A.TALLY_SQL)
def q20(spark: SparkSession, d: str) -> DataFrame:
    return routing.withheld_by_reason(A.tally(spark, d), 800_000_000)


# The candidates of a model id, written out: seeds (whole, last segment), forms (as it is, two suffixes, up to @), then dotted, undated, both.
_DOTTED = lambda x: f"list_reduce(list_prepend('', string_split({x}, '-')), lambda a, b: CASE WHEN a = '' THEN b WHEN regexp_matches(a, '(^|[-.])[0-9]+$') AND regexp_full_match(b, '[0-9]+') THEN a || '.' || b ELSE a || '-' || b END)"
_UNDATED = lambda x: f"nullif(regexp_replace({x}, '-([0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$', ''), {x})"
CANDIDATES_SQL = f"""seeds AS (SELECT model, s.n AS seed, s.v FROM (SELECT DISTINCT model, lower(trim(model)) AS m FROM pairs), LATERAL (SELECT 0 AS n, m AS v UNION ALL SELECT 1, CASE WHEN contains(m, '/') THEN regexp_extract(m, '([^/]*)$', 1) END) s WHERE s.v IS NOT NULL),
forms AS (SELECT model, seed, f.n AS form, f.v FROM seeds, LATERAL (SELECT 0 AS n, seeds.v UNION ALL SELECT 1, CASE WHEN seeds.v LIKE '%:cloud' THEN seeds.v[:-7] END UNION ALL SELECT 2, CASE WHEN seeds.v LIKE '%-cloud' THEN seeds.v[:-7] END UNION ALL SELECT 3, CASE WHEN contains(seeds.v, '@') THEN split_part(seeds.v, '@', 1) END) f WHERE f.v IS NOT NULL),
spelled AS (SELECT model, seed * 100 + form * 10 + x.n AS place, x.v FROM (SELECT *, {_UNDATED("v")} AS u FROM forms) f, LATERAL (SELECT 0 AS n, f.v AS v UNION ALL SELECT 1, {_DOTTED("f.v")} UNION ALL SELECT 2, f.u UNION ALL SELECT 3, {_DOTTED("f.u")}) x WHERE x.v <> ''),
cands AS (SELECT model, v AS cand, row_number() OVER (PARTITION BY model ORDER BY min(place)) - 1 AS rank FROM spelled GROUP BY model, v)"""
RESOLVE_SQL = f"""pairs AS (SELECT DISTINCT provider, model FROM usage), {CANDIDATES_SQL},
keys AS (SELECT p.provider, p.model, lower(trim(p.provider)) || '/' || cand AS key, 0 AS spec, rank FROM pairs p JOIN cands c ON c.model = p.model WHERE trim(p.provider) <> '' AND cand NOT LIKE '%/%' UNION ALL SELECT p.provider, p.model, cand, 1, rank FROM pairs p JOIN cands c ON c.model = p.model),
resolved AS (SELECT p.provider, p.model, f.key FROM pairs p LEFT JOIN (SELECT provider, model, arg_min(r.key, CASE WHEN curated THEN 0 ELSE 1 END * 10000 + spec * 1000 + rank) AS key FROM keys k JOIN rates r ON r.key = k.key GROUP BY provider, model) f ON f.provider = p.provider AND f.model = p.model)"""
RATE_SQL = RESOLVE_SQL.replace("SELECT DISTINCT provider, model FROM usage", "SELECT DISTINCT '' AS provider, model FROM usage") + ", rate AS (SELECT s.model, CASE WHEN NOT r.free THEN r.r_input END AS rate FROM resolved s LEFT JOIN rates r ON r.key = s.key)"
TURNS_SQL = "turns AS (SELECT * REPLACE (project || '/' || cast(created // 86400 AS VARCHAR) AS session_id) FROM usage)"
ESC_SQL = TURNS_SQL + """, esc AS (
  SELECT session_id, opening, sum(CASE WHEN later AND (open_rate IS NULL OR rate IS NULL) THEN 1 ELSE 0 END) AS unclassified, arg_max(model, rate * 1e15 - rn) FILTER (later AND rate > open_rate) AS to_model,
    coalesce(sum(cost) FILTER (later AND rate > open_rate AND billable), 0.0) AS cost_after, coalesce(sum(requests) FILTER (later AND rate > open_rate AND on_quota), 0) AS quota_after,
    coalesce(sum(requests) FILTER (later AND rate > open_rate AND needs_price AND NOT billable), 0) AS unpriced_after
  FROM (SELECT u.*, o.opening, x.rate AS open_rate, r.rate, u.rn > 1 AND u.model <> o.opening AS later FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created, seq) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM turns WHERE session_id IS NOT NULL) u
    JOIN (SELECT session_id, arg_min(model, created * 100000000 + seq) AS opening FROM turns WHERE session_id IS NOT NULL GROUP BY session_id) o ON o.session_id = u.session_id LEFT JOIN rate x ON x.model = o.opening LEFT JOIN rate r ON r.model = u.model WHERE n >= 2)
  GROUP BY session_id, opening)"""


def _rate(spark: SparkSession, d: str, rows: Rows) -> tuple[DataFrame, DataFrame]:
    """Usage with a project's day as its session (the table's own sessions hardly change model), and rates of its models."""
    u = rows(spark, d).withColumn("session_id", F.concat("project", F.lit("/"), F.floor(F.col("created") / 86400).cast("string")))
    return u, lookup.input_rate(u, A.rates(spark))


@query("q21_escalations", "SELECT count(*) AS sessions_examined, count(to_model) AS sessions_escalated, cast(coalesce(sum(unclassified), 0) AS BIGINT) AS unclassified_changes FROM esc", A.DATED_SQL, A.RATES_SQL, RATE_SQL, ESC_SQL)
def q21(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return routing.escalations(*_rate(spark, d, rows))[0]


@query("q21_transitions", f"SELECT opening AS from_model, to_model, count(*) AS sessions, {R6('sum(cost_after)')} AS cost_after, cast(sum(unpriced_after) AS BIGINT) AS unpriced_after, cast(sum(quota_after) AS BIGINT) AS quota_after FROM esc WHERE to_model IS NOT NULL GROUP BY 1, 2", A.DATED_SQL, A.RATES_SQL, RATE_SQL, ESC_SQL)
def q21t(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return routing.escalations(*_rate(spark, d, rows))[1]


@query("q22_attribution", f"""SELECT requests, tokens, CASE WHEN k = 1 AND open = 0 THEN {R6("cost")} END AS cost, CASE WHEN k = 1 AND open = 0 THEN s ELSE 'unavailable' END AS cost_status
FROM (SELECT count(*) AS requests, cast(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, sum(cost) AS cost, count(DISTINCT cost_status) AS k, max(cost_status) AS s, coalesce(sum(CASE WHEN billable AND cost IS NULL THEN 1 ELSE 0 END), 0) AS open
FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM usage WHERE session_id = (SELECT min(session_id) FROM usage)) WHERE n > 1)""", A.USAGE_SQL)
def q22(spark: SparkSession, d: str) -> DataFrame:
    u = A.usage(spark, d)
    return routing.attribution(u, u.agg(F.min("session_id")).first()[0], 1)


@query("q23_journal_stats", "SELECT 'usage' AS table_name, count(*) AS n, min(created) FILTER (created > 0) AS oldest FROM usage UNION ALL SELECT 'routing', count(*), min(created) FILTER (created > 0) FROM routing UNION ALL SELECT 'tally', count(*), min(day) FILTER (day > 0) FROM tally", A.DATED_SQL, A.ROUTING_SQL, A.TALLY_SQL)
def q23(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.journal_stats({"usage": rows(spark, d), "routing": A.routing(spark, d), "tally": A.tally(spark, d)})


@query("q24_project_labels", """SELECT p.path, coalesce(l.label, p.path) AS label FROM paths p LEFT JOIN (SELECT path, arg_min(suffix, k) AS label FROM (
  SELECT path, k, suffix, count(*) OVER (PARTITION BY suffix) AS owners FROM (SELECT path, k, array_to_string(parts[len(parts) - k + 1 : len(parts)], '/') AS suffix FROM (SELECT path, parts, unnest(generate_series(1, len(parts))) AS k FROM paths WHERE len(parts) > 0))) WHERE owners = 1 GROUP BY path) l ON l.path = p.path""",
  r"paths AS (SELECT path, list_filter(string_split_regex(path, '[/\\]+'), lambda x: x <> '') AS parts FROM (SELECT DISTINCT cwd AS path FROM transcript_line WHERE cwd IS NOT NULL))")
def q24(spark: SparkSession, d: str) -> DataFrame:
    return usage.project_labels(table(spark, d, "transcript_line"), "cwd")


PRICED_SQL = f"""priced AS (SELECT u.*, s.key, r.free, CASE WHEN u.incomplete THEN NULL ELSE c_in + c_out + c_re + c_cr + c_cw END AS est FROM (
  SELECT seq, CASE WHEN input = 0 THEN 0.0 ELSE input / 1e6 * ri END AS c_in, CASE WHEN output = 0 THEN 0.0 ELSE output / 1e6 * ro END AS c_out, CASE WHEN reasoning = 0 THEN 0.0 ELSE reasoning / 1e6 * coalesce(rr, ro) END AS c_re,
    CASE WHEN cache_read = 0 THEN 0.0 ELSE cache_read / 1e6 * rc END AS c_cr, CASE WHEN cache_write = 0 THEN 0.0 ELSE cache_write / 1e6 * rw END AS c_cw
  FROM (SELECT u.*, CASE WHEN p.through IS NOT NULL THEN p_input WHEN t.threshold IS NOT NULL THEN t_input ELSE r_input END AS ri, CASE WHEN p.through IS NOT NULL THEN p_output WHEN t.threshold IS NOT NULL THEN t_output ELSE r_output END AS ro,
      CASE WHEN p.through IS NOT NULL OR t.threshold IS NOT NULL THEN NULL ELSE r_reasoning END AS rr, CASE WHEN p.through IS NOT NULL THEN NULL WHEN t.threshold IS NOT NULL THEN t_cache_read ELSE r_cache_read END AS rc, CASE WHEN p.through IS NOT NULL THEN NULL WHEN t.threshold IS NOT NULL THEN t_cache_write ELSE r_cache_write END AS rw
    FROM usage u LEFT JOIN resolved s ON s.provider = u.provider AND s.model = u.model LEFT JOIN rates r ON r.key = s.key LEFT JOIN LATERAL (SELECT * FROM tiers t WHERE t.key = s.key AND u.input + u.cache_read > t.threshold ORDER BY threshold DESC LIMIT 1) t ON true
    LEFT JOIN LATERAL (SELECT * FROM periods p WHERE p.key = s.key AND u.created > 0 AND strftime(to_timestamp(u.created) AT TIME ZONE 'UTC', '%Y-%m-%d') <= p.through ORDER BY through LIMIT 1) p ON true)) c
  JOIN usage u ON u.seq = c.seq LEFT JOIN resolved s ON s.provider = u.provider AND s.model = u.model LEFT JOIN rates r ON r.key = s.key),
decided AS (SELECT *, CASE WHEN free THEN 0.0 ELSE est END AS ec, CASE WHEN free THEN 'free' WHEN est IS NOT NULL THEN 'estimated' END AS es FROM priced),
final AS (SELECT seq, key, CASE WHEN used THEN ec ELSE cost END AS cost, CASE WHEN cost_status = 'unavailable' AND cost IS NULL AND (billing = 'subscription' OR category = 'CLOUD') THEN 'quota' WHEN used THEN es ELSE cost_status END AS cost_status,
    CASE WHEN cost_status = 'unavailable' AND cost IS NULL AND billing = 'subscription' AND es = 'estimated' THEN ec END AS api_equivalent_cost, CASE WHEN used AND es = 'estimated' AND category = 'UNKNOWN' THEN 'PAID' ELSE category END AS category
  FROM (SELECT *, cost_status = 'unavailable' AND billing <> 'subscription' AND category NOT IN ('CLOUD', 'LOCAL', 'FREE') AND es IS NOT NULL AS used FROM decided))"""


@query("q25_priced", f"SELECT seq, key, {R6('cost')} AS cost, cost_status, {R6('api_equivalent_cost')} AS api_equivalent_cost, category FROM final", A.DATED_SQL, A.RATES_SQL, A.TIERS_SQL, A.PERIODS_SQL, RESOLVE_SQL, PRICED_SQL)
def q25(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    priced = lookup.apply_estimates(lookup.estimate(rows(spark, d), A.rates(spark), A.tiers(spark), A.periods(spark)))
    return priced.select("seq", "key", X.scaled_round(F.col("cost"), 6).alias("cost"), "cost_status", X.scaled_round(F.col("api_equivalent_cost"), 6).alias("api_equivalent_cost"), "category")


@query("q26_resolution", "SELECT * FROM resolved", A.USAGE_SQL, A.RATES_SQL, RESOLVE_SQL)
def q26(spark: SparkSession, d: str) -> DataFrame:
    return lookup.resolve(A.usage(spark, d), A.rates(spark))


@query("q27_price_period", """SELECT seq, model AS key, cast(p.through AS DATE) AS through FROM usage u LEFT JOIN LATERAL (SELECT through FROM periods p WHERE p.key = u.model AND strftime(to_timestamp(u.created) AT TIME ZONE 'UTC', '%Y-%m-%d') <= p.through ORDER BY through LIMIT 1) p ON true WHERE u.created > 0""", A.DATED_SQL, A.PERIODS_SQL)
def q27(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    dated = rows(spark, d).where("created > 0").select("seq", F.col("model").alias("key"), F.to_date(F.timestamp_seconds("created")).alias("day"))
    return lookup.period_rates(dated, A.periods(spark).select("key", "through")).select("seq", "key", "through")


@query("q28_price_tier", "SELECT seq, model AS key, (SELECT max(threshold) FROM tiers t WHERE t.key = u.model AND u.input + u.cache_read > t.threshold) AS threshold FROM usage u", A.USAGE_SQL, A.TIERS_SQL)
def q28(spark: SparkSession, d: str) -> DataFrame:
    rows = A.usage(spark, d).select("seq", F.col("model").alias("key"), (F.col("input") + F.col("cache_read")).alias("context"))
    return lookup.tier_of(rows, A.tiers(spark).select("key", "threshold"), "context").select("seq", "key", "threshold")


@query("q29_trailing_series", f"SELECT cast(e AS INTEGER) AS epoch_day, coalesce((SELECT cast(sum(tokens) AS BIGINT) FROM usage WHERE created > 0 AND created // 86400 = e), 0) AS tokens FROM generate_series({DAY // 86400 - 6}, {DAY // 86400}) g(e)", A.DATED_SQL)
def q29(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.trailing_series(rows(spark, d), DAY // 86400)


@query("q30_supersede", """SELECT position AS seq, event_id, provider, model, tokens, created FROM (SELECT *, min(seq) OVER (PARTITION BY k) AS position, row_number() OVER (PARTITION BY k ORDER BY tokens DESC, seq) AS n
FROM (SELECT *, coalesce('E:' || event_id, concat_ws(chr(31), 'S', coalesce(provider, ''), coalesce(model, ''), input, output, reasoning, cache_read, cache_write, created)) AS k FROM usage)) WHERE n = 1""", A.DATED_SQL)
def q30(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return supersede.supersede(rows(spark, d)).select("seq", "event_id", "provider", "model", total_tokens().alias("tokens"), "created")


@query("q31_apportion", """SELECT project, category, tokens, base + CASE WHEN row_number() OVER (PARTITION BY project ORDER BY rest DESC, category) <= 1000 - sum(base) OVER (PARTITION BY project) THEN 1 ELSE 0 END AS share
FROM (SELECT *, CASE WHEN tokens > 0 THEN 1 + tokens * (1000 - present) // total ELSE 0 END AS base, CASE WHEN tokens > 0 THEN tokens * (1000 - present) % total ELSE -1 END AS rest FROM (SELECT *, cast(sum(tokens) OVER (PARTITION BY project) AS BIGINT) AS total, count(*) FILTER (tokens > 0) OVER (PARTITION BY project) AS present
  FROM (SELECT coalesce(project, '(unattributed)') AS project, category, cast(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1, 2)) WHERE total > 0 AND present <= 1000)""", A.USAGE_SQL)
def q31(spark: SparkSession, d: str) -> DataFrame:
    per = A.usage(spark, d).withColumn("project", F.coalesce("project", F.lit(usage.UNATTRIBUTED))).groupBy("project", "category").agg(F.sum(total_tokens()).alias("tokens"))
    return usage.apportion(per, "project", "category", "tokens", 1000)


@query("q32_limits_merge", """SELECT agent, windows, stale, updated_at, rank, tier FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY windows > 0 DESC, NOT stale DESC, updated_at DESC NULLS LAST, rank DESC, t DESC NULLS LAST) AS n,
  coalesce(t, max(t) OVER (PARTITION BY agent)) AS tier FROM (SELECT agent, CASE WHEN fraction IS NULL THEN 0 ELSE 1 END AS windows, stale, updated_at, CASE WHEN ready THEN 1 ELSE 0 END AS rank, label AS t FROM windows)) WHERE n = 1""", A.WINDOWS_SQL)
def q32(spark: SparkSession, d: str) -> DataFrame:
    w = A.windows(spark, d)
    snaps = w.select("agent", F.when(F.col("fraction").isNull(), 0).otherwise(1).alias("windows"), "stale", "updated_at", F.when(F.col("ready"), 1).otherwise(0).alias("rank"), F.col("label").alias("tier"))
    return limits.merge_snapshots(snaps).select("agent", "windows", "stale", "updated_at", "rank", "tier")


@query("q33_binding_window", f"SELECT agent, label, fraction, resets_at FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY fraction DESC, coalesce(resets_at, 4611686018427387904), label) AS n FROM windows WHERE NOT stale AND (resets_at IS NULL OR resets_at > {NOW}) AND fraction IS NOT NULL) WHERE n = 1", A.WINDOWS_SQL)
def q33(spark: SparkSession, d: str) -> DataFrame:
    return limits.binding_window(A.windows(spark, d), NOW)


@query("q33_alarms", f"SELECT agent, label, fraction, resets_at, seq FROM windows WHERE fraction >= 0.9 AND (resets_at IS NULL OR resets_at > {NOW})", A.WINDOWS_SQL)
def q33a(spark: SparkSession, d: str) -> DataFrame:
    return limits.alarms(A.windows(spark, d), NOW).select("agent", "label", "fraction", "resets_at", "seq")


@query("q34_classify", """SELECT provider, model, CASE WHEN m LIKE '%:cloud' OR m LIKE '%-cloud' OR list_contains(pw, 'cloud') THEN 'CLOUD' WHEN list_has_any(pw, hosts) OR list_has_any(mw, hosts) OR regexp_matches(p, 'localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|::1|ollama|lmstudio|llamacpp|llama[.]cpp|vllm|local') THEN 'LOCAL'
  WHEN m LIKE '%-free' OR m LIKE '%:free' THEN 'FREE' WHEN list_has_any(pw, paid) THEN 'PAID' ELSE 'UNKNOWN' END AS category
FROM (SELECT DISTINCT provider, model, lower(coalesce(provider, '')) AS p, lower(coalesce(model, '')) AS m, string_split_regex(lower(coalesce(provider, '')), '[^a-z0-9]+') AS pw, string_split_regex(lower(coalesce(model, '')), '[^a-z0-9]+') AS mw,
  ['localhost', 'ollama', 'lmstudio', 'llamacpp', 'vllm', 'local'] AS hosts, [""" + ", ".join(f"'{p}'" for p in X.PAID_PROVIDERS) + """] AS paid FROM usage_event)""")
def q34(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "usage_event").select("provider", "model").distinct()
    return pairs.withColumn("category", X.classify(F.col("provider"), F.col("model")))


@query("q35_record_tallies", f"""SELECT cast(sum(requests) AS BIGINT) AS total_prompts, cast(sum(requests) FILTER (created >= {DAY}) AS BIGINT) AS today_prompts, count(DISTINCT session_id) AS total_sessions, count(DISTINCT session_id) FILTER (created >= {DAY}) AS today_sessions,
  count(DISTINCT created // 86400) FILTER (created > 0) AS active_days, cast(sum(tokens) AS BIGINT) AS total_tokens, cast(sum(tokens) FILTER (created >= {DAY}) AS BIGINT) AS today_tokens FROM usage""", A.DATED_SQL)
def q35(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    return usage.record_tallies(rows(spark, d), DAY)


@query("q36_carry_forward", """SELECT rec_id, first_value(meta_session IGNORE NULLS) OVER w AS session, last_value(turn_model IGNORE NULLS) OVER w AS model, coalesce(last_value(turn_cwd IGNORE NULLS) OVER w, first_value(meta_cwd IGNORE NULLS) OVER w) AS cwd
FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", """lines AS (SELECT rec_id, file_name, CASE WHEN line_no % 7 = 1 THEN feed_id || line_no END AS meta_session, CASE WHEN line_no % 5 = 0 THEN 'm' || line_no END AS turn_model,
  CASE WHEN line_no % 11 = 0 THEN '/t' || line_no END AS turn_cwd, CASE WHEN line_no % 3 = 1 THEN '/m' || line_no END AS meta_cwd FROM raw_record)""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("line_no"), F.col("line_no").cast("string")
    lines = table(spark, d, "raw_record").select(
        "rec_id", "file_name", F.when(n % 7 == 1, F.concat("feed_id", text)).alias("meta_session"), F.when(n % 5 == 0, F.concat(F.lit("m"), text)).alias("turn_model"), F.when(n % 11 == 0, F.concat(F.lit("/t"), text)).alias("turn_cwd"), F.when(n % 3 == 1, F.concat(F.lit("/m"), text)).alias("meta_cwd")
    )
    return supersede.carry_forward(lines, "file_name", "rec_id").select("rec_id", "session", "model", "cwd")


@query("q37_cumulative_delta", """SELECT * FROM (SELECT seq, greatest(input - coalesce(lag(input) OVER w, 0), 0) AS delta_input, greatest(output - coalesce(lag(output) OVER w, 0), 0) AS delta_output FROM usage WINDOW w AS (PARTITION BY provider, model ORDER BY seq)) WHERE delta_input + delta_output > 0""", A.USAGE_SQL)
def q37(spark: SparkSession, d: str) -> DataFrame:
    return supersede.cumulative_to_delta(A.usage(spark, d), ["provider", "model"], "seq", ["input", "output"]).select("seq", "delta_input", "delta_output")


@query("q38_drop_replays", """SELECT seq, coalesce(tokens - before <> output, false) AS disagrees FROM (SELECT seq, tokens, output, lag(tokens) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM usage WHERE session_id IS NOT NULL) WHERE before IS NULL OR tokens <> before""", A.USAGE_SQL)
def q38(spark: SparkSession, d: str) -> DataFrame:
    calls = A.usage(spark, d).where("session_id is not null").withColumn("total", total_tokens())
    return supersede.drop_replays(calls, "session_id", "seq", "total", "output").select("seq", "disagrees")


@query("q39_filtered_view", f"""SELECT provider, model, cast(sum(requests) AS BIGINT) AS requests FROM usage WHERE created >= {NOW - 30 * 86400} AND lower(provider) = 'anthropic' GROUP BY provider, model""", A.DATED_SQL)
def q39(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    seen = rows(spark, d).where(views.in_range(F.col("created"), NOW, 30) & views.matches(provider="ANTHROPIC"))
    return views.sort_view(seen.groupBy("provider", "model").agg(F.sum("requests").alias("requests")), "models", ["provider", "model"], "requests")


@query("q40_search", "SELECT seq, model FROM usage WHERE contains(lower(coalesce(model, '')), 'glint') OR contains(lower(coalesce(project, '')), 'glint')", A.USAGE_SQL)
def q40(spark: SparkSession, d: str) -> DataFrame:
    return views.search(A.usage(spark, d), "GLINT", ["model", "project"]).select("seq", "model")


@query("q41_insert_or_ignore", """SELECT event_id, cast(min(seq) AS BIGINT) AS seq FROM usage WHERE event_id IS NOT NULL AND seq % 3 = 0 AND event_id NOT IN (SELECT event_id FROM usage WHERE event_id IS NOT NULL AND seq % 3 <> 0) GROUP BY event_id""", A.USAGE_SQL)
def q41(spark: SparkSession, d: str) -> DataFrame:
    u = A.usage(spark, d)
    return supersede.insert_or_ignore(u.where("seq % 3 <> 0"), u.where("seq % 3 = 0")).select("event_id", "seq")


@query("q42_labels", f"""SELECT seq, CASE WHEN input >= 1000000000 THEN printf('%.1fB', floor(input / 1e8 + 0.5) / 10) WHEN input >= 1000000 THEN printf('%.1fM', floor(input / 1e5 + 0.5) / 10) WHEN input >= 1000 THEN printf('%.1fK', floor(input / 1e2 + 0.5) / 10) ELSE cast(input AS VARCHAR) END AS tokens_label,
  CASE WHEN s < 60 THEN '<1m' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h ' || lpad(cast(s // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' END AS age_label,
  CASE WHEN regexp_matches(model, '^[=+@-]') THEN '''' || model ELSE model END AS csv_model, CASE WHEN project IS NULL OR trim(project) = '' THEN NULL WHEN rtrim(project, '/') = '' THEN project ELSE rtrim(project, '/') END AS path
FROM (SELECT *, abs({NOW} - created) AS s FROM usage)""", A.DATED_SQL)
def q42(spark: SparkSession, d: str, rows: Rows = A.usage_dated) -> DataFrame:
    u = rows(spark, d)
    return u.select("seq", X.format_count(F.col("input")).alias("tokens_label"), X.format_duration(F.abs(F.lit(NOW) - F.col("created"))).alias("age_label"), X.csv_guard(F.col("model")).alias("csv_model"), X.project_path(F.col("project")).alias("path"))


@query("q43_first_positions", "SELECT session_id, cast(min(seq) AS BIGINT) AS first FROM usage GROUP BY session_id", A.USAGE_SQL)
def q43(spark: SparkSession, d: str) -> DataFrame:
    return supersede.positions(A.usage(spark, d), "session_id")


@query("q44_cost_display", "SELECT seq, CASE cost_status WHEN 'free' THEN 0.0 WHEN 'local' THEN 0.0 WHEN 'quota' THEN NULL WHEN 'unavailable' THEN NULL ELSE cost END AS sort_key, CASE WHEN cost_status = 'local' THEN 'LOCAL' WHEN cost_status = 'free' THEN 'FREE' WHEN cost_status = 'quota' THEN 'ON QUOTA' WHEN cost_status = 'unavailable' THEN 'UNKNOWN COST' WHEN cost IS NULL THEN upper(cost_status) || ' / NO COST' ELSE '$' || printf('%.4f', cost) || ' ' || cost_status END AS shown FROM usage", A.USAGE_SQL)
def q44(spark: SparkSession, d: str) -> DataFrame:
    return A.usage(spark, d).select("seq", X.cost_sort_key(F.col("cost_status"), F.col("cost")).alias("sort_key"), X.cost_display(F.col("cost_status"), F.col("cost")).alias("shown"))
