"""Queries over the readers, recorders, exports and scalars: logs are written from the tables and read back, beside SQL over the tables.

The SQL follows the published rules of each format, not the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import export, journal, supersede, usage, views
from ..schema import CATEGORIES, COST_STATUSES, TOKEN_BUCKETS, USAGE_SCHEMA, known_label, total_tokens
from ..session import scratch, table
from ..sources import config, lines, stores, telemetry
from ..streaming import state as live
from ..streaming import tail
from . import adapters as A
from .stamp_sql import stamped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


ROW = ["event_id", "provider", "model", "category", "cost_status", "billing", "requests", *TOKEN_BUCKETS, "cost", "created", "session_id", "project", "incomplete"]


def rows_of(read: DataFrame) -> DataFrame:
    """What a reader says of each request; seq, which only orders, aside."""
    return read.select(*ROW)


# A count is a whole number from 0 to 2**53; a project has no separators at its end.
COUNT = lambda c: f"CASE WHEN {c} BETWEEN 0 AND 9007199254740992 THEN {c} END"
PATH = lambda c: f"CASE WHEN trim({c}) = '' THEN NULL WHEN rtrim({c}, '/\\') = '' THEN {c} ELSE rtrim({c}, '/\\') END"
RFC = lambda c: f"coalesce(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}([.]\\d+)?([Zz]|[+-]\\d{{2}}:\\d{{2}})') THEN cast(floor(epoch(try_cast(upper({c}) AS TIMESTAMPTZ))) AS BIGINT) END, 0)"
WORDS = lambda c: f"string_split_regex(lower({c}), '[^a-z0-9]+')"
_HOSTS = "['localhost', 'ollama', 'lmstudio', 'llamacpp', 'vllm', 'local']"
_PAID = "[" + ", ".join(f"'{p}'" for p in X.PAID_PROVIDERS) + "]"


def category_sql(p: str, m: str) -> str:
    """Whole words decide: cloud, then the user's own machine, then free by name, then paid providers."""
    return f"""CASE WHEN lower({m}) LIKE '%:cloud' OR lower({m}) LIKE '%-cloud' OR list_contains({WORDS(p)}, 'cloud') THEN 'CLOUD' WHEN list_has_any({WORDS(p)}, {_HOSTS}) OR list_has_any({WORDS(m)}, {_HOSTS})
    OR regexp_matches(lower({p}), 'localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|::1|ollama|lmstudio|llamacpp|llama[.]cpp|vllm|local') THEN 'LOCAL' WHEN lower({m}) LIKE '%-free' OR lower({m}) LIKE '%:free' THEN 'FREE' WHEN list_has_any({WORDS(p)}, {_PAID}) THEN 'PAID' ELSE 'UNKNOWN' END"""


def _text(df: DataFrame, label: str, order: list[str] | None = None) -> str:
    """The lines of df (one column) written as text below the shared folder; dropped like any intermediate table."""
    return scratch(df, label, "text")


# --- sources ------------------------------------------------------------------------------------------------


@query("s02_transcripts", f"""SELECT coalesce(request_id, message.id, uuid) AS event_id, 'anthropic' AS provider, m AS model, {category_sql("'anthropic'", "m")} AS category, 'unavailable' AS cost_status, 'per_token' AS billing, cast(1 AS BIGINT) AS requests, coalesce(i, 0) AS input, coalesce(o, 0) AS output,
  cast(0 AS BIGINT) AS reasoning, coalesce(r, 0) AS cache_read, coalesce(w, 0) AS cache_write, cast(NULL AS DOUBLE) AS cost, {RFC("ts")} AS created, session_id, {PATH("cwd")} AS project, i IS NULL OR o IS NULL AS incomplete
FROM (SELECT *, coalesce(message.model, 'unknown') AS m, {COUNT("message.usage.input_tokens")} AS i, {COUNT("message.usage.output_tokens")} AS o, {COUNT("message.usage.cache_read_input_tokens")} AS r, {COUNT("message.usage.cache_creation_input_tokens")} AS w FROM transcript_line WHERE message.role = 'assistant' AND message.usage IS NOT NULL)
WHERE m NOT LIKE '<%' AND (i IS NULL OR o IS NULL OR i + o + coalesce(r, 0) + coalesce(w, 0) > 0)""")
def s02(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcript_line")
    message = F.struct("message.id", "message.role", "message.model", "message.content", "message.usage")
    line = F.to_json(F.struct(F.col("request_id").alias("requestId"), "uuid", F.col("ts").alias("timestamp"), F.col("session_id").alias("sessionId"), "cwd", message.alias("message")))
    return rows_of(lines.transcript_usage(lines.read_lines(spark, _text(t.select(line), "transcripts"), "*")))


_INCLUSIVE = f"SELECT *, {COUNT('input_tokens')} AS i, {COUNT('output_tokens')} AS o, coalesce({COUNT('reasoning_tokens')}, 0) AS re, coalesce({COUNT('cache_read_tokens')}, 0) AS cr, coalesce({COUNT('cache_write_tokens')}, 0) AS cw FROM usage_event"


@query("s01_message_store", f"""SELECT event_id, provider, model, category, CASE WHEN category = 'LOCAL' THEN 'local' WHEN category = 'FREE' THEN 'free' WHEN cost IS NOT NULL AND cost_status IN ('reported', 'calculated', 'estimated') THEN cost_status WHEN category = 'PAID' AND cost IS NOT NULL THEN 'calculated'
    WHEN category = 'CLOUD' AND coalesce(cost, 0) <= 0 THEN 'quota' ELSE 'unavailable' END AS cost_status, 'per_token' AS billing, cast(1 AS BIGINT) AS requests, coalesce(i, 0) AS input, coalesce(o, 0) AS output, re AS reasoning, cr AS cache_read, cw AS cache_write,
  CASE WHEN category = 'CLOUD' AND coalesce(cost, 0) <= 0 AND NOT (cost IS NOT NULL AND cost_status IN ('reported', 'calculated', 'estimated')) THEN NULL ELSE cost END AS cost, cast(floor(epoch(received_at)) AS BIGINT) AS created, session_id, cast(NULL AS VARCHAR) AS project, i IS NULL OR o IS NULL AS incomplete
FROM (SELECT * REPLACE (CASE WHEN named = 'UNKNOWN' AND cost > 0 THEN 'PAID' ELSE named END AS category) FROM (SELECT * REPLACE (coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, CASE WHEN cost >= 0 AND NOT isinf(cost) AND NOT isnan(cost) THEN cost END AS cost), {category_sql("coalesce(provider, 'unknown')", "coalesce(model, 'unknown')")} AS named FROM ({_INCLUSIVE})))""")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """usage_event as messages of a store, half of them below `info`; the time a message was stored is that of its delivery, in milliseconds."""
    u = table(spark, d, "usage_event")
    tokens = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("outputTokens"), F.col("reasoning_tokens").alias("reasoning"), F.struct(F.col("cache_read_tokens").alias("read"), F.col("cache_write_tokens").alias("write")).alias("cache"))
    source = F.when(F.col("cost_status") == "reported", "provider_reported").otherwise(F.col("cost_status"))
    info = F.struct(F.lit("assistant").alias("role"), F.col("provider").alias("providerID"), F.col("model").alias("modelID"), F.col("event_id").alias("id"), F.col("session_id").alias("sessionID"), tokens.alias("tokens"), "cost", source.alias("cost_source"))
    data = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(info.alias("info")))).otherwise(F.to_json(info))
    return rows_of(stores.message_usage(u.select(data.alias("data"), F.unix_millis(F.col("received_at").cast("timestamp")).alias("time_created"))))


@query("s06_event_store", f"""SELECT CASE WHEN session_id IS NOT NULL THEN 'copilot:' || session_id || ':' || CASE WHEN id % 3 = 0 THEN cast(id AS VARCHAR) WHEN id % 3 = 1 THEN concat('t', batch_no, ':', seen, ':', i2, ':', o2) ELSE concat(seen, ':', i2, ':', o2) END END AS event_id, 'copilot' AS provider, model,
  {category_sql("'copilot'", "model")} AS category, 'unavailable' AS cost_status, 'subscription' AS billing, cast(1 AS BIGINT) AS requests, i2 AS input, o2 AS output, re AS reasoning, cr AS cache_read, cw AS cache_write, cast(NULL AS DOUBLE) AS cost, seen AS created, session_id, project, i IS NULL OR o IS NULL AS incomplete
FROM (SELECT e.* REPLACE (coalesce(model, 'unknown') AS model, coalesce({PATH("s.cwd")}, s.repository) AS project), greatest(coalesce(i, 0) - cr - cw, 0) AS i2, greatest(coalesce(o, 0) - re, 0) AS o2, cast(floor(epoch(received_at)) AS BIGINT) AS seen
  FROM ({_INCLUSIVE}) e LEFT JOIN (SELECT session_id AS sid, max(project) AS cwd, 'repo-' || min(host_id) AS repository FROM usage_event WHERE session_id IS NOT NULL GROUP BY 1) s ON s.sid = e.session_id) WHERE i2 + o2 + re + cr + cw > 0 OR i IS NULL OR o IS NULL""")
def s06(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_event")
    at = F.unix_timestamp(F.col("received_at").cast("timestamp"))
    k = F.col("id") % 3
    events = u.select(F.when(k == 0, F.col("id")).alias("id"), "session_id", "model", *(F.col(f"{c}_tokens").cast("double").alias(f"{c}_tokens") for c in TOKEN_BUCKETS), F.when(k == 1, F.col("batch_no").cast("long")).alias("turn_index"), F.when(k == 2, F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise((at * 1000).cast("string")).alias("created_at"))
    sessions = u.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.max("project").alias("cwd"), F.concat(F.lit("repo-"), F.min("host_id")).alias("repository"))
    return rows_of(stores.event_usage(events, sessions, "subscription"))


_CODEX = f"""log AS (SELECT *, row_number() OVER (ORDER BY rec_id) AS place FROM (SELECT rec_id, file_name, body::JSON AS j FROM raw_record WHERE feed_kind = 'codex' AND json_valid(body) AND json_type(body) = 'OBJECT')),
said AS (SELECT *, j->>'type' AS kind, j->'payload' AS p, CASE WHEN j->>'type' = 'response_item' AND json_exists(j, '$.payload.payload') THEN j->'payload'->'payload' ELSE j->'payload' END AS item FROM log WHERE j->>'type' IS NOT NULL AND json_exists(j, '$.payload')),
carried AS (SELECT *, first_value(CASE WHEN kind = 'session_meta' THEN coalesce(p->>'id', p->>'session_id') END IGNORE NULLS) OVER w AS session, last_value(CASE WHEN kind = 'turn_context' THEN coalesce(p->>'model', p->>'model_slug') END IGNORE NULLS) OVER w AS model,
  coalesce(last_value(CASE WHEN kind = 'turn_context' THEN p->>'cwd' END IGNORE NULLS) OVER w, first_value(CASE WHEN kind = 'session_meta' THEN p->>'cwd' END IGNORE NULLS) OVER w) AS cwd FROM said WINDOW w AS (PARTITION BY file_name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
num AS (SELECT *, j->>'timestamp' AS ts, json_type(item, '$.info.total_token_usage') = 'OBJECT' AS has_total, {", ".join(f"CASE WHEN json_type(item, '$.info.{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE WHEN try_cast(item->'info'->{arrow} AS DOUBLE) >= 0 AND try_cast(item->'info'->{arrow} AS DOUBLE) % 1 = 0 AND try_cast(item->'info'->{arrow} AS DOUBLE) <= 9007199254740992 THEN cast(try_cast(item->'info'->{arrow} AS DOUBLE) AS BIGINT) END END AS {name}" for name, path, arrow in (
    ("i", "last_token_usage.input_tokens", "'last_token_usage'->'input_tokens'"), ("c", "last_token_usage.cached_input_tokens", "'last_token_usage'->'cached_input_tokens'"), ("o", "last_token_usage.output_tokens", "'last_token_usage'->'output_tokens'"),
    ("re", "last_token_usage.reasoning_output_tokens", "'last_token_usage'->'reasoning_output_tokens'"), ("own", "last_token_usage.total_tokens", "'last_token_usage'->'total_tokens'"), ("total", "total_token_usage.total_tokens", "'total_token_usage'->'total_tokens'")))}
  FROM carried WHERE kind NOT IN ('session_meta', 'turn_context') AND item->>'type' = 'token_count' AND json_type(item, '$.info.last_token_usage') = 'OBJECT'),
calls AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, CASE WHEN has_total THEN coalesce(total, 0) END AS t FROM num))"""


@query("s05_rollouts", f"""WITH {_CODEX} SELECT 'codex:' || ts || ':' || coalesce(own, 0) || ':' || coalesce(t, 0) AS event_id, 'openai' AS provider, m AS model, {category_sql("'openai'", "m")} AS category, 'unavailable' AS cost_status, 'per_token' AS billing, cast(1 AS BIGINT) AS requests, greatest(coalesce(i, 0) - coalesce(c, 0), 0) AS input, greatest(coalesce(o, 0) - coalesce(re, 0), 0) AS output,
  coalesce(re, 0) AS reasoning, coalesce(c, 0) AS cache_read, cast(0 AS BIGINT) AS cache_write, cast(NULL AS DOUBLE) AS cost, {RFC("ts")} AS created, session AS session_id, {PATH("cwd")} AS project, i IS NULL OR o IS NULL AS incomplete
FROM (SELECT *, coalesce(model, 'unknown') AS m FROM calls) WHERE (t IS NULL OR before IS NULL OR t <> before) AND (i IS NULL OR o IS NULL OR greatest(coalesce(i, 0) - coalesce(c, 0), 0) + greatest(coalesce(o, 0) - coalesce(re, 0), 0) + coalesce(re, 0) + coalesce(c, 0) > 0)""")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """The rollout feeds of raw_record, each file's lines in their order of arrival; bodies that aren't whole objects say nothing."""
    r = table(spark, d, "raw_record").where("feed_kind = 'codex' and try_parse_json(body) is not null")
    return rows_of(lines.rollout_usage(r.select(F.col("file_name").alias("file"), F.struct(F.lit(0).alias("block"), F.col("rec_id").alias("row")).alias("pos"), F.col("body").alias("line"))))


@query("s09_telemetry", f"""SELECT CASE WHEN event_id IS NOT NULL THEN concat('gemini:', event_id, ':', stamp, ':', coalesce(i, 0) + coalesce(o, 0)) END AS event_id, 'gemini' AS provider, trim(model) AS model, 'UNKNOWN' AS category, 'unavailable' AS cost_status, 'per_token' AS billing, cast(1 AS BIGINT) AS requests, coalesce(i, 0) - least(cr, coalesce(i, 0)) AS input, coalesce(o, 0) AS output, re AS reasoning,
  least(cr, coalesce(i, 0)) AS cache_read, cast(0 AS BIGINT) AS cache_write, cast(NULL AS DOUBLE) AS cost, cast(floor(epoch(received_at)) AS BIGINT) AS created, session_id, cast(NULL AS VARCHAR) AS project, i IS NULL OR o IS NULL AS incomplete
FROM (SELECT *, strftime(received_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS stamp FROM ({_INCLUSIVE})) WHERE trim(model) <> '' AND id % 10 <> 0 AND (i IS NULL OR o IS NULL OR coalesce(i, 0) + coalesce(o, 0) + re > 0)""")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """usage_event as a telemetry stream: pretty-printed objects one after the other, one in ten a failed call, read back and split."""
    u = table(spark, d, "usage_event")
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    attributes = F.struct(
        F.lit("gemini_cli.api_response").alias("event.name"), F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event.timestamp"), "model", F.when(F.col("id") % 10 == 0, 500).otherwise(200).alias("status_code"), F.col("event_id").alias("prompt_id"),
        F.col("session_id").alias("session.id"), F.col("input_tokens").alias("input_token_count"), F.col("output_tokens").alias("output_token_count"), F.col("cache_read_tokens").alias("cached_content_token_count"), F.col("reasoning_tokens").alias("thoughts_token_count"), total.alias("total_token_count"), F.lit('odd } "{ text').alias("note"),
    )
    return rows_of(telemetry.telemetry_usage(telemetry.read_objects(spark, _text(u.select(F.to_json(F.struct(attributes.alias("attributes")), {"pretty": "true"})), "telemetry"))))


_LOGS = "SELECT *, sum(i0) OVER w AS ti, sum(o0) OVER w AS t_o, sum(r0) OVER w AS tr, sum(c0) OVER w AS tc, sum(w0) OVER w AS tw, count(*) OVER w AS n FROM (SELECT *, coalesce(input_tokens, 0) AS i0, coalesce(output_tokens, 0) AS o0, coalesce(reasoning_tokens, 0) AS r0, coalesce(cache_read_tokens, 0) AS c0, coalesce(cache_write_tokens, 0) AS w0 FROM usage_event WHERE model IS NOT NULL AND project IS NOT NULL) WINDOW w AS (PARTITION BY project, model ORDER BY id)"


@query("s07_snapshots", f"""SELECT concat('copilot:shutdown:', s, ':', model, ':', cast(ti + t_o + tr + tc + tw AS BIGINT)) AS event_id, 'copilot' AS provider, model, {category_sql("'copilot'", "model")} AS category, 'unavailable' AS cost_status, 'per_token' AS billing, cast(1 AS BIGINT) AS requests, greatest(i0 - c0 - w0, 0) AS input, greatest(o0 - r0, 0) AS output, r0 AS reasoning, c0 AS cache_read, w0 AS cache_write,
  cast(NULL AS DOUBLE) AS cost, cast(floor(epoch(received_at)) AS BIGINT) AS created, s AS session_id, cast(NULL AS VARCHAR) AS project, false AS incomplete FROM (SELECT *, 's' || md5(project) AS s FROM ({_LOGS})) WHERE i0 + o0 + r0 + c0 + w0 > 0""")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """usage_event as logs of running totals, a session for each project, and what each snapshot adds."""
    u = table(spark, d, "usage_event").where("model is not null and project is not null")
    u.createOrReplaceTempView("_snapshot_events")
    logs = spark.sql(_LOGS.replace("usage_event", "_snapshot_events"))
    use = F.struct(F.col("ti").alias("inputTokens"), F.col("t_o").alias("output_tokens"), F.col("tr").alias("reasoningTokens"), F.col("tc").alias("cacheReadTokens"), F.col("tw").alias("cacheWriteTokens"))
    entry = F.create_map("model", F.struct(F.struct(F.col("n").alias("count")).alias("requests"), use.alias("usage")))
    line = F.to_json(F.struct(F.lit("session.shutdown").alias("type"), F.unix_millis(F.col("received_at").cast("timestamp")).alias("timestampMs"), F.struct(entry.alias("modelMetrics")).alias("data")))
    made = logs.select(F.concat(F.lit("/state/s"), F.md5(F.col("project").cast("binary")), F.lit("/log.jsonl")).alias("file"), F.struct(F.lit(0).alias("block"), F.col("id").alias("row")).alias("pos"), line.alias("line"))
    return rows_of(lines.snapshot_usage(made))


_WINDOWS_OF = lambda w: f"CASE WHEN json_type(j, '$.rate_limits.{w}.used_percentage') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN try_cast(j->'rate_limits'->'{w}'->>'used_percentage' AS DOUBLE) END"


@query("s15_status_line", f"""SELECT rec_id, list_filter([CASE WHEN a IS NOT NULL AND (ra IS NULL OR ra > 500) THEN '5h ' || cast(round(a) AS BIGINT) || '%' END, CASE WHEN b IS NOT NULL AND (rb IS NULL OR rb > 500) THEN '7d ' || cast(round(b) AS BIGINT) || '%' END], lambda x: x IS NOT NULL) AS shown
FROM (SELECT rec_id, {_WINDOWS_OF("five_hour")} AS a, {_WINDOWS_OF("seven_day")} AS b, CASE WHEN json_type(j, '$.rate_limits.five_hour.resets_at') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN cast(try_cast(j->'rate_limits'->'five_hour'->>'resets_at' AS DOUBLE) AS BIGINT) END AS ra,
  CASE WHEN json_type(j, '$.rate_limits.seven_day.resets_at') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN cast(try_cast(j->'rate_limits'->'seven_day'->>'resets_at' AS DOUBLE) AS BIGINT) END AS rb FROM (SELECT rec_id, body::JSON AS j FROM raw_record WHERE feed_kind = 'statusline' AND json_valid(body) AND json_type(body) = 'OBJECT'))""".replace("list_filter(", "array_to_string(list_filter(").replace("IS NOT NULL) AS shown", "IS NOT NULL), ' · ') AS shown"))
def s15(spark: SparkSession, d: str) -> DataFrame:
    """The live windows of every status line, without the time that is left."""
    r = table(spark, d, "raw_record").where("feed_kind = 'statusline' and try_parse_json(body) is not null").where("startswith(trim(body), '{')").select("rec_id", F.col("body").alias("line"))
    return config.status_windows(r, 500).select("rec_id", F.regexp_replace("status_line", r" \(resets [^)]*\)", "").alias("shown"))


_CLAMPED = ", ".join(f"greatest(coalesce({c}, 0), 0) AS {n}" for c, n in (("requests", "requests"), *((f"{b}_tokens - 5", b) for b in TOKEN_BUCKETS)))


@query("s10_journal", f"""SELECT id AS seq, event_id, CASE WHEN category IN ('LOCAL', 'FREE', 'PAID', 'CLOUD', 'UNKNOWN') THEN category ELSE 'UNKNOWN' END AS category, CASE WHEN cost_status = 'quota' AND billing IS NOT DISTINCT FROM 'subscription' AND cost IS NULL THEN 'unavailable' ELSE cost_status END AS cost_status,
  CASE WHEN billing = 'subscription' THEN 'subscription' ELSE 'per_token' END AS billing, {_CLAMPED}, cost FROM usage_event WHERE id > (SELECT median(id) FROM usage_event)""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """usage_event as journal rows behind a cursor; counts are lowered by five so that some are damaged, labels are the table's own spelling."""
    u = table(spark, d, "usage_event")
    rows = u.select(F.col("id").alias("seq"), "event_id", "category", "cost_status", "billing", "requests", *((F.col(f"{c}_tokens") - 5).alias(c) for c in TOKEN_BUCKETS), "cost")
    after = u.agg(F.median("id")).first()[0]
    return journal.scanned(rows.where(F.col("seq") > after)).drop("incomplete")


@query("t03_live_supersede", f"WITH {A.USAGE_SQL} SELECT position AS seq, event_id, tokens FROM (SELECT *, min(seq) OVER (PARTITION BY event_id) AS position, row_number() OVER (PARTITION BY event_id ORDER BY tokens DESC, seq) AS n FROM usage WHERE event_id IS NOT NULL) WHERE n = 1")
def t03(spark: SparkSession, d: str) -> DataFrame:
    """Events with an id as a stream of three files, superseded live: the state after all of them."""
    rows = lines.as_usage(A.usage(spark, d).where("event_id is not null"), **{c: F.col(c) for c in ("seq", "event_id", "provider", "model", "category", "cost_status", "billing", "requests", *TOKEN_BUCKETS, "cost", "session_id", "project", "incomplete")})
    source, updates, marks = scratch(rows.repartition(3), "stream", "parquet"), scratch(rows.limit(0).select("seq"), "updates", "parquet") + "/u", scratch(rows.limit(0).select("seq"), "marks", "parquet") + "/m"
    stream = spark.readStream.schema(USAGE_SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)
    live.live_usage(stream).writeStream.outputMode("update").option("checkpointLocation", marks).foreachBatch(live.write_state(updates)).trigger(availableNow=True).start().awaitTermination()
    return live.latest_state(spark.read.parquet(updates)).select("seq", "event_id", total_tokens().alias("tokens"))


@query("t02_tail", f"""SELECT coalesce(request_id, message.id, uuid) AS event_id, coalesce(message.usage.output_tokens, 0) AS output FROM transcript_line WHERE message.role = 'assistant' AND message.usage IS NOT NULL AND coalesce(message.model, '') NOT LIKE '<%'
  AND (message.usage.input_tokens IS NULL OR message.usage.output_tokens IS NULL OR message.usage.input_tokens + message.usage.output_tokens + coalesce(message.usage.cache_read_input_tokens, 0) + coalesce(message.usage.cache_creation_input_tokens, 0) > 0)""")
def t02(spark: SparkSession, d: str) -> DataFrame:
    """transcript_line as files that are tailed by byte offsets, and the requests in what the tail gave."""
    t = table(spark, d, "transcript_line")
    line = F.to_json(F.struct(F.col("request_id").alias("requestId"), "uuid", F.col("session_id").alias("sessionId"), F.struct("message.id", "message.role", "message.model", "message.usage").alias("message")))
    source, marks = _text(t.select(line), "tailed").removeprefix("file://").removeprefix("file:"), scratch(t.limit(0).select("line_id"), "marks", "parquet")
    stream = tail.tail(spark, f"{source}/part-*")
    stream.writeStream.outputMode("append").format("parquet").option("path", marks + "/read").option("checkpointLocation", marks + "/m").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(marks + "/read").select("file", F.struct(F.lit(0).alias("block"), F.col("pos").alias("row")).alias("pos"), "line")
    return lines.transcript_usage(read).select("event_id", "output")


@query("x14_plan_label", "SELECT tier, CASE WHEN contains(t, 'max_') THEN CASE WHEN regexp_full_match(m, '[0-9x]+x') THEN 'Max ' || m ELSE 'Max' END WHEN list_contains(w, 'enterprise') THEN 'Enterprise' WHEN list_contains(w, 'team') THEN 'Team' WHEN list_contains(w, 'pro') THEN 'Pro' END AS label FROM (SELECT *, regexp_extract(t, 'max_([0-9x]*)', 1) AS m, string_split_regex(t, '[^a-z0-9]+') AS w FROM (SELECT tier, lower(tier) AS t FROM (SELECT DISTINCT panel || s AS tier FROM limit_record, (VALUES ('_max_20x'), ('_MAX_5x_y'), ('_max_'), (' max'), ('-Pro'), ('_promo'), ('.team.'), ('/Enterprise')) v(s))))")
def x14(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(*(F.lit(x) for x in ("_max_20x", "_MAX_5x_y", "_max_", " max", "-Pro", "_promo", ".team.", "/Enterprise"))))
    tiers = table(spark, d, "limit_record").select("panel").distinct().select("panel", ends.alias("s")).select(F.concat("panel", "s").alias("tier"))
    return tiers.select("tier", X.plan_label(F.col("tier")).alias("label"))


# --- sinks --------------------------------------------------------------------------------------------------

_PLAIN = lambda c: f"regexp_replace(cast(cast(cast({c} AS VARCHAR) AS DECIMAL(38, 18)) AS VARCHAR), '[.]?0+$', '')"
_GUARD = lambda c: f"coalesce(CASE WHEN regexp_matches({c}, '^[=+@\\t\\r-]') AND try_cast({c} AS DOUBLE) IS NULL THEN '''' || {c} ELSE {c} END, '')"


@query("k02_usage_csv", f"""WITH {A.DATED_SQL} SELECT {", ".join(f"{_GUARD(c)} AS {c}" for c in ("provider", "model", "category", "cost_status", "project", "session_id"))}, {", ".join(f"cast({c} AS VARCHAR) AS {n}" for c, n in (("requests", "requests"), *((b, b + "_tokens") for b in TOKEN_BUCKETS), ("created", "created")))}, coalesce({_PLAIN("cost")}, '') AS cost, '' AS api_equivalent_cost FROM usage""")
def k02(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_rows(A.usage_dated(spark, d))


@query("k01_usage_rows", f"WITH {A.DATED_SQL} SELECT provider, model, category, cost_status, requests, input AS input_tokens, output AS output_tokens, reasoning AS reasoning_tokens, cache_read AS cache_read_tokens, cache_write AS cache_write_tokens, cost, billing, incomplete, created, project, session_id, cast(NULL AS DOUBLE) AS api_equivalent_cost FROM usage")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return export.published(A.usage_dated(spark, d))


def _listed_sql(source: str, keys: list[str], top: int, more: dict[str, str]) -> str:
    """The top groups by tokens with their details, and one row of all others."""
    k = ", ".join(keys)
    keyed = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"""WITH {source}, g AS (SELECT {k}, {A.COUNTERS_SQL}, {", ".join(f"{sql} AS {n}" for n, sql in more.items())} FROM u GROUP BY {k}),
r AS (SELECT *, {keyed} AND row_number() OVER (PARTITION BY {keyed} ORDER BY input + output + reasoning + cache_read + cache_write DESC, {k}) <= {top} AS shown FROM g)
SELECT {", ".join(f"CASE WHEN shown THEN {x} END AS {x}" for x in keys)}, shown, cast(sum(requests) AS BIGINT) AS requests, cast(sum(input + output + reasoning + cache_read + cache_write) AS BIGINT) AS tokens, cast(sum(unpriced_requests) AS BIGINT) AS unpriced_requests, {", ".join(f"any_value(CASE WHEN shown THEN {n} END) AS {n}" for n in more)} FROM r GROUP BY ALL HAVING shown OR sum(requests) > 0"""


_LISTED = ["shown", "requests", "tokens", "unpriced_requests"]
_SEEN_SQL = {"first_seen": "min(created) FILTER (created > 0)", "last_seen": "max(created) FILTER (created > 0)"}


@query("k04_by_model", _listed_sql(A.USAGE_SQL + ", u AS (SELECT * FROM usage)", ["provider", "model", "category", "cost_status"], 8, {"sessions": "count(DISTINCT session_id)"}))
def k04m(spark: SparkSession, d: str) -> DataFrame:
    """The summary's list of models, by all four keys."""
    return export.by_model(A.usage(spark, d), 8).select("provider", "model", "category", "cost_status", *_LISTED, "sessions")


@query("k04_by_project", _listed_sql(A.DATED_SQL + ", u AS (SELECT * REPLACE (coalesce(project, '(unattributed)') AS project) FROM usage)", ["project"], 8, {"sessions": "count(DISTINCT session_id)", "models": "count(DISTINCT concat_ws('/', provider, model))", **_SEEN_SQL}))
def k04p(spark: SparkSession, d: str) -> DataFrame:
    return export.by_project(A.usage_dated(spark, d), 8).select("project", *_LISTED, "sessions", "models", *_SEEN_SQL)


@query("k04_by_session", _listed_sql(A.DATED_SQL + ", u AS (SELECT * FROM usage)", ["session_id"], 8, {"project": "arg_min(project, seq) FILTER (project IS NOT NULL)", "models": "array_to_string(list_sort(list(DISTINCT concat_ws('/', provider, model)))[1:6], ',')", "models_total": "count(DISTINCT concat_ws('/', provider, model))", **_SEEN_SQL, "duration_secs": "max(created) FILTER (created > 0) - min(created) FILTER (created > 0)"}))
def k04s(spark: SparkSession, d: str) -> DataFrame:
    """The summary's list of sessions; rows without one are in `other`."""
    return export.by_session(A.usage_dated(spark, d), 8).select("session_id", *_LISTED, "project", "models", F.col("models_total").cast("long").alias("models_total"), *_SEEN_SQL, "duration_secs")


@query("k04_undated", f"WITH {A.DATED_SQL} SELECT cast(coalesce(sum(requests) FILTER (created <= 0), 0) AS BIGINT) AS undated_requests FROM usage")
def k04u(spark: SparkSession, d: str) -> DataFrame:
    return usage.undated_requests(A.usage_dated(spark, d))


@query("k07_model_usage", f"WITH {A.DATED_SQL} SELECT model, cast(sum(input) AS BIGINT) AS input_tokens, cast(sum(output + reasoning) AS BIGINT) AS output_tokens, cast(sum(cache_read) AS BIGINT) AS cache_read_input_tokens, cast(sum(cache_write) AS BIGINT) AS cache_creation_input_tokens, cast(sum(tokens) FILTER (created >= {A.DAY_START} AND created < {A.DAY_START + 86400}) AS BIGINT) AS today_tokens FROM usage GROUP BY model")
def k07(spark: SparkSession, d: str) -> DataFrame:
    return usage.record_models(A.usage_dated(spark, d), F.col("created").between(A.DAY_START, A.DAY_START + 86399))


@query("k07_days", f"WITH {A.DATED_SQL} SELECT cast(make_timestamp(created * 1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS day, cast(sum(tokens) AS BIGINT) AS tokens FROM usage WHERE created > 0 GROUP BY 1")
def k07d(spark: SparkSession, d: str) -> DataFrame:
    """The active days of a desktop record in its local zone."""
    return usage.record_days(A.usage_dated(spark, d), A.NOW, "America/New_York")


_RECORDED = f"""SELECT *, CASE WHEN provider IS NULL OR model IS NULL THEN 'provider and model are required' WHEN {COUNT("input_tokens")} IS NULL OR {COUNT("output_tokens")} IS NULL THEN 'input_tokens and output_tokens must be counts' WHEN event_id IS NULL THEN 'event_id or created is required'
  WHEN cost_status <> 'reported' THEN 'only a reported cost may be asserted' WHEN bill IS NOT NULL AND bill NOT IN ('subscription', 'per_token') THEN 'unknown billing' WHEN cost < 0 OR isnan(cost) THEN 'bad cost' WHEN cost IS NOT NULL AND bill = 'subscription' THEN 'a subscription has no cost per event' END AS reason FROM (SELECT *, billing AS bill FROM usage_event)"""


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = table(spark, d, "usage_event")
    return journal.validate_events(u.select(F.to_json(F.struct("event_id", "provider", "model", "input_tokens", "output_tokens", "cost", "cost_status", "billing")).alias("line")), A.NOW)


@query("k09_recorded", f"SELECT event_id, provider, model, CASE WHEN cost IS NOT NULL THEN 'reported' WHEN bill = 'subscription' THEN 'quota' ELSE 'unavailable' END AS cost_status, coalesce(bill, 'per_token') AS billing, input_tokens AS input, output_tokens AS output, cost FROM ({_RECORDED}) WHERE reason IS NULL")
def k09(spark: SparkSession, d: str) -> DataFrame:
    """The events that a strict recorder takes."""
    return _recorded(spark, d)[0].select("event_id", "provider", "model", "cost_status", "billing", "input", "output", "cost")


@query("k09_refused", f"SELECT reason, count(*) AS n FROM ({_RECORDED}) WHERE reason IS NOT NULL GROUP BY reason")
def k09r(spark: SparkSession, d: str) -> DataFrame:
    """Why a strict recorder refuses the others."""
    return _recorded(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


CUT = A.NOW - 120 * 86400


@query("k13_prune_routing", f"""WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other:' || o_custkey ELSE 'claude-code:' || o_custkey || ':' || o_orderkey END AS event_id, cast(floor(epoch(o_orderdate)) AS BIGINT) AS created FROM orders), edge AS (SELECT cast(quantile_cont(created, 0.9) AS BIGINT) AS e FROM r)
SELECT k FROM r, edge WHERE created >= e OR (event_id LIKE 'claude-code:%' AND split_part(event_id, ':', 2) IN (SELECT split_part(event_id, ':', 2) FROM r, edge WHERE created >= e AND event_id LIKE 'claude-code:%'))""")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """What a prune keeps of routing rows, cut at the ninth decile of their times."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    id_ = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat(F.lit("other:"), F.col("o_custkey").cast("string"))).otherwise(F.concat_ws(":", F.lit("claude-code"), F.col("o_custkey").cast("string"), k.cast("string")))
    rows = o.select(k.alias("k"), id_.alias("event_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"))
    edge = rows.agg(F.round(F.percentile("created", 0.9)).cast("long")).first()[0]
    return journal.kept_routing(rows, edge, "claude-code").select("k")


@query("k13_prune_usage", f"WITH {A.DATED_SQL} SELECT seq FROM usage WHERE created <= 0 OR created >= {CUT} OR seq = (SELECT max(seq) FROM usage)")
def k13u(spark: SparkSession, d: str) -> DataFrame:
    u = A.usage_dated(spark, d)
    return u.where(~journal.is_old(CUT) | (F.col("seq") == u.agg(F.max("seq")).first()[0])).select("seq")


# --- filters, orders and merges ----------------------------------------------------------------------------

_BY = "cast(sum(requests) AS BIGINT) AS requests, cast(sum(tokens) AS BIGINT) AS tokens"


def _by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.sum(total_tokens()).alias("tokens"))


@query("f01_today", f"WITH {A.DATED_SQL} SELECT provider, {_BY} FROM usage WHERE created >= {A.DAY_START} GROUP BY provider")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return _by(A.usage_dated(spark, d).where(views.in_range(F.col("created"), A.NOW, None, A.DAY_START)), "provider")


@query("f01_last_7_days", f"WITH {A.DATED_SQL} SELECT provider, {_BY} FROM usage WHERE created >= {A.NOW - 7 * 86400} GROUP BY provider")
def f01w(spark: SparkSession, d: str) -> DataFrame:
    return _by(A.usage_dated(spark, d).where(views.in_range(F.col("created"), A.NOW, 7)), "provider")


@query("f03_project", f"WITH {A.USAGE_SQL}, p AS (SELECT rtrim(min(project), '/') AS p FROM usage) SELECT model, {_BY} FROM usage, p WHERE rtrim(project, '/') = p GROUP BY model")
def f03(spark: SparkSession, d: str) -> DataFrame:
    """One project, whichever way its path ends: the first by name."""
    u = A.usage(spark, d)
    return _by(u.where(views.matches(project=u.agg(F.min("project")).first()[0])), "model")


@query("f03_unattributed", f"WITH {A.USAGE_SQL} SELECT model, {_BY} FROM usage WHERE project IS NULL GROUP BY model")
def f03u(spark: SparkSession, d: str) -> DataFrame:
    return _by(A.usage(spark, d).where(views.matches(project=usage.UNATTRIBUTED)), "model")


@query("f04_session", f"WITH {A.USAGE_SQL} SELECT provider, model, {_BY} FROM usage WHERE session_id = (SELECT max(session_id) FROM usage) GROUP BY ALL")
def f04(spark: SparkSession, d: str) -> DataFrame:
    u = A.usage(spark, d)
    return _by(u.where(views.matches(session=u.agg(F.max("session_id")).first()[0])), "provider", "model")


@query("f07_drill_down", f"WITH {A.USAGE_SQL} SELECT session_id, {_BY} FROM usage WHERE lower(provider) = 'anthropic' AND lower(model) = (SELECT min(lower(model)) FROM usage WHERE lower(provider) = 'anthropic') GROUP BY session_id")
def f07(spark: SparkSession, d: str) -> DataFrame:
    """A provider, then its first model by name, then that one's sessions."""
    u = A.usage(spark, d).where(views.matches(provider="anthropic"))
    return _by(u.where(views.matches(model=u.agg(F.min(F.lower("model"))).first()[0])), "session_id")


_KEY = "coalesce('E:' || event_id, concat_ws(chr(31), 'S', coalesce(provider, ''), coalesce(model, ''), input, output, reasoning, cache_read, cache_write, created))"


@query("d04_live_merge", f"WITH {A.DATED_SQL} SELECT position AS seq, event_id, tokens FROM (SELECT *, min(seq) OVER (PARTITION BY k) AS position, row_number() OVER (PARTITION BY k ORDER BY tokens DESC, seq) AS n FROM (SELECT *, {_KEY} AS k FROM (SELECT * REPLACE (seq + CASE WHEN seq % 3 = 1 THEN 1000000000 WHEN seq % 3 = 2 THEN 2000000000 ELSE 0 END AS seq) FROM usage))) WHERE n = 1")
def d04(spark: SparkSession, d: str) -> DataFrame:
    """Three sources, merged live: all are deduplicated, in their order."""
    return supersede.merge_sources(*_three(spark, d), dedup_base=True).select("seq", "event_id", total_tokens().alias("tokens"))


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    u = A.usage_dated(spark, d)
    parts = [u.where(F.col("seq") % 3 == i).withColumn("seq", F.col("seq") + i * 1_000_000_000) for i in range(3)]
    return parts[0], parts[1:]


@query("d03_one_shot_merge", f"""WITH {A.DATED_SQL}, all_rows AS (SELECT *, {_KEY} AS k FROM (SELECT * REPLACE (seq + CASE WHEN seq % 3 = 1 THEN 1000000000 WHEN seq % 3 = 2 THEN 2000000000 ELSE 0 END AS seq) FROM usage)), base AS (SELECT *, max(seq) OVER (PARTITION BY k) AS last FROM all_rows WHERE seq < 1000000000),
pool AS (SELECT seq, event_id, tokens, k FROM base WHERE seq = last UNION ALL SELECT seq, event_id, tokens, k FROM all_rows WHERE seq >= 1000000000)
SELECT seq, event_id, tokens FROM base WHERE seq <> last UNION ALL SELECT position, event_id, tokens FROM (SELECT *, min(seq) OVER (PARTITION BY k) AS position, row_number() OVER (PARTITION BY k ORDER BY tokens DESC, seq) AS n FROM pool) WHERE n = 1""")
def d03(spark: SparkSession, d: str) -> DataFrame:
    """Three sources, merged once: all rows of the first stay, the last of an identity can be superseded."""
    return supersede.merge_sources(*_three(spark, d)).select("seq", "event_id", total_tokens().alias("tokens"))


# --- scalars over the tables' own values -------------------------------------------------------------------


@query("x04_counts", f"SELECT id, {COUNT('input_tokens')} AS whole, CASE WHEN cost >= 0 AND cost % 1 = 0 AND cost <= 9007199254740992 THEN cast(cost AS BIGINT) END AS fractional FROM usage_event")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage_event").select("id", X.count_or_null(F.col("input_tokens")).alias("whole"), X.count_or_null(F.col("cost")).alias("fractional"))


_PLAIN_INT = "CASE WHEN regexp_full_match(created, '[0-9]+') THEN try_cast(created AS BIGINT) END"


@query("x05_epoch_seconds", f"SELECT id, CASE WHEN v > 100000000000000 THEN v // 1000000 WHEN v > 100000000000 THEN v // 1000 ELSE v END AS seconds FROM (SELECT id, {_PLAIN_INT} AS v FROM usage_event)")
def x05(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_event")
    return u.select("id", X.epoch_seconds(F.when(F.col("created").rlike("^[0-9]+$"), F.col("created").try_cast("long"))).alias("seconds"))


@query("x06_rfc3339", f"SELECT line_id, {RFC('ts')} AS seconds FROM transcript_line")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_line").select("line_id", F.coalesce(X.rfc3339_seconds(F.col("ts")), F.lit(0)).alias("seconds"))


@query("x07_project_path", f"SELECT DISTINCT cwd, {PATH('cwd')} AS path FROM transcript_line")
def x07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_line").select("cwd", X.project_path(F.col("cwd")).alias("path")).distinct()


_DATED_NAMES = "SELECT DISTINCT model || s AS name FROM usage_event, (VALUES (''), ('-20250929'), ('-2025-09-29'), ('-4-5-20250929'), ('-2025-9'), ('@x'), (':cloud')) v(s) WHERE model IS NOT NULL"


def _names(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(*(F.lit(s) for s in ("", "-20250929", "-2025-09-29", "-4-5-20250929", "-2025-9", "@x", ":cloud"))))
    return table(spark, d, "usage_event").where("model is not null").select("model", ends.alias("s")).select(F.concat("model", "s").alias("name")).distinct()


@query("x10_strip_date", f"SELECT name, regexp_replace(name, '-([0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$', '') AS undated FROM ({_DATED_NAMES})")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("name", X.strip_date(F.col("name")).alias("undated"))


@query("x11_dotted_version", f"""SELECT name, list_reduce(list_prepend('', string_split(name, '-')), lambda a, b: CASE WHEN a = '' THEN b WHEN regexp_matches(a, '(^|[-.])[0-9]+$') AND regexp_full_match(b, '[0-9]+') THEN a || '.' || b ELSE a || '-' || b END) AS dotted FROM ({_DATED_NAMES})""")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("name", X.dotted_version(F.col("name")).alias("dotted"))


@query("x12_share_label", "SELECT id, CASE WHEN w = 0 OR p = 0 THEN NULL WHEN p * 100.0 / w < 1 THEN '<1%' ELSE cast(round(p * 100.0 / w) AS BIGINT) || '%' END AS share FROM (SELECT id, coalesce(output_tokens, 0) AS p, coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) AS w FROM usage_event)")
def x12(spark: SparkSession, d: str) -> DataFrame:
    part, more = F.coalesce("output_tokens", F.lit(0)), F.coalesce("cache_read_tokens", F.lit(0))
    return table(spark, d, "usage_event").select("id", X.share_label(part, part + more).alias("share"))


@query("x15_window_label", """SELECT limit_id, CASE WHEN m IS NULL OR m <= 0 THEN CASE WHEN ready THEN 'Secondary window' ELSE 'Primary window' END WHEN m = 300 THEN 'Session (5-hour)' WHEN m = 10080 THEN 'Weekly (7-day)' WHEN m % 1440 = 0 THEN (m // 1440) || '-day window' WHEN m % 60 = 0 THEN (m // 60) || '-hour window' ELSE m || '-minute window' END AS label
FROM (SELECT limit_id, ready, CASE limit_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 300 WHEN 2 THEN 10080 WHEN 3 THEN 1440 * (limit_id % 5) WHEN 4 THEN 60 * (limit_id % 11) ELSE limit_id END AS m FROM limit_record)""")
def x15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("limit_id")
    m = F.when(k % 7 == 0, F.lit(None).cast("long")).when(k % 7 == 1, 300).when(k % 7 == 2, 10080).when(k % 7 == 3, 1440 * (k % 5)).when(k % 7 == 4, 60 * (k % 11)).otherwise(k)
    return table(spark, d, "limit_record").select("limit_id", X.window_label(m, F.col("ready")).alias("label"))


@query("x16_session_of_file", """SELECT DISTINCT file, CASE WHEN length(s) = 36 THEN s END AS session FROM (SELECT file, regexp_extract(array_to_string(parts[-5:], '-'), '^[^_]*') AS s FROM (SELECT 'a/rollout-' || coalesce(session_id, 'none') || CASE WHEN line_id % 3 = 0 THEN '_turn.jsonl' WHEN line_id % 3 = 1 THEN '.jsonl.zst' ELSE '.jsonl' END AS file,
  string_split('rollout-' || coalesce(session_id, 'none') || CASE WHEN line_id % 3 = 0 THEN '_turn' ELSE '' END, '-') AS parts FROM transcript_line))""")
def x16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("line_id") % 3
    file = F.concat(F.lit("a/rollout-"), F.coalesce("session_id", F.lit("none")), F.when(k == 0, "_turn.jsonl").when(k == 1, ".jsonl.zst").otherwise(".jsonl"))
    return table(spark, d, "transcript_line").select(file.alias("file")).distinct().select("file", X.session_of_file(F.col("file")).alias("session"))


_URLS = ["https://{h}/x", "http://u:p@{h}:8080/y?z", "{h}", "ftp://[::1]:9/{h}", "a@b@{h}#f", "https://{h}?q=a/b"]


@query("x17_host", "WITH h AS (SELECT DISTINCT host_id AS h FROM host_clock) SELECT h, n, CASE n WHEN 3 THEN '::1' ELSE h END AS host FROM h, generate_series(0, 5) g(n)")
def x17(spark: SparkSession, d: str) -> DataFrame:
    urls = F.array(*(F.concat(F.lit(a), F.col("host_id"), F.lit(b)) for a, b in (u.split("{h}") for u in _URLS)))
    each = table(spark, d, "host_clock").select("host_id").distinct().select(F.col("host_id").alias("h"), F.posexplode(urls).alias("n", "url"))
    return each.select("h", F.col("n").cast("long").alias("n"), X.url_host(F.col("url")).alias("host"))


@query("x03_labels", "SELECT id, CASE WHEN upper(category) IN ('LOCAL', 'FREE', 'PAID', 'CLOUD', 'UNKNOWN') THEN upper(category) ELSE 'UNKNOWN' END AS category, CASE WHEN cost_status IN ('reported', 'calculated', 'estimated', 'free', 'local', 'quota', 'unavailable') THEN cost_status ELSE 'unavailable' END AS cost_status FROM usage_event")
def x03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage_event").select("id", known_label(F.upper("category"), CATEGORIES, "UNKNOWN").alias("category"), known_label(F.col("cost_status"), COST_STATUSES, "unavailable").alias("cost_status"))


@query("x23_coverage_label", f"""WITH {A.USAGE_SQL}, b AS (SELECT model, {A.COUNTERS_SQL} FROM usage GROUP BY model), c AS (SELECT model, quota_requests AS q, CASE WHEN priced_requests + unpriced_requests > 0 THEN round(priced_requests * 100.0 / (priced_requests + unpriced_requests) * 10000) / 10000 END AS pct FROM b), l AS (SELECT *, CASE WHEN pct >= 99.95 THEN 'all priced' WHEN pct IS NOT NULL THEN printf('%.0f', floor(pct + 0.5)) || '% priced' END AS p FROM c)
SELECT model, CASE WHEN q > 0 THEN concat_ws(' · ', p, q || ' on quota') ELSE coalesce(p, '') END AS label FROM l WHERE q < 1000""")
def x23(spark: SparkSession, d: str) -> DataFrame:
    per = A.usage(spark, d).groupBy("model").agg(*usage.counters()).where("quota_requests < 1000")
    pct = X.percent(F.col("priced_requests"), F.col("priced_requests") + F.col("unpriced_requests"), 4)
    return per.select("model", X.coverage_label(pct, F.col("quota_requests")).alias("label"))


@query("f10_stale", "WITH " + stamped("read", "SELECT limit_id AS k, updated_at AS raw, host_id FROM limit_record") + f" SELECT limit_id AS seq, micros IS NULL OR {A.NOW} - micros // 1000000 > {A.STALE_AFTER} OR {A.NOW} - micros // 1000000 < -60 AS stale FROM limit_record l LEFT JOIN read r ON r.k = l.limit_id")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return A.windows(spark, d).select("seq", "stale")
