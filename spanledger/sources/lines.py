"""JSON Lines logs: transcripts, rollouts, cumulative snapshots; one row a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import classify, count_or_null, epoch_seconds, project_path, rfc3339_seconds, session_of_file
from ..operators.supersede import carry_forward, cumulative_to_delta, drop_replays
from ..schema import TOKEN_BUCKETS, USAGE_SCHEMA


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """file, pos, line of every file below path; compressed ones (.zst, .gz) are read as they are.

    pos sorts the lines of a file: its block's offset, then the line's place. Files are split like any text input, so a
    long file is many tasks. A last line that is still being written doesn't parse and counts as malformed; one that is a whole
    object counts, and is superseded by identity when it is read again. (Tailing reads lines that are ended only.)
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    # Rows of one block are in one task, where the ids ascend: block and id together order a file.
    return placed.select("file", F.struct("block", "row").alias("pos"), "line")


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


S, D = T.StringType(), T.DoubleType()
_TRANSCRIPT_COUNTS = ("input_tokens", "inputTokens", "output_tokens", "outputTokens", "cache_read_input_tokens", "cacheReadInputTokens", "cache_creation_input_tokens", "cacheCreationInputTokens")
# What is read of a transcript line; content isn't, so it never leaves the scan.
TRANSCRIPT = struct(
    requestId=S, request_id=S, uuid=S, timestamp=S, sessionId=S, session_id=S, cwd=S, message=struct(id=S, role=S, model=S, usage=struct(**{c: D for c in _TRANSCRIPT_COUNTS})),
)


def count_of(*names: str) -> Column:
    """The count under the first of the names that holds one, else null."""
    return F.coalesce(*(count_or_null(F.col(n)) for n in names))


def number_of(*names: str) -> Column:
    return F.coalesce(count_of(*names), F.lit(0))


def as_usage(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of USAGE_SCHEMA from the given columns; those not given have the schema's empty value."""
    empty = {"requests": F.lit(1), "category": F.lit("UNKNOWN"), "cost_status": F.lit("unavailable"), "billing": F.lit("per_token"), "created": F.lit(0), "incomplete": F.lit(False), **{c: F.lit(0) for c in TOKEN_BUCKETS}}
    return df.select(*(columns.get(f.name, empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA))


def used() -> Column:
    """Whether a row holds tokens, or it isn't known how many."""
    return F.col("incomplete") | (reduce(lambda a, b: a + b, map(F.col, TOKEN_BUCKETS)) > 0)


def transcript_usage(lines: DataFrame) -> DataFrame:
    """Assistant requests of transcript lines.

    Identity is the request id, else the message's, else the line's uuid. Rows without input or output count are kept
    as incomplete; complete rows without any token, and models in angle brackets, are left out.
    """
    r = lines.where(F.col("line").contains('"usage"')).select("file", "pos", F.from_json("line", TRANSCRIPT).alias("r")).select("file", "pos", "r.*")
    u = "message.usage."
    asked, given = count_of(u + "input_tokens", u + "inputTokens"), count_of(u + "output_tokens", u + "outputTokens")
    model = F.coalesce("message.model", F.lit("unknown"))
    rows = r.where((F.col("message.role") == "assistant") & F.col("message.usage").isNotNull() & ~model.startswith("<"))
    out = as_usage(
        rows, seq=F.col("pos.row"), event_id=F.coalesce("requestId", "request_id", "message.id", "uuid"), provider=F.lit("anthropic"), model=model, category=classify(F.lit("anthropic"), model), input=F.coalesce(asked, F.lit(0)), output=F.coalesce(given, F.lit(0)),
        cache_read=number_of(u + "cache_read_input_tokens", u + "cacheReadInputTokens"), cache_write=number_of(u + "cache_creation_input_tokens", u + "cacheCreationInputTokens"), created=F.coalesce(rfc3339_seconds(F.col("timestamp")), F.lit(0)),
        session_id=F.coalesce("sessionId", "session_id"), project=project_path(F.col("cwd")), incomplete=asked.isNull() | given.isNull(),
    )
    return out.where(used())


_CALL = struct(input_tokens=D, cached_input_tokens=D, output_tokens=D, reasoning_output_tokens=D, total_tokens=D)
_WINDOW = struct(used_percent=D, window_minutes=D, resets_at=D)
_INFO = struct(last_token_usage=_CALL, total_token_usage=struct(total_tokens=D))
_LIMITS = struct(limit_id=S, limit_name=S, primary=_WINDOW, secondary=_WINDOW)
# Older writers nest the item one level deeper, and some write no payload at all.
_ITEM = dict(type=S, info=_INFO, rate_limits=_LIMITS)
_HEAD = dict(id=S, session_id=S, cwd=S, model=S, model_slug=S)
ROLLOUT = struct(timestamp=S, type=S, info=_INFO, rate_limits=_LIMITS, **_HEAD, payload=struct(**_HEAD, **_ITEM, payload=struct(**_ITEM)))


def rollout_rows(lines: DataFrame) -> DataFrame:
    """Parsed rollout lines of the kinds that matter: timestamp, type, head (of the payload, else the line) and item."""
    kinds = F.col("line").contains("session_meta") | F.col("line").contains("turn_context") | F.col("line").contains("token_count")
    r = lines.where(kinds).select("file", "pos", F.from_json("line", ROLLOUT).alias("r")).where("r.type is not null")
    bare = F.col("r.payload").isNull()
    head = F.struct(*(F.when(bare, F.col(f"r.{c}")).otherwise(F.col(f"r.payload.{c}")).alias(c) for c in _HEAD))
    nested = (F.col("r.type") == "response_item") & F.col("r.payload.payload").isNotNull()
    item = F.struct(*(F.when(nested, F.col(f"r.payload.payload.{c}")).when(bare, F.col(f"r.{c}")).otherwise(F.col(f"r.payload.{c}")).alias(c) for c in _ITEM))
    return r.select("file", "pos", "r.timestamp", "r.type", head.alias("head"), item.alias("item"))


def rollout_usage(lines: DataFrame) -> DataFrame:
    """Requests of rollout lines.

    Session, model and directory are carried along the file; a call that repeats the running total is a replay and
    dropped. Cached tokens are taken out of input, reasoning out of output: buckets are disjoint. Identity is what the line
    says (its stamp, its own and the running total), so that history copied into a fork's file counts once. Estimates without
    tokens are left out; calls whose counts are gone are kept as incomplete.
    """
    r = rollout_rows(lines)
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    said = r.withColumns({
        "meta_session": F.when(meta, F.coalesce("head.id", "head.session_id")), "meta_cwd": F.when(meta, F.col("head.cwd")), "turn_model": F.when(turn, F.coalesce("head.model", "head.model_slug")), "turn_cwd": F.when(turn, F.col("head.cwd")),
    })
    carried = carry_forward(said, "file", "pos")
    last = "item.info.last_token_usage."
    calls = carried.where(~meta & ~turn & (F.col("item.type") == "token_count") & F.col("item.info.last_token_usage").isNotNull())
    calls = calls.withColumns({"total": F.when(F.col("item.info.total_token_usage").isNotNull(), number_of("item.info.total_token_usage.total_tokens")), "own": number_of(last + "total_tokens")})
    kept = drop_replays(calls, "file", "pos", "total", "own")
    cached, reasoning = number_of(last + "cached_input_tokens"), number_of(last + "reasoning_output_tokens")
    asked, given = count_of(last + "input_tokens"), count_of(last + "output_tokens")
    model = F.coalesce("model", F.lit("unknown"))
    id_ = F.when(F.col("timestamp").isNotNull(), F.concat_ws(":", F.lit("codex"), "timestamp", F.col("own").cast("string"), F.coalesce("total", F.lit(0)).cast("string")))
    out = as_usage(
        kept, seq=F.col("pos.row"), event_id=id_, provider=F.lit("openai"), model=model, category=classify(F.lit("openai"), model), input=F.greatest(F.coalesce(asked, F.lit(0)) - cached, F.lit(0)), output=F.greatest(F.coalesce(given, F.lit(0)) - reasoning, F.lit(0)),
        reasoning=reasoning, cache_read=cached, created=F.coalesce(rfc3339_seconds(F.col("timestamp")), F.lit(0)), session_id=F.coalesce("session", session_of_file(F.col("file"))), project=project_path(F.col("cwd")), incomplete=asked.isNull() | given.isNull(),
    )
    return out.where(used())


def rollout_limits(lines: DataFrame) -> DataFrame:
    """limit_id, window, used_percent, minutes, resets_at of the newest reading of each limit id."""
    r = rollout_rows(lines.where(F.col("line").contains('"rate_limits"'))).where("item.rate_limits is not null")
    named = F.lower(F.trim("item.rate_limits.limit_id"))
    read = r.select(F.when(named != "", named).otherwise("default").alias("limit_id"), F.coalesce(rfc3339_seconds(F.col("timestamp")), F.lit(0)).alias("at"), "file", "pos", F.col("item.rate_limits").alias("l"))
    best = read.groupBy("limit_id").agg(F.max_by("l", F.struct("at", "file", "pos")).alias("l"), F.max("at").alias("at"))
    each = best.select("limit_id", "at", F.explode(F.array(F.struct(F.lit("primary").alias("window"), F.col("l.primary").alias("w")), F.struct(F.lit("secondary").alias("window"), F.col("l.secondary").alias("w")))).alias("e"))
    return each.where("e.w is not null").select("limit_id", "at", "e.window", F.col("e.w.used_percent").alias("used_percent"), F.col("e.w.window_minutes").cast("long").alias("minutes"), F.col("e.w.resets_at").cast("long").alias("resets_at"))


_SNAPSHOT = {"input": ("inputTokens", "input_tokens"), "output": ("outputTokens", "output_tokens"), "reasoning": ("reasoningTokens", "reasoning_tokens"), "cache_read": ("cacheReadTokens", "cache_read_tokens"), "cache_write": ("cacheWriteTokens", "cache_write_tokens")}
SHUTDOWN = struct(
    type=S, event=S, timestamp=S, timestampMs=S, time=S, data=struct(modelMetrics=T.MapType(S, struct(requests=struct(count=D), usage=struct(**{n: D for names in _SNAPSHOT.values() for n in names})))),
)


def snapshot_usage(lines: DataFrame, billing: str = "per_token") -> DataFrame:
    """Requests of logs that write cumulative totals of each model at shutdown: what each adds to the one before.

    A session is the folder of its log. Totals are inclusive: after the difference cached tokens are taken out of input and reasoning
    out of output. Identity is the running total itself, so a log read again adds nothing.
    """
    r = lines.where(F.col("line").contains("session.shutdown")).select("file", "pos", F.from_json("line", SHUTDOWN).alias("r")).where("coalesce(r.type, r.event) = 'session.shutdown'")
    at = F.coalesce(rfc3339_seconds(F.coalesce("r.timestamp", "r.time")), *(F.when(F.col(f"r.{c}").rlike("^[1-9][0-9]*$"), epoch_seconds(F.col(f"r.{c}").try_cast("long"))) for c in ("timestamp", "timestampMs", "time")), F.lit(0))
    session = F.element_at(F.split("file", "/"), -2)
    each = r.select(session.alias("session"), "file", "pos", at.alias("at"), F.explode("r.data.modelMetrics").alias("model", "m")).withColumn("seq", F.monotonically_increasing_id())
    flat = each.select("session", "model", "at", "seq", F.struct("file", "pos").alias("place"), number_of("m.requests.count").alias("calls"), *(number_of(*(f"m.usage.{n}" for n in names)).alias(c) for c, names in _SNAPSHOT.items()))
    delta = cumulative_to_delta(flat, ["session", "model"], "place", ["calls", *_SNAPSHOT]).where(reduce(lambda a, b: a + b, (F.col(f"delta_{c}") for c in _SNAPSHOT)) > 0)
    running = reduce(lambda a, b: a + b, (F.col(c) for c in _SNAPSHOT))
    d = {c: F.col(f"delta_{c}") for c in _SNAPSHOT}
    return as_usage(
        delta, seq=F.col("seq"), event_id=F.concat_ws(":", F.lit("copilot:shutdown"), "session", "model", running.cast("string")), provider=F.lit("copilot"), model=F.col("model"), category=classify(F.lit("copilot"), F.col("model")), billing=F.lit(billing), requests=F.greatest("delta_calls", F.lit(1)),
        input=F.greatest(d["input"] - d["cache_read"] - d["cache_write"], F.lit(0)), output=F.greatest(d["output"] - d["reasoning"], F.lit(0)), reasoning=d["reasoning"], cache_read=d["cache_read"], cache_write=d["cache_write"], created=F.col("at"), session_id=F.col("session"),
    )


def skipped(lines: DataFrame, schema: T.StructType, undated: Column) -> DataFrame:
    """One row of what a pass couldn't use: malformed, undated and all lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    r = lines.where(F.trim("line") != "").select(F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", S)]), options).alias("r"))
    bad = F.col("r._bad").isNotNull()
    return r.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("malformed"), F.coalesce(F.sum((~bad & undated).cast("int")), F.lit(0)).alias("undated"))


def sse_documents(lines: DataFrame) -> DataFrame:
    """The JSON documents of a piped response: NDJSON or server-sent events, without `data:` and [DONE]."""
    body = F.trim(F.regexp_replace("line", r"^\s*data:\s*", ""))
    return lines.withColumn("line", body).where((F.col("line") != "") & (F.col("line") != "[DONE]") & ~F.col("line").rlike(r"^(event|id|retry):|^:"))


def piped_documents(lines: DataFrame) -> DataFrame:
    """pos, line of a piped response: its NDJSON or event lines, or, where no line parses by itself, the whole as one document."""
    each = sse_documents(lines)
    alone = each.where(F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"))
    if not alone.isEmpty():
        return alone
    whole = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("line"))  # one response
    return whole.select(F.lit(0).cast("long").alias("pos"), "line").where("line <> ''")


LOCAL_DONE = struct(model=S, created_at=S, prompt_eval_count=D, eval_count=D, done=T.BooleanType())
LOCAL_CHAT = struct(id=S, model=S, created=D, usage=struct(prompt_tokens=D, completion_tokens=D, prompt_tokens_details=struct(cached_tokens=D), completion_tokens_details=struct(reasoning_tokens=D)))


def _last(documents: DataFrame, schema: T.StructType, wanted: str) -> DataFrame:
    return documents.select("pos", F.from_json("line", schema).alias("d")).where(wanted).agg(F.max_by("d", "pos").alias("d")).where("d is not null").select("d.*")


def local_generate_usage(documents: DataFrame, now: int) -> DataFrame:
    """The request that a stream of generate responses ends with: the last one that is done."""
    r = _last(documents, LOCAL_DONE, "d.done")
    n = lambda c: F.coalesce(count_or_null(F.col(c)), F.lit(0))
    created = F.coalesce(rfc3339_seconds(F.regexp_replace("created_at", r"(\.\d{6})\d+", "$1")), F.lit(now))
    return as_usage(r, seq=F.lit(0), event_id=F.concat_ws(":", F.lit("ollama"), "model", "created_at"), provider=F.lit("ollama"), model=F.col("model"), category=F.lit("LOCAL"), cost_status=F.lit("local"), input=n("prompt_eval_count"), output=n("eval_count"), created=created)


def local_chat_usage(documents: DataFrame, now: int) -> DataFrame:
    """The request that a stream of chat responses ends with: the last one with usage. Cached tokens are taken out of the prompt."""
    r = _last(documents, LOCAL_CHAT, "d.usage is not null")
    n = lambda c: F.coalesce(count_or_null(F.col(c)), F.lit(0))
    cached, reasoning = F.least(n("usage.prompt_tokens_details.cached_tokens"), n("usage.prompt_tokens")), F.least(n("usage.completion_tokens_details.reasoning_tokens"), n("usage.completion_tokens"))
    return as_usage(
        r, seq=F.lit(0), event_id=F.col("id"), provider=F.lit("llamacpp"), model=F.col("model"), category=F.lit("LOCAL"), cost_status=F.lit("local"), input=n("usage.prompt_tokens") - cached, output=n("usage.completion_tokens") - reasoning, reasoning=reasoning, cache_read=cached,
        created=F.coalesce(F.col("created").cast("long"), F.lit(now)),
    )
