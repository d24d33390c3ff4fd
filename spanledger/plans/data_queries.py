"""The pN_ queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import scaled_round
from ..operators import dedup, drift, forest, nested, rolling, stamps
from ..session import materialize, table
from .stamp_sql import stamped

TRANSCRIPT_COUNTS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
EVENT_COUNTS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens"]


def _sum(names: list[str]):
    total = F.lit(0).cast("long")
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0))
    return total


# --- 1: hierarchies -----------------------------------------------------------------------------------------


def transcript_forest(spark: SparkSession, d: str, *annotation) -> forest.Forest:
    """The uuid links of all transcript lines; of a line delivered several times the first copy counts."""
    lines = table(spark, d, "transcript_line").select("line_id", "uuid", "parent_uuid", "session_id", "agent_id")
    once = forest.first_rows(lines, "uuid", "line_id", ["parent_uuid", "session_id", "agent_id"])
    group = F.coalesce("session_id", "uuid").alias("_group")
    sizes = lines.where("uuid <> ''").groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return forest.Forest(once.select(F.col("uuid").alias("_id"), F.col("parent_uuid").alias("_parent"), group, F.col("line_id").alias("_order"), "line_id", "agent_id"), *annotation, sizes=sizes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return transcript_forest(spark, d).circle_nodes().select(F.col("_id").alias("uuid"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every uuid with its root, depth, entry-exit interval and number of descendants."""
    return transcript_forest(spark, d).nodes().withColumnsRenamed({"_id": "uuid", "_parent": "parent_uuid"})


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every transcript line with what p1_hierarchy says of its uuid; state is `no_uuid` for lines without one."""
    lines = table(spark, d, "transcript_line").select("line_id", "uuid")
    nodes = p1_hierarchy(spark, d).select("uuid", "state", "root", "depth", "descendants")
    return lines.join(nodes, "uuid", "left").withColumn("state", F.coalesce("state", F.lit("no_uuid")))


def p1_levels(spark: SparkSession, d: str) -> DataFrame:
    """State, root, depth and number of descendants of every uuid."""
    return p1_hierarchy(spark, d).select("uuid", "state", "root", "depth", "descendants")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of every uuid that has a root: path, and the ancestor it goes on from, null where it begins at the root.

    forest.expand_paths() gives the full paths of chosen ones.
    """
    return forest.pieces(transcript_forest(spark, d, forest.path_pieces(), forest.PIECES)).withColumnRenamed("_id", "uuid")


# --- 3: messages delivered more than once -------------------------------------------------------------------


def _transcript_messages(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "transcript_line").withColumn("_mid", F.col("message.id"))
    return lines.select(F.col("line_id").alias("row_id"), dedup.first_filled("request_id", "_mid", "uuid").alias("ident"), _sum([f"message.usage.{c}" for c in TRANSCRIPT_COUNTS]).alias("tokens")).where("ident is not null")


SHAPE = ["provider", "model", *EVENT_COUNTS]


def _shaped(stamped: DataFrame) -> DataFrame:
    """ident: the event id, or all that tells events without one apart. Undated and unresolved stamps are alike."""
    shape = F.concat(F.lit("s:"), dedup.one_of(*SHAPE, "stamp_micros", "stamp_rest"))
    return stamped.withColumns({"ident": F.when(F.col("event_id") != "", F.concat(F.lit("e:"), F.col("event_id"))).otherwise(shape), "tokens": _sum(EVENT_COUNTS)})


def _stamped(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    return stamps.normalise(events.withColumn("_from", F.lit("usage_event.created")), table(spark, d, "host_clock"), "created", "host_id", "_from").drop("_from")


def _event_messages(spark: SparkSession, d: str) -> DataFrame:
    """Only events without id need the instant of their stamp."""
    events = table(spark, d, "usage_event").select("id", "host_id", "created", "event_id", *SHAPE)
    named = events.where("event_id <> ''").withColumns({"stamp_micros": F.lit(None).cast("long"), "stamp_rest": F.lit(None).cast("string")})
    nameless = _stamped(spark, d, events.where("event_id is null or event_id = ''")).drop("stamp_status")
    return _shaped(named.unionByName(nameless)).select(F.col("id").alias("row_id"), "ident", "tokens")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The surplus copies of both tables, of all batches that there are."""
    tagged = lambda rows, name: rows.select(F.lit(name).alias("table_name"), "row_id", "ident", "tokens")
    rows = tagged(_transcript_messages(spark, d), "transcript_line").unionByName(tagged(_event_messages(spark, d), "usage_event"))
    return dedup.Copies(rows, ["table_name", "ident"], ["table_name", "row_id"], "tokens").surplus()


def p3_unique_messages(spark: SparkSession, d: str) -> DataFrame:
    """One transcript line of each message: singletons, those of rank 1, and lines without identity, which all stay."""
    lines = table(spark, d, "transcript_line")
    surplus = dedup.surplus(_transcript_messages(spark, d), ["ident"], "row_id", "tokens").withColumnRenamed("row_id", "line_id")
    return lines.join(surplus, "line_id", "left_anti").select("line_id", "batch_no", "uuid", "request_id", F.col("message.id").alias("message_id"), "session_id")


# --- 4: rolling totals --------------------------------------------------------------------------------------


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily averages (to eight digits) of every model and day over the trailing 7 and 30 days."""
    events = table(spark, d, "usage_event").select("id", "host_id", "created", "event_id", *SHAPE, "cost")
    # Stamped once, into a narrow table from which both the copies and the daily totals are told.
    known = materialize(_shaped(_stamped(spark, d, events)).select("id", "ident", "tokens", "model", "input_tokens", "cost", "stamp_micros"), "events")
    gone = dedup.surplus(known, ["ident"], "id", "tokens")
    dated = known.where("stamp_micros is not null").join(gone, "id", "left_anti")
    daily = rolling.daily_totals(dated, "model", "stamp_micros", "input_tokens", "cost")
    days = rolling.trailing_totals(daily).withColumnRenamed("entity", "model")
    return days.select(*(scaled_round(F.col(c), 8).alias(c) if "cost" in c or "avg" in c else F.col(c) for c in days.columns))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    days = p4_rolling(spark, d)
    return days.where(2 * F.col("tokens_7") > F.col("tokens_30")).select("model", F.date_format("day", "yyyy-MM-dd").alias("usage_day"))


# --- 5: drifting schemas ------------------------------------------------------------------------------------

#: The columns of the one table, by the canonical path of each kind of feed; field_alias adds the other spellings.
TARGETS = [
    drift.Target("client_version", "string", ("payload.cli_version", "version")),
    drift.Target("session", "string", ("payload.session_id", "sessionId", "session_id")),
    drift.Target("record_type", "string", ("type",)),
    drift.Target("model", "string", ("payload.model", "message.model", "model.id", "model")),
    drift.Target("billing", "string", ("billing",)),
    drift.Target("input_tokens", "long", ("payload.info.last_token_usage.input_tokens", "message.usage.input_tokens", "input_tokens", "context_window.total_input_tokens")),
    drift.Target("output_tokens", "long", ("payload.info.last_token_usage.output_tokens", "message.usage.output_tokens", "output_tokens")),
    drift.Target("stop_reason", "string", ("message.stop_reason",)),
]
#: field_alias is a small dimension (fixed at 22 rows); more than so many are refused rather than sent to every task.
MOST_ALIASES = 10_000


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "field_alias").select("canonical_path", "spelling_path").where("canonical_path is not null and spelling_path is not null").distinct().limit(MOST_ALIASES + 1).collect()
    if len(known) > MOST_ALIASES:
        raise ValueError(f"field_alias has more than {MOST_ALIASES} rows")
    targets = drift.with_spellings(TARGETS, [tuple(r) for r in known])
    return drift.ingest(table(spark, d, "raw_record"), ["rec_id", "feed_id", "feed_kind", "file_no", "line_no"], "body", targets)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """All records in one typed table; what doesn't fit is in _rescued."""
    return _ingested(spark, d).drop("_layout")


def p5_typed(spark: SparkSession, d: str) -> DataFrame:
    """The one table's typed columns, without what was rescued."""
    return p5_records(spark, d).drop("_rescued")


def p5_promoted(spark: SparkSession, d: str) -> DataFrame:
    """The typed table after the cost field was approved: rescued values replayed into a column of its own."""
    return drift.promote(p5_records(spark, d), drift.Target("cost", "double", ("cost", "cost.total_cost_usd")))


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change between files, with the kinds before and after it, from the layouts that ingestion wrote down."""
    return drift.changes(_ingested(spark, d), table(spark, d, "field_alias"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select("feed_id", F.col("file_no").cast("int").alias("file_no"), "field_path", "change")


# --- 6: nested records --------------------------------------------------------------------------------------


def p6_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(nested.occurrences(table(spark, d, "raw_record"), "rec_id", "body"))


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.occurrences(table(spark, d, "raw_record"), "rec_id", "body"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The scalars of the distinct objects as rows: hash, field, item_pos, type, value."""
    return nested.values(p6_objects(spark, d))


def p6_flat(spark: SparkSession, d: str) -> DataFrame:
    """The scalars of every object that stands in an array, put together from the bridge and the stored objects' values."""
    return nested.flat(materialize(nested.occurrences(table(spark, d, "raw_record"), "rec_id", "body"), "occurrences"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_bridge(spark, d).where("in_array").select("rec_id", F.col("path").alias("array_path"), "item_pos")


# --- 7: mixed timestamps ------------------------------------------------------------------------------------


STAMPED = {"transcript_line": "transcript_line.ts", "usage_event": "usage_event.created", "limit_record": "limit_record.resets_at"}


def p7_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp of the three tables with its status and, where resolved, its UTC instant."""
    rows = stamps.stamp_rows(spark, {
        "transcript_line": (table(spark, d, "transcript_line"), "line_id", "ts"),
        "usage_event": (table(spark, d, "usage_event"), "id", "created"),
        "limit_record": (table(spark, d, "limit_record"), "limit_id", "resets_at"),
    })
    rows = rows.withColumn("_from", F.element_at(F.create_map(*(F.lit(x) for p in STAMPED.items() for x in p)), F.col("table_name")))
    out = stamps.normalise(rows, table(spark, d, "host_clock"), "raw", "host_id", "_from")
    return out.select("table_name", "row_id", "stamp_status", F.timestamp_micros("stamp_micros").alias("instant"), stamps.instant_text().alias("instant_text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_instants(spark, d).where(F.col("stamp_status") == stamps.UNRESOLVED).select("table_name", "row_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_hierarchy": p1_hierarchy,
    "p1_levels": p1_levels,
    "p1_lines": p1_lines,
    "p1_paths": p1_paths,
    "p3_found": p3_found,
    "p3_unique_messages": p3_unique_messages,
    "p4_found": p4_found,
    "p4_rolling": p4_rolling,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p5_typed": p5_typed,
    "p5_promoted": p5_promoted,
    "p5_changes": p5_changes,
    "p6_found": p6_found,
    "p6_bridge": p6_bridge,
    "p6_objects": p6_objects,
    "p6_values": p6_values,
    "p6_flat": p6_flat,
    "p7_found": p7_found,
    "p7_instants": p7_instants,
}
NODES_SQL = "nodes AS (SELECT uuid AS u, arg_min(coalesce(parent_uuid, chr(0)), line_id) AS p FROM transcript_line WHERE uuid <> '' GROUP BY uuid)"
_EVENTS = (
    stamped("read", "SELECT id AS k, created AS raw, host_id FROM usage_event")
    + """,
events AS (SELECT e.*, r.micros, row_number() OVER (PARTITION BY CASE WHEN event_id <> '' THEN 'e:' || event_id ELSE 's:' || concat_ws(chr(31), """
    + ", ".join(f"coalesce(cast({c} AS VARCHAR), chr(0))" for c in [*SHAPE, "micros", "rest"])
    + ") END ORDER BY "
    + " + ".join(f"coalesce({c}, 0)" for c in EVENT_COUNTS)
    + """ DESC, id) AS n FROM usage_event e LEFT JOIN read r ON r.k = e.id),
lines AS (SELECT line_id, row_number() OVER (PARTITION BY k ORDER BY t DESC, line_id) AS n FROM (SELECT line_id, CASE WHEN request_id <> '' THEN '0:' || request_id WHEN message.id <> '' THEN '1:' || message.id WHEN uuid <> '' THEN '2:' || uuid END AS k,
  coalesce(message.usage.input_tokens, 0) + coalesce(message.usage.output_tokens, 0) + coalesce(message.usage.cache_read_input_tokens, 0) + coalesce(message.usage.cache_creation_input_tokens, 0) AS t FROM transcript_line) WHERE k IS NOT NULL)"""
)
_SPAN = lambda w: f"(PARTITION BY model ORDER BY day RANGE BETWEEN INTERVAL {w - 1} DAYS PRECEDING AND CURRENT ROW)"
_ROLLING = (
    _EVENTS
    + """,
daily AS (SELECT model, cast(make_timestamp(micros) AS DATE) AS day, count(*) AS events, cast(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens, sum(cost) FILTER (NOT isnan(cost)) AS cost, max(cost) FILTER (NOT isnan(cost)) AS top FROM events WHERE n = 1 AND micros IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT model, cast(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY model),
rolling AS (SELECT c.model, c.day, d.events IS NOT NULL AS active, """
    + ", ".join(
        f"cast(coalesce(sum(d.events) OVER w{w}, 0) AS BIGINT) AS events_{w}, cast(coalesce(sum(d.tokens) OVER w{w}, 0) AS BIGINT) AS tokens_{w}, round(sum(d.cost) OVER w{w} * 1e8) / 1e8 AS cost_{w}, round(max(d.top) OVER w{w} * 1e8) / 1e8 AS top_cost_{w}, "
        f"round(coalesce(sum(d.tokens) OVER w{w}, 0) / {w}.0 * 1e8) / 1e8 AS avg_tokens_{w}, round(sum(d.cost) OVER w{w} / {w}.0 * 1e8) / 1e8 AS avg_cost_{w}"
        for w in (7, 30)
    )
    + " FROM cal c LEFT JOIN daily d ON d.model IS NOT DISTINCT FROM c.model AND d.day = c.day WINDOW "
    + ", ".join(f"w{w} AS {_SPAN(w).replace('model', 'c.model').replace('ORDER BY day', 'ORDER BY c.day')}" for w in (7, 30))
    + ")"
)
_INSTANTS = (
    stamped("read", "SELECT table_name || ':' || row_id AS k, raw, host_id FROM stamped")
    + """,
told AS (SELECT table_name, row_id, r.* FROM stamped s JOIN read r ON r.k = s.table_name || ':' || s.row_id)"""
)
_STAMPED = """stamped AS (SELECT 'transcript_line' AS table_name, line_id AS row_id, ts AS raw, host_id FROM transcript_line UNION ALL SELECT 'usage_event', id, created, host_id FROM usage_event UNION ALL SELECT 'limit_record', limit_id, resets_at, host_id FROM limit_record),"""
_WHOLE = "SELECT *, body::JSON AS j FROM raw_record WHERE json_valid(body) AND json_type(body) = 'OBJECT'"
_FIELDS = f"""whole AS ({_WHOLE}),
tree AS (SELECT rec_id, feed_id, feed_kind, file_no, '' AS path, j FROM whole UNION ALL SELECT rec_id, feed_id, feed_kind, file_no, CASE WHEN t.path = '' THEN e.key ELSE t.path || '.' || e.key END, e.value FROM (SELECT * FROM tree WHERE json_type(j) = 'OBJECT') t, json_each(t.j) e),
fields AS (SELECT feed_id, feed_kind, file_no, path, coalesce(bit_or(CASE json_type(j) WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'OBJECT' THEN 8 WHEN 'ARRAY' THEN 16 WHEN 'NULL' THEN 0 ELSE 2 END), 0) AS kinds FROM tree WHERE path <> '' GROUP BY ALL),
files AS (SELECT feed_id, file_no, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS before FROM (SELECT DISTINCT feed_id, file_no FROM raw_record WHERE feed_id IS NOT NULL AND file_no IS NOT NULL)),
pairs AS (SELECT f.feed_id, f.file_no, coalesce(a.feed_kind, b.feed_kind) AS feed_kind, coalesce(a.path, b.path) AS path, a.kinds AS now, b.kinds AS was FROM (SELECT f.feed_id, f.file_no, x.path FROM files f JOIN fields x ON x.feed_id = f.feed_id AND x.file_no IN (f.file_no, f.before) WHERE f.before IS NOT NULL GROUP BY ALL) u
  JOIN files f ON f.feed_id = u.feed_id AND f.file_no = u.file_no LEFT JOIN fields a ON a.feed_id = u.feed_id AND a.file_no = f.file_no AND a.path = u.path LEFT JOIN fields b ON b.feed_id = u.feed_id AND b.file_no = f.before AND b.path = u.path),
states AS (SELECT *, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'retyped' END AS change FROM pairs WHERE now IS NULL OR was IS NULL OR (now <> was AND now > 0 AND was > 0)),
known AS (SELECT feed_kind, canonical_path AS grp, spelling_path AS path FROM field_alias UNION SELECT feed_kind, canonical_path, canonical_path FROM field_alias),
mates AS (SELECT s.feed_id, s.file_no, k.grp FROM states s JOIN known k ON k.feed_kind = s.feed_kind AND k.path = s.path GROUP BY ALL HAVING bool_or(change = 'added') AND bool_or(change = 'removed')),
paired AS (SELECT DISTINCT s.feed_id, s.file_no, s.path FROM states s JOIN known k ON k.feed_kind = s.feed_kind AND k.path = s.path JOIN mates m ON m.feed_id = s.feed_id AND m.file_no = s.file_no AND m.grp = k.grp),
told AS (SELECT s.feed_id, cast(s.file_no AS INTEGER) AS file_no, s.path AS field_path, CASE WHEN p.path IS NOT NULL AND change = 'added' THEN 'renamed' ELSE change END AS change, was, now FROM states s LEFT JOIN paired p ON p.feed_id = s.feed_id AND p.file_no = s.file_no AND p.path = s.path WHERE p.path IS NULL OR change <> 'removed')"""
_KIND_NAMES = lambda c: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} & {1 << i} > 0 THEN '{n}' END" for i, n in enumerate(("string", "number", "boolean", "object", "array"))) + ")"
_ITEMS = f"""whole AS ({_WHOLE}),
tree AS (SELECT rec_id, '' AS path, '' AS pos, j, false AS item FROM whole UNION ALL
  SELECT rec_id, CASE WHEN json_type(t.j) = 'ARRAY' THEN t.path || '[]' WHEN t.path = '' THEN e.key ELSE t.path || '.' || e.key END, CASE WHEN json_type(t.j) = 'OBJECT' THEN t.pos WHEN t.pos = '' THEN e.key ELSE t.pos || '.' || e.key END, e.value, json_type(t.j) = 'ARRAY' FROM (SELECT * FROM tree WHERE json_type(j) IN ('OBJECT', 'ARRAY')) t, json_each(t.j) e)"""
_LEVELS = f"""{NODES_SQL},
up AS (SELECT u, p FROM nodes WHERE p IN (SELECT u FROM nodes) UNION SELECT up.u, n.p FROM up JOIN nodes n ON n.u = up.p AND n.p IN (SELECT u FROM nodes)),
down AS (SELECT u, u AS root, 0 AS depth, CASE WHEN p = chr(0) THEN 'tree' ELSE 'orphan' END AS state FROM nodes WHERE p NOT IN (SELECT u FROM nodes)
  UNION ALL SELECT n.u, d.root, d.depth + 1, d.state FROM down d JOIN nodes n ON n.p = d.u),
below AS (SELECT p AS u, count(*) AS n FROM up GROUP BY p)"""
_LEVELS_SELECT = """SELECT n.u AS uuid, coalesce(d.state, CASE WHEN c.u IS NOT NULL THEN 'circle' ELSE 'below_circle' END) AS state, d.root, cast(d.depth AS BIGINT) AS depth, CASE WHEN d.u IS NOT NULL THEN coalesce(b.n, 0) END AS descendants
FROM nodes n LEFT JOIN down d ON d.u = n.u LEFT JOIN (SELECT DISTINCT u FROM up WHERE u = p) c ON c.u = n.u LEFT JOIN below b ON b.u = n.u"""
_TARGETS = ", ".join(f"('{t.name}', '{t.type}', {i}, '{p}')" for t in TARGETS for i, p in enumerate(t.paths))
# Of each column's paths (its own, then those of the alias groups that hold one of them) the first whose value fits.
_TYPED = f"""whole AS ({_WHOLE}),
tree AS (SELECT rec_id, '' AS path, j FROM whole UNION ALL SELECT rec_id, CASE WHEN t.path = '' THEN e.key ELSE t.path || '.' || e.key END, e.value FROM (SELECT * FROM tree WHERE json_type(j) = 'OBJECT') t, json_each(t.j) e),
target(name, type, i, path) AS (VALUES {_TARGETS}), alias AS (SELECT DISTINCT canonical_path AS c, spelling_path AS s FROM field_alias), grp AS (SELECT DISTINCT c, c AS path, 0 AS k FROM alias UNION SELECT c, s, 1 FROM alias),
spelled AS (SELECT name, type, path, row_number() OVER (PARTITION BY name ORDER BY o) AS place FROM (SELECT name, type, path, min(o) AS o FROM (SELECT name, type, path, printf('0%03d', i) AS o FROM target UNION ALL SELECT t.name, t.type, g.path, printf('1%03d', t.i) || h.c || chr(0) || cast(g.k AS VARCHAR) || g.path FROM target t JOIN grp h ON h.path = t.path JOIN grp g ON g.c = h.c) GROUP BY ALL)),
fits AS (SELECT t.rec_id, s.name, arg_min(v, place) AS v FROM (SELECT rec_id, path, json_type(j) AS k, j->>'$' AS v FROM tree WHERE path <> '') t JOIN spelled s ON s.path = t.path WHERE k <> 'NULL' AND CASE type WHEN 'string' THEN k NOT IN ('OBJECT', 'ARRAY') ELSE k NOT IN ('OBJECT', 'ARRAY', 'BOOLEAN') AND regexp_full_match(v, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?') AND try_cast(v AS DECIMAL(38, 10)) % 1 = 0 AND try_cast(v AS DECIMAL(38, 10)) BETWEEN -9223372036854775808 AND 9223372036854775807 END GROUP BY ALL)"""
_FLAT = f"""whole AS ({_WHOLE}),
tree AS (SELECT rec_id, '' AS path, '' AS pos, j, false AS item, cast(NULL AS VARCHAR) AS array_path, cast(NULL AS VARCHAR) AS item_pos, '' AS field, '' AS value_pos FROM whole UNION ALL
  SELECT rec_id, CASE WHEN json_type(t.j) = 'ARRAY' THEN t.path || '[]' WHEN t.path = '' THEN e.key ELSE t.path || '.' || e.key END, CASE WHEN json_type(t.j) = 'OBJECT' THEN t.pos WHEN t.pos = '' THEN e.key ELSE t.pos || '.' || e.key END, e.value, json_type(t.j) = 'ARRAY',
    CASE WHEN json_type(t.j) = 'ARRAY' THEN array_path WHEN t.item THEN t.path[:-3] END, CASE WHEN json_type(t.j) = 'ARRAY' THEN item_pos WHEN t.item THEN t.pos END, CASE WHEN json_type(t.j) = 'ARRAY' THEN field || '[]' ELSE e.key END, CASE WHEN json_type(t.j) = 'OBJECT' THEN '' WHEN value_pos = '' THEN e.key ELSE value_pos || '.' || e.key END
  FROM (SELECT * FROM tree WHERE json_type(j) IN ('OBJECT', 'ARRAY')) t, json_each(t.j) e)"""
SQL: dict[str, str] = {
    "p5_typed": "WITH RECURSIVE " + _TYPED + " SELECT r.rec_id, r.feed_id, r.feed_kind, r.file_no, r.line_no, w.rec_id IS NOT NULL AS _whole, " + ", ".join(f"cast(max(CASE WHEN f.name = '{t.name}' THEN f.v END) AS {'BIGINT' if t.type == 'long' else 'VARCHAR'}) AS {t.name}" for t in TARGETS) + " FROM raw_record r LEFT JOIN whole w ON w.rec_id = r.rec_id LEFT JOIN fits f ON f.rec_id = r.rec_id GROUP BY ALL",
    "p6_flat": f"WITH RECURSIVE {_FLAT} SELECT rec_id, array_path, item_pos, field, value_pos, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'empty' ELSE 'number' END AS type, CASE WHEN json_type(j) NOT IN ('NULL', 'ARRAY') THEN j->>'$' END AS value FROM tree WHERE array_path IS NOT NULL AND json_type(j) <> 'OBJECT' AND NOT (json_type(j) = 'ARRAY' AND json_array_length(j) > 0)",
    "p3_found": f"WITH {_EVENTS} SELECT 'transcript_line' AS table_name, line_id AS row_id FROM lines WHERE n > 1 UNION ALL SELECT 'usage_event', id FROM events WHERE n > 1",
    "p4_rolling": f"WITH {_ROLLING} SELECT * FROM rolling",
    "p4_found": f"WITH {_ROLLING} SELECT model, strftime(day, '%Y-%m-%d') AS usage_day FROM rolling WHERE 2 * tokens_7 > tokens_30",
    "p5_found": f"WITH RECURSIVE {_FIELDS} SELECT feed_id, file_no, field_path, change FROM told",
    "p5_changes": f"WITH RECURSIVE {_FIELDS} SELECT feed_id, file_no, field_path, change, {_KIND_NAMES('was')} AS was, {_KIND_NAMES('now')} AS now FROM told",
    "p6_found": f"WITH RECURSIVE {_ITEMS} SELECT rec_id, path[:-3] AS array_path, pos AS item_pos FROM tree WHERE item AND json_type(j) = 'OBJECT'",
    "p7_found": f"WITH {_STAMPED} {_INSTANTS} SELECT table_name, row_id FROM told WHERE status = 'unresolved'",
    "p7_instants": f"WITH {_STAMPED} {_INSTANTS} SELECT table_name, row_id, status AS stamp_status, make_timestamp(micros) AS instant, strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%f') || rest || 'Z' AS instant_text FROM told",
    "p1_found": f"""WITH RECURSIVE {NODES_SQL}, up AS (SELECT u, p FROM nodes WHERE p IN (SELECT u FROM nodes) UNION SELECT up.u, n.p FROM up JOIN nodes n ON n.u = up.p)
SELECT DISTINCT u AS uuid FROM up WHERE u = p""",
    "p1_levels": f"WITH RECURSIVE {_LEVELS} {_LEVELS_SELECT}",
    "p1_lines": f"""WITH RECURSIVE {_LEVELS}, levels AS ({_LEVELS_SELECT}) SELECT t.line_id, t.uuid, coalesce(l.state, 'no_uuid') AS state, l.root, l.depth, l.descendants FROM transcript_line t LEFT JOIN levels l ON l.uuid = t.uuid""",
    "p3_unique_messages": """SELECT line_id, batch_no, uuid, request_id, message.id AS message_id, session_id FROM (
  SELECT *, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY t DESC, line_id) END AS n FROM (
    SELECT *, CASE WHEN request_id <> '' THEN '0:' || request_id WHEN message.id <> '' THEN '1:' || message.id WHEN uuid <> '' THEN '2:' || uuid END AS k,
      coalesce(message.usage.input_tokens, 0) + coalesce(message.usage.output_tokens, 0) + coalesce(message.usage.cache_read_input_tokens, 0) + coalesce(message.usage.cache_creation_input_tokens, 0) AS t FROM transcript_line)) WHERE n = 1""",
}
