"""SQLite stores as a Python data source, read only, with a pushed lower bound, and the rows of the stores we know."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

from ..functions.scalars import classify, epoch_seconds, project_path, rfc3339_seconds
from .lines import S, as_usage, count_of, number_of, struct, used

_TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=0.25)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def columns_of(path: str, name: str) -> list[tuple[str, str]]:
    """(column, declared type) of a table of a store; empty if it hasn't that table."""
    con = connect(path)
    try:
        return [(r[1], (r[2] or "").upper()) for r in con.execute(f'PRAGMA table_info("{name}")')]
    finally:
        con.close()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class StoreReader(DataSourceReader):
    """Reads a table in ranges of rowid, one a task; a >= filter on one column goes into the statement."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.names
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.path, self.name, self.tasks = options["path"], options["table"], int(options.get("tasks", "4"))
        self.bounds: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and len(f.attribute) == 1 and f.attribute[0] in self.names and isinstance(f.value, (int, float, str)):
                self.bounds.append((f.attribute[0], f.value))
            yield f  # Spark checks again: a store's types are loose

    def partitions(self):
        con = connect(self.path)
        try:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()
        finally:
            con.close()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.tasks))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        there = {c for c, _ in columns_of(self.path, self.name)}
        chosen = ", ".join(f'"{c}"' if c in there else f'NULL AS "{c}"' for c in self.names)
        # A bound is only pushed where it compares as it does in Spark: a number with numbers, a text with texts.
        asked = "".join(f" AND (typeof(\"{c}\") IN ({'\'text\'' if isinstance(v, str) else '\'integer\', \'real\''}) AND \"{c}\" >= ?)" for c, v in self.bounds if c in there)
        con = connect(self.path)
        try:
            for row in con.execute(f'SELECT {chosen} FROM "{self.name}" WHERE rowid >= ? AND rowid < ?{asked}', (partition.low, partition.high, *(v for c, v in self.bounds if c in there))):
                yield tuple(self._fit(v, k) for v, k in zip(row, self.kinds))
        finally:
            con.close()

    @staticmethod
    def _fit(value, kind: str):
        if value is None:
            return None
        if kind == "string":
            return value if isinstance(value, str) else str(value)
        if kind == "long":
            return value if isinstance(value, int) else None
        return float(value) if isinstance(value, (int, float)) else None


class SqliteStore(DataSource):
    """spark.read.format("sqlite_store").option("path", ...).option("table", ...).load(); give a schema to probe columns by name."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def schema(self) -> T.StructType:
        found = columns_of(self.options["path"], self.options["table"])
        return T.StructType([T.StructField(c, _TYPES.get(t, T.StringType())) for c, t in found])

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(schema, self.options)


def read_store(spark: SparkSession, path: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table of a store. Columns of the schema that the table lacks are null."""
    spark.dataSource.register(SqliteStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers that push filters need it
    reader = spark.read.format("sqlite_store").option("path", path).option("table", name)
    return (reader.schema(schema) if schema else reader).load()


_D = T.DoubleType()
_TOKENS = struct(**{n: _D for n in ("input", "inputTokens", "output", "outputTokens", "reasoning", "reasoningTokens")}, cache=struct(**{n: _D for n in ("read", "readTokens", "write", "writeTokens")}))
_INFO = struct(role=S, providerID=S, provider_id=S, modelID=S, model_id=S, id=S, messageID=S, message_id=S, sessionID=S, session_id=S, tokens=_TOKENS, cost=_D, cost_source=S)
MESSAGE = T.StructType([T.StructField("info", _INFO), *_INFO.fields])
# What a store says of a cost's source, and the status it then has.
COST_SOURCES = {"provider_reported": "reported", "calculated": "calculated", "estimated": "estimated"}


def message_usage(messages: DataFrame) -> DataFrame:
    """Assistant messages of a store with JSON in `data` and `time_created`; those without counts are kept as incomplete.

    A cost must be finite and not negative. Where it stands follows from the category and from what the store says of its source: local
    and free models are that; a named source stands; a paid model's cost without one was calculated; a cloud model without
    positive cost is on quota, and a zero there is no cost; all else is unknown.
    """
    m = messages.select("time_created", F.from_json("data", MESSAGE).alias("m"), F.monotonically_increasing_id().alias("seq")).where("m is not null")
    m = m.select("seq", "time_created", F.coalesce("m.info", F.struct(*(F.col(f"m.{f.name}") for f in _INFO.fields))).alias("m"))
    rows = m.where("m.role = 'assistant'")
    provider, model = F.coalesce("m.providerID", "m.provider_id", F.lit("unknown")), F.coalesce("m.modelID", "m.model_id", F.lit("unknown"))
    cost = F.when((F.col("m.cost") >= 0) & (F.col("m.cost") < float("inf")), F.col("m.cost"))
    some = F.coalesce(cost > 0, F.lit(False))
    named = classify(provider, model)
    category = F.when((named == "UNKNOWN") & some, "PAID").otherwise(named)
    source = F.when(cost.isNotNull(), F.create_map(*(F.lit(x) for pair in COST_SOURCES.items() for x in pair))[F.col("m.cost_source")])
    status = (
        F.when(category == "LOCAL", "local").when(category == "FREE", "free").when(source.isNotNull(), source).when((category == "PAID") & cost.isNotNull(), "calculated")
        .when((category == "CLOUD") & ~some, "quota").otherwise("unavailable")
    )
    asked, given = count_of("m.tokens.input", "m.tokens.inputTokens"), count_of("m.tokens.output", "m.tokens.outputTokens")
    return as_usage(
        rows, seq=F.col("seq"), event_id=F.coalesce("m.id", "m.messageID", "m.message_id"), provider=provider, model=model, category=category, input=F.coalesce(asked, F.lit(0)), output=F.coalesce(given, F.lit(0)), reasoning=number_of("m.tokens.reasoning", "m.tokens.reasoningTokens"),
        cache_read=number_of("m.tokens.cache.read", "m.tokens.cache.readTokens"), cache_write=number_of("m.tokens.cache.write", "m.tokens.cache.writeTokens"), cost=F.when(status != "quota", cost), cost_status=status, created=F.coalesce(epoch_seconds(F.col("time_created")), F.lit(0)),
        session_id=F.coalesce("m.sessionID", "m.session_id"), incomplete=asked.isNull() | given.isNull(),
    )


EVENTS = "id long, session_id string, model string, input_tokens double, output_tokens double, cache_read_tokens double, cache_write_tokens double, reasoning_tokens double, turn_index long, created_at string"
SESSIONS = "id string, cwd string, repository string"


def event_usage(events: DataFrame, sessions: DataFrame, billing: str = "per_token") -> DataFrame:
    """Requests of a store of usage events, left-joined to its sessions; inclusive counts are made disjoint.

    Identity is the session and the row's own key; without key the turn, the time and the counts. Rows without session have none.
    No cost is claimed: what a plan makes of it is decided when estimates are applied.
    """
    s = sessions.select(F.col("id").alias("_sid"), "cwd", "repository")
    rows = events.withColumn("seq", F.monotonically_increasing_id()).join(s, F.col("session_id") == F.col("_sid"), "left")
    asked, given = count_of("input_tokens"), count_of("output_tokens")
    read, written, reasoning = number_of("cache_read_tokens"), number_of("cache_write_tokens"), number_of("reasoning_tokens")
    at = F.coalesce(rfc3339_seconds(F.col("created_at")), F.when(F.col("created_at").rlike(r"^\d+$"), epoch_seconds(F.col("created_at").try_cast("long"))), F.lit(0))
    model = F.coalesce("model", F.lit("unknown"))
    rows = rows.withColumns({"_in": F.greatest(F.coalesce(asked, F.lit(0)) - read - written, F.lit(0)), "_out": F.greatest(F.coalesce(given, F.lit(0)) - reasoning, F.lit(0)), "_at": at})
    content = F.concat_ws(":", F.col("_at").cast("string"), F.col("_in").cast("string"), F.col("_out").cast("string"))
    id_ = F.when(F.col("id").isNotNull(), F.col("id").cast("string")).when(F.col("turn_index").isNotNull(), F.concat(F.lit("t"), F.col("turn_index").cast("string"), F.lit(":"), content)).otherwise(content)
    out = as_usage(
        rows, seq=F.col("seq"), event_id=F.when(F.col("session_id").isNotNull(), F.concat_ws(":", F.lit("copilot"), "session_id", id_)), provider=F.lit("copilot"), model=model, category=classify(F.lit("copilot"), model), billing=F.lit(billing), input=F.col("_in"), output=F.col("_out"),
        reasoning=reasoning, cache_read=read, cache_write=written, created=F.col("_at"), session_id=F.col("session_id"), project=F.coalesce(project_path(F.col("cwd")), "repository"), incomplete=asked.isNull() | given.isNull(),
    )
    return out.where(used())


def store_of(paths: list[str], tables: set[str]) -> str | None:
    """The first store that has all the tables: chosen by its schema, not its name."""
    for path in paths:
        try:
            if all(columns_of(path, t) for t in tables):
                return path
        except sqlite3.Error:
            continue
    return None
