"""The event journal: Parquet tables with strict, idempotent appends, pruning and a schema version.

A journal has one writer at a time, guarded by a lock file; tables are replaced by renaming a finished copy.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import count_or_null, epoch_seconds
from ..schema import CATEGORIES, COST_STATUSES, ROUTING_SCHEMA, TOKEN_BUCKETS, USAGE_SCHEMA, known_label
from .supersede import insert_or_ignore

VERSION = 3
#: The closed key set of a recorded usage event.
EVENT_KEYS = [
    "event_id", "provider", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "session_id", "project", "created", "cost", "cost_status", "billing",
]
TALLY_SCHEMA = "day long, agent string, reason string, runs long"
LEAST_KEPT_DAYS = 31


class Refused(ValueError):
    """A batch that breaks a rule; none of it was written."""


def validate_events(raw: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(usage rows, errors) of recorded events given as JSON lines in `line`.

    Unknown keys, missing names or counts, counts that aren't whole, an event with neither id nor time, an asserted
    status other than reported, a bad cost, and a cost on a subscription are errors; errors names line and reason.
    """
    doc = raw.select("line", F.try_parse_json("line").alias("v")).withColumn("m", F.from_json("line", "map<string,string>"))
    num = lambda k: F.try_variant_get("v", f"$.{k}", "double")
    is_number = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT).*"), F.lit(False))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    has = lambda k: F.coalesce(F.map_contains_key("m", F.lit(k)), F.lit(False)) & F.col("m")[k].isNotNull()
    count = lambda k: F.when(is_number(k), count_or_null(num(k)))
    optional = ["reasoning_tokens", "cache_read_tokens", "cache_write_tokens"]
    bad_cost = has("cost") & (~is_number("cost") | ~F.coalesce((num("cost") >= 0) & (num("cost") < float("inf")), F.lit(False)))
    reason = (
        F.when(F.col("v").isNull() | F.col("m").isNull(), "not a JSON object")
        .when(F.size(F.array_except(F.map_keys("m"), F.array(*(F.lit(k) for k in EVENT_KEYS)))) > 0, "unknown key")
        .when(~has("provider") | ~has("model"), "provider and model are required")
        .when(count("input_tokens").isNull() | count("output_tokens").isNull(), "input_tokens and output_tokens must be counts")
        .when(reduce(lambda a, b: a | b, (has(k) & count(k).isNull() for k in optional)), "a count isn't whole")
        .when(~has("event_id") & ~has("created"), "event_id or created is required")
        .when(has("cost_status") & (text("cost_status") != "reported"), "only a reported cost may be asserted")
        .when(has("billing") & ~text("billing").isin("subscription", "per_token"), "unknown billing")
        .when(bad_cost, "bad cost").when(has("cost") & (text("billing") == "subscription"), "a subscription has no cost per event")
    )
    judged = doc.withColumn("reason", reason)
    good = judged.where("reason is null")
    status = F.when(num("cost").isNotNull(), "reported").when(text("billing") == "subscription", "quota").otherwise("unavailable")
    zero = lambda k: F.coalesce(count(k), F.lit(0))
    values = {
        "seq": F.monotonically_increasing_id(), "event_id": text("event_id"), "provider": text("provider"), "model": text("model"), "category": F.lit("UNKNOWN"), "cost_status": status, "billing": F.coalesce(text("billing"), F.lit("per_token")), "requests": F.lit(1),
        "input": zero("input_tokens"), "output": zero("output_tokens"), "reasoning": zero("reasoning_tokens"), "cache_read": zero("cache_read_tokens"), "cache_write": zero("cache_write_tokens"), "cost": num("cost"), "api_equivalent_cost": F.lit(None),
        "created": F.coalesce(epoch_seconds(num("created")), F.lit(now)), "session_id": text("session_id"), "project": text("project"), "incomplete": F.lit(False),
    }
    rows = good.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA))
    named = F.coalesce("event_id", F.concat_ws(":", F.lit("shape"), F.xxhash64("provider", "model", "input", "output", "created").cast("string")))
    return rows.withColumn("event_id", named), judged.where("reason is not null").select("line", "reason")


def last_finished(documents: DataFrame, schema, done: Column, pos: str = "pos") -> DataFrame:
    """One row: the last document for which done holds, as a struct `d`."""
    parsed = documents.select(pos, F.from_json("line", schema).alias("d")).where(done)
    return parsed.agg(F.max_by("d", pos).alias("d")).where("d is not null")


def validate_routing(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routing rows, errors): task, agent and model are required, counters whole and not negative; a cost means reported."""
    counters = ["retries", "escalations", "review_defects"]
    bad = F.when(F.col("task").isNull() | F.col("agent").isNull() | F.col("model").isNull(), "task, agent and model are required").when((F.col("cost") < 0) | F.isnan("cost"), "bad cost")
    for c in counters:
        bad = bad.when(F.col(c) < 0, f"{c} is negative")
    judged = events.withColumn("reason", bad)
    defaults = {"phase": F.lit("implement"), "provider": F.lit("unknown"), "category": F.lit("UNKNOWN"), "requests": F.lit(1), "tokens": F.lit(0), "created": F.lit(0)}
    status = F.when(F.col("cost").isNotNull(), "reported").otherwise(F.coalesce("cost_status", F.lit("unavailable")))
    value = lambda n: status if n == "cost_status" else F.coalesce(n, defaults[n]) if n in defaults else F.col(n)
    return judged.where("reason is null").select(*(value(f.name).cast(f.dataType).alias(f.name) for f in ROUTING_SCHEMA)), judged.where("reason is not null")


class Journal:
    """A folder of Parquet tables: usage, routing and tally."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 5.0):
        self.spark, self.path, self.wait = spark, path, wait
        os.makedirs(path, exist_ok=True)
        self.schemas = {"usage": USAGE_SCHEMA, "routing": ROUTING_SCHEMA, "tally": TALLY_SCHEMA}
        if any(os.path.exists(f"{self._folder(t)}.{x}") for t in self.schemas for x in ("old", "new")):
            with self._lock():
                self._recover()
        version = self._version()
        if version > VERSION:
            raise Refused(f"the journal has version {version}, newer than {VERSION}")

    def _version(self) -> int:
        try:
            with open(f"{self.path}/version.json") as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return VERSION

    @contextmanager
    def _lock(self):
        lock, end = f"{self.path}/lock", time.time() + self.wait
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                if time.time() > end:
                    raise Refused("another writer holds the journal") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            os.unlink(lock)

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def read(self, table: str, after: int | None = None) -> DataFrame:
        """A table; columns that older files lack are null. With after, the usage rows whose seq is larger."""
        if not os.path.exists(self._folder(table)):
            return self.spark.createDataFrame([], self.schemas[table])
        df = self.spark.read.option("mergeSchema", "true").schema(self.schemas[table]).parquet(self._folder(table))
        return df if after is None else df.where(F.col("seq") > after)

    def scan_usage(self, after: int | None = None) -> DataFrame:
        """The usage rows (with after, those behind that cursor; a cursor beyond the newest row starts anew), labels checked.

        A plan's event is stored as quota. Without cost it is handed on as an open row of a subscription, which is what the path
        that decides on estimates expects. Counts below zero are damage and read as 0; labels outside the vocabularies as the pessimistic one.
        """
        rows = self.read("usage")
        if after is not None:
            top = rows.agg(F.max("seq")).first()[0]
            rows = rows if top is None or top < after else rows.where(F.col("seq") > after)
        return scanned(rows)

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._folder(table))
        with open(f"{self.path}/version.json.new", "w") as f:
            json.dump({"version": VERSION}, f)
        os.chmod(f"{self.path}/version.json.new", 0o600)
        os.replace(f"{self.path}/version.json.new", f"{self.path}/version.json")

    def record_usage(self, rows: DataFrame) -> int:
        """Append the rows whose event_id isn't there yet; the number of rows written."""
        with self._lock():
            held = self.read("usage")
            top = held.agg(F.max("seq")).first()[0] or 0
            fresh = insert_or_ignore(held, rows).select(*(f.name for f in USAGE_SCHEMA)).withColumn("seq", F.col("seq") + top + 1).cache()
            try:
                n = fresh.count()
                if n:
                    self._append("usage", fresh)
            finally:
                fresh.unpersist()
            return n

    def record_events(self, raw: DataFrame, now: int) -> int:
        """Append recorded events, all or none: an error in one refuses the batch."""
        rows, errors = validate_events(raw, now)
        first = errors.limit(1).collect()
        if first:
            raise Refused(f"{first[0]['reason']}: {first[0]['line'][:80]}")
        return self.record_usage(rows)

    def record_routing(self, events: DataFrame) -> int:
        rows, errors = validate_routing(events)
        if first := errors.limit(1).collect():
            raise Refused(first[0]["reason"])
        with self._lock():
            fresh = rows.join(self.read("routing").select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])
            n = fresh.count()
            if n:
                self._append("routing", fresh.select(*(f.name for f in ROUTING_SCHEMA)))
            return n

    def tally(self, agent: str, reason: str, at: int) -> None:
        """Count one withheld run on its UTC day. Counts are appended and summed when read."""
        with self._lock():
            self._append("tally", self.spark.createDataFrame([(at - at % 86400, agent, reason, 1)], TALLY_SCHEMA))

    def tallies(self) -> DataFrame:
        return self.read("tally").groupBy("day", "agent", "reason").agg(F.sum("runs").alias("runs")).orderBy("day", "agent", "reason")

    def prune(self, cutoff: int, now: int, emitter: str = "claude-code") -> dict[str, int]:
        """Drop dated rows before cutoff; kept are undated rows, the newest usage row, and an emitter's routing rows of sessions with newer ones.

        Old routing rows of other emitters, and those without id, go. Tallies go by whole days, uncounted.
        The cutoff can't be in the current month or the last LEAST_KEPT_DAYS days.
        """
        month = int(datetime.fromtimestamp(now, timezone.utc).replace(day=1, hour=0, minute=0, second=0, microsecond=0).timestamp())
        if cutoff > min(month, now - LEAST_KEPT_DAYS * 86400):
            raise Refused("the cutoff is too recent")
        gone = {}
        with self._lock():
            for table in ("usage", "routing", "tally"):
                rows = self.read(table)
                if table == "tally":
                    kept = rows.where(F.col("day") >= cutoff - 86399)
                elif table == "usage":
                    top = rows.agg(F.max("seq")).first()[0]
                    kept = rows.where(~is_old(cutoff) | (F.col("seq") == (top if top is not None else -1)))
                else:
                    kept = kept_routing(rows, cutoff, emitter)
                before, after = rows.count(), kept.count()
                if table != "tally":
                    gone[table] = before - after
                if before != after:
                    self._replace(table, kept)
        return gone

    def _replace(self, table: str, rows: DataFrame) -> None:
        """Put rows in a table's place. A crash in between leaves the old or the new table behind, which _recover() puts back."""
        new, old = f"{self._folder(table)}.new", f"{self._folder(table)}.old"
        rows.write.mode("overwrite").parquet(new)
        os.rename(self._folder(table), old)
        os.rename(new, self._folder(table))
        shutil.rmtree(old)
        self.spark.catalog.refreshByPath(self._folder(table))

    def _recover(self) -> None:
        """After a crash between the two renames: the old table is whole and comes back."""
        for table in self.schemas:
            folder = self._folder(table)
            if not os.path.exists(folder) and os.path.exists(f"{folder}.old"):
                os.rename(f"{folder}.old", folder)
            for rest in (f"{folder}.old", f"{folder}.new"):
                if os.path.exists(rest):
                    shutil.rmtree(rest)


def scanned(rows: DataFrame) -> DataFrame:
    """Stored usage rows as a source hands them on; see Journal.scan_usage()."""
    plan = F.coalesce(F.col("billing") == "subscription", F.lit(False))
    status = known_label(F.col("cost_status"), COST_STATUSES, "unavailable")
    return rows.withColumns({
        "category": known_label(F.col("category"), CATEGORIES, "UNKNOWN"), "cost_status": F.when((status == "quota") & plan & F.col("cost").isNull(), "unavailable").otherwise(status),
        "billing": F.when(plan, "subscription").otherwise("per_token"), **{c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("requests", *TOKEN_BUCKETS)}, "incomplete": F.lit(False),
    })


def is_old(cutoff: int) -> Column:
    """Dated before cutoff."""
    return (F.col("created") > 0) & (F.col("created") < cutoff)


def kept_routing(rows: DataFrame, cutoff: int, emitter: str) -> DataFrame:
    """Routing rows that a prune keeps: those that aren't old, and an emitter's of sessions that also have newer ones.

    An id is `<emitter>:<session>:...`; without a second colon all of the emitter's ids are one session.
    """
    mark = emitter + ":"
    rest = F.substring(F.col("event_id"), len(mark) + 1, 2**30)
    session = F.when(F.col("event_id").startswith(mark), F.substring(rest, F.lit(1), F.locate(":", rest)))
    keyed = rows.withColumn("_s", session)
    fresh, old = keyed.where(~is_old(cutoff)), keyed.where(is_old(cutoff))
    live = fresh.where("created > 0 and _s is not null").select("_s").distinct()
    return fresh.unionByName(old.join(live, "_s", "left_semi").select(fresh.columns)).drop("_s")
