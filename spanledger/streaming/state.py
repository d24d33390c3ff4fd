"""Stateful merging and alerts on streams. Late rows are always accepted: no watermark drops any."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.supersede import identity
from ..schema import USAGE_SCHEMA, total_tokens


def live_usage(rows: DataFrame) -> DataFrame:
    """A stream of usage rows superseded by identity: key, position (first seq) and the reading with most tokens.

    Run it in update mode. The state holds one row an identity and is never evicted, since a larger reading may come
    at any time; write the updates to a keyed table and compact that.
    """
    packed = F.struct(*(f.name for f in USAGE_SCHEMA))
    best = F.max_by(packed, F.struct(total_tokens().alias("t"), (-F.col("seq")).alias("n")))
    return rows.withColumn("key", identity()).groupBy("key").agg(F.min("seq").alias("position"), best.alias("row"))


def latest_state(updates: DataFrame) -> DataFrame:
    """The usage rows of a table of appended updates (batch, key, position, row): the newest of each key."""
    newest = updates.groupBy("key").agg(F.max_by("row", "batch").alias("row"), F.min("position").alias("position"))
    return newest.select(*(F.col("position").alias("seq") if f.name == "seq" else F.col(f"row.{f.name}").alias(f.name) for f in USAGE_SCHEMA))


def write_state(path: str):
    """A foreachBatch function that appends updates with their batch. A replayed batch changes nothing that is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return write


ALERT = "scope string, period string, level string, pct double, at long"


def quiet_alerts(alerts: DataFrame, hours: float = 1.0) -> DataFrame:
    """Alerts without those that repeat their budget's last level within the given hours; `ok` is never passed on.

    alerts: scope, period, level, pct, at (epoch seconds).
    """
    seconds = int(hours * 3600)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, since = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for row in rows.itertuples(index=False):
            if row.level != "ok" and (row.level != level or row.at - since >= seconds):
                out.append(row)
                level, since = row.level, int(row.at)
            elif row.level == "ok":
                level, since = None, 0
        state.update((level, since))
        yield pd.DataFrame(out, columns=rows.columns)

    return alerts.groupBy("scope", "period").applyInPandasWithState(keep, ALERT, "level string, since long", "append", GroupStateTimeout.NoTimeout)
